"""trolley — market-basket analytics as Spark DataFrame plans."""

from .config import DEFAULT, BasketConfig

__all__ = ["BasketConfig", "DEFAULT"]
