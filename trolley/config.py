"""Run parameters of the market-basket job, as one immutable value."""

from __future__ import annotations

from dataclasses import dataclass, replace

REGISTER_CHOICES = ("all", "shop", "espresso", "shop1", "shop2")


@dataclass(frozen=True)
class BasketConfig:
    # Map items to taxonomy categories before building baskets.
    taxo: bool = True
    # Naive Bayes variant for recommendations: True = "subset" as written
    # (candidates without any rule stay in the list with score 0).
    subset: bool = True
    # Keep only distinct baskets.
    unique: bool = False
    # Register filter: all | shop (not 3) | espresso (3) | shop1 | shop2.
    register: str = "all"
    # Inclusive bounds on the number of distinct items in a basket.
    cartsize_min: int = 2
    cartsize_max: int | None = 6
    # Length of each recommendation list.
    topn: int = 5
    # Additive smoothing constant (0 = raw relative frequency).
    smooth_k: float = 0.01
    # Strict thresholds, as fractions of the basket count.
    support_item: float = 0.01
    support_pair: float = 0.0
    confidence_threshold: float = 0.0
    lift_threshold: float = 0.0
    # Open interval on the receipt timestamp, e.g. ("1996-01-01", "2000-01-01").
    timerange: tuple[str, str] | None = None
    # Item removed from every basket before sizing (off by default).
    drop_item: str | None = None
    # basket_subsets enumerates baskets of at most this many items (the whole-cart rule).
    subset_len_max: int = 6
    # Category given to items missing from the taxonomy.
    unknown_category: str = "0000"
    # Longest partner list kept per item in the interaction report.
    interaction_list_max: int = 100
    # Rows shown by the table preview.
    preview_rows: int = 200

    def __post_init__(self) -> None:
        if self.register not in REGISTER_CHOICES:
            raise ValueError(f"register must be one of {REGISTER_CHOICES}")
        if self.cartsize_min < 1:
            raise ValueError("cartsize_min must be at least 1")
        if self.cartsize_max is not None and self.cartsize_max < self.cartsize_min:
            raise ValueError("cartsize_max must be >= cartsize_min")
        if self.topn < 1:
            raise ValueError("topn must be positive")
        if self.smooth_k < 0:
            raise ValueError("smooth_k must be >= 0")

    def with_(self, **changes) -> "BasketConfig":
        return replace(self, **changes)


DEFAULT = BasketConfig()
