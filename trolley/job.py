"""The job on real tables: reads and checks them, runs, writes the result files.

    spark-submit --py-files trolley.zip -m trolley.job --lines ... --headers ... --catalog ... --taxonomy ... --out ...

Every field of BasketConfig is an option too (``--support-item 0.005``,
``--no-taxo``, ``--register shop``). With ``--resume STAGE`` the run restarts from
the files of an earlier one under ``--out``.
"""

from __future__ import annotations

import argparse
import dataclasses

from pyspark.sql import SparkSession

from .config import REGISTER_CHOICES, BasketConfig
from .plans import results
from .plans.market_basket import BasketRun
from .session import build_session
from .sources.tables import read_tables

#: Options that are not plain numbers.
_SPECIAL = {"register": {"choices": REGISTER_CHOICES}, "timerange": {"nargs": 2, "metavar": ("FROM", "TO")}, "drop_item": {}, "unknown_category": {}}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="trolley.job", description=__doc__.split("\n")[0])
    for name in ("lines", "headers", "catalog", "taxonomy", "out"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--rejects", help="where rows that break the contract are written (default: OUT/rejects)")
    p.add_argument("--resume", choices=results.STAGES)
    for f in dataclasses.fields(BasketConfig):
        option = "--" + f.name.replace("_", "-")
        if isinstance(f.default, bool):
            p.add_argument(option, action=argparse.BooleanOptionalAction, default=f.default)
        elif f.name == "cartsize_max":
            p.add_argument(option, type=lambda s: None if s == "none" else int(s), default=f.default, metavar="N|none")
        elif f.name in _SPECIAL:
            p.add_argument(option, default=f.default, **_SPECIAL[f.name])
        else:
            p.add_argument(option, type=type(f.default), default=f.default)
    return p


def run_job(spark: SparkSession, options: argparse.Namespace) -> dict[str, int]:
    """Rows of each result file written under options.out."""
    tables, rejects = read_tables(spark, options.lines, options.headers, options.catalog, options.taxonomy)
    rejects.write.mode("overwrite").parquet(options.rejects or f"{options.out}/rejects")
    if options.resume:
        run, bad = results.resume(spark, options.out, tables, options.resume)
        bad.write.mode("append").parquet(options.rejects or f"{options.out}/rejects")
        return results.export(run, f"{options.out}/resumed")
    values = {f.name: getattr(options, f.name) for f in dataclasses.fields(BasketConfig)}
    if values["timerange"]:
        values["timerange"] = tuple(values["timerange"])
    return results.export(BasketRun(spark, tables, BasketConfig(**values)), options.out)


def main(argv: list[str] | None = None) -> None:
    options = parser().parse_args(argv)
    spark = build_session(app_name="trolley-job")
    for name, rows in run_job(spark, options).items():
        print(f"{results.FILES[name]}\t{rows}")
    spark.stop()


if __name__ == "__main__":
    main()
