"""Command line entry points for a batch rebuild.

    python -m souk inspect RAW_CSV_DIR                 profile the nine CSVs
    python -m souk load    RAW_CSV_DIR RAW_DIR [--widen]  CSV -> raw Parquet, compared with the source
    python -m souk views   RAW_DIR                     register the 20 views, list them
    python -m souk export  RAW_DIR MART_DIR [--staging DIR] [--jobs N]
                                                       build and export the 12 marts

Folders may be on any file system Spark can write (hdfs://, s3a://, ...).
Reports are small (one row per table, column or mart) and are printed.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from souk.schemas import RAW_TABLES
from souk.sources.publish import read_all_published


def _raw_parquet(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return read_all_published(spark, folder, RAW_TABLES)


def run(argv: list[str], spark: SparkSession | None = None) -> dict[str, DataFrame]:
    """Run one command; returns the report DataFrames it printed."""
    p = argparse.ArgumentParser(prog="souk")
    sub = p.add_subparsers(dest="cmd", required=True)
    a = sub.add_parser("inspect")
    a.add_argument("raw_csv_dir")
    a = sub.add_parser("load")
    a.add_argument("raw_csv_dir")
    a.add_argument("raw_dir")
    a.add_argument("--widen", action="store_true", help="doubles where whole-number columns hold other numbers")
    a = sub.add_parser("views")
    a.add_argument("raw_dir")
    a = sub.add_parser("export")
    a.add_argument("raw_dir")
    a.add_argument("mart_dir")
    a.add_argument("--staging", default=None)
    a.add_argument("--jobs", type=int, default=4)
    args = p.parse_args(argv)

    from souk.session import build_session
    spark = spark or build_session()

    from souk.operators import profile as P
    from souk.plans.build import build_and_export, load_raw
    from souk.plans.registry import Marketplace, register_views, view_catalog
    from souk.schemas import RAW_FILES
    from souk.sources.csv_source import read_raw_folder

    if args.cmd == "inspect":
        raw = read_raw_folder(spark, args.raw_csv_dir)
        out = {"shape": P.profile_shape(raw), "dtypes": P.profile_dtypes(raw),
               "nulls": P.profile_nulls(raw), "duplicates": P.profile_duplicates(raw)}
    elif args.cmd == "load":
        base = args.raw_csv_dir.rstrip("/")
        paths = {t: f"{base}/{f}" for t, f in RAW_FILES.items()}
        stored, accounts = load_raw(spark, paths, args.raw_dir, args.widen)
        out = {"reconcile": P.reconcile_loads(accounts, stored), "losses": P.load_losses(spark, accounts)}
    elif args.cmd == "views":
        register_views(Marketplace(_raw_parquet(spark, args.raw_dir)))
        out = {"views": view_catalog(spark)}
    else:
        out = {"manifest": build_and_export(_raw_parquet(spark, args.raw_dir), args.mart_dir,
                                            staging_folder=args.staging,
                                            max_concurrent_jobs=args.jobs)}
    for name, df in out.items():
        print(f"== {name}")
        df.show(200, truncate=False)
    return out


if __name__ == "__main__":
    run(sys.argv[1:])
