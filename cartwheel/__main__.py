"""Command line: run reports or the cleaning run.

  python -m cartwheel reports --shop DIR [--only a,b] [--out DIR] [--format parquet|csv]
  python -m cartwheel reports --testdata /root/testdata/sf0.01 --only traffic_channel
  python -m cartwheel clean IN.csv OUT_DIR --median AUTHORIZED_CAP \
      --date DATE_OF_REGISTRATION=dd-MM-yyyy:COMPANY_CATEGORY
  python -m cartwheel ingest CSV_DIR OUT_DIR [--by-month] [--empty-as mysql|null]
  python -m cartwheel list

``--shop`` is a folder of normalised Parquet tables written by ``sources.shop.ingest_csv``.
Without ``--out`` each report is shown (first 20 rows).
"""

from __future__ import annotations

import argparse
import sys


def _reports(args) -> int:
    from cartwheel.plans.reports import REPORTS
    from cartwheel.scratch import scratch_scope
    from cartwheel.session import build_session
    spark = build_session()
    if args.shop:
        from cartwheel.sources.shop import read_shop_tables
        tables = read_shop_tables(spark, args.shop)
    else:
        from cartwheel.sources.testviews import shop_tables
        tables = shop_tables(spark, args.testdata)
    names = [n for n in (args.only.split(",") if args.only else REPORTS) if n]
    unknown = [n for n in names if n not in REPORTS]
    if unknown:
        print(f"unknown reports: {', '.join(unknown)}", file=sys.stderr)
        return 2
    with scratch_scope(spark):  # reports share what they store; nothing of it stays
        for name in names:
            df = REPORTS[name](tables)
            if args.out:
                writer = df.write.mode("overwrite")
                target = f"{args.out.rstrip('/')}/{name}"
                (writer.option("header", True).csv(target) if args.format == "csv" else writer.parquet(target))
                print(f"{name}: written to {target}")
            else:
                print(f"== {name}")
                df.show(20, truncate=False)
    return 0


def _ingest(args) -> int:
    from pyspark.errors import AnalysisException

    from cartwheel.scratch import scratch_scope
    from cartwheel.session import build_session
    from cartwheel.sources.schemas import SHOP_SCHEMAS
    from cartwheel.sources.shop import ingest_csv
    spark = build_session()
    done = 0
    for name in SHOP_SCHEMAS:
        src = f"{args.csv_dir.rstrip('/')}/{name}.csv"
        try:  # Spark looks, so that any Hadoop path works
            spark.read.text(src)
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                continue
            raise
        with scratch_scope(spark):
            ingest_csv(spark, name, src, f"{args.out.rstrip('/')}/{name}", empty_as=args.empty_as,
                       partition_by_month=args.by_month and name != "orders")
        print(f"{name}: {src} -> {args.out.rstrip('/')}/{name}")
        done += 1
    if not done:
        print(f"no <table>.csv found in {args.csv_dir}", file=sys.stderr)
        return 2
    return 0


def _clean(args) -> int:
    from cartwheel.operators.clean import CleanRules, clean_csv
    from cartwheel.scratch import scratch_scope
    from cartwheel.session import build_session
    formats, keys = {}, {}
    for spec in args.date or []:
        column, rest = spec.split("=", 1)
        fmt, _, key = rest.partition(":")
        formats[column] = fmt
        if key:
            keys[column] = key
    rules = CleanRules(median_columns=tuple(args.median or ()), date_formats=formats,
                       group_mean_keys=keys, text_fill=args.fill, drop_above=args.drop_above)
    spark = build_session()
    with scratch_scope(spark):
        clean_csv(spark, args.source, args.target, rules)
    print(f"cleaned table written to {args.target}")
    return 0


def main(argv=None) -> int:
    p = argparse.ArgumentParser(prog="cartwheel")
    sub = p.add_subparsers(dest="cmd", required=True)
    r = sub.add_parser("reports", help="run web-shop reports")
    src = r.add_mutually_exclusive_group(required=True)
    src.add_argument("--shop", help="folder of normalised Parquet shop tables")
    src.add_argument("--testdata", help="a /root/testdata/sf* folder (derived views)")
    r.add_argument("--only", help="comma-separated report names (default: all)")
    r.add_argument("--out", help="write each report below this folder")
    r.add_argument("--format", choices=("parquet", "csv"), default="parquet")
    c = sub.add_parser("clean", help="profile-driven cleaning of a CSV file")
    c.add_argument("source")
    c.add_argument("target")
    c.add_argument("--median", action="append", help="column filled with its median")
    c.add_argument("--date", action="append", help="COLUMN=PATTERN[:GROUP_KEY]")
    c.add_argument("--fill", default="nodata", help="constant for text columns")
    c.add_argument("--drop-above", type=float, default=30.0, help="drop columns missing more (%%)")
    g = sub.add_parser("ingest", help="CSV exports of the shop tables -> normalised Parquet")
    g.add_argument("csv_dir", help="folder holding <table>.csv files (or folders)")
    g.add_argument("out")
    g.add_argument("--by-month", action="store_true", help="partition event tables by month")
    g.add_argument("--empty-as", choices=("mysql", "null"), default="mysql")
    sub.add_parser("list", help="list report names")
    args = p.parse_args(argv)
    if args.cmd == "list":
        from cartwheel.plans.reports import REPORTS
        print("\n".join(REPORTS))
        return 0
    if args.cmd == "ingest":
        return _ingest(args)
    return _reports(args) if args.cmd == "reports" else _clean(args)


if __name__ == "__main__":
    sys.exit(main())
