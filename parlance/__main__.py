"""Command line: list and run registered queries, and write reports of transcripts.

    python -m parlance list
    python -m parlance run NAME --data DIR [--out DIR]
    python -m parlance report TRANSCRIPTS --out DIR --url URL --model NAME [--language hi]
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from parlance.operators import reports
from parlance.plans import registry
from parlance.runtime import ship_package
from parlance.sources import models, readers


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="parlance")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("name", choices=sorted(registry.QUERIES))
    run.add_argument("--data", required=True)
    run.add_argument("--out")
    report = sub.add_parser("report")
    report.add_argument("transcripts")
    report.add_argument("--out", required=True)
    report.add_argument("--url", default="http://127.0.0.1:8080/v1")
    report.add_argument("--model", default="default")
    report.add_argument("--language", default="hi")
    report.add_argument("--timeout", type=float, default=900)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(registry.QUERIES)))
        return
    spark = SparkSession.builder.appName("parlance").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship_package(spark)
    if args.command == "run":
        df = registry.QUERIES[args.name](spark, args.data.rstrip("/"))
        df.write.mode("overwrite").parquet(args.out) if args.out else df.show(50, truncate=80)
        return
    url, model, timeout = args.url, args.model, args.timeout
    lines = readers.read_transcripts(spark, args.transcripts).withColumnRenamed("file", "conv_id")

    def save(df, name):
        df.write.mode("overwrite").parquet(f"{args.out}/{name}")
        return spark.read.schema(df.schema).parquet(f"{args.out}/{name}")

    made = save(reports.build_reports(lines, lambda: models.HttpChat(url, model, timeout), save, language=args.language), "reports")
    save(reports.markdown(made, language=args.language), "markdown")
    print(made.select(F.count("*")).first()[0], "reports")


if __name__ == "__main__":
    main()
