"""Documents converted, inspected or given outlines from the command line, any number at a time.

    spark-submit quire/__main__.py convert FILES --out URI
    spark-submit quire/__main__.py inspect FILES [--json] [--bookmarks] [--pages]
    spark-submit quire/__main__.py add-bookmarks PDFS CAJS --out URI

FILES is a path, folder or pattern. Exit status 1 tells that some document failed; each failure
is a line on standard error. ``add-bookmarks`` pairs files by their names without suffix.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import documents
from quire.sinks import reports
from quire.sources import documents as source


def _failures(rows: DataFrame, message: str = "error.message") -> int:
    """Prints the failures as they come, partition by partition, and counts them."""
    failed = 0
    for row in rows.filter(F.col(message).isNotNull()).select("path", F.col(message).alias("m")).toLocalIterator():
        print(f"{row.path}: {row.m}", file=sys.stderr)
        failed += 1
    return failed


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quire", description=__doc__.splitlines()[0])
    commands = parser.add_subparsers(dest="command", required=True)
    convert = commands.add_parser("convert")
    convert.add_argument("files")
    convert.add_argument("--out", required=True)
    convert.add_argument("--no-bookmarks", action="store_true")
    convert.add_argument("--allow-damaged", action="store_true")
    look = commands.add_parser("inspect")
    look.add_argument("files")
    for flag in ("--json", "--bookmarks", "--pages"):
        look.add_argument(flag, action="store_true")
    add = commands.add_parser("add-bookmarks")
    add.add_argument("pdfs")
    add.add_argument("cajs")
    add.add_argument("--out", required=True)
    args = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("quire").getOrCreate()
    if args.command == "convert":
        files = source.read(spark, args.files)
        made = documents.to_pdf(files, include_bookmarks=not args.no_bookmarks, allow_damaged=args.allow_damaged)
        wrote = reports.write_files(made, "pdf", args.out, ".pdf", keep_errors=True)
        unknown = files.filter(~F.coalesce(documents.detect_format(F.col("content")).isin(*documents.CONVERTIBLE), F.lit(False))).select("path", F.lit("unsupported input format").alias("error"))
        return int(_failures(wrote.select("path", "error").unionByName(unknown), "error") > 0)
    if args.command == "inspect":
        failed = 0
        for row in reports.inspections(source.read(spark, args.files), bookmarks=args.bookmarks, pages=args.pages).toLocalIterator():
            if row.error:
                print(f"{row.path}: {row.error.message}", file=sys.stderr)
                failed = 1
            else:
                print(row.json if args.json else row.text.removesuffix("\n"))
        return failed
    name = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    pdfs = source.read(spark, args.pdfs).select(name.alias("path"), F.col("content").alias("pdf"))
    outlines = documents.bookmarks(source.read(spark, args.cajs)).withColumn("path", name)
    done = documents.add_bookmarks(pdfs, outlines, refuse_existing=True)
    return int(_failures(reports.write_files(done, "pdf", args.out, ".pdf", keep_errors=True), "error") > 0)


if __name__ == "__main__":
    sys.exit(main())
