"""python -m foliant: converts or cleans the files of a folder, or lists the formats.

    python -m foliant convert IN OUT EXT
    python -m foliant clean IN OUT audit|sanitize|decontaminate
    python -m foliant formats
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.files import output_name, stem
from .operators.cleaning import purify
from .sinks.files import EXPORTERS, batch_summary, export_documents, write_files
from .sources.files import IMPORTERS, extension, read_folder


def main(args: list[str]) -> int:
    if args == ["formats"]:
        print("import:", *sorted(IMPORTERS))
        print("export:", *sorted(EXPORTERS))
        return 0
    if len(args) != 4 or args[0] not in ("convert", "clean"):
        print(__doc__, file=sys.stderr)
        return 2
    what, source, target, how = args
    if what == "convert" and how not in EXPORTERS or what == "clean" and how not in ("audit", "sanitize", "decontaminate"):
        print(f"not known: {how}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("foliant").getOrCreate()
    read = read_folder(spark, source)
    if what == "convert":
        made = export_documents(read.where("error IS NULL"), how, "path", "md").join(read.select(F.col("path").alias("p")), F.col("path") == F.col("p")).drop("p")
        files = made.select(F.regexp_replace(output_name(F.col("path"), how), "_\\.", ".").alias("name"), "content", "error")
    else:
        done = purify(read.where("error IS NULL"), how, "path", "md", path="path")
        files = done.select(F.concat(stem(F.col("path")), F.lit("_clean."), extension(F.col("path"))).alias("name"), F.encode(F.when(F.lit(how) == "audit", F.to_json("report")).otherwise(F.col("text")), "utf-8").alias("content"), "error")
    written = write_files(files.where("content IS NOT NULL"), target).select("error").unionByName(read.where("error IS NOT NULL").select("error"))
    total, converted, failed = batch_summary(written).first()
    print(f"{total} files, {converted} written, {failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
