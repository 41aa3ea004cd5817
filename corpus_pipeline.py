"""From raw documents to packed training windows, in five stages.

Each stage takes (spark, docs, sf_dir), with docs the rows that the stage before it left, and returns a
DataFrame; all but the last return the columns of documents, whatever these are. Columns are carried by number where a stage
needs its own beside them, so that extra columns of any name go through. run() writes each stage's result as Parquet
into the shared folder and reads it again; a stage's files go once the next stage's are written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import minhash, mixing, packing, quality, substring
from foliant.llm.common import WORD, replayable, shared_folder, table, with_uid


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated quality is at least the threshold stay.

    Null and empty texts are scored like others, a null key has a score too; texts that are equal stay or go together, very
    long ones are scored whole. Repeated rows stay repeated; an empty table gives an empty one.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)])
    scored = quality.score(rows, model, f"c{[c.lower() for c in docs.columns].index('text')}").where(F.col("score") >= quality.THRESHOLD)
    return scored.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8) stays, the one with the least key.

    Rows that tie in the key count by row number, so that of repeated rows exactly one stays; a null key stays only where its group has no
    other. Null, empty and blank texts are near nothing and all stay. Very long texts are compared by all their words. An empty table gives an empty one.
    """
    docs = replayable(docs)
    found = minhash.near_duplicates(docs, k=5, num=80, den=100)
    rows = with_uid(docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)]))
    left = rows.join(found.where("chosen").select("uid"), "uid", "left_semi")
    return left.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that recur anywhere are cut out, all occurrences; n_chars (if there is one) is counted anew.

    Every row stays. A null text stays null, short and empty ones are as they were; repeated rows lose all they share. An empty table gives an empty one.
    """
    rows = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"], docs["text"].cast("string").alias("text"))
    left = substring.remove_repeats(rows, texts=True)
    return _with_text(left, docs, F.col("text"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time that it takes of a document, with the words it takes; n_chars (if there is one) is counted anew.

    A null source is a source. Documents without words are in no mix. A document that is taken whole keeps its text as it is, of one that is taken in part, in
    the last round of its source, the words are joined by one space. Repeated rows are documents of their own. An empty table gives an empty one.
    """
    docs = replayable(docs)
    _, mixed = mixing.mix(docs)
    parts = mixed.groupBy("uid", "epoch").agg(F.min("begin").alias("begin"), F.sum("length").alias("length"), F.min("size").alias("size"))
    rows = with_uid(docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)], docs["text"].cast("string").alias("text")))
    met = rows.join(parts, "uid")
    words = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), (F.col("begin") + 1).cast("int"), F.col("length").cast("int"))
    return _with_text(met, docs, F.when(F.col("length") == F.col("size"), F.col("text")).otherwise(F.array_join(words, " ")))


def _with_text(rows: DataFrame, docs: DataFrame, text) -> DataFrame:
    """The columns of ``docs`` out of numbered ones, with another text and the count of characters that goes with it."""
    kinds = {f.name: f.dataType for f in docs.schema}
    new = {"text": text.cast(kinds["text"])} | ({"n_chars": F.length(text).cast(kinds["n_chars"])} if "n_chars" in kinds else {})
    return rows.select(*[new.get(c, F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)])


#: Earlier stages leave each executor twice the workers that one operator has, and each worker comes to hold an encoder.
PACKING_WORDS = 100_000


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the windows, with their ids; null and empty texts give their end id, repeated rows are packed each, an empty table gives no piece."""
    return packing.pack(docs, words=PACKING_WORDS)


STAGES = [
    ("quality classifier", quality_stage),
    ("minhash near-dedup", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The classifier has no SQL form; tests/llm/test_pipeline.py holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, docs = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return docs
