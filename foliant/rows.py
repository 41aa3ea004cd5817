"""Row numbers, cut lineage and joins that hot keys cannot stop; all parts of the library use these."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key that one task of a spread join takes, at least; more where all rows are very many.
SPREAD = 20_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, which the session names in ``spark.checkpoint.dir``.

    Where it names none, a temporary folder serves a session on this one machine (tests); any other session is refused,
    as files would scatter over machines that can be lost.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.conf.get("spark.master", "local")
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    return tempfile.mkdtemp(prefix="foliant-")


def stash(df: DataFrame, packed: bool = False) -> DataFrame:
    """Cuts lineage through the shared checkpoint folder.

    Spark removes the files once nothing refers to them if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on. Checkpoints are
    not compressed; ``packed`` keeps batches of narrow rows as compressed bytes, in a fraction of the space.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    if not packed:
        return df.checkpoint(eager=True)
    return df.mapInArrow(_pack, "batch binary").checkpoint(eager=True).mapInArrow(_unpack, df.schema)


def sweep(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files (and checkpoints, where it is told to) that nothing refers to any more.

    It does so once the driver collects its garbage, which a driver with room to spare may put off until all steps of a job
    lie on disk together. A frame that has run refers to its shuffle files as long as Python holds it, in
    cycles too, and the last actions' files can outlast a call.
    """
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Gives the system what this process has freed; allocators keep it otherwise, in every worker that waits for its next task."""
    pa.default_memory_pool().release_unused()
    if hasattr(ctypes.CDLL(None), "malloc_trim"):  # glibc
        ctypes.CDLL(None).malloc_trim(0)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], ["batch"])
    trim()


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0):
            yield from pa.ipc.open_stream(data.as_py())
    trim()


#: Plan nodes that give the same rows in the same order whenever they run again, and whatever columns are read.
_STEADY = {"Project", "Filter", "SubqueryAlias", "View", "LogicalRelation", "LocalRelation", "LogicalRDD", "DataSourceV2Relation", "Union"}


def replayable(df: DataFrame) -> DataFrame:
    """The rows in an order that every evaluation repeats: plain scans and checkpoints as they are, all else checkpointed once.

    Plans with expressions like rand() are checkpointed too.
    """
    plan = df._jdf.queryExecution().analyzed()
    left = [plan]
    while left:
        node = left.pop()
        if node.getClass().getSimpleName() not in _STEADY or not node.deterministic():
            return stash(df)
        left += [node.children().apply(i) for i in range(node.children().size())]
    return df


def with_uid(df: DataFrame, name: str = "uid") -> DataFrame:
    """A row number that is the same in every evaluation."""
    return replayable(df).withColumn(name, F.monotonically_increasing_id())


def spread_join(many: DataFrame, few: DataFrame, keys: list[str], count: str, spread: Column, total: int, how: str = "inner", largest: int | None = None, salt: str | None = None) -> DataFrame:
    """Joins ``many`` with ``few`` on ``keys``, which are unique in ``few``; the rows of a hot key go to several tasks.

    ``few`` holds in ``count`` how many rows of ``many`` have the key, out of ``total``; ``spread`` is an expression over ``many`` that tells rows
    of a key apart. A key is hot beyond SPREAD rows, or beyond a 4096th of all: there are never more than 4096
    hot keys, so that they can be broadcast; each is dealt to as many tasks as its rows need. No key may be null in ``few``. Where ``largest`` bounds the
    rows of any key and none can be hot, it is a plain join. ``salt`` names a column that tells the parts of a hot key apart.
    """
    most = max(SPREAD, total // 4096)
    if largest is not None and largest <= most:
        joined = many.join(few, keys, how)
        return joined.withColumn(salt, F.lit(0)) if salt else joined
    hot = few.where(F.col(count) > most).select(*[F.col(k).alias(f"_hot_{k}") for k in keys], F.ceil(F.col(count) / most).cast("int").alias("_salts"))
    same = None
    for k in keys:
        one = F.col(k) == F.col(f"_hot_{k}")
        same = one if same is None else same & one
    salted = many.join(F.broadcast(hot), same, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_salts")).cast("int"), F.lit(0))).drop("_salts", *[f"_hot_{k}" for k in keys])
    copies = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col(count) / most).cast("int") - 1, F.lit(0)))))
    joined = salted.join(copies, [*keys, "_salt"], how)
    return joined.withColumnRenamed("_salt", salt) if salt else joined.drop("_salt")
