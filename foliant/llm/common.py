"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import functools
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..rows import replayable, shared_folder, spread_join, stash, sweep, trim, with_uid
from . import wordhash

__all__ = ["SLICE_BYTES", "WORD", "kept", "n_words", "release", "replayable", "shared_folder", "slices", "spread_join", "stash", "sweep", "table", "trimmed", "with_uid"]

#: A word is a maximal run of anything but space, \t, \n, \v, \f, \r.
WORD = r"[^\x20\x09-\x0D]+"

#: Texts are handled in slices of about so many bytes, which bounds every numpy temporary.
SLICE_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text="text"):
    """Number of words of a text column, natively; null counts as 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


_kept: dict = {}


def kept(name: str, make):
    """An object with caches that a worker process keeps from task to task; it holds one at a time."""
    if name not in _kept:
        release()
        _kept[name] = make()
    return _kept[name]


def release() -> None:
    """Gives up what an earlier operator kept in this worker process, and gives its memory back to the system."""
    if _kept:
        _kept.clear()
        gc.collect()  # an object with caches that call its methods refers to itself
    wordhash.forget()
    trim()


def trimmed(run: Callable) -> Callable:
    """A function for mapInArrow that gives its memory back to the system as its task ends; what kept() holds stays."""

    @functools.wraps(run)
    def to_the_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        wordhash.forget()
        trim()

    return to_the_end


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Cuts Arrow batches into runs of rows whose texts hold about ``limit`` bytes.

    Yields the run and its texts as bytes (None for null); a longer text makes a run of its own.
    """
    for batch in batches:
        kind = pa.large_binary() if pa.types.is_large_string(batch.column(column).type) else pa.binary()
        texts = batch.column(column).cast(kind)  # a view; only a run's texts are copied at a time
        begin, held = 0, 0
        for i, size in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
            if held and held + size > limit:
                yield batch.slice(begin, i - begin), texts.slice(begin, i - begin).to_pylist()
                begin, held = i, 0
            held += size + 16
        if begin < len(texts):
            yield batch.slice(begin), texts.slice(begin).to_pylist()
