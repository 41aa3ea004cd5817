"""Document fingerprints from prefix polynomial hashes.

A text's prefix arrays hold, for every code point, the polynomial hash of all that precedes it,
modulo two primes. The difference of two entries, times an inverse power, is the hash of the
span between them: any two spans are compared in constant time, and the longest common extension
of two places is found by binary search. A fingerprint holds the hash and length of the whole text
and the least hashes of its distinct spans of a fixed width, so that two fingerprints alone
estimate how alike (Jaccard) the texts' sets of spans are.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, table, with_uid
from .wordhash import mix

U = np.uint64
P = (U(2**31 - 1), U(2**31 - 19))
BASES = (U(1_103_515_245 % (2**31 - 1)), U(1_664_525))
#: Code points of a span, and the number of least span hashes that a fingerprint holds.
WIDTH, LEAST = 16, 64
#: Text bytes that one task orders, about, up to so many tasks; rows of a range of keys.
PART_BYTES, PARTS, RANGE_ROWS = 16 << 20, 100_000, 1_000_000

_tables: list[tuple[np.ndarray, np.ndarray]] = []


def _reduce(x: np.ndarray, k: int) -> np.ndarray:
    """x modulo the k-th prime, for x below 2**63: both are a little below 2**31, so that high bits fold down."""
    if k == 0:  # 2**31 - 1
        x = (x & P[0]) + (x >> U(31))
        x = (x & P[0]) + (x >> U(31))
        return np.where(x >= P[0], x - P[0], x)
    x = (x & P[0]) + (x >> U(31)) * U(19)
    x = (x & P[0]) + (x >> U(31)) * U(19)
    return np.where(x >= P[1], x - P[1], x)


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers and inverse powers of both bases for exponents below n; kept while small."""
    if _tables and len(_tables[0][0]) >= n:
        return _tables
    size, made = 1 << max(12, (n - 1).bit_length()), []
    for k, p in enumerate(P):
        pair = []
        for base in (int(BASES[k]), pow(int(BASES[k]), -1, int(p))):
            row, have = np.ones(size, U), 1
            while have < size:  # doubling: the next stretch is the last one times a power
                row[have : 2 * have] = _reduce(row[:have] * U(pow(base, have, int(p))), k)
                have *= 2
            pair.append(row)
        made.append(tuple(pair))
    if size <= 1 << 20:
        _tables[:] = made
    return made


class Prefixes:
    """Prefix arrays of one text."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(U) + U(1)
        self.n, self.powers = len(codes), _powers(len(codes) + 1)
        self.sums = []
        for k in (0, 1):
            sums = np.zeros(self.n + 1, U)
            np.cumsum(_reduce(codes * self.powers[k][0][: self.n], k), out=sums[1:])
            self.sums.append(_reduce(sums, k))

    def spans(self, begins, ends) -> np.ndarray:
        """Hashes (below 2**62) of the spans [begin, end)."""
        parts = [_reduce((s[ends] + P[k] - s[begins]) % P[k] * self.powers[k][1][begins], k) for k, s in enumerate(self.sums)]
        return parts[0] << U(31) | parts[1]

    def windows(self, width: int, begin: int, end: int) -> np.ndarray:
        """Hashes of all spans of this width in [begin, end), by their begin."""
        if end - begin < width:
            return np.empty(0, U)
        parts = []
        for k, s in enumerate(self.sums):
            x = s[begin + width : end + 1] + P[k] - s[begin : end - width + 1]
            parts.append(_reduce(x * self.powers[k][1][begin : end - width + 1], k))  # below 2**32 * 2**31
        return parts[0] << U(31) | parts[1]

    def equal(self, i: int, other: Prefixes, j: int, length: int) -> bool:
        """Whether two spans have equal hashes: differences of prefixes, each moved to the other's place."""
        for k in (0, 1):
            here = self.sums[k].item(i + length) - self.sums[k].item(i)
            there = other.sums[k].item(j + length) - other.sums[k].item(j)
            if (here * other.powers[k][0].item(j) - there * self.powers[k][0].item(i)) % int(P[k]):
                return False
        return True

    def common(self, i: int, other: Prefixes, j: int) -> int:
        """Longest common extension: how many code points agree from place i here and j there."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(i, other, j, middle):
                low = middle
            else:
                high = middle - 1
        return low


def least(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k least distinct values, in order."""
    if len(hashes) > 16 * k:
        part = np.unique(hashes[hashes < U(int((8 * k / len(hashes)) * 2**64))])
        if len(part) >= k:
            return part[:k]
    return np.unique(hashes)[:k]


def span_hashes(prefix: Prefixes, begin: int, end: int, width: int = WIDTH) -> np.ndarray:
    return mix(prefix.windows(width, begin, end))


def fingerprint(whole: int, n: int, hashes: np.ndarray) -> str:
    """Hex: the whole text's hash and length in 16 digits each, then 16 for each least hash."""
    return np.concatenate([np.array([whole, n], U), hashes]).astype(">u8").tobytes().hex()


def likeness(a: str, b: str, k: int = LEAST) -> float:
    """Estimated Jaccard likeness of two texts' span sets from their fingerprints; 1 for equal texts.

    Of the k least hashes of both together, the share that both have. Texts without spans (shorter than
    the width) are alike only if equal.
    """
    if a[:32] == b[:32]:
        return 1.0
    x, y = (set(np.frombuffer(bytes.fromhex(s[32:]), ">u8").tolist()) for s in (a, b))
    both, shared = sorted(x | y)[:k], x & y
    return sum(v in shared for v in both) / len(both) if both else 0.0


def of_text(text: str) -> str:
    """The fingerprint of a whole text."""
    p = Prefixes(text)
    return fingerprint(int(p.spans(np.array([0]), np.array([p.n]))[0]), p.n, least(span_hashes(p, 0, p.n), LEAST))


def _known(text: str) -> tuple[str, Prefixes, str]:
    p = Prefixes(text)
    return text, p, fingerprint(int(p.spans(np.array([0]), np.array([p.n]))[0]), p.n, least(span_hashes(p, 0, p.n), LEAST))


def compare(text: str, own: Prefixes, mark: str, following: str, then: Prefixes, next_mark: str) -> dict:
    """A text against its edited form (its last half replaced by the next text's begin) and against the next text.

    The edited form's spans are the text's own, the next one's and the few that cross the seam; the
    first two come from the prefix arrays at hand.
    """
    cut = own.n - own.n // 2
    taken = min(own.n // 2, then.n)
    edited = text[:cut] + following[:taken]
    data = edited.encode()
    seam = Prefixes(edited[max(0, cut - WIDTH + 1) : cut + WIDTH - 1])
    hashes = least(np.concatenate([least(span_hashes(own, 0, cut), LEAST), least(span_hashes(then, 0, taken), LEAST), span_hashes(seam, 0, seam.n)]), LEAST)
    whole = 0
    for k in (0, 1):  # the hash of a join: the second part's, moved behind the first
        p = int(P[k])
        total = (int(own.sums[k][cut]) + int(then.sums[k][taken]) * pow(int(BASES[k]), cut, p)) % p
        whole = whole << 31 | total
    edited_mark = fingerprint(whole, cut + taken, hashes)
    return {"n_chars": own.n, "edited_sha256": hashlib.sha256(data).hexdigest(), "fingerprint": mark, "edited_fingerprint": edited_mark, "near_edited": likeness(mark, edited_mark), "near_next": likeness(mark, next_mark), "common_next": own.common(0, then, 0)}


def _heads(rows: DataFrame) -> list[tuple]:
    """(key, uid) of the first row of each part, in order: parts follow one another by descending key and hold about as many bytes each.

    Only keys, row numbers and sizes are ordered, by ranges; running sums over the ranges say where a part begins. One pair comes to
    the driver for each part.
    """
    kind = rows.schema["key"].dataType.simpleString()
    order = [F.col("key").desc_nulls_last(), F.col("uid").asc()]
    small = rows.select("key", "uid", (F.octet_length("text") + 64).cast("long").alias("size"))
    stats = small.agg(F.count("*"), F.sum("size")).first()
    least = max(PART_BYTES, (stats[1] or 0) // PARTS)
    ranged = stash(small.repartitionByRange(1 + stats[0] // RANGE_ROWS, *order).sortWithinPartitions(*order)).withColumn("range", F.spark_partition_id())
    sums = {r["range"]: r["size"] for r in ranged.groupBy("range").agg(F.sum("size").alias("size")).collect()}
    before, begin = {}, 0
    for k in sorted(sums):
        before[k], begin = begin, begin + sums[k]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, last, seen = 0, -1, 0
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            upto = before[batch.column("range")[0].as_py()] + done + np.cumsum(sizes) - sizes if len(sizes) else sizes
            part = upto // least
            new = np.flatnonzero(np.diff(part, prepend=last))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(new)) for c in ("key", "uid", "range")] + [pa.array(part[new], pa.int64()), pa.array(new + seen, pa.int64())], ["key", "uid", "range", "part", "at"])
            if len(sizes):
                done, last, seen = done + int(sizes.sum()), part[-1], seen + len(sizes)

    found = sorted(ranged.mapInArrow(first, f"key {kind}, uid long, range int, part long, at long").collect(), key=lambda r: (r["part"], r["range"], r["at"]))
    return [(r["key"], r["uid"]) for i, r in enumerate(found) if not i or r["part"] != found[i - 1]["part"]]


def _placed(rows: DataFrame, heads: list[tuple]) -> DataFrame:
    """Adds ``part`` and ``extra``: each row in its part, and each part's first row in the part before it as well (the very first in the last)."""
    known = sorted((key, -uid) for key, uid in heads if key is not None)
    blank = sorted(uid for key, uid in heads if key is None)
    number = {uid: i for i, (_, uid) in enumerate(heads)}

    @F.udf("array<int>", useArrow=True)
    def parts(key, uid: int) -> list[int]:
        at = len(known) + bisect_right(blank, uid) if key is None else len(known) - bisect_left(known, (key, -uid))
        return [at - 1, (at - 2) % len(heads)] if uid in number else [at - 1]

    return rows.select("*", F.posexplode(parts("key", "uid")).alias("copy", "part")).withColumn("extra", F.col("copy") > 0).drop("copy")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, common_next) for every row.

    Rows are taken by descending key of any type that has an order (null keys last, repeated keys by row number); a row's next
    is the one that follows, the last row's is the first. A single row is its own next. A null text counts as empty, a very long one is
    hashed whole. An empty table gives an empty one; other columns are not read.
    ``common_next`` is the longest common prefix with the next text, by binary search over the prefix arrays.

    Texts are shuffled once: rows are dealt to parts of about equal bytes (PART_BYTES, and beyond PARTS parts as much more as it needs), whatever
    their keys, and each part's first row goes along with the part before it as well, so that each task reads its rows and their successors
    in one ordered stream. A task holds one batch and one text's arrays.
    """
    kind, narrow = docs.schema[key].dataType.simpleString(), f"`{key}`"
    rows = with_uid(docs.select(docs[key].alias("key"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text")))
    heads = _heads(rows)
    ordered = _placed(rows, heads).repartitionById(max(1, len(heads)), "part").sortWithinPartitions("part", "extra", F.col("key").desc_nulls_last(), "uid")
    names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_next"]
    kinds = dict(zip(names, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()), strict=True))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for its next
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                piece = batch.slice(begin, 256)
                keys, found = [], []
                for k, (text, part, extra) in enumerate(zip(*(piece.column(c).to_pylist() for c in ("text", "part", "extra")), strict=True)):
                    known = _known(text)
                    if held and held[0] == part:
                        keys.append(held[1])
                        found.append(compare(*held[2], *known))
                    held = None if extra else (part, piece.column("key").slice(k, 1), known)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays(keys), *(pa.array([f[c] for f in found], kinds[c]) for c in names)], [key, *names])

    return ordered.select("key", "text", "part", "extra").mapInArrow(walk, f"{narrow} {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_next long")


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
