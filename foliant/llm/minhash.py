"""MinHash near-duplicates with SetSketch registers.

A document's shingles (runs of words) are hashed; for each register the least value of its own
permutation is taken as an exponential variate and kept as a truncated power of the base:
``floor(1 - log_b(h))`` clipped to a byte. Registers of unions are maxima of registers, and equal
registers become likelier with the Jaccard similarity. Bands of registers give candidates; a joint likelihood
of registers that are greater, less and equal sorts out most that are not alike; what is left is
confirmed on the full sets.

Work does not grow with the square of a group: documents with equal sets are one class from the start;
in each bucket all classes meet its least one and the one that meets most others only; only where a bucket still holds
several components are pairs between different components tried, by their sketches, in blocks.

Each step ends in a checkpoint; what earlier steps have shuffled is removed on the way (``sweep``), so that the disk need not hold the files of all steps together.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, slices, spread_join, stash, sweep, table, trimmed, with_uid
from .graph import components
from .wordhash import mix, span_sums, spans, words_of

U = np.uint64
#: Registers; those that bands are made of; base, rate and greatest value of a register (a byte).
REGISTERS, BANDED, BASE, RATE, TOP = 512, 128, 1.07, 20.0, 255
#: Chance to miss a pair right at the threshold, which settles the width of a band.
MISS = 1e-4
#: log likelihood by which the threshold must lose for a pair to be left out unconfirmed: 4 standard deviations.
DOUBT = 8.0
#: Similarities below the threshold, by their distance from it, that the threshold is weighed against.
STEPS = (0.02, 0.04, 0.06, 0.08, 0.11, 0.15, 0.2, 0.3, 0.45)
#: Classes of a bucket that one task holds.
BLOCK = 1024
#: Least half hashes of a set that go along with its sketch into the blocks; smaller sets go whole.
LEAST = 512
#: Members of a star that are confirmed in one go.
STAR = 256

_rng = np.random.Generator(np.random.PCG64(99))
_A = _rng.integers(0, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, REGISTERS, dtype=np.uint32)


def band_width(least: float) -> int:
    """Registers of a band: the most with which a pair of this similarity is missed by all bands at a chance of at most MISS."""
    return max(r for r in range(1, 33) if r == 1 or (1 - least**r) ** (BANDED // r) <= MISS)


def shingles(texts: list, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words of each text, lower-cased A-Z (of fewer words: of the whole), and bounds by text."""
    h, bounds = words_of(texts, lower=True)
    counts = np.diff(bounds)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(n)])
    text = np.repeat(np.arange(len(texts)), n)
    begins = np.arange(at[-1]) - at[text] + bounds[text] if len(text) else np.empty(0, np.int64)
    ends = np.minimum(begins + k, bounds[text + 1]) if len(text) else begins
    return spans(span_sums(h), begins, ends), at


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of a non-empty set of hashes."""
    x = (hashes >> U(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for begin in range(0, len(x), 512):
        np.minimum(least, (x[begin : begin + 512, None] * _A + _B).min(0), out=least)
    variate = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(variate) / np.log(BASE)), 0, TOP).astype(np.uint8)


def log_likelihood(jaccard, less, equal, greater, na, nb):
    """Joint likelihood of two sketches' comparison, given their sets' sizes."""
    u, v = na / (na + nb), nb / (na + nb)
    p = lambda x: -np.log1p(-np.clip(x, 1e-9, 1) * (BASE - 1) / BASE) / np.log(BASE)
    above, below = np.clip(p(u - v * jaccard), 1e-9, 1), np.clip(p(v - u * jaccard), 1e-9, 1)
    return greater * np.log(above) + less * np.log(below) + equal * np.log(np.clip(1 - above - below, 1e-9, 1))


def plausible(sa: np.ndarray, sb: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of sketches may well belong to sets of at least this similarity.

    The likelihood is concave in the similarity: if the threshold loses to any lower one by DOUBT, so do all above it.
    """
    greater, less = (sa > sb).sum(1), (sa < sb).sum(1)
    counts = (less, REGISTERS - greater - less, greater, na.astype(np.float64), nb.astype(np.float64))
    most = np.minimum(na, nb) / np.maximum(na, nb)
    at = log_likelihood(np.minimum(least, most), *counts)
    keep = most >= least * (1 - 1e-12)
    for step in STEPS:
        if least > step:
            keep &= log_likelihood(np.minimum(least - step, most), *counts) - at <= DOUBT
    return keep


def _sketched(rows: DataFrame, k: int) -> DataFrame:
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for part, texts in slices(batches):
            hashes, at = shingles(texts, k)
            n, cls, proof, marks = [], [], [], []
            for i in range(len(texts)):
                own = np.unique(hashes[at[i] : at[i + 1]])
                n.append(len(own))
                with np.errstate(over="ignore"):
                    cls.append(int(mix(np.array([own.sum(dtype=U) ^ (np.bitwise_xor.reduce(own) * U(0x9E3779B97F4A7C15)) ^ U(len(own))]))[0] >> U(1)) if len(own) else None)
                    proof.append(int(mix(own ^ U(0xD1B54A32D192ED03)).sum(dtype=U) >> U(1)) if len(own) else None)
                marks.append(sketch(own).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays([part.column("uid"), part.column("key"), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(proof, pa.int64()), pa.array(marks, pa.binary())], ["uid", "key", "n", "cls", "proof", "marks"])

    return rows.mapInArrow(run, f"uid long, key {rows.schema['key'].dataType.simpleString()}, n long, cls long, proof long, marks binary")


def _bands(classes: DataFrame, width: int) -> DataFrame:
    """(band, slot, cls) for every band of every class; slot is the band's number."""
    count = BANDED // width

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.random.Generator(np.random.PCG64(5)).integers(1, 2**63, (count, width), dtype=U) * U(2) + U(1)
        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):
                part = batch.slice(begin, 4096)
                marks = np.frombuffer(b"".join(part.column("marks").to_pylist()), np.uint8).reshape(-1, REGISTERS)[:, : count * width].reshape(-1, count, width)
                keys = mix((mix(marks.astype(U) + base) * base).sum(2, dtype=U) + np.arange(count, dtype=U) * U(0x9E3779B97F4A7C15))
                cls = np.repeat(part.column("cls").to_numpy(), count)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(np.arange(count, dtype=np.int32), len(marks))), pa.array(cls)], ["band", "slot", "cls"])

    return classes.select("cls", "marks").mapInArrow(run, "band long, slot int, cls long")


def _likely(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Of pairs (a, b) those whose sketches leave the threshold possible."""
    mark = lambda side: classes.select(F.col("cls").alias(side), F.col("n").alias(f"n{side}"), F.col("marks").alias(f"m{side}"))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):
                part = batch.slice(begin, 4096)
                sa, sb = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in ("ma", "mb"))
                keep = plausible(sa, sb, part.column("na").to_numpy(), part.column("nb").to_numpy(), least)
                yield part.select(["a", "b"]).filter(pa.array(keep))

    joined = pairs.join(mark("a"), "a").join(mark("b"), "b").where(F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(least * (1 - 1e-12)))
    return joined.select("a", "b", "na", "nb", "ma", "mb").mapInArrow(run, "a long, b long")


def least_of(hashes: np.ndarray) -> np.ndarray:
    """The LEAST least upper halves of a set's hashes, in order."""
    return np.unique((hashes >> U(32)).astype(np.uint32))[:LEAST]


def may_link(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sets may have the similarity, given their least hashes: by an estimate, or nearly exactly where both sets are whole."""
    ordered = np.sort(np.concatenate([a, b]), kind="stable")
    twice = ordered[1:] == ordered[:-1]
    if len(a) < LEAST and len(b) < LEAST:
        both = int(twice.sum())
        return both + 2 >= least * (len(ordered) - both - 2)  # halves that collide change a set by hardly more
    union = np.flatnonzero(np.append(~twice, True))[:LEAST]  # last places of the least values of both together
    both = int(twice[: union[-1]].sum())
    return both / LEAST >= least - 4 * (least * (1 - least) / LEAST) ** 0.5


def _across(left: DataFrame, classes: DataFrame, bodies: DataFrame, k: int, least: float, width: int) -> DataFrame:
    """Plausible pairs (a, b) of different components that share a bucket, each from the first bucket that it shares.

    ``left`` has (band, slot, cls, part). Classes stay in blocks of bounded size, and the others of their bucket stream by; a
    hot bucket is spread over many blocks. Only pairs that pass the sketches, and then the least hashes of both sets, leave, so that few leave that are no links.
    """
    count = BANDED // width

    @trimmed
    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            hashes, at = shingles(texts, k)
            yield pa.RecordBatch.from_arrays([part.column("cls"), pa.array([least_of(hashes[at[i] : at[i + 1]]).tobytes() for i in range(len(texts))], pa.binary())], ["cls", "least"])

    needed = left.select("cls").distinct()
    known = bodies.join(needed, "cls", "left_semi").mapInArrow(shrink, "cls long, least binary").join(classes.select("cls", "n", "marks"), "cls")
    total = left.count()
    sweep(left.sparkSession)
    sized = left.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("many"))
    dealt = spread_join(left, sized, ["band"], "many", F.col("cls"), total, largest=total).drop("many").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    stay = dealt.withColumn("block", F.col("own")).withColumn("stays", F.lit(True))
    pass_by = dealt.where("blocks > 1").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("own") - 1))).where("own > 0").withColumn("stays", F.lit(False))
    ordered = stay.unionByName(pass_by).join(known, "cls").repartition("band", "block").sortWithinPartitions("band", "block", F.col("stays").desc())

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, here = None, None
        for batch in batches:
            for small in range(0, batch.num_rows, 128):
                part = batch.slice(small, 128)
                tags = list(zip(*(part.column(c).to_pylist() for c in ("band", "block", "stays")), strict=True))
                cuts = [0, *(i for i in range(1, len(tags)) if tags[i] != tags[i - 1]), len(tags)]
                for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                    piece = part.slice(begin, end - begin)
                    group = {c: piece.column(c).to_numpy() for c in ("cls", "part", "own", "n", "slot")}
                    group["marks"] = np.frombuffer(b"".join(piece.column("marks").to_pylist()), np.uint8).reshape(-1, REGISTERS)
                    group["least"] = np.array([*map(_halves, piece.column("least").to_pylist()), None], object)[:-1]
                    *tag, stays = tags[begin]
                    own = None  # pairs inside the block come from its rows against those before them
                    if stays:
                        here, own = ({c: np.concatenate([here[c], group[c]]) for c in group}, len(here["cls"])) if at == tag else (group, 0)
                        at = tag
                    if at == tag:
                        a, b = pairs(group, here, own)
                        if len(a):
                            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def pairs(v: dict, r: dict, own: int | None) -> tuple[np.ndarray, np.ndarray]:
        ok = (v["part"][:, None] != r["part"]) & (np.minimum(v["n"][:, None], r["n"]) >= least * (1 - 1e-12) * np.maximum(v["n"][:, None], r["n"]))
        if own is not None:
            ok &= own + np.arange(len(v["cls"]))[:, None] > np.arange(len(r["cls"]))
        i, j = np.nonzero(ok)
        found = []
        for some in range(0, len(i), 8192):
            p, q = i[some : some + 8192], j[some : some + 8192]
            ma, mb = v["marks"][p], r["marks"][q]
            same = (ma[:, : count * width] == mb[:, : count * width]).reshape(-1, count, width).all(2)
            ok = np.flatnonzero(same.argmax(1) == r["slot"][q])
            ok = ok[plausible(ma[ok], mb[ok], v["n"][p[ok]], r["n"][q[ok]], least)]
            found += [(x, y) for x, y in zip(p[ok].tolist(), q[ok].tolist(), strict=True) if may_link(v["least"][x], r["least"][y], least)]
        x, y = (np.array([f[k] for f in found], np.int64) for k in (0, 1))
        return v["cls"][x], r["cls"][y]

    return ordered.select("band", "block", "stays", "cls", "part", "own", "n", "slot", "marks", "least").mapInArrow(run, "a long, b long")


def _halves(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint32)


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Of pairs (a, b) those with den * intersection >= num * union on their full shingle sets.

    The members of a star travel to its centre, in groups of about STAR, and are compared as they stream by.
    """
    total = pairs.count()
    sweep(pairs.sparkSession)
    sized = spread_join(pairs, pairs.groupBy("a").agg(F.count("*").alias("many")), ["a"], "many", F.col("b"), total, largest=total)
    salt = F.pmod(F.xxhash64("b"), F.ceil(F.col("many") / STAR)).cast("long")
    members = sized.select("a", salt.alias("salt"), F.col("b").alias("cls"), F.lit(False).alias("centre"))
    centres = members.select("a", "salt").distinct().select("a", "salt", F.col("a").alias("cls"), F.lit(True).alias("centre"))
    told = members.unionByName(centres).join(texts, "cls")
    ordered = told.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("centre").desc())

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in batches:
            for part, bodies in slices([batch]):
                hashes, bounds = shingles(bodies, k)
                found = []
                for i, (a, salt, cls, centre) in enumerate(zip(*(part.column(c).to_pylist() for c in ("a", "salt", "cls", "centre")), strict=True)):
                    mine = np.unique(hashes[bounds[i] : bounds[i + 1]])
                    if centre:
                        at, own = (a, salt), mine
                    elif at == (a, salt):
                        both = len(np.intersect1d(own, mine, assume_unique=True))
                        if den * both >= num * (len(own) + len(mine) - both):
                            found.append((a, cls))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    return ordered.select("a", "salt", "cls", "centre", "text").mapInArrow(run, "a long, b long")


@trimmed
def _deflated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in slices(batches):
        yield pa.RecordBatch.from_arrays([part.column("uid"), pa.array([zlib.compress(t or b"", 5) for t in texts], pa.binary())], ["uid", "body"])


@trimmed
def _inflated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, 256):
            part = batch.slice(begin, 256)
            yield pa.RecordBatch.from_arrays([part.column("uid"), pa.array([zlib.decompress(b).decode() for b in part.column("body").to_pylist()], pa.string())], ["cls", "text"])


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(uid, key, n_shingles, component_id, kept, chosen) for every row; links need den * intersection >= num * union.

    Texts are lower-cased (A-Z) and cut into words at ASCII white space; a set holds the distinct runs of k words,
    or the whole of fewer. Null, empty and blank texts have no set, link with nothing and keep their own key as component. A component's
    id is the least key in it; ``kept`` marks the rows that have it. Rows with a null key take part and are
    never kept; where nothing else is in a component, its id is null. ``chosen`` marks exactly one row of each component (of those that tie in
    the key, the first by row number), and every row without a set. Repeated rows link with one another. Texts of any length are sketched and compared whole. An
    empty table gives an empty one; other columns are not read.
    """
    spark, least, width = docs.sparkSession, num / den, band_width(num / den)
    rows = with_uid(docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text")))
    marked = stash(_sketched(rows, k), packed=True)
    named = marked.where("n > 0")
    # rows with equal sets (two hashes of the set together: some 2**126 values) are one class, which goes by its first row's number
    best = F.struct(F.col("key").isNull().alias("blank"), "key", "uid")
    kinds = stash(named.groupBy("cls", "proof").agg(F.min("uid").alias("node"), F.count("*").alias("rows"), F.min("key").alias("least"), F.min(best).alias("best")))
    classes = stash(named.join(kinds.select(F.col("node").alias("uid")), "uid", "left_semi").select(F.col("uid").alias("cls"), "n", "marks"), packed=True)
    sizes = kinds.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.max("rows"), F.lit(0))).first()
    bands = _bands(classes, width)
    shared = bands.groupBy("band").agg(F.count("*").alias("many")).where("many > 1")
    # only classes that share a bucket go on; hot buckets are dealt to several tasks
    entries = sizes[0] * (BANDED // width)
    members = stash(spread_join(bands, shared, ["band"], "many", F.col("cls"), entries, largest=sizes[0]))
    largest = members.agg(F.coalesce(F.max("many"), F.lit(0))).first()[0]
    sweep(spark)
    # the class that meets most others is the likeliest to be what they are copies of
    score = members.groupBy("cls").agg(F.sum("many").alias("score"))
    buckets = stash(members.select("band", "slot", "cls").join(score, "cls"))
    centre = buckets.groupBy("band").agg(F.max(F.struct("score", "cls"))["cls"].alias("top"), F.min("cls").alias("low"), F.count("*").alias("many"))
    stars = spread_join(buckets.select("band", "cls"), centre, ["band"], "many", F.col("cls"), entries, largest=largest)
    tried = stash(stars.select(F.col("top").alias("a"), F.col("cls").alias("b")).unionAll(stars.select(F.col("low").alias("a"), F.col("cls").alias("b"))).where("a <> b").distinct())
    sweep(spark)
    likely = stash(_likely(tried, classes, least))
    sweep(spark)
    needed = buckets.select(F.col("cls").alias("uid")).distinct()
    # all texts are shuffled to find these: as compressed bytes
    told = rows.select("uid", "text").mapInArrow(_deflated, "uid long, body binary").join(needed, "uid", "left_semi")
    bodies = stash(told.mapInArrow(_inflated, "cls long, text string"), packed=True)
    sweep(spark)
    links = stash(_confirmed(likely, bodies, k, num, den))
    parts = components(links)
    sweep(spark)
    # buckets that still hold several components: all pairs between different ones
    placed = buckets.select("band", "slot", "cls").join(parts, F.col("cls") == F.col("node"), "left").select("band", "slot", "cls", F.coalesce("root", "cls").alias("part"))
    mixed = placed.groupBy("band").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("many")).where("low < high").select("band", "many")
    across = _across(stash(spread_join(placed, mixed, ["band"], "many", F.col("cls"), entries, largest=largest).drop("many")), classes, bodies, k, least, width)
    met = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = stash(across.distinct().join(met, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        parts = components(links.unionAll(stash(_confirmed(more, bodies, k, num, den))))
    sweep(spark)
    # components of classes first, then of rows, so that only one join has a row for each document
    told = kinds.join(parts.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left").withColumn("part", F.coalesce("root", "node")).select("cls", "proof", "node", "rows", "least", "best", "part")
    whole = told.groupBy("part").agg(F.min("least").alias("component"), F.min("best")["uid"].alias("one"), F.count("*").alias("classes"))
    final = spread_join(told.select("cls", "proof", "node", "rows", "part"), whole, ["part"], "classes", F.col("node"), sizes[0], largest=sizes[0]).select("cls", "proof", "rows", "component", "one")
    found = spread_join(named.select("uid", "key", "n", "cls", "proof"), final, ["cls", "proof"], "rows", F.col("uid"), sizes[1], largest=sizes[2])
    with_set = found.select("uid", F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("key") == F.col("component"), F.lit(False)).alias("kept"), (F.col("uid") == F.col("one")).alias("chosen"))
    without = marked.where("n = 0").select("uid", F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("key").alias("component_id"), F.col("key").isNotNull().alias("kept"), F.lit(True).alias("chosen"))
    return with_set.unionByName(without)


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, num=85, den=100).drop("uid", "chosen")


OP1_SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[t.s + 1:t.s + 3], ' ') AS k FROM d, unnest(range(0, CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - 2, 1) END)) AS t(s)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM shingles a JOIN shingles b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * i >= 85 * (a.n + b.n - i)),
edges AS (SELECT x AS a, y AS b FROM links UNION ALL SELECT y, x FROM links),
reached AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM reached r JOIN edges e ON r.b = e.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least AS component_id, d.doc_id = least AS kept FROM d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a, min(b) AS least FROM reached GROUP BY a) r ON r.a = d.doc_id"""
