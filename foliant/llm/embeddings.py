"""Embedding near-duplicates through an inverted multi-index.

Each half of the vectors has a codebook of its own; a vector's cell is the pair of its nearest
centroids. Searching, a vector visits cells by increasing sum of its two half distances (the multi-sequence
order) until the share of neighbours at the threshold that must be found is reached; how many cells that takes
is measured on the sample, with neighbours made right at the threshold, the hardest there are. Every
candidate is verified by its cosine in double precision. Vectors compare only within their label.

Codebooks grow with the square root of the number of vectors of a label, each size of vectors has its own, and they are fitted on
a sample of EACH vectors for every centroid, at most EACH * CENTROIDS = 65,536 for a size; all rows are indexed and all
rows search. A grid of CENTROIDS squared is full at some two billion vectors of a label; beyond, cells hold more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread_join, stash, table, with_uid
from .graph import components

LEAST, RECALL = 0.93, 0.98
#: Centroids of a codebook at most; sampled vectors for each centroid, and in any case (of the largest size of vectors).
CENTROIDS, EACH, SAMPLE = 4096, 16, 4000
#: Vectors of a cell and label that the size of the codebooks aims at; residents of a block; visitors of one.
FILL, RESIDENTS, VISITORS = 128, 2048, 16_384


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = (x.shape[1] + 1) // 2
    return x[:, :cut], x[:, cut:]


def codebook(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means by Lloyd's rounds; an empty centroid stays where it is."""
    centres = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))]
    for _ in range(10):
        norms = (centres**2).sum(1)
        near = np.concatenate([(norms - 2 * x[i : i + 2048] @ centres.T).argmin(1) for i in range(0, len(x), 2048)])
        order = np.argsort(near, kind="stable")
        begins = np.searchsorted(near[order], np.arange(len(centres)))
        full = np.flatnonzero(np.diff(np.append(begins, len(x))))
        sums = np.add.reduceat(x[order], begins[full], axis=0)
        centres = centres.copy()
        centres[full] = sums / np.diff(np.append(begins, len(x)))[full, None]
    return centres


class Index:
    """Codebooks of one dimension, and how many cells a search visits."""

    def __init__(self, sample: np.ndarray, k: int, least: float, recall: float):
        rng = np.random.Generator(np.random.PCG64(3))
        self.books = tuple(codebook(h, k, rng) for h in halves(sample))
        self.columns = len(self.books[1])
        cells = len(self.books[0]) * self.columns
        # neighbours at exactly the threshold, in random directions
        x = sample[:4000]
        aside = rng.normal(size=x.shape)
        aside -= (aside * x).sum(1, keepdims=True) * x
        y = least * x + np.sqrt(max(0.0, 1 - least * least)) * aside / np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-12)
        rank = np.minimum(self._rank(x, y), self._rank(y, x))
        self.visits = int(min(cells, 1 + np.quantile(rank, recall, method="higher")))

    def _far(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.maximum((h * h).sum(1)[:, None] + (b * b).sum(1) - 2 * h @ b.T, 0) for h, b in zip(halves(x), self.books, strict=True))

    def _rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many cells x visits before y's."""
        first, second = self._far(x)
        i, j = (d.argmin(1) for d in self._far(y))
        at, n = first[np.arange(len(x)), i] + second[np.arange(len(x)), j], np.zeros(len(x), np.int64)
        for row in first.T:
            n += (row[:, None] + second < at[:, None]).sum(1)
        return n

    def visit(self, x: np.ndarray) -> np.ndarray:
        """[vectors, visits]: cells in multi-sequence order, the own one first.

        With both halves' centroids sorted by distance, the k-th nearest cell is at places (i, j) with
        (i + 1) * (j + 1) <= k: only those are looked at.
        """
        orders = []
        for far in self._far(x):
            few = np.argpartition(far, self.visits - 1, axis=1)[:, : self.visits] if self.visits < far.shape[1] else np.tile(np.arange(far.shape[1]), (len(x), 1))
            orders.append((far, np.take_along_axis(few, np.argsort(np.take_along_axis(far, few, 1), axis=1, kind="stable"), 1)))
        (first, order1), (second, order2) = orders
        first, second = np.take_along_axis(first, order1, 1), np.take_along_axis(second, order2, 1)
        i, j = np.array([(a, b) for a in range(order1.shape[1]) for b in range(order2.shape[1]) if (a + 1) * (b + 1) <= self.visits], np.int64).T
        best = np.argsort(first[:, i] + second[:, j], axis=1, kind="stable")[:, : self.visits]
        rows = np.arange(len(x))[:, None]
        return order1[rows, i[best]] * self.columns + order2[rows, j[best]]


def unit(payloads: list[bytes], size: int, kind: str) -> np.ndarray:
    """Vectors of length 1 in double precision out of their bytes (kind f4 or f8)."""
    x = np.frombuffer(b"".join(payloads), kind).reshape(-1, size).astype(np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def links(v: dict[str, np.ndarray], r: dict[str, np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of visitors and residents that link here: class, number of links (with copies), least class of their component here.

    Cell by cell, the visitors that search it meet its residents. A pair counts if the visitor's search reaches the
    resident's cell; if the resident's reaches the visitor's as well, only at the search of the lower class.
    """
    order = np.argsort(r["cell"], kind="stable")
    cells, begins = np.unique(r["cell"][order], return_index=True)
    ends, pairs = np.append(begins[1:], len(order)), []
    for cell, begin, end in zip(cells, begins, ends, strict=True):
        some = np.flatnonzero((v["seen"] == cell).any(1))
        if not len(some):
            continue
        own = order[begin:end]
        i, j = np.nonzero(v["x"][some] @ r["x"][own].T >= least)
        i, j = some[i], own[j]
        back = np.zeros(len(i), bool)
        for at in range(0, len(i), 1 << 17):
            p, q = i[at : at + (1 << 17)], j[at : at + (1 << 17)]
            back[at : at + (1 << 17)] = (r["seen"][q] == v["cell"][p][:, None]).any(1)
        ok = (v["cls"][i] != r["cls"][j]) & ((v["cls"][i] < r["cls"][j]) | ~back)
        pairs.append((i[ok], j[ok]))
    i, j = (np.concatenate([p[k] for p in pairs]) if pairs else np.empty(0, np.int64) for k in (0, 1))
    left, right = v["cls"].copy(), r["cls"].copy()
    while True:
        before = left.copy(), right.copy()
        np.minimum.at(left, i, right[j])
        np.minimum.at(right, j, left[i])
        if (left == before[0]).all() and (right == before[1]).all():
            break
    counts = np.bincount(i, r["copies"][j], len(left)).astype(np.int64), np.bincount(j, v["copies"][i], len(right)).astype(np.int64)
    on = counts[0] > 0, counts[1] > 0
    return tuple(np.concatenate([a[on[0]], b[on[1]]]) for a, b in ((v["cls"], r["cls"]), counts, (left, right)))


def near_vectors(vectors: DataFrame, least: float = LEAST, recall: float = RECALL, key: str = "vec_id", vector: str = "embedding", label: str = "label", fill: int = FILL) -> DataFrame:
    """(uid, key, n_links, component_id, kept) for every row.

    Vectors that are null, empty, zero or hold null or non-finite components, and those without a label, link with nothing.
    Vectors of different sizes do not link. Equal vectors of a label are one class: it searches once and counts for all, so
    copies are never compared among themselves. A component's id is the least key in it; ``kept`` marks rows that
    have it (never a null key), so that of rows that tie in the least key all are kept. Vectors of any length are compared whole. An empty table gives an empty one; other columns are not read.

    A vector goes, once, to each first-half centroid among its cells, where the residents of its cells wait in blocks of
    bounded size; visitors stream by, so that a task holds one block and one batch. Hot blocks are split on both sides.
    Links are counted where they are found (a pair that both sides find counts at the lower id's search);
    of the links themselves only a spanning forest for each block leaves it.
    """
    exact = vectors.schema[vector].dataType.simpleString() == "array<float>"  # then four bytes a component lose nothing
    kind = "<f4" if exact else "<f8"
    rows = with_uid(vectors.select(vectors[key].alias("key"), vectors[vector].cast("array<double>").alias("vector"), vectors[label].cast("string").alias("label")))
    good = F.col("label").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    named = rows.withColumn("good", F.coalesce(good, F.lit(False))).where("good").select("uid", "key", "label", "vector", F.xxhash64("label", "vector").alias("cls"), F.xxhash64(F.lit(1), "vector", "label").alias("proof"))
    # equal vectors of a label (two hashes together: 2**128 values) are one class, which goes by its first row's number
    kinds = stash(named.groupBy("cls", "proof").agg(F.count("*").alias("copies"), F.min("uid").alias("node"), F.min("key").alias("least")))
    first = named.join(kinds.select(F.col("node").alias("uid"), "copies"), "uid").select(F.col("uid").alias("cls"), "copies", "label", "vector")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(kind), np.cumsum([0, *lists.value_lengths().to_pylist()])
            payloads = [flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cls", "copies", "label", "size")), pa.array(payloads, pa.binary())], ["cls", "copies", "label", "size", "payload"])

    # scaled by its largest component, the length of a vector of doubles can neither overflow nor vanish
    scaled = F.col("vector") if exact else F.transform("vector", lambda v: v / F.array_max(F.transform("vector", F.abs)))
    packed = stash(first.select("cls", "copies", "label", F.size("vector").alias("size"), scaled.alias("vector")).mapInArrow(pack, "cls long, copies long, label string, size int, payload binary"))
    books = _books(packed, kind, fill, least, recall)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                part = batch.slice(begin, 1024)
                sizes, payloads = part.column("size").to_pylist(), part.column("payload").to_pylist()
                own, seen, rows = ([None] * len(sizes) for _ in range(3))
                for size in set(sizes):
                    which = [i for i, s in enumerate(sizes) if s == size]
                    index = books.get(size)
                    cells = index.visit(unit([payloads[i] for i in which], size, kind)) if index else np.zeros((len(which), 1), np.int64)
                    for i, found in zip(which, cells, strict=True):
                        places = found // (index.columns if index else 1)
                        own[i], seen[i], rows[i] = int(found[0]), np.sort(found).astype(np.int32).tobytes(), [int(places[0]), *(int(x) for x in np.unique(places) if x != places[0])]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("cls", "copies", "label", "size")), pa.array(own, pa.int32()), pa.array(seen, pa.binary()), pa.array(rows, pa.list_(pa.int32()))], ["cls", "copies", "label", "size", "cell", "seen", "rows"])

    # where vectors live and search, without the vectors themselves: the home row comes first
    routed = stash(packed.mapInArrow(route, "cls long, copies long, label string, size int, cell int, seen binary, rows array<int>"))
    placed = routed.select("cls", "label", "size", F.posexplode("rows").alias("nth", "row")).withColumn("home", F.col("nth") == 0).drop("nth")
    crowd = placed.groupBy("label", "size", "row").agg(F.count_if("home").alias("residents"), F.count("*").alias("visitors")).where("residents > 0")
    crowd = crowd.select("label", "size", "row", "visitors", F.ceil(F.col("residents") / RESIDENTS).cast("int").alias("blocks"), F.ceil(F.col("visitors") / VISITORS).cast("int").alias("flows"))
    met = spread_join(placed, crowd, ["label", "size", "row"], "visitors", F.col("cls"), placed.count())
    share = lambda salt, n: F.pmod(F.xxhash64("cls", F.lit(salt)), F.col(n)).cast("int")
    place = ["label", "size", "row", "block", "flow"]
    at = ["cls", "label", "size", "row", "stays", "block", "flow"]
    visitors = met.select("*", F.lit(False).alias("stays"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), share(1, "flows").alias("flow")).select(*at)
    residents = met.where("home").select("*", F.lit(True).alias("stays"), share(2, "blocks").alias("block"), F.explode(F.sequence(F.lit(0), F.col("flows") - 1)).alias("flow")).select(*at)
    whole = packed.select("cls", "payload").join(routed.select("cls", "copies", "cell", "seen"), "cls")
    ordered = visitors.unionByName(residents).join(whole, "cls").repartition(*place).sortWithinPartitions(*place, F.col("stays").desc())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, here = None, None
        for batch in batches:
            for small in range(0, batch.num_rows, 512):
                part = batch.slice(small, 512)
                tags = list(zip(*(part.column(c).to_pylist() for c in [*place, "stays"]), strict=True))
                cuts = [0, *(i for i in range(1, len(tags)) if tags[i] != tags[i - 1]), len(tags)]
                for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                    *tag, stays = tags[begin]
                    group = _loaded(part.slice(begin, end - begin), tag[1], kind)
                    if stays:  # a block may come in several pieces
                        here = {c: np.concatenate([here[c], group[c]]) for c in group} if at == tag else group
                        at = tag
                    elif at == tag:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in links(group, here, least)], ["cls", "links", "root"])

    found = stash(ordered.select(*place, "stays", "cls", "copies", "cell", "payload", "seen").mapInArrow(search, "cls long, links long, root long"))
    parts = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    degree = found.groupBy(F.col("cls").alias("d")).agg(F.sum("links").alias("links"))
    # components of classes first, then of rows, so that only one join has a row for each vector
    told = kinds.join(degree, F.col("node") == F.col("d"), "left").join(parts.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left")
    told = told.select("cls", "proof", "node", "copies", "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("root", "node").alias("part"))
    ids = told.groupBy("part").agg(F.min("least").alias("component"), F.count("*").alias("classes"))
    sizes = kinds.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    final = spread_join(told.drop("least"), ids, ["part"], "classes", F.col("node"), sizes[0]).select("cls", "proof", "copies", "n", "component")
    joined = spread_join(named.select("uid", "key", "cls", "proof"), final, ["cls", "proof"], "copies", F.col("uid"), sizes[1])
    linked = joined.select("uid", F.col("key").alias(key), F.col("n").cast("long").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("key") == F.col("component"), F.lit(False)).alias("kept"))
    alone = rows.where(~F.coalesce(good, F.lit(False))).select("uid", F.col("key").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"), F.col("key").isNotNull().alias("kept"))
    return linked.unionByName(alone)


def _books(packed: DataFrame, kind: str, fill: int, least: float, recall: float) -> dict[int, Index]:
    """An index for each size of vectors that fills more than one cell, fitted on a sample by hash; sizes without one have a single cell."""
    sizes = packed.groupBy("size").agg(F.count("*").alias("n"), F.approx_count_distinct("label").alias("labels")).where("size > 1").collect()
    total, wanted = sum(r["n"] for r in sizes), {}
    for r in sizes:
        k = int(min(CENTROIDS, round((r["n"] / max(1, r["labels"]) / fill) ** 0.5)))
        if k > 1:
            wanted[r["size"]] = (k, min(1.0, max(EACH * k, SAMPLE * r["n"] // total) / r["n"]))
    if not wanted:
        return {}
    share = F.create_map(*[F.lit(x) for size, (_, part) in wanted.items() for x in (size, int(part * (1 << 30)))])[F.col("size")]
    drawn: dict[int, list] = {}
    for r in packed.where(F.pmod(F.xxhash64(F.lit(7), "cls"), F.lit(1 << 30)) < share).select("size", "cls", "payload").collect():
        drawn.setdefault(r["size"], []).append((r["cls"], r["payload"]))
    return {size: Index(unit([p for _, p in sorted(found)], size, kind), wanted[size][0], least, recall) for size, found in drawn.items()}


def _loaded(part: pa.RecordBatch, size: int, kind: str) -> dict[str, np.ndarray]:
    group = {c: part.column(c).to_numpy() for c in ("cls", "copies", "cell")}
    return group | {"x": unit(part.column("payload").to_pylist(), size, kind), "seen": np.stack([np.frombuffer(s, np.int32) for s in part.column("seen").to_pylist()])}


def op8_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings")).drop("uid")


OP8_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
good AS (SELECT vec_id, label, x, sqrt(list_sum(list_transform(x, lambda c: c * c))) AS size FROM v WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id WHERE list_dot_product(a.x, b.x) / (a.size * b.size) >= 0.93),
reached AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, least AS component_id, v.vec_id = least AS kept FROM v LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) c ON c.a = v.vec_id JOIN (SELECT a, min(b) AS least FROM reached GROUP BY a) r ON r.a = v.vec_id"""
