"""Document quality from random-indexing word vectors and a small network.

Every token has a sparse ternary index vector, derived from its hash. A token's word vector is the sum of
the index vectors of its neighbours in the training sample; tokens never seen there keep their index vector.
Vectors are pooled per document, once over words and once over word shapes (kind of characters, case,
length), next to a few plain ratios. A two-layer network scores the pooled vector; its temperature
is fitted on rows that it was not trained on, so that scores are calibrated probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import release, slices, table, trimmed
from .wordhash import _CODES, mix, powers

U = np.uint64
BUCKETS, SIZE, SHAPES, NONZERO = 1 << 14, 48, 512, 4
#: Plain ratios next to the pooled vectors.
RATIOS = 8
#: The fit takes at most so many labelled rows, those least by a hash of their id. Word vectors are learned from a span of so many characters of
#: each, at a place by hash; the network is fitted on the features of whole texts.
SAMPLE_ROWS, SPAN_CHARS = 2500, 12_000
HIDDEN, EPOCHS, RATE, DECAY = 24, 300, 0.01, 1e-4
THRESHOLD = 0.3

_KIND = np.full(256, 3, np.uint8)  # 0 white space, 1 letter (and all bytes beyond ASCII), 2 digit, 3 other
_KIND[[32, 9, 10, 11, 12, 13]] = 0
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_LINE = np.zeros(256, np.int64)
_LINE[10] = 1
_BASE = U(0x9E3779B97F4A7C15)


def tokens(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts together: bucket, shape and hash of each token, and bounds by text."""
    raw = np.frombuffer(b"\n".join(t or b"" for t in texts) + b"\n", np.uint8)
    kind = _KIND[raw]
    change = np.flatnonzero(np.diff(kind, prepend=np.uint8(9), append=np.uint8(9)))
    begins, ends = change[:-1], change[1:]
    inside = kind[begins] > 0
    begins, ends = begins[inside], ends[inside]
    power, inverse = powers(_BASE, len(raw) + 1)
    total = np.zeros(len(raw) + 1, U)
    np.cumsum(_CODES[raw] * power[: len(raw)], out=total[1:])
    hashes = mix((total[ends] - total[begins]) * inverse[begins]) if len(begins) else np.empty(0, U)
    upper = np.concatenate([[0], np.cumsum(_UPPER[raw])])
    length, capitals = ends - begins, upper[ends] - upper[begins]
    case = np.where(capitals == 0, 0, np.where((capitals >= length - 1) & (length > 1), 3, np.where(_UPPER[raw[begins]] == 1, 1, 2))) if len(begins) else np.empty(0, np.int64)
    glued = np.append(begins[1:] == ends[:-1], False) if len(begins) else np.empty(0, bool)
    what = kind[begins].astype(np.int64)
    plain = (((what - 1) * 4 + case) * 8 + np.minimum(length, 15) // 2) * 2 + glued  # below 192
    marks = 192 + (raw[begins] % 64).astype(np.int64) * 4 + np.minimum(length, 4) - 1  # a run of other characters: its first and its length
    shape = np.where(what == 3, marks, plain)
    at = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
    return (hashes >> U(50)).astype(np.int64), shape, hashes, np.searchsorted(begins, at)


def index_vectors(n: int, seed: int) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(seed))
    out = np.zeros((n, SIZE), np.float32)
    for _ in range(NONZERO):
        out[np.arange(n), rng.integers(0, SIZE, n)] += rng.choice([-1.0, 1.0], n)
    return out


def learn_vectors(ids: np.ndarray, bounds: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Word vectors: sums of the neighbours' index vectors at distances 1 and 2 inside a text, frequent neighbours damped, scaled to length 1."""
    index = index_vectors(n, seed)
    damped = index / np.sqrt(1 + np.bincount(ids, minlength=n)).astype(np.float32)[:, None]
    text = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    sums = np.zeros((n, SIZE), np.float32)
    for begin in range(0, len(ids), 1 << 16):  # bounds the gathered rows
        for far in (1, 2):
            left = slice(max(begin, far), min(len(ids), begin + (1 << 16)))
            here, there = np.arange(left.start, left.stop), np.arange(left.start, left.stop) - far
            same = text[here] == text[there]
            for a, b in ((here[same], there[same]), (there[same], here[same])):
                order = np.argsort(ids[a], kind="stable")
                words, first = np.unique(ids[a][order], return_index=True)
                if len(words):
                    sums[words] += np.add.reduceat(damped[ids[b[order]]], first, axis=0)
    sums = np.where(np.abs(sums).sum(1, keepdims=True) > 0, sums, index)
    return sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    words: np.ndarray
    shapes: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def pooled(self, texts: list) -> np.ndarray:
        """[texts, features]"""
        ids, shape, hashes, bounds = tokens(texts)
        out = np.zeros((len(texts), 2 * SIZE + RATIOS), np.float32)
        for i, text in enumerate(texts):
            a, b = int(bounds[i]), int(bounds[i + 1])
            if a == b:
                continue
            n = b - a
            for begin in range(a, b, 1 << 15):  # bounds the gathered rows of a long text
                out[i, :SIZE] += self.words[ids[begin : min(b, begin + (1 << 15))]].sum(0)
            counts = np.bincount(shape[a:b], minlength=SHAPES).astype(np.float32)
            out[i, SIZE : 2 * SIZE] = counts @ self.shapes
            out[i, : 2 * SIZE] /= n
            own = hashes[a:b]
            lines = text.split(b"\n")
            out[i, 2 * SIZE :] = (np.log1p(n), len(np.unique(own)) / n ** 0.8, len(set(lines)) / len(lines), counts[192:].sum() / n, counts[:192].reshape(3, 4, -1)[:, 3].sum() / n, len(text) / n / 8, (own[1:] == own[:-1]).sum() / n, (own[2:] == own[:-2]).sum() / n)
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, texts: list) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(self.pooled(texts).astype(np.float64)) / self.temperature, -35, 35)))


def vectors(texts: list) -> Model:
    """A model that has learned word and shape vectors from these texts, and knows nothing else yet."""
    parts, at = [], 0
    while at < len(texts):  # slices bound the byte arrays
        stop, held = at, 0
        while stop < len(texts) and (stop == at or held < 1 << 19):
            held += len(texts[stop] or b"")
            stop += 1
        ids, shape, _, bounds = tokens(texts[at:stop])
        parts.append((ids.astype(np.int16), shape.astype(np.int16), np.diff(bounds)))  # BUCKETS and SHAPES fit
        at = stop
    ids = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.int16)
    shape = np.concatenate([p[1] for p in parts]) if parts else np.empty(0, np.int16)
    bounds = np.cumsum(np.concatenate([[0], *(p[2] for p in parts)]).astype(np.int64))
    return Model(learn_vectors(ids, bounds, BUCKETS, 1), learn_vectors(shape, bounds, SHAPES, 2), np.zeros(1), np.ones(1), np.zeros((2 * SIZE + RATIOS, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0, 1.0)


def fit(model: Model, x: np.ndarray, quality: np.ndarray, checked: np.ndarray) -> Model:
    """Trains the network on the pooled vectors ``x`` of the rows that are not ``checked`` and fits the temperature on those that are.

    Without rows of both labels the score is the share of label 1, or one half without any row.
    """
    if len(set(quality[~checked])) < 2:
        share = (quality.sum() + 1) / (len(quality) + 2)
        model.b2 = float(np.log(share / (1 - share)))
        return model
    x = x.astype(np.float64)
    model.mean, model.scale = x[~checked].mean(0), x[~checked].std(0) + 1e-3
    rng = np.random.Generator(np.random.PCG64(7))
    z, y = (x - model.mean) / model.scale, quality.astype(np.float64)
    weights = {"w1": rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), "b2": np.array(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))}
    first, second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    zt, yt = z[~checked], y[~checked]
    for step in range(1, EPOCHS + 1):
        h = np.tanh(zt @ weights["w1"] + weights["b1"])
        error = (1 / (1 + np.exp(-np.clip(h @ weights["w2"] + weights["b2"], -35, 35))) - yt) / len(yt)
        back = np.outer(error, weights["w2"]) * (1 - h * h)
        grads = {"w1": zt.T @ back + DECAY * weights["w1"], "b1": back.sum(0), "w2": h.T @ error + DECAY * weights["w2"], "b2": error.sum()}
        for k, g in grads.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            weights[k] = weights[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    model.w1, model.b1, model.w2, model.b2 = weights["w1"], weights["b1"], weights["w2"], float(weights["b2"])
    if checked.any():
        logit, yc = model.logits(x[checked]), y[checked]
        loss = lambda t: np.mean(np.logaddexp(0, -np.where(yc == 1, logit, -logit) / t))
        model.temperature = float(min(np.geomspace(0.5, 8, 81), key=loss))
    return model


def fold(key: Column) -> Column:
    return F.crc32(key.cast("string")) % 5


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, span: int = SPAN_CHARS, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Fits a model on a bounded sample of the labelled rows whose fold is not 0; fold 1 fits the temperature.

    ``rows`` bounds the sample, whatever the length of its texts: word vectors are learned on the driver from a span of ``span`` characters
    of each, features are pooled from the whole texts where these are. Null labels, keys and texts are not learned from, empty texts are; a key with
    two labels counts as the lower, one with several texts as the least of them. Without labelled rows every score is one half. Other columns are not read.
    """
    known = labels.select(labels[key].alias("k"), labels[label].cast("int").alias("y")).where("k IS NOT NULL AND y IN (0, 1)").where(fold(F.col("k")) != 0)
    chosen = known.groupBy("k").agg(F.min("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(rows)
    chosen = docs.sparkSession.createDataFrame(chosen.toArrow(), chosen.schema)  # at most `rows` rows; from Arrow, as rows of a list go through Python workers
    held = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text")).where("text IS NOT NULL")
    found = held.join(F.broadcast(chosen), F.col("key") == F.col("k")).select("key", "text", "y", (fold(F.col("key")) == 1).alias("checked"))
    begin = F.pmod(F.xxhash64("key"), F.greatest(F.length("text") - span, F.lit(0)) + 1).cast("int") + 1
    cut = found.groupBy("key").agg(F.min(F.struct(F.xxhash64("text"), F.substring("text", begin, F.lit(span)).alias("span")))["span"].alias("span")).collect()
    model = vectors([r["span"].encode() for r in sorted(cut, key=lambda r: r["key"])])
    del cut
    release()  # the driver goes on for long

    @trimmed
    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for part, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("key", "mark", "y", "checked")), pa.array([x.tobytes() for x in model.pooled(texts)], pa.binary())], ["key", "mark", "y", "checked", "x"])

    kind = found.schema["key"].dataType.simpleString()
    pooled = found.withColumn("mark", F.xxhash64("text")).select("key", "mark", "text", "y", "checked").mapInArrow(pool, f"key {kind}, mark long, y int, checked boolean, x binary")
    sample = sorted(pooled.groupBy("key").agg(F.min(F.struct("mark", "y", "checked", "x")).alias("r")).collect(), key=lambda r: r["key"])
    x = np.stack([np.frombuffer(r["r"]["x"], np.float32) for r in sample]) if sample else np.empty((0, 2 * SIZE + RATIOS), np.float32)
    return fit(model, x, np.array([r["r"]["y"] for r in sample], np.int64), np.array([r["r"]["checked"] for r in sample], bool))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """All columns and rows of ``docs`` with a score from 0 to 1; null and empty texts are scored like any other, very long ones are read whole.

    One scan, no shuffle; texts go to Python once, in their own column if that is of strings; scores depend on the text alone, so that repeated texts tie. A column of docs that has the score's name is replaced;
    no other name clashes, as columns go by number while they are scored. An empty table gives an empty one.
    """
    kept = [c for c in docs.columns if c != name]
    own = text in kept and isinstance(docs.schema[text].dataType, StringType)
    read = f"c{kept.index(text) if own else len(kept)}"

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for part, texts in slices(batches, read):
            found = pa.array(model.scores(texts), pa.float64())
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), found], [*kept, name])

    schema = docs.select(*[docs[c] for c in kept]).withColumn(name, F.lit(0.0)).schema
    added = [] if own else [docs[text].cast("string").alias(read)]
    return docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(kept)], *added).mapInArrow(run, schema)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
