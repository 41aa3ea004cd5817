"""Repeated passages: phrases confirmed by counting, then located by sharded Aho-Corasick automata.

A window is a run of consecutive words of one document. Every window has an anchor, the least-hashed
short run of words in it, at a place that depends on the window's words alone: equal windows have equal
anchors. Neighbouring windows with their anchor at the same place form a stretch.

1. Stretches are counted by anchor over the whole corpus. An anchor met once rules out all its windows.
   A stretch whose words recur as a whole is a phrase. Where stretches of an anchor differ (at the ends of passages), the windows
   of those met once, and of the first of each that recurs, are counted; those met again are phrases. Neighbours that always meet are one phrase.
2. A confirmed phrase is taken, once, from the first document that has it, as words. Documents are dealt into shards; a shard
   is sent the phrases that were sighted in it, each once, compiles them into an automaton over words
   (pyahocorasick), and streams its documents through it. Only what the automaton finds is marked. Documents without any recurring
   anchor can hold no phrase and need no automaton.

So each automaton has the phrases that can occur in its shard, and is bounded by the shard's
size, whatever the size of the corpus. Hashes only lead to phrases; the automaton compares words.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, slices, spread_join, stash, table, trimmed, with_uid
from .wordhash import span_sums, spans, words_of

U = np.uint64
WINDOW, ANCHOR = 35, 10
#: Text bytes of a shard, about (a longer text has most of one to itself), and of what is looked at together.
SHARD_BYTES, RUN_BYTES = 4 << 20, 1 << 20
#: Words of patterns in one automaton.
NODES = 1_500_000
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def stretches(h: np.ndarray, bounds: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Of each stretch: its text, anchor hash, hash of all its words, first window (word in the text) and number of windows."""
    counts = np.maximum(np.diff(bounds) - window + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    empty = np.empty(0, np.int64)
    if not len(text):
        return empty, empty.view(U), empty.view(U), empty, empty
    begin = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + bounds[text]
    sums = span_sums(h)
    at = np.arange(len(h) - anchor + 1)
    grams = spans(sums, at, at + anchor)
    # the least of the window's grams by the hash's upper half; of equal ones the first
    least, have, wide = (grams & U(0xFFFFFFFF00000000)) | at.astype(U), 1, window - anchor + 1
    while 2 * have <= wide:
        least, have = np.minimum(least[: len(least) - have], least[have:]), 2 * have
    if have < wide:
        least = np.minimum(least[: len(least) - (wide - have)], least[wide - have :])
    place = (least[begin] & U(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    many = np.diff(np.append(first, len(place)))
    starts = begin[first]
    return text[first], grams[place[first]], spans(sums, starts, starts + many - 1 + window), starts - bounds[text[first]], many


def _stretch_rows(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            text, anchors, whole, starts, many = stretches(*words_of(texts), window, anchor)
            uid = part.column("uid").to_numpy()[text]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchors.view(np.int64), whole.view(np.int64), uid, starts * 64 + many)], ["anchor", "whole", "uid", "place"])

    return rows.select("uid", "text").mapInArrow(run, "anchor long, whole long, uid long, place long")


def sightings(sums: np.ndarray, base: int, whole: np.ndarray, unlike: np.ndarray, window: int) -> np.ndarray:
    """[phrases, 2] of a document: hash and place, in order of place, stretches first.

    ``whole`` are places of stretches that recur as wholes, ``unlike`` those whose windows are tried one by one. Window phrases and
    stretch phrases have hashes of their own.
    """
    parts = []
    many = unlike % 64
    starts = np.sort(np.repeat(unlike // 64, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
    for places, kind in ((np.sort(whole), U(0)), (starts * 64 + 1, U(0x5851F42D4C957F2D))):
        start, step = places // 64, places % 64
        hashes = (spans(sums, base + start, base + start + step - 1 + window) ^ kind).view(np.int64)
        parts.append(np.stack([hashes, places], 1))
    return np.concatenate(parts)


def followers(uid: np.ndarray, phrase: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The phrase that begins where each one's windows end, in the same document; 0 without one."""
    joined = np.append((uid[1:] == uid[:-1]) & (place[1:] // 64 == (place // 64 + place % 64)[:-1]), False) if len(uid) else np.empty(0, bool)
    return np.where(joined, np.roll(phrase, -1), 0)


def chains(phrases: list[dict], window: int) -> list[tuple[int, int, list[int], int]]:
    """(begin, end, phrases, shards) of the runs that one document gives.

    A phrase and its neighbour are one run if the one is always followed by the other, and both are met equally often: then
    they are never met apart.
    """
    out: list[tuple[int, int, list[int], int]] = []
    last = None
    for p in sorted(phrases, key=lambda p: (p["place"] % 64 == 1, p["place"])):
        start, step = divmod(p["place"], 64)
        if last and last["following"] == p["phrase"] and last["n"] == p["n"] and last["place"] // 64 + last["place"] % 64 == start:
            begin, _, known, most = out[-1]
            out[-1] = (begin, start + step - 1 + window, known + [p["phrase"]], max(most, p["shards"]))
        else:
            out.append((start, start + step - 1 + window, [p["phrase"]], p["shards"]))
        last = p
    return out


def covered_by(begins: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, begins, 1)
    np.add.at(marks, ends, -1)
    return np.cumsum(marks[:n]) > 0


class Passages:
    """Aho-Corasick automata over words for the phrases of one shard.

    Words get numbers shard by shard. Beyond NODES words the phrases make several automata, of which one is in memory at a time.
    """

    def __init__(self, phrases: list[bytes]):
        self.number: dict[bytes, int] = {}
        self.parts: list[list[tuple[int, ...]]] = [[]]
        held = 0
        for text in phrases:
            words = tuple([self.number.setdefault(w, len(self.number) + 1) for w in text.split()])
            if held and held + len(words) > NODES:
                self.parts.append([])
                held = 0
            self.parts[-1].append(words)
            held += len(words)
        self._only = self._compiled(self.parts[0]) if len(self.parts) == 1 else None

    @staticmethod
    def _compiled(phrases: list[tuple[int, ...]]) -> ahocorasick.Automaton | None:
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for words in phrases:
            automaton.add_word(words, len(words))
        if not len(automaton):
            return None
        automaton.make_automaton()
        return automaton

    def locate(self, documents: list[list[bytes]]) -> list[np.ndarray]:
        """Marks in each document (a list of words) all words that lie in an occurrence of any phrase."""
        known = self.number.get
        coded = [tuple([known(w, 0) for w in words]) for words in documents]
        found = [np.zeros(len(w), bool) for w in coded]
        for part in self.parts:
            automaton = self._only if len(self.parts) == 1 else self._compiled(part)
            for words, marks in zip(coded, found, strict=True):
                hits = np.array(list(automaton.iter(words)), np.int64).reshape(-1, 2) if words and automaton else np.empty((0, 2), np.int64)
                marks |= covered_by(hits[:, 0] + 1 - hits[:, 1], hits[:, 0] + 1, len(words))
        return found


def kept_text(text: bytes, covered: np.ndarray) -> bytes:
    """The text without covered words; a kept word keeps the white space before it."""
    out, last = [], 0
    for (begin, end), gone in zip((m.span() for m in _WORDS.finditer(text)), covered.tolist(), strict=True):
        if not gone:
            out.append(text[last:end] if out or not covered[0] else text[begin:end])
        last = end
    return b"".join(out) + text[last:]


@trimmed
def deflated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes, which halves what a shuffle of whole texts writes."""
    release()
    for part, texts in slices(batches):
        bodies = pa.array([None if t is None else zlib.compress(t, 5) for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([part.column("uid"), part.column("rest"), bodies], ["uid", "rest", "body"])


def inflated(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Runs of rows whose texts hold about RUN_BYTES, with these texts."""
    for batch in batches:
        for small in range(0, batch.num_rows, 256):
            piece = batch.slice(small, 256)
            bodies = [None if b is None else zlib.decompress(b) for b in piece.column("body").to_pylist()]
            begin, held = 0, 0
            for i, body in enumerate(bodies):
                if i > begin and held + len(body or b"") > RUN_BYTES:
                    yield piece.slice(begin, i - begin), bodies[begin:i]
                    begin, held = i, 0
                held += len(body or b"")
            yield piece.slice(begin), bodies[begin:]


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, text: str = "text", texts: bool = True, automata: type = Passages) -> DataFrame:
    """All rows and other columns of ``docs``, with n_words, n_removed and kept_sha256, and (``texts``) the text that is left.

    A word is removed if it lies in a window whose words also start anywhere else, in the same
    or another row; windows are judged on the input. ``kept_sha256`` is of the kept words, joined by one space. In the text that is left,
    kept words keep the white space before them. A null text has no words, and stays null; an empty text and one shorter than a window lose nothing. Repeated rows
    repeat each other's passages, so that of copies nothing is left. A text of any length is handled whole; one longer than a shard is a
    shard of its own. A column of docs that has an added name is replaced, other names clash with nothing. An empty table gives an empty one.

    Texts are read twice for the stretches, whose anchors are counted with pre-aggregation, and shuffled once;
    texts without recurring anchors are done then. What is collected by group is a document's own stretches. Phrases are asked for
    once by each shard; hot anchors and phrases are dealt to several tasks. ``automata`` compiles a shard's phrases and marks its documents.
    """
    assert window <= 60
    added = ["n_words", "n_removed", "kept_sha256"]
    rest = [c for c in docs.columns if c != text and c not in added]
    named = with_uid(docs.select(docs[text].cast("string").alias("text"), F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(rest)], F.lit(0).alias("none")).alias("rest")))
    found = _stretch_rows(named, window, anchor)
    counted = stash(found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("whole").alias("low"), F.max("whole").alias("high")).where("n > 1").select("anchor", "n", (F.col("low") == F.col("high")).alias("alike")))
    total, largest = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    recurring = stash(spread_join(found, counted, ["anchor"], "n", F.struct("uid", "place"), total, largest=largest).select("uid", "place", "whole", "alike"), packed=True)
    # a stretch that recurs as a whole is one phrase; windows are tried of those that do not, and of the first of those that do
    differ = recurring.where("NOT alike").select("uid", "place", "whole")
    wholes = differ.groupBy("whole").agg(F.count("*").alias("n"), F.min(F.struct("uid", "place")).alias("first")).where("n > 1")
    first = (F.col("first.uid") == F.col("uid")) & (F.col("first.place") == F.col("place"))
    told = spread_join(differ, wholes, ["whole"], "n", F.struct("uid", "place"), total, "left", largest).select("uid", "place", F.col("n").isNotNull().alias("twice"), F.coalesce(first, F.lit(True)).alias("tried"))
    twice = recurring.where("alike").select("uid", "place", F.lit(True).alias("twice"), F.lit(False).alias("tried")).unionByName(told)
    own = twice.groupBy("uid").agg(F.collect_list(F.when(F.col("twice"), F.col("place"))).alias("whole"), F.collect_list(F.when(F.col("tried"), F.col("place"))).alias("unlike"))

    @trimmed
    def sight(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, bodies in inflated(batches):
            h, bounds = words_of(bodies)
            sums = span_sums(h)
            out = [[] for _ in range(5)]
            for i, (body, packed, whole, unlike) in enumerate(zip(bodies, *(part.column(c).to_pylist() for c in ("body", "whole", "unlike")), strict=True)):
                flagged = unlike is not None
                digest = None if flagged else hashlib.sha256(b" ".join((body or b"").split())).hexdigest()
                seen = sightings(sums, int(bounds[i]), np.array(whole, np.int64), np.array(unlike, np.int64), window)[:, :2].tobytes() if flagged else None
                for column, value in zip(out, (int(bounds[i + 1] - bounds[i]), digest, packed if texts or flagged else None, len(body or b"") if flagged else None, seen), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([part.column("uid"), part.column("rest"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.binary())], ["uid", "rest", "n_words", "digest", "body", "flagged", "seen"])

    rest_kind = named.schema["rest"].dataType.simpleString()
    looked = named.select("uid", "rest", "text").mapInArrow(deflated, f"uid long, rest {rest_kind}, body binary")
    looked = stash(looked.join(own, "uid", "left").select("uid", "rest", "body", "whole", "unlike").mapInArrow(sight, f"uid long, rest {rest_kind}, n_words long, digest string, body binary, flagged long, seen binary"))
    suspects = looked.where("flagged IS NOT NULL")
    shards = 1 + (suspects.agg(F.sum("flagged")).first()[0] or 0) // SHARD_BYTES
    shard = F.pmod(F.xxhash64("uid"), F.lit(shards))

    @trimmed
    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                part = batch.slice(begin, 1024)
                seen = part.column("seen").to_pylist()
                uid = np.repeat(part.column("uid").to_numpy(), [len(s) // 16 for s in seen])
                phrase, place = np.frombuffer(b"".join(seen), np.int64).reshape(-1, 2).T.copy()
                yield pa.RecordBatch.from_arrays([*map(pa.array, (uid, phrase, place, followers(uid, phrase, place)))], ["uid", "phrase", "place", "following"])

    each = suspects.select("uid", "seen").mapInArrow(single, "uid long, phrase long, place long, following long")
    counts = stash(each.groupBy("phrase").agg(F.count("*").alias("n")).where("n > 1"), packed=True)
    asked, largest = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    # where phrases are met: the shards (of a hot phrase in several rows), the first place, and what follows if that is always the same
    met = spread_join(each, counts, ["phrase"], "n", F.struct("uid", "place"), asked, largest=largest, salt="salt").withColumn("shard", shard.cast("int"))
    met = met.groupBy("phrase", "salt").agg(F.max("n").alias("n"), F.min(F.struct("uid", "place")).alias("first"), F.min("following").alias("low"), F.max("following").alias("high"), F.collect_set("shard").alias("shards"))
    wanted = stash(met.select("phrase", "n", "first", "low", (F.col("low") == F.col("high")).alias("same"), "shards"), packed=True)
    follows = F.when((F.min("low") == F.max("low")) & F.bool_and("same"), F.min("low"))
    confirmed = wanted.groupBy("phrase").agg(F.max("n").alias("n"), F.sum(F.size("shards")).alias("shards"), F.min("first").alias("first"), follows.alias("following"))
    # the first document that has a phrase gives its words
    given = confirmed.groupBy(F.col("first.uid").alias("u")).agg(F.collect_list(F.struct(F.col("first.place").alias("place"), "phrase", "n", "shards", "following")).alias("phrases"))

    @trimmed
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, bodies in inflated(batches):
            out: list[list] = [[] for _ in range(3)]
            for body, phrases in zip(bodies, part.column("phrases").to_pylist(), strict=True):
                words = body.split()
                for begin, end, known, most in chains(phrases, window):
                    for column, value in zip(out, (b" ".join(words[begin:end]), known, most), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.list_(pa.int64())), pa.array(out[2], pa.int64())], ["body", "phrases", "shards"])

    givers = suspects.select("uid", "body").join(given, F.col("uid") == F.col("u")).select("body", "phrases")
    runs = stash(givers.mapInArrow(extract, "body binary, phrases array<long>, shards long"), packed=True).withColumn("run", F.monotonically_increasing_id())
    told = wanted.select("phrase", "shards").join(runs.select(F.explode("phrases").alias("phrase"), "run"), "phrase")
    sent = told.select("run", F.explode("shards").alias("shard")).distinct()
    delivered = spread_join(sent, runs.select("run", "body", "shards"), ["run"], "shards", F.col("shard"), asked, largest=shards)
    blank = F.lit(None)
    patterns = delivered.select("shard", F.lit(False).alias("document"), "body", blank.cast(rest_kind).alias("rest"), blank.cast("long").alias("n_words"))
    streams = patterns.unionByName(suspects.select(shard.cast("int").alias("shard"), F.lit(True).alias("document"), "body", "rest", "n_words"))
    ordered = streams.repartition("shard").sortWithinPartitions("shard", "document")

    @trimmed
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, phrases, passages = None, [], None
        for batch in batches:
            tags = list(zip(*(batch.column(c).to_pylist() for c in ("shard", "document")), strict=True))
            cuts = [0, *(i for i in range(1, len(tags)) if tags[i] != tags[i - 1]), len(tags)]
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                (now, document), part = tags[begin], batch.slice(begin, end - begin)
                if now != at:
                    at, phrases, passages = now, [], None
                if not document:  # a shard's phrases come before its documents
                    phrases += part.column("body").to_pylist()
                    continue
                passages = passages or automata(phrases)
                for some, bodies in inflated([part]):
                    yield marked(some, bodies, passages)

    def marked(part: pa.RecordBatch, bodies: list[bytes], passages: Passages) -> pa.RecordBatch:
        documents = [b.split() for b in bodies]
        covered = passages.locate(documents)
        digests = [hashlib.sha256(b" ".join([w for w, c in zip(words, mask.tolist(), strict=True) if not c])).hexdigest() for words, mask in zip(documents, covered, strict=True)]
        left = [(kept_text(b, c) if c.any() else b).decode() if texts else None for b, c in zip(bodies, covered, strict=True)]
        return pa.RecordBatch.from_arrays([part.column("rest"), part.column("n_words"), pa.array([int(c.sum()) for c in covered], pa.int64()), pa.array(digests, pa.string()), pa.array(left, pa.string())], ["rest", "n_words", "n_removed", "kept_sha256", "body"])

    cut = ordered.mapInArrow(mark, f"rest {rest_kind}, n_words long, n_removed long, kept_sha256 string, body string")
    clean = looked.where("flagged IS NULL").select("rest", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("digest").alias("kept_sha256"), F.col("body"))
    columns = [F.col("rest")[f"c{i}"].alias(c) for i, c in enumerate(rest)]
    if not texts:
        return clean.drop("body").unionByName(cut.drop("body")).select(*columns, *added)

    @trimmed
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                bodies = pa.array([None if b is None else zlib.decompress(b).decode() for b in part.column("body").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("rest"), *(part.column(c) for c in added), bodies], ["rest", *added, "body"])

    plain = clean.mapInArrow(unpack, f"rest {rest_kind}, n_words long, n_removed long, kept_sha256 string, body string")
    return plain.unionByName(cut).select(*columns, *added, F.col("body").alias(text))


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), texts=False)


#: The words of every window of 35, joined by spaces, which no word has.
OP10_SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, t.s, array_to_string(w[t.s + 1:t.s + 35], ' ') AS k FROM d, unnest(range(0, greatest(len(w) - 34, 0))) AS t(s)),
again AS (SELECT k FROM windows GROUP BY k HAVING count(*) > 1),
covered AS (SELECT DISTINCT doc_id, s + r.i AS p FROM windows SEMI JOIN again USING (k), range(0, 35) AS r(i)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""
