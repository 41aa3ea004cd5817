"""Packing token streams into full windows whose sources keep their target proportions.

Deficit round-robin: each source is a queue of tokens. In every window each queue earns tokens in
proportion to what it holds, so that all queues end together; it is served, in whole quanta, once its
deficit allows; the rest of the deficit goes on to the next window. As rates are fixed, the deficit
before any window has a closed form: a task that starts at any window knows all deficits there, and
the windows of different partitions join without a gap. Served stretches follow one another without
padding and are cut at window bounds and document ends only, so that every window but the last is full.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, release, slices, stash, table, trimmed, with_uid
from .lines import positions
from .tokens import BEYOND, VOCABULARY, Kept, Pieces, byte_alphabet, unmixed

WINDOW, END_ID, QUANTUM = 2048, 1, 256
#: A source that holds at least this part of all tokens has a queue of its own (a token in every window, on average).
QUEUES = 2048
#: Entries of the windows by queues that are worked out at once.
ROUNDS = 1 << 18
#: Words and lines' beginnings that half a cache of a worker may hold; a matter of memory, never of ids.
WORDS = 600_000
#: The byte-level letter for a space, and marks that end a word of letters and are a pre-token.
_SPACE, _MARKS = "\u0120", frozenset(".,;:!?)")
_id = attrgetter("id")


class IdEncoder(Pieces):
    """ids of whole texts, as the library's encode() has them; recurring stretches are encoded once."""

    def __init__(self, path: str, words: int = WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        super().__init__(path)
        del self.model  # large, and the library has its own
        self.width = np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32
        self._model, self._code = self.library.model, "H" if self.width is np.uint16 else "I"
        self._letters = {b: c for c, b in byte_alphabet().items()}
        self._chunks = Kept(self._word, words)
        self._pieces, self._lines = Kept(self._piece, words // 5), Kept(self._line, words // 5)

    def _piece(self, piece: str) -> bytes:
        """By the library's own model; its byte letters are put in here, its pre-tokenizer would cut the piece no further."""
        return array(self._code, map(_id, self._model.tokenize(piece.encode().decode("latin-1").translate(self._letters)))).tobytes()

    def _line(self, word: str) -> bytes:
        """A line's end and the word after it."""
        return self._pieces["\n"] + self._chunk(word)

    def _word(self, word: str) -> bytes:
        """A word and the space before it. Most are plain letters, perhaps with a mark behind them, which is a piece of its own."""
        if word.isalpha():
            if word.isascii():
                return array(self._code, map(_id, self._model.tokenize(f"{_SPACE}{word}"))).tobytes()
            if max(word) < BEYOND:
                return self._piece(f" {word}")
        elif word[-1:] in _MARKS and word[:-1].isalpha() and max(word) < BEYOND:
            return self._chunks[word[:-1]] + self._pieces[word[-1]]
        unmixed(word)
        head, _, tail = word.partition("\n")
        if head and tail and not head[-1].isspace() and not tail[0].isspace():  # a line's end between other characters is a piece of its own
            return self._chunks[head] + self._lines[tail]
        return self._chunk(f" {word}")

    def _chunk(self, chunk: str) -> bytes:
        return b"".join([self._pieces[p] for p in self.pieces(chunk)])

    def encode(self, text: str) -> bytes:
        """Little-endian ids, two bytes an id (four for vocabularies over 65,536)."""
        out = []
        for k, part in enumerate(self.segments(text)):
            if k % 2:
                out.append(np.array([self.special[part]], self.width).tobytes())
            elif part:
                out += self.stretches(part, self._chunks, self._chunk)
        return b"".join(out)


def encoder(path: str, words: int = WORDS) -> IdEncoder:
    return kept(f"encoder {path} {words}", lambda: IdEncoder(path, words))


class Schedule:
    """Maps a place on a queue to its place in the packed stream.

    ``weights`` are the target proportions of the queues (by default what each holds, so that all end together). A queue
    that has run out leaves its share to the others, by weight.
    """

    def __init__(self, totals: np.ndarray, window: int, quantum: int, weights: np.ndarray | None = None):
        self.totals, self.window, self.quantum = totals.astype(np.int64), window, quantum
        self.windows = max(1, -(-int(totals.sum()) // window))
        self.weights = None if weights is None else weights.astype(np.float64)
        if weights is not None:  # served tokens grow in straight lines with a common level, from one queue's end to the next
            level = self.totals / self.weights
            order = np.argsort(level, kind="stable")
            left = self.weights.sum() - np.concatenate([[0.0], np.cumsum(self.weights[order])[:-1]])
            steps = np.diff(level[order], prepend=0.0) * np.maximum(left, 0)
            self.levels, self.served_at = np.concatenate([[0.0], level[order]]), np.concatenate([[0.0], np.cumsum(steps)])

    def served(self, window: np.ndarray, queue: np.ndarray) -> np.ndarray:
        """Tokens that a queue has been served before a window; both arrays are matched, or spread, one against the other.

        What it has earned by then, in whole quanta; at the end, everything. By default exact in integers: the
        products are split so that they hold for totals far beyond 2**32.
        """
        totals = self.totals[queue]
        if self.weights is None:
            whole, rest = totals // self.windows, totals % self.windows
            earned = whole * window + ((rest.astype(object) * window // self.windows).astype(np.int64) if self.windows >= 1 << 31 else rest * window // self.windows)
        else:
            level = np.interp(np.asarray(window, np.float64) * self.window, self.served_at, self.levels)
            earned = np.minimum(totals, np.floor(self.weights[queue] * level).astype(np.int64))
        return np.where(window >= self.windows, totals, earned // self.quantum * self.quantum)

    def _round(self, queue: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The window in which the token at this place of its queue is served."""
        n = self.windows
        need, total = (at // self.quantum + 1) * self.quantum, self.totals[queue]
        if self.weights is None and int(self.totals.max()) * n < 1 << 61:
            return np.maximum(np.minimum(n, (need * n + total - 1) // total), 1) - 1
        low, high = np.zeros(need.shape, np.int64), np.full(need.shape, n, np.int64)  # not served before low, served before high
        while (high - low > 1).any():
            middle = (low + high) // 2
            enough = self.served(middle, queue) >= need
            low, high = np.where(enough, low, middle), np.where(enough, middle, high)
        return high - 1

    def pieces(self, queue: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each piece of the documents at [begin, end) of their queues: document, place in the queue, length, place in the stream.

        A document's pieces are the stretches that it is served in, cut at the ends of windows.
        """
        first = begin // self.quantum
        many = (end - 1) // self.quantum - first + 1
        doc = np.repeat(np.arange(len(queue)), many)
        quanta = (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + first[doc]) * self.quantum
        rounds = self._round(queue[doc], quanta)
        keep = np.flatnonzero((np.diff(rounds, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
        doc, rounds, own = doc[keep], rounds[keep], queue[doc[keep]]
        begins = np.maximum(begin[doc], quanta[keep])
        last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.empty(0, bool)
        ends = np.where(last, end[doc], np.append(begins[1:], 0) if len(doc) else begins)
        at, every, step = np.empty(len(doc), np.int64), np.arange(len(self.totals)), max(1, ROUNDS // len(self.totals))
        for some in range(0, len(doc), step):  # queues before the own one have been served in this window, the others before it
            here = slice(some, some + step)
            w, q = rounds[here], own[here]
            upto = np.where(every < q[:, None], self.served(w[:, None] + 1, every[None, :]), self.served(w[:, None], every[None, :]))
            at[here] = upto.sum(1) + begins[here] - upto[np.arange(len(q)), q]
        cuts = (at + ends - begins - 1) // self.window - at // self.window + 1
        part = np.repeat(np.arange(len(doc)), cuts)
        nth = np.arange(len(part)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        bound = (at[part] // self.window + nth) * self.window
        here = np.maximum(at[part], bound)
        stop = np.minimum(at[part] + (ends - begins)[part], bound + self.window)
        return doc[part], begins[part] + here - at[part], stop - here, here


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, window: int = WINDOW, quantum: int = QUANTUM, weights: dict | None = None, key: str = "doc_id", text: str = "text", source: str = "source", words: int = WORDS) -> DataFrame:
    """One row per piece: key, source, start, length, ids (binary), ids_crc32, doc_tokens, sequence_id, offset.

    ids hold little-endian ids of two bytes (four for vocabularies over 65,536); ids_crc32 is of the same as four-byte ids. ``sequence_id`` counts
    windows from 0, ``offset`` is the place in the window. Only the last sequence can be short; it is to be
    padded to ``window`` unless its length is a power of two. A null or empty text has its end id
    only, a null source is a source, a very long text goes into as many windows as it takes. Repeated rows are documents of their own. An empty table gives
    an empty one. Other columns are not read.

    ``weights`` (source -> positive number) are the token proportions that windows are to have while sources last; by default each source's share of
    all tokens. A source that ``weights`` lacks has the share of all tokens as well. At every size of the corpus, sources below
    one part in QUEUES of all tokens, which cannot be in every window, share one queue in random order; the others have one each.

    ``words`` bounds what each worker remembers of words' ids, in memory only. Texts are tokenized once; the ids are checkpointed, then shuffled once to meet the places that
    sums over queues give. Queues are ordered by a hash of the row number, in parts (see lines.positions), so that a
    source with a third of all rows is spread over many tasks.
    """
    kind, narrow = docs.schema[key].dataType.simpleString(), f"`{key}`"

    @trimmed
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(public_tokenizers.path(vocabulary), words)
        end = np.array([end_id], known.width).tobytes()
        for batch, texts in slices(batches):
            ids = [(known.encode(t.decode()) if t else b"") + end for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("key"), batch.column("source"), pa.array([len(x) // len(end) for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["uid", "key", "source", "doc_tokens", "ids"])

    rows = with_uid(docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"), docs[source].cast("string").alias("source")))
    coded = stash(rows.mapInArrow(encode, f"uid long, key {kind}, source string, doc_tokens long, ids binary"))
    named = coded.groupBy("source").agg(F.sum("doc_tokens").alias("tokens"), F.count("*").alias("n"))
    whole = named.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    large = sorted(named.where(F.col("tokens") * QUEUES >= whole[0]).collect(), key=lambda r: (r["source"] is None, r["source"] or ""))  # at most QUEUES
    totals = [r["tokens"] for r in large] + [whole[0] - sum(r["tokens"] for r in large)]
    told = None
    if weights is not None:
        told = np.array([float(weights.get(r["source"], 0)) for r in large] + [0.0])
        told = np.where(told > 0, told / max(told.sum(), 1e-300), np.array(totals) / max(1, whole[0])) + 1e-12
    plan = Schedule(np.array(totals, np.int64), window, quantum, told)
    # from Arrow, as rows of a list go through Python workers
    own = docs.sparkSession.createDataFrame(pa.table({"s": pa.array([r["source"] for r in large], pa.string()), "q": pa.array(range(len(large)), pa.int32())}))
    queued = coded.select("uid", "doc_tokens", "source").join(F.broadcast(own), F.col("source").eqNullSafe(F.col("s")), "left").select("uid", "doc_tokens", F.coalesce("q", F.lit(len(large))).alias("queue"))
    placed = positions(queued, "queue", F.xxhash64("uid"), "doc_tokens", "line", whole[1])
    joined = coded.join(placed.select("uid", "queue", "line"), "uid")

    @trimmed
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for whole in batches:
            for small in range(0, whole.num_rows, 1024):
                batch = whole.slice(small, 1024)
                queue, line, n = (batch.column(c).to_numpy().astype(np.int64) for c in ("queue", "line", "doc_tokens"))
                doc, begin, length, at = plan.pieces(queue, line, line + n)
                start, ids = begin - line[doc], batch.column("ids").to_pylist()
                wide = len(ids[0]) // int(n[0])
                long = [np.frombuffer(x, np.uint16 if wide == 2 else np.uint32).astype("<u4").tobytes() for x in ids]
                bounds = list(zip(doc.tolist(), start.tolist(), (start + length).tolist(), strict=True))
                parts = pa.array([ids[d][a * wide : b * wide] for d, a, b in bounds], pa.binary())
                sums = pa.array([zlib.crc32(long[d][4 * a : 4 * b]) for d, a, b in bounds], pa.int64())
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays([batch.column("key").take(take), batch.column("source").take(take), pa.array(start), pa.array(length), parts, sums, pa.array(n[doc]), pa.array(at // window), pa.array(at % window)], [key, "source", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return joined.select("key", "source", "queue", "line", "doc_tokens", "ids").mapInArrow(cut, f"{narrow} {kind}, source string, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
