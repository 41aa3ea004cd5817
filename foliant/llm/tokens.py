"""Token counts by dynamic programming over prefixes.

For byte-level BPE the encoding of every prefix of a pre-token is a chain of tokens in which each
neighbouring pair is stable: the pair's bytes encode to just that pair. So the last token of a
prefix is the one suffix token that is stable after the last token of the prefix before it, and
one pass stores, for every prefix, its exact number of tokens. Texts are cut at pre-token
boundaries, pre-tokens recur, and their tables are kept in bounded caches. The stored counts answer
how many tokens any prefix has and where a budget ends, without encoding anything again.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import kept, slices, table

VOCABULARY = "byte_bpe_50k.json"
#: Entries that half a cache may hold; a matter of memory, never of results.
CHUNKS, PIECES, PAIRS = 250_000, 150_000, 300_000
LIMIT = 512

_SPACES = "\t-\r \x85\xa0"  # white space below U+0250, as the tokenizer library has it
_class = lambda kind: "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)
_L, _N = _class("L"), _class("N")
#: The byte-level pre-tokenizer's pattern, for texts below U+0250; others go through the library's own.
_PIECE = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[{_N}]+| ?[^{_SPACES}{_L}{_N}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")
#: The first character that goes through the library's own pre-tokenizer.
BEYOND = "\u0250"
_BEYOND = re.compile(f"[{BEYOND}-\U0010ffff]")
_CLEAN_CUT = re.compile(r"(?<=\S)(?= \S)")


def _blank(piece: str) -> bool:
    return piece.isspace() and not re.search("[\x1c-\x1f]", piece)


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Mixed(Exception):
    """A stretch that begins or ends with white space, next to which a space is no place to cut."""


def unmixed(word: str) -> str:
    if not word or word[0].isspace() or word[-1].isspace():
        raise Mixed
    return word


class Kept(dict):
    """A bounded cache of what ``make`` makes of a key. Full, it becomes the older half, of which what is asked for again moves up."""

    def __init__(self, make, limit: int):
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key: str):
        made = self.older.get(key)
        if made is None:
            made = self.make(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = made
        return made


class Pieces:
    """Cuts texts where a byte-level BPE tokenizer cuts them, in two steps that caches can follow."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True) or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: only plain byte-level BPE vocabularies can be counted by prefix")
        self.model, self.special = spec["model"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def segments(self, text: str) -> list[str]:
        """Text and special strings in turn; every second one is special."""
        return self._special.split(text) if self._special and any(s in text for s in self.special) else [text]

    @staticmethod
    def stretches(text: str, known: Kept, chunk) -> list:
        """What ``known`` or ``chunk`` makes of each stretch of an ordinary text; no pre-token crosses their bounds.

        A space between two words is a clean place to cut, a space next to white space is none. ``known`` takes words without the
        space before them; the first stretch goes to ``chunk`` as it is.
        """
        head, *tail = text.split(" ")
        if not tail:
            return [chunk(head)]
        last = tail.pop()
        if head and last and not head[-1].isspace() and not last[0].isspace():
            try:
                return [chunk(head), *map(known.__getitem__, tail), chunk(f" {last}") if last[-1].isspace() else known[last]]
            except Mixed:
                pass
        head, *tail = _CLEAN_CUT.split(text)
        return [chunk(head), *(chunk(c) if c[-1].isspace() else known[c[1:]] for c in tail)]

    def pieces(self, chunk: str) -> list[str]:
        """The pre-tokens of a chunk."""
        if chunk.isascii() and chunk[:1] == " ":  # most are a word, or a word and a mark
            if chunk[1:].isalpha():
                return [chunk]
            if chunk[-1] in ".," and chunk[1:-1].isalpha():
                return [chunk[:-1], chunk[-1]]
        if not _BEYOND.search(chunk):
            return _PIECE.findall(chunk)
        return [chunk[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(chunk)]


class PrefixCounter(Pieces):
    """Exact token counts of whole texts and of all their prefixes."""

    def __init__(self, path: str):
        super().__init__(path)
        self._pairs: dict[int, bool] = {}
        alphabet = byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        self.ids = {raw(t): i for t, i in self.model["vocab"].items() if all(c in alphabet for c in t)}
        # tokens numbered in the order in which merges make them; a byte is its own halves
        self.number = {bytes([b]): b for b in range(256)}
        self.halves, self.merged = {b: (b, b) for b in range(256)}, {}
        for i, m in enumerate(self.model["merges"], 256):
            a, b = map(raw, m.split(" ") if isinstance(m, str) else m)
            if (self.number[a], self.number[b]) not in self.merged and a + b not in self.number:
                self.number[a + b], self.halves[i] = i, (self.number[a], self.number[b])
            self.merged.setdefault((self.number[a], self.number[b]), i)
        self.number = {t: i for t, i in self.number.items() if t in self.ids and (i < 256 or self._stable(*self.halves[i], below=i))}
        self._suffixes = ahocorasick.Automaton()  # finds all tokens that end at a place, the longest first
        for t, i in self.number.items():
            self._suffixes.add_word(t.decode("latin-1"), (i, len(t)))
        self._suffixes.make_automaton()
        self._tables = Kept(self._table, PIECES)
        self._totals = Kept(lambda c: self._chunk(f" {unmixed(c)}"), CHUNKS)

    def _stable(self, left: int, right: int, below: int = 1 << 60) -> bool:
        """Whether no merge older than ``below`` crosses from one token into the other.

        Goes back in time: of the two parts that meet at the boundary, the one made later is
        taken apart, and a merge of both crosses if it is older than what ended their meeting.
        Of equal merges the left one comes first.
        """
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < below:
                return False
            if left < 256 and right < 256:
                return True
            if left > right:
                below, left = left, self.halves[left][1]
            else:
                below, right = right + 1, self.halves[right][0]

    def piece_table(self, piece: str) -> tuple[int, ...]:
        """Number of tokens of every byte prefix of a pre-token: entry i is for the first i bytes."""
        return self._tables[piece]

    def _table(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        pairs, last, count, done = self._pairs, [-1], [0], 0
        for at, (token, size) in self._suffixes.iter(data.decode("latin-1")):
            begin = at + 1 - size
            if at < done:  # this prefix has its last token
                continue
            if begin:
                pair = last[begin] << 20 | token
                good = pairs.get(pair)
                if good is None:
                    good = pairs[pair] = self._stable(last[begin], token)
                if not good:
                    continue
            last.append(token)
            count.append(count[begin] + 1)
            done += 1
        if done < len(data):
            raise ValueError("the vocabulary lacks a byte")
        if len(pairs) >= PAIRS:
            pairs.clear()
        return tuple(count)

    def _chunk(self, chunk: str) -> int:
        return sum([self.piece_table(p)[-1] for p in self.pieces(chunk)])

    def count(self, text: str) -> int:
        """Tokens of the whole text, as the library's encode() has them by default, without added ones."""
        total = 0
        for k, part in enumerate(self.segments(text)):
            if k % 2:
                total += 1
            elif part:
                total += sum(self.stretches(part, self._totals, self._chunk))
        return total

    def prefix_counts(self, text: str) -> list[int]:
        """Entry i: the exact number of tokens of text[:i], for every i from 0 to len(text)."""
        out, done = [0], 0
        for k, part in enumerate(self.segments(text)):
            if k % 2:  # a special string cut short is ordinary text, read on from the ordinary text before it
                base, before = out[-1], self._tail
                for i in range(1, len(part)):
                    out.append(before[0] + self.count(before[1] + part[:i]))
                out.append(base + 1)
                done = out[-1]
                continue
            at, pieces = 0, self.pieces(part) if part else []
            total = done
            while at < len(pieces):
                piece = pieces[at]
                if _blank(piece) and at + 1 < len(pieces) and pieces[at + 1][0] == " " and len(pieces[at + 1]) > 1:
                    # white space cut off by the space that belongs to the next word: until then it is one piece
                    run = self.piece_table(piece + " ")
                    sizes = [len(c.encode()) for c in piece + " "]
                    held, marks = 0, []
                    for s in sizes:
                        held += s
                        marks.append(run[held])
                    out += [total + m for m in marks]
                    total += self.piece_table(piece)[-1]
                    following = pieces[at + 1]
                    out += self._inside(following, total)[1:]
                    total += self.piece_table(following)[-1]
                    at += 2
                    continue
                if _blank(piece) and at + 1 < len(pieces) and _blank(pieces[at + 1]):
                    # the run's last character, cut off from the rest of its run by what follows it
                    run = self.piece_table(piece + pieces[at + 1])
                    held = 0
                    for c in piece + pieces[at + 1]:
                        held += len(c.encode())
                        out.append(total + run[held])
                    total += self.piece_table(piece)[-1] + self.piece_table(pieces[at + 1])[-1]
                    at += 2
                    continue
                out += self._inside(piece, total)
                total += self.piece_table(piece)[-1]
                at += 1
            # text[:i] ends its ordinary part here; a special string that follows may be cut short
            cut = max(0, len(part) - 64)
            while cut and not (part[cut] == " " and not part[cut - 1].isspace() and part[cut + 1 : cut + 2].strip()):
                cut -= 1
            self._tail = (done + self.count(part[:cut]), part[cut:])
            if k + 1 < len(self.segments(text)):
                done = total
        return out

    def _inside(self, piece: str, total: int) -> list[int]:
        counts, held, out = self.piece_table(piece), 0, []
        if piece in ("'re", "'ve", "'ll"):  # cut short, these are an apostrophe and a letter
            return [total + 1, total + 2, total + counts[-1]]
        for c in piece:
            held += len(c.encode())
            out.append(total + counts[held])
        return out

    def truncate(self, text: str, budget: int) -> str:
        """The longest prefix of at most ``budget`` tokens. Counts may fall by a little when a token is completed, so the last place that fits counts."""
        counts = self.prefix_counts(text)
        return text[: max(i for i, n in enumerate(counts) if n <= budget)] if budget >= 0 else ""


def counter(path: str) -> PrefixCounter:
    """One for each worker process, which may serve many tasks."""
    return kept(f"counter {path}", lambda: PrefixCounter(path))


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for every row; a null text counts as empty.

    ``vocabulary`` is a file name below the public tokenizers' folder; the library is loaded from it
    on each executor. Repeated rows stay repeated, an empty table gives an empty one, other columns
    are not read. One scan without a shuffle; memory is bounded by the caches and one slice of texts.
    """
    kind = docs.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(public_tokenizers.path(vocabulary))
        for batch, texts in slices(batches):
            sizes = [len(t or b"") for t in texts]
            counts = [known.count(t.decode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts])], [key, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text")).mapInArrow(count, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
