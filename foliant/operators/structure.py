"""Corpus-wide structure of Markdown: lines, outlines, section numbers, references, citations, spelling.

A document is a row (key, md); its parts are rows of child tables with (key, line). Everything here is
windows, joins and aggregates over those, keyed by document, so that all of it runs in parallel.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..rows import with_uid
from .rowwise import ROWS

#: Lines that leave a worker together.
LINES = 8192


#: So many repeated keys at most go to every executor; more are met by a join that Spark plans.
FEW_KEYS = 1_000_000


def by_repeats(docs: DataFrame, key: str, alone: Callable[[DataFrame], DataFrame], shared: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``alone`` of the rows whose key no other row has, with ``shared`` of all others; the keys are counted at once, as a column of their own.

    Rows of one key are one document. Where none is repeated, which is the rule, each row is handled where it is read, and no
    task's memory depends on how many rows there are.
    """
    again = docs.groupBy(F.col(key).alias("_again")).agg(F.count("*").alias("_n")).where("_n > 1").select("_again")
    found = again.count()
    if not found:
        return alone(docs)
    again = F.broadcast(again) if found <= FEW_KEYS else again
    same = docs[key].eqNullSafe(again["_again"])
    return alone(docs.join(again, same, "left_anti")).unionByName(shared(docs.join(again, same, "left_semi")))


def _lines_by_window(docs: DataFrame, key: str, md: str) -> DataFrame:
    parts = docs.select(F.col(key), F.posexplode(T.lines(F.col(md))).alias("line", "content")).withColumn("fence", F.col("content").rlike(T.FENCE))
    before = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(F.col("fence").cast("int")).over(before), F.lit(0)) % 2 == 1
    return parts.withColumn("fenced", F.col("fence") | inside).drop("fence")


def _lines_by_row(docs: DataFrame, key: str, md: str) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()
    fence = T.FENCE.replace(r"\s", r"[ \t\n\x0B\f\r]")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                split = pc.split_pattern(part.column(1), "\n")
                rows, content = pc.list_parent_indices(split).to_numpy(), pc.list_flatten(split)
                marks = pc.match_substring_regex(content, fence).to_numpy(zero_copy_only=False)
                first = np.searchsorted(rows, rows)
                before = np.cumsum(marks) - marks
                fenced = marks | ((before - before[first]) % 2 == 1)
                for at in range(0, len(rows), LINES):  # views of what is there
                    here = slice(at, at + LINES)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows[here])), pa.array((np.arange(len(rows)) - first)[here].astype("int32")), content[here], pa.array(fenced[here])], [key, "line", "content", "fenced"])

    return docs.select(F.col(key), F.col(md)).mapInArrow(run, f"`{key}` {kind}, line int, content string, fenced boolean")


def lines(docs: DataFrame, key: str = "doc_id", md: str = "md") -> DataFrame:
    """(key, line, content, fenced): every line, and whether it belongs to a fenced region or its fences. Rows that share a key share their fences."""
    return by_repeats(docs.select(F.col(key), F.col(md)), key, lambda d: _lines_by_row(d, key, md), lambda d: _lines_by_window(d, key, md))


def headings(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, line, level, title, label) of the ATX headings outside fences."""
    found = lines(docs, key).where(~F.col("fenced")).withColumn("level", T.heading_level(F.col("content"))).where("level IS NOT NULL")
    bare = F.trim(F.regexp_replace("content", r"^\s*#{1,6}", ""))
    label = F.regexp_extract(bare, r"\{#([^}]*)\}\s*$", 1)
    return found.select(key, "line", "level", F.trim(F.regexp_replace(bare, r"\{#[^}]*\}\s*$", "")).alias("title"), F.when(label != "", label).alias("label"))


def outline(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_headings, outline): levels and titles in order, as text."""
    return headings(docs, key).groupBy(key).agg(F.count("*").alias("n_headings"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "level", "title"))), lambda h: F.concat(h["level"].cast("string"), F.lit(":"), h["title"])), "|").alias("outline"))


def section_numbers(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """headings() with ``number``: dotted counters by level; a counter starts anew below a shallower heading.

    The count of a level is a running sum inside the group of lines since the last shallower heading; the
    groups are running sums themselves. A skipped level prints 0.
    """
    found = headings(docs, key)
    upto = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    for k in range(1, 7):
        found = found.withColumn(f"g{k}", F.sum((F.col("level") < k).cast("int")).over(upto))
    for k in range(1, 7):
        inside = Window.partitionBy(key, f"g{k}").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
        found = found.withColumn(f"c{k}", F.sum((F.col("level") == k).cast("int")).over(inside))
    number = F.array_join(F.slice(F.array(*[F.col(f"c{k}").cast("string") for k in range(1, 7)]), F.lit(1), F.col("level")), ".")
    return found.select(key, "line", "level", "title", "label", number.alias("number"))


def references(docs: DataFrame, key: str = "doc_id", md: str = "md") -> DataFrame:
    r"""(key, ord, target, number) of every reference command outside fences; an unknown target has ``?``, ``\eqref`` has parentheses."""
    named = F.regexp_extract_all("content", F.lit(r"(\\(?:eq|c|C)?ref\{[^}]*\})"), F.lit(1))
    used = lines(docs, key, md).where(~F.col("fenced")).select(key, "line", F.posexplode(named).alias("at", "raw")).withColumn("target", F.regexp_extract("raw", r"\{([^}]*)\}", 1))
    used = used.withColumn("ord", F.row_number().over(Window.partitionBy(key).orderBy("line", "at")).cast("long"))
    known = section_numbers(docs, key).where("label IS NOT NULL").groupBy(F.col(key).alias("k"), "label").agg(F.min_by("number", "line").alias("number"))
    number = F.coalesce("number", F.lit("?"))
    shown = F.when(F.startswith("raw", F.lit("\\eqref")), F.concat(F.lit("("), number, F.lit(")"))).otherwise(number)
    return used.join(known, (F.col(key) == F.col("k")) & (F.col("target") == F.col("label")), "left").select(key, "ord", "target", shown.alias("number"))


_CITED = re.compile(r"\[@|\\cite\{")


def cited_groups(text: str, resolves: Callable[[list[str]], bool]) -> Iterator[list[str]]:
    r"""The keys of each citation group, ``[@k; @k2]`` or ``\cite{a,b}``, in order, fences or not.

    A group is closed by the next ] or }, over line ends. One that ``resolves`` is passed over whole; else the
    search goes on right behind its opener.
    """
    at = 0
    while found := _CITED.search(text, at):
        pandoc, at = found[0] == "[@", found.end()
        close = text.find("]" if pandoc else "}", at)
        if close == -1:
            continue
        inner = text[at - 1 : close] if pandoc else text[at:close]
        keys = [k.strip().lstrip("@").strip() if pandoc else k.strip() for k in inner.split("; " if pandoc else ",")]
        keys = [k for k in keys if k]
        yield keys
        if keys and resolves(keys):
            at = close + 1


def citation_order(docs: DataFrame, bib: DataFrame, key: str = "doc_id", md: str = "md") -> DataFrame:
    r"""(key, cited, number) by the whole rule: both forms of citation, numbered by first appearance.

    In a group, keys before the first unknown one get numbers, those after it get none from this group. ``bib``
    is not collected: each document gets the known ones among the keys that it could cite.
    """
    kind = docs.schema[key].dataType.simpleString()

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rows, keys = [], []
            for i, text in enumerate(part.column("md").to_pylist()):
                for k in {k for group in cited_groups(text, lambda _: False) for k in group}:
                    rows.append(i)
                    keys.append(k)
            yield pa.RecordBatch.from_arrays([part.column("uid").take(pa.array(rows, pa.int64())), pa.array(keys, pa.string())], ["uid", "cited"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rows, keys, numbers = [], [], []
            for i, (text, known) in enumerate(zip(part.column("md").to_pylist(), part.column("known").to_pylist(), strict=True)):
                known, order = set(known), {}
                for group in cited_groups(text, known.issuperset):
                    for k in group:
                        if k not in known:
                            break
                        order.setdefault(k, len(order) + 1)
                rows += [i] * len(order)
                keys += order
                numbers += order.values()
            yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(rows, pa.int64())), pa.array(keys, pa.string()), pa.array(numbers, pa.int64())], [key, "cited", "number"])

    citing = with_uid(docs.select(F.col(key).alias("key"), F.col(md).alias("md"))).where(F.contains("md", F.lit("[@")) | F.contains("md", F.lit("\\cite{")))
    asked = citing.select("uid", "md").mapInArrow(candidates, "uid long, cited string")
    known = asked.join(bib.select(F.col("key").alias("cited")).distinct(), "cited").groupBy("uid").agg(F.collect_set("cited").alias("known"))
    return citing.join(known, "uid").select("key", "md", "known").mapInArrow(number, f"`{key}` {kind}, cited string, number long")


_NO_PROSE = ("`[^`\n]*`", r"\$[^$\n]*\$", r"<[^>\n]*>", r"\\[A-Za-z]+", r"\]\([^)\n]*\)")


def _words(text: Column) -> Column:
    for pattern in _NO_PROSE:
        text = F.regexp_replace(text, pattern, " ")
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}(?:[\p{L}']*\p{L}))"), F.lit(1))


def _words_by_row(docs: DataFrame, key: str, md: str) -> DataFrame:
    # pieces begin at fences: every second one is outside, but for its first line
    pieces = F.split(F.concat(F.lit("\n"), F.col(md)), r"\n(?=" + T.FENCE.removeprefix("^").replace(r"\s", r"[ \t\x0B\f\r]") + ")")
    prose = F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, "").when(i == 0, p).otherwise(F.regexp_replace(p, r"\A[^\n]*", ""))), "\n")
    found = docs.select(F.col(key), F.coalesce(F.sort_array(_words(prose)), F.array().cast("array<string>")).alias("words"))
    at = F.filter(F.sequence(F.lit(0), F.size("words")), lambda i: (i == 0) | (i == F.size("words")) | (F.get("words", i) != F.get("words", i - 1)))
    runs = found.select(key, "words", at.alias("at"))
    each = F.transform(F.slice("at", F.lit(1), F.size("at") - 1), lambda b, i: F.struct(F.get("words", b).alias("word"), (F.get("at", i + 1) - b).cast("long").alias("n")))
    return runs.select(key, F.explode(each).alias("of")).select(key, "of.word", "of.n")


def _words_by_key(docs: DataFrame, key: str, md: str) -> DataFrame:
    return _lines_by_window(docs, key, md).where(~F.col("fenced")).select(key, F.explode(_words(F.col("content"))).alias("word")).groupBy(key, "word").agg(F.count("*").alias("n"))


def words(docs: DataFrame, key: str = "doc_id", md: str = "md") -> DataFrame:
    """(key, word, n): lower-cased words of two letters or more in prose (no fences, inline code, inline math, tags, commands, link targets)."""
    return by_repeats(docs.select(F.col(key), F.col(md)), key, lambda d: _words_by_row(d, key, md), lambda d: _words_by_key(d, key, md))


def misspellings(docs: DataFrame, dictionary: DataFrame, key: str = "doc_id", md: str = "md") -> DataFrame:
    """(key, word, n) of words that the dictionary (word) lacks; words are counted by document first."""
    return words(docs, key, md).join(dictionary.select("word").distinct(), "word", "left_anti").select(key, "word", "n")


def word_summary(words: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n, n_distinct, first_word, last_word) of (key, word, n).

    Runs of rows with one key, which is how words() has them, are summed up where they are: a least string
    is found by sorting, and only a row for each run is sorted.
    """
    kind = words.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            runs = np.arange(len(keys))
            if not pa.types.is_nested(keys.type):
                codes = pc.dictionary_encode(keys, null_encoding="encode").indices.to_numpy()
                runs = np.cumsum(np.append([0], codes[1:] != codes[:-1]))[: len(keys)]
            table = pa.table([pa.array(runs), *batch.columns[1:]], ["run", "word", "n"])
            told = table.group_by("run", use_threads=False).aggregate([("n", "sum"), ("n", "count"), ("word", "min"), ("word", "max")]).combine_chunks()
            if told.num_rows:
                first = keys.take(pa.array(np.searchsorted(runs, told["run"].to_numpy())))
                yield pa.RecordBatch.from_arrays([first, *(told[c].chunk(0) for c in ("n_sum", "n_count", "word_min", "word_max"))], [key, "n", "n_distinct", "first_word", "last_word"])

    parts = words.select(key, "word", "n").mapInArrow(run, f"`{key}` {kind}, n long, n_distinct long, first_word string, last_word string")
    return parts.groupBy(key).agg(F.sum("n").alias("n"), F.sum("n_distinct").alias("n_distinct"), F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"))


def suggestions(wrong: DataFrame, dictionary: DataFrame, most: int = 8) -> DataFrame:
    """(word, suggestion, rank): the nearest dictionary words within two edits, whatever their first letter.

    A dictionary word is cut into three pieces; two edits leave one of them whole, moved by two places at
    most. So words meet on a piece, its number and the dictionary word's length, and few have to be compared.
    """
    near = dictionary.select(F.col("word").alias("suggestion")).distinct().withColumn("len", F.length("suggestion"))
    near = near.withColumn("i", F.explode(F.array(*[F.lit(i) for i in range(3)]))).withColumn("piece", F.expr("substring(suggestion, CAST((len * i) DIV 3 + 1 AS INT), CAST((len * (i + 1)) DIV 3 - (len * i) DIV 3 AS INT))"))
    asked = wrong.select("word").distinct().withColumn("len", F.explode(F.array(*[F.length("word") + d for d in range(-2, 3)]))).where("len >= 0")
    asked = asked.withColumn("i", F.explode(F.array(*[F.lit(i) for i in range(3)]))).withColumn("at", F.explode(F.expr("transform(sequence(-2, 2), d -> (len * i) DIV 3 + 1 + d)"))).where("at >= 1")
    asked = asked.select("word", "len", "i", F.expr("substring(word, CAST(at AS INT), CAST((len * (i + 1)) DIV 3 - (len * i) DIV 3 AS INT))").alias("piece")).distinct()
    scored = asked.join(near, ["len", "i", "piece"]).select("word", "suggestion").distinct().withColumn("d", F.levenshtein("word", "suggestion")).where("d <= 2")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("word").orderBy("d", "suggestion")))
    return ranked.where(F.col("rank") <= most).select("word", "suggestion", F.col("rank").cast("long").alias("rank"))


def images(docs: DataFrame, key: str = "doc_id", md: str = "md") -> DataFrame:
    """(key, ord, alt, path) of image references."""
    found = docs.select(key, F.posexplode(F.regexp_extract_all(md, F.lit(r"(!\[[^\]]*\]\([^)]*\))"), F.lit(1))).alias("ord", "raw"))
    return found.select(key, F.col("ord").cast("long").alias("ord"), F.regexp_extract("raw", r"!\[([^\]]*)\]", 1).alias("alt"), F.regexp_extract("raw", r"\]\(([^)]*)\)$", 1).alias("path"))
