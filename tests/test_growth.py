"""What a task holds must not grow with the table: steps that work row by row, against the plain ones."""

import hashlib
import io
import random
import re
import time
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from foliant import queries as q
from foliant.functions.artifacts import HINTS
from foliant.kernels import office, package
from foliant.kernels import purify as K
from foliant.kernels.markdown import events
from foliant.operators import cleaning
from foliant.operators import structure as S

DATA = "/root/testdata/sf0.001"
BITS = ["```", "~~~", " \t```py", "\n", "\n", "\n", "\r\n", "\x0b```", "word ", "l'an ", "'x ", "Été ", "ΣΑΣ ", "`", "$", "<", ">", "\\ref", "](", ")", " ab ", " ab ", "abc'", " ```", "\u0085~~~", "İx "]


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    texts = [None, "", "\n", "```", "```\na", "\n```\na b cd\n```\nef", "~~~", "x\n"] + ["".join(rng.choice(BITS) for _ in range(rng.randint(1, 60))) for _ in range(600)]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "one\n```\ntwo")], "doc_id long, md string").repartition(3)


@pytest.mark.parametrize("name", ["misspelled_words", "line_kinds"])
def test_lines_are_not_sorted(spark, name):
    plan = q.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    below = plan.split("MapInArrow", 1)[1]  # a row for each document at most leaves it
    assert "Sort" not in below and "HashAggregate(keys=[doc_id" not in below


def test_lines_and_words_row_by_row(docs):
    assert rows(S._lines_by_row(docs, "doc_id", "md")) == rows(S._lines_by_window(docs, "doc_id", "md"))
    assert rows(S._words_by_row(docs, "doc_id", "md")) == rows(S._words_by_key(docs, "doc_id", "md"))


@pytest.mark.parametrize("few", [0, 10**6])
def test_rows_of_one_key_share_their_fences(docs, few, monkeypatch):
    monkeypatch.setattr(S, "FEW_KEYS", few)
    twice = docs.union(docs.where("doc_id < 100 OR doc_id IS NULL"))
    assert rows(S.lines(twice)) == rows(S._lines_by_window(twice, "doc_id", "md"))
    assert rows(S.words(twice)) == rows(S._words_by_key(twice, "doc_id", "md"))


def test_word_summary(docs):
    words = S.words(docs)
    wanted = words.groupBy("doc_id").agg(F.sum("n").alias("n"), F.count("*").alias("n_distinct"), F.min("word").alias("first_word"), F.max("word").alias("last_word"))
    assert rows(S.word_summary(words)) == rows(wanted)
    assert rows(S.word_summary(words.repartition(5, "word"))) == rows(wanted)


PHRASES = ["Certainly, ", "It's worth noting that ", "ıt is ımportant to note that ", "Additionally, ", "To Summarize, ", " I hope thiſ helps!", " Feel free to ask us.", "As an AI ", "Bien sûr, ", "Il est İmportant ", "À noter que ", "Pour resumer, ", " N'hésitez pas à poser vos questions", "En tant qu'IA, ", "in conAdditionally, clusion, ", "word", "x\n", "\n", "`c`", "$m$", "$$", "\\[", "\\]", "``", "```\n", " ;", "\t!", "« ", " »", "\r\n", "\r", "--", "---", "—", "​", "﻿", "а", "“", "\U000e0041", "\x00", "  \t "]


def test_phrases_without_a_hint_are_found_by_none():
    rng, tried = random.Random(7), 0
    assert len(HINTS) == len(cleaning._TICS)
    for _ in range(3000):
        text = "".join(rng.choice(PHRASES) for _ in range(rng.randint(0, 25)))
        plain = K.purify(text, "decontaminate", "markdown", tics=cleaning._TICS)
        assert K.purify(text, "decontaminate", "markdown", tics=cleaning._TICS, hints=HINTS) == plain
        tried += plain[1]["tic_changes"]
    assert tried > 1000
    letters = {c: re.compile(c, re.I) for c in sorted(set("".join("".join(h) for h in HINTS)))}
    for odd in filter(str.isalpha, map(chr, range(128, 0x1F000))):
        assert all(K._folded(odd) == c for c, pattern in letters.items() if pattern.fullmatch(odd))


def test_texts_are_skimmed_for_anomalies():
    text = "Été: word, and more. " * 100_000
    took = []
    for _ in range(3):
        began = time.perf_counter()
        assert K.purify(text, "decontaminate", "markdown", tics=cleaning._TICS, hints=HINTS)[0] == text
        took.append(time.perf_counter() - began)
    assert min(took) < 0.5  # some 1.6 s where each pattern is tried in each place


PIECES = ["# ", "## x", "```", "~~~", " ```py", "    ", "\t", "- ", "* ", "1. ", "2) ", "> ", "| a | b |", "| --- | --- |", "---", "===", "***", "_ _ _", "<div>", "<b>", "<!-- c -->", "word", "wörd\xa0", "`c`", "``", "$x_1$", "$$", "$$E=\\frac{a}{b}$$", "*e*", "**s**", "_u_", "~~d~~", "~", "[l](u)", '![i](p "t")', "[", "]", "!", "\\", "\\*", "&amp;", "&", "<a@b.c>", "\n", "\n", "\n", "\n\n", "  \n", "   \n", " \n", "\r\n", "[x] ", "٣. ", "#h", " x"]


def test_markdown_is_read_as_before():
    """The digest was taken of what the reader without its short cuts made of these texts."""
    rng, told = random.Random(11), hashlib.sha256()
    for _ in range(4000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30)))
        told.update(repr([tuple(e) for e in events(text, rng.random() < 0.8)]).encode())
    assert told.hexdigest() == "b4ed81b112c6fdb98e7678dd61bd6d850cd3f20833b5a3c926c3b3063b156cc6"


def test_packages_are_those_of_the_library(monkeypatch):
    packed = []
    monkeypatch.setattr(zlib, "compressobj", lambda *a, make=zlib.compressobj: packed.append(a) or make(*a))
    parts = [("mimetype", "x"), ("a.xml", "é" * 5000), ("b.xml", b""), ("c.xml", "c" * 9000)]
    assert package._zipped(parts, ("mimetype",), ("b.xml", "c.xml")) == package._zipped_by_library([(n, b.encode() if isinstance(b, str) else b) for n, b in parts], ("mimetype",))
    package.to_word("first")
    packed.clear()
    made = package.to_word("# second *one*")
    assert len(packed) == 2  # the document and its source; seven parts before
    assert zipfile.ZipFile(io.BytesIO(made)).testzip() is None and office.recover_word(made) == ("# second *one*", True)
