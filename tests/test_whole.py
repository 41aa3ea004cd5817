"""Queries without SQL, that work on whole documents, against brute force."""

import os
import re
from pathlib import Path

from foliant import queries as q
from pyspark.sql import functions as F

from foliant.functions import artifacts as A
from foliant.functions import text as T
from foliant.operators import blocks as B
from foliant.operators import structure as S
from foliant.kernels.blocks import parse_blocks, split_inline
from foliant.plans.decorate import decorated

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
#: A phrase for each of the 25 patterns, in their order.
OPENINGS = ["Of course, ", "It's worth noting that ", "It is important to note that ", "Additionally, ", "Furthermore, ", "Moreover ", "In conclusion, ", "In summary, ", "To summarize, "]
CLOSINGS = [" I hope this helps!", " Let me know if you have any questions.", " Feel free to reach out to us."]
SELF = ["As an AI language model, ", "As a large language model, "]
FRENCH = ["Avec plaisir! ", "Il est important de souligner que ", "Il convient de préciser que ", "Il est essentiel de noter ", "En outre, ", "Pour résumer, "], [" J'espère que cela vous aide.", " N'hésitez pas à poser vos questions.", " Si vous avez d'autres questions, écrivez."], ["En tant qu'IA, ", "En tant que grand modèle de langage, "]


def cleaned(md):
    for pattern in A.TICS:
        md = re.sub(re.sub(r"^\(\?(i|im)dU\)|^\(\?iU\)", lambda f: "(?im)" if "m" in f[0] else "(?i)", pattern), "", md)
    md = re.sub("[ \t]+([;!?])", "\u00a0\\1", md)
    return re.sub("[ \t]+»", "\u00a0»", re.sub("«[ \t]+", "«\u00a0", md))


def table(spark, folder, texts):
    rows = [(i, t, "fr" if i % 2 else "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_decontaminate_reads_whole_documents(spark, tmp_path):
    whole = [f"first line\n{p}kept {i}\nlast ; line" for i, p in enumerate(OPENINGS + FRENCH[0])]
    whole += [f"first line\nkept {i}{p}\nlast line « x »" for i, p in enumerate(CLOSINGS + FRENCH[1])]
    whole += [f"first line\nso {p}kept {i} ?" for i, p in enumerate(SELF + FRENCH[2])]
    folder = table(spark, tmp_path, whole)
    found = {r["doc_id"]: r["text"] for r in q.QUERIES["decontaminate_prose"](spark, folder).collect()}
    assert len(A.TICS) == len(whole) == len(found) == 25
    phrases = OPENINGS + FRENCH[0] + CLOSINGS + FRENCH[1] + SELF + FRENCH[2]
    for i, phrase in enumerate(phrases):
        assert phrase.strip() not in found[i] and "kept" in found[i]
    for r in decorated(spark, folder).collect():
        assert found[r["doc_id"]] == cleaned(r["md"])


def test_decontaminate_equals_brute_force(spark):
    found = {r["doc_id"]: r["text"] for r in q.QUERIES["decontaminate_prose"](spark, DATA).collect()}
    rows = decorated(spark, DATA).collect()
    assert len(found) == len(rows) > 0
    assert all(found[r["doc_id"]] == cleaned(r["md"]) for r in rows)


def test_measures_by_hand(spark):
    md = "# A # b {#x}\n\npara $x$ and \\(y\\)\nmore\n\n## Deep\n- a $z$\n- b\n\n1. c\n\n> q\n> r\n\n---\n\n| a |\n| - |\n\n```py\n$no$ ![x](y)\n```\n\n~~~\nx\n~~~\n\n$$\nE\n$$\n\n<div>\nh $v$\n</div>\n\n![i](p) [l](u)\n"
    docs = spark.createDataFrame([(1, md), (2, None), (2, ""), (3, "a\nb")], "doc_id long, md string")
    rows = sorted(B.analysis(docs).collect(), key=lambda r: (r["doc_id"], r["chars"]))
    assert len(rows) == 4
    r = rows[0].asDict(recursive=True)
    assert r["outline"] == [{"level": 1, "text": "A # b {#x}"}, {"level": 2, "text": "Deep"}]
    assert r["languages"] == ["py"]
    wanted = {"headings": 2, "display_equations": 1, "inline_equations": 4, "equations": 5, "code_blocks": 1, "bullet_lists": 1, "ordered_lists": 1, "quotes": 1, "tables": 1, "rules": 1, "html_blocks": 1, "paragraphs": 3, "images": 2, "links": 1, "n_lines": md.count("\n"), "chars": len(md)}
    assert {k: r[k] for k in wanted} == wanted
    for empty in rows[1:3]:
        assert all(empty[k] == 0 for k in empty.asDict() if k not in ("doc_id", "outline", "languages")) and not empty["outline"]
    assert rows[3]["n_lines"] == 2 and rows[3]["paragraphs"] == 1


def test_measures_equal_brute_force(spark):
    found = {r["doc_id"]: r for r in q.QUERIES["document_measures"](spark, DATA).collect()}
    rows = decorated(spark, DATA).collect()
    assert len(found) == len(rows) > 0
    names = {"heading": "headings", "equation": "display_equations", "code": "code_blocks", "bullets": "bullet_lists", "ordered": "ordered_lists", "quote": "quotes", "table": "tables", "rule": "rules", "html": "html_blocks", "paragraph": "paragraphs"}
    for d in rows:
        r, md = found[d["doc_id"]], d["md"]
        blocks = parse_blocks(md)
        assert sum(r[n] for n in names.values()) == len(blocks)
        for kind, name in names.items():
            assert r[name] == sum(b[0] == kind for b in blocks)
        assert len(r["outline"]) == r["headings"] and r["equations"] == r["display_equations"] + r["inline_equations"]
        texts = ["\n".join(x.rstrip("\r") for x in md.split("\n")[b[3] : b[4]]) for b in blocks if b[0] not in ("code", "equation")]
        assert r["inline_equations"] == sum(r.is_equation for t in texts for r in split_inline(t))
        assert (r["chars"], r["images"], r["n_lines"]) == (len(md), md.count("!["), md.count("\n") + (not md.endswith("\n")))


def test_citation_order(spark):
    cases = {
        1: (r"\cite{b,a} then [@a; @c]", {"b": 1, "a": 2, "c": 3}),
        2: ("[@a; @no; @b] and [@c]", {"a": 1, "c": 2}),  # the group ends at the unknown key
        3: (r"[@no; @a] \cite{no,b} \cite{ c , a}", {"c": 1, "a": 2}),
        4: (r"[@no \cite{b}] [@a]", {"b": 1, "a": 2}),  # a literal group's inside is read on
        5: ("[@a;@b] [@b", {}),
        6: ("```\n[@b]\n```\n\\cite{a,\nc}", {"b": 1, "a": 2, "c": 3}),
        7: ("[@]; \\cite{} \\cite{", {}),
        8: (None, {}),
    }
    docs = spark.createDataFrame([(k, md) for k, (md, _) in cases.items()], "doc_id long, md string")
    bib = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "key string")
    found = {}
    for r in S.citation_order(docs, bib).collect():
        found.setdefault(r["doc_id"], {})[r["cited"]] = r["number"]
    assert found == {k: w for k, (_, w) in cases.items() if w}


def test_citation_order_on_the_documents(spark):
    found = sorted((r["doc_id"], r["cited"], r["number"]) for r in q.QUERIES["citation_order"](spark, DATA).collect())
    wanted = []
    for r in decorated(spark, DATA).collect():
        k = r["doc_id"] % 4
        wanted += [] if k == 3 else [(r["doc_id"], f"k{k}", 1)] + [(r["doc_id"], "k1", 2)] * (k != 1)
        assert r["md"].count("[@") == 1 and "\\cite{" not in r["md"]
    assert found == sorted(wanted)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_suggestions_miss_no_word_within_two_edits(spark):
    import random

    rng = random.Random(5)
    make = lambda n: "".join(rng.choice("abé") for _ in range(n))
    known = sorted({make(rng.randint(1, 9)) for _ in range(250)} | {"hello", "abcdefgh"})
    wrong = sorted({make(rng.randint(1, 10)) for _ in range(60)} | {"jello", "ello", "abcdefghij", "cdefgh", "a"})
    found = {(r["word"], r["suggestion"], r["rank"]) for r in S.suggestions(spark.createDataFrame([(w,) for w in wrong], "word string"), spark.createDataFrame([(w,) for w in known], "word string"), most=1000).collect()}
    wanted = set()
    for w in wrong:
        near = sorted((d, s) for s in known if (d := distance(w, s)) <= 2)
        wanted |= {(w, s, k) for k, (_, s) in enumerate(near, 1)}
    assert found == wanted
    assert {("jello", "hello"), ("ello", "hello"), ("abcdefghij", "abcdefgh"), ("cdefgh", "abcdefgh")} <= {x[:2] for x in found}


def test_csv_table_keeps_every_row(spark):
    docs = spark.range(1).select(F.concat(F.lit("h\n"), F.repeat(F.lit("r\n"), F.lit(1_000_500)), F.lit("last")).alias("t"))
    md = docs.select(T.csv_table(F.col("t")).alias("md"))
    assert md.select(F.size(F.split("md", "\n")), F.right("md", F.lit(9))).first() == (1_000_504, "| last |\n")
    assert spark.createDataFrame([("a,b",), ("",)], "t string").select(T.csv_table(F.col("t"))).collect()[0][0] == "| a | b |\n| --- | --- |\n"
