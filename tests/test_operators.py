"""Operators over DataFrames: child tables, joins, files, streams and SQL functions."""

import json
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from foliant import conversion_queries as q
from foliant.functions import files as N
from foliant.functions import text as T
from foliant.functions.register import register
from foliant.kernels import purify as K
from foliant.operators import cleaning, mathematics, parts, scholarly
from foliant.plans.decorate import decorated
from foliant.sinks.files import batch_summary, export_documents, referenced_assets, write_annotations, write_files
from foliant.sources.files import formats, import_documents, read_folder, review_items, sibling_images, stream_folder

DATA = "/root/testdata/sf0.001"


def test_decisions_equal_the_whole_pass(spark):
    """The as-of join decides as the pass over each text does."""
    docs = decorated(spark, DATA)
    told = cleaning.decisions(cleaning.artifacts(docs), cleaning.zones(docs))
    by = {(r["doc_id"], r["applied"]): r["n"] for r in told.groupBy("doc_id", "applied").agg(F.count("*").alias("n")).collect()}
    for r in cleaning.purify(docs, "sanitize", form="markdown").collect():
        assert (by.get((r["doc_id"], True), 0), by.get((r["doc_id"], False), 0)) == (r["report"]["applied"], r["report"]["skipped"])


def test_purify_whole_documents(spark):
    rows = {r["doc_id"]: r["md"] for r in decorated(spark, DATA).collect()}
    found = {r["doc_id"]: r["text"] for r in q.QUERIES["purify_markdown"](spark, DATA).collect()}
    assert found == {k: K.purify(md, "decontaminate", "markdown", tics=cleaning._TICS)[0] for k, md in rows.items()}
    counted = Counter((a.kind, z) for md in rows.values() for a in K.artifacts(md) for z in [next(z for b, e, z in K.zones(md, "markdown") if b <= a.offset < e)])
    seen = {(r["kind"], r["zone"]): r["n"] for r in q.QUERIES["zone_decisions"](spark, DATA).collect()}
    assert seen == counted


def test_formats_and_reports(spark):
    rows = [("a.md", "x"), ("b.JSON", "x"), (None, " [1]"), (None, "---\nt\n---\nx"), ("c.zzz", "—")]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id int, path string, md string")
    native = [r[0] for r in docs.orderBy("doc_id").select(cleaning.detect_format(F.col("md"), F.col("path"))).collect()]
    done = cleaning.purify(docs, "audit", path="path").orderBy("doc_id").withColumn("json", cleaning.report_json(F.col("report"))).collect()
    assert native == [r["report"]["format"] for r in done] == ["markdown", "frozen", "frozen", "markdown", "prose"]
    assert json.loads(done[4]["json"])["artifact_breakdown"] == {"dash_em": 1} and "applied" not in json.loads(done[4]["json"])
    with pytest.raises(ValueError):
        cleaning.purify(docs, "clean")


def test_scholarly(spark):
    docs = spark.createDataFrame([(1, "# A {#a}\n\\ref{a} [@k; @j]"), (2, None), (3, "[@zz]"), (3, "\\cite{j}")], "doc_id int, md string")
    assert Counter(r["md"] for r in scholarly.resolve_references(docs).collect()) == Counter(["# 1 A\n1 [@k; @j]", None, "[@zz]", "\\cite{j}"])
    assert [(r["label"], r["number"]) for r in scholarly.labels(docs).collect()] == [("a", "1")]
    bib = scholarly.bibliography(spark.createDataFrame([(1, "@a{k, title={T}}\n@b{j, year=1}")], "id int, text string"), "id")
    found = scholarly.cite(docs, bib).collect()
    assert Counter(tuple(r["cited"] or ()) for r in found) == Counter([("k", "j"), (), (), ("j",)])


def test_macros_by_document(spark):
    docs = spark.createDataFrame([(1, "\\newcommand{\\a}{x}\\renewcommand{\\a}{y}"), (2, "none")], "doc_id int, md string")
    known = mathematics.macro_map(mathematics.macros(docs))
    met = docs.join(known, "doc_id", "left").select("doc_id", F.lit("\\a^2").alias("latex"), "macros")
    assert {r["doc_id"]: (r["unicode"], r["typst"]) for r in mathematics.convert_latex(met, "doc_id", "latex", "macros").collect()} == {1: ("y²", "y^2"), 2: ("a²", "a^2")}


def test_parts(spark):
    md = "| a | b |\n|---|---|\n| 1 | 2 |\n\n![i](p.png) ![j](p.png) ![k](http://x)\n\nWrod and word"
    docs = spark.createDataFrame([(1, md), (2, None)], "doc_id int, md string")
    assert [(r["row"], r["col"], r["text"], md[r["begin"] : r["end"]]) for r in parts.table_cells(docs).collect()] == [(0, 0, "a", "a"), (0, 1, "b", "b"), (1, 0, "1", "1"), (1, 1, "2", "2")]
    assert parts.figures(docs).count() == 2
    files = spark.createDataFrame([("p.png", b"x"), ("../q", b"y")], "path string, content binary")
    assert [(r["path"], bytes(r["content"])) for r in referenced_assets(parts.located_images(docs), files).collect()] == [("p.png", b"x")]
    words = parts.dictionary(spark.createDataFrame([("SFX S Y 1\nSFX S 0 s .", "2\nword/S\nand")], "aff string, dic string"))
    assert sorted(r["word"] for r in words.collect()) == ["and", "word", "words"]
    wrong = parts.located_misspellings(docs, words).collect()
    assert [(r["word"], md[r["begin"] : r["end"]]) for r in wrong] == [("Wrod", "Wrod")]
    moved = parts.move_blocks(docs.where("doc_id = 1"), F.lit(0), F.lit(2)).first()["md"]
    assert moved.endswith("| 1 | 2 |\n")


def test_names_and_messages(spark):
    files = spark.createDataFrame([("d", "a.png")] * 3 + [("e", "a.png"), ("d", ".x")], "folder string, name string")
    assert Counter((r["folder"], r["unique"]) for r in parts.unique_names(files, "folder", "name").collect()) == Counter([("d", "a.png"), ("d", "a_1.png"), ("d", "a_2.png"), ("e", "a.png"), ("d", ".x")])
    texts = spark.createDataFrame([("fr", "a", "oui"), ("en", "a", "yes"), ("en", "b", "no")], "language string, key string, text string")
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    assert {r["key"]: r["text"] for r in parts.messages(keys, texts, "fr").collect()} == {"a": "oui", "b": "no", "c": "c"}
    jobs = parts.jobs(spark.createDataFrame([("x", None), ("y", "pdf"), ("x", None)], "path string, target string"), "md")
    assert {(r["path"], r["target"]) for r in jobs.collect()} == {("x", "md"), ("y", "pdf")} and jobs.count() == 2
    row = spark.createDataFrame([('{"a": "1"}', "a\nb\nc", "<svg><g/></svg>", "<g/>")], "j string, t string, s string, f string")
    got = row.select(N.settings(F.col("j"), {"a": "0", "b": "2"}).alias("s"), N.settings(F.lit("broken"), {"a": "0"}).alias("d"), T.line_number(F.col("t"), F.lit(3)).alias("n"), N.embed_svg(F.col("s"), F.lit("<x/>")).alias("w"), N.embed_svg(F.col("f"), F.lit("<x/>")).alias("v")).first()
    assert (tuple(got["s"]), tuple(got["d"]), got["n"], got["w"]) == (("1", "2"), ("0",), 2, "<svg><g/><x/></svg>") and got["v"].endswith("<g/><x/></svg>")


def test_small_text_functions(spark):
    one = lambda value, column: spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]
    assert one("a\\{}$#%^&_~", T.escape_tex) == "a\\textbackslash{}\\{\\}\\$\\#\\%\\^{}\\&\\_\\textasciitilde{}"
    assert one("a*`|", T.escape_rst) == "a\\*\\`\\|" and one("#a", T.escape_typst) == "\\#a" and one("<&", T.escape_html) == "&lt;&amp;"
    assert one("    a\n b", T.outdent) == "  a\nb" and one("a\n\n\n\nb  \n", T.collapse_newlines) == "a\n\nb\n"
    assert one("Hello World", lambda c: T.subsequence(c, "hwd")) and not one("Hello", lambda c: T.subsequence(c, "oh"))
    assert one("x", T.toggle_comment) == "<!-- x -->" and one(" <!-- x -->", T.toggle_comment) == " x"
    assert one("a\nb", lambda c: T.duplicate_line(c, F.lit(1))) == "a\na\nb"
    assert one('<div style="text-align: left">', lambda c: T.set_alignment(c, "right")) == '<div style="text-align: right">'
    assert one("x \n\t\n", lambda c: T.code_block(c, "py")) == "```py\nx\n```\n" and one("a\nb", lambda c: T.subsequence(c, "ab"))


def test_files_and_streams(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.org").write_text("* T\n")
    (folder / "b.xyz").write_bytes(b"?")
    (folder / "c.md").write_bytes("é".encode("cp1252"))
    (folder / "p.PNG").write_bytes(b"x")
    (folder / "p.png").write_bytes(b"x")
    (folder / "sub" / "d.csv").write_text("x,y\n")
    found = {Path(r["path"]).name: (r["md"], r["error"]) for r in read_folder(spark, str(folder)).collect()}
    assert found["a.org"] == ("# T\n", None) and found["c.md"] == ("é", None) and found["d.csv"][0].startswith("| x | y |") and "not supported" in found["b.xyz"][1]
    assert sibling_images(spark, str(folder)).count() == 1
    query = stream_folder(spark, str(folder), "*.org").writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("arrived").select("md").first()["md"] == "# T\n"
    made = export_documents(spark.createDataFrame([("x", "# T"), ("y", None)], "name string, md string"), "html", "name")
    named = made.select(F.concat("name", F.lit("/z.html")).alias("name"), "content").unionByName(spark.createDataFrame([("../no", b"x"), ("/no", b"x")], "name string, content binary"))
    written = {r["name"]: (r["bytes"], r["error"]) for r in write_files(named, str(out)).collect()}
    assert written["x/z.html"][1] is None and (out / "x" / "z.html").read_text().startswith("<!DOCTYPE") and written["../no"][1] and written["/no"][1]
    assert tuple(batch_summary(write_files(named, str(out))).first()) == (4, 2, 2)
    write_annotations(spark.createDataFrame([(1, ["n"]), (2, [])], "key int, items array<string>"), str(out / "notes"))
    assert spark.read.json(str(out / "notes")).count() == 1
    counts = {r["direction"]: r["count"] for r in formats(spark, ("pdf", "html")).groupBy("direction").count().collect()}
    assert counts["export"] == 2 and counts["import"] > 40
    bad = import_documents(spark.createDataFrame([("a.docx", b"no")], "path string, content binary")).first()
    assert bad["md"] is None and bad["error"]
    assert review_items(spark.createDataFrame([("a.docx", None)], "path string, content binary")).count() == 0


def test_sql_functions(spark):
    names = register(spark)
    assert len(names) == 14
    row = spark.sql(r"SELECT to_markdown(cast('* T' AS binary), 'org') AS a, latex_to_unicode('x^2') AS b, latex_to_typst('ab') AS c, purify_sanitize('a—b', '') AS d, purify_audit('a—b') AS e, block_kinds('# x\n\ny') AS f, detect_format('{') AS g, to_markdown(cast('x' AS binary), 'zzz') AS h, decode(from_markdown('# T', 'org'), 'utf-8') AS i, html_to_markdown(NULL) AS j, purify_decontaminate('Certainly, x', 'prose') AS k").first()
    assert (row["a"], row["b"], row["c"], row["d"], row["e"], row["f"], row["g"], row["h"], row["j"], row["k"]) == ("# T\n", "x²", "a b", "a-b", {"dash_em": 1}, ["heading", "paragraph"], "frozen", None, None, "x")
    assert "* T" in row["i"]


def test_command_line():
    run = lambda *a: subprocess.run([sys.executable, "-m", "foliant", *a], capture_output=True, text=True, cwd=Path(__file__).parent.parent, timeout=120)
    listed = run("formats")
    assert listed.returncode == 0 and "docx" in listed.stdout.split("export:")[1] and "pptx" in listed.stdout
    assert run().returncode == 2 and run("convert", "a", "b", "zzz").returncode == 2
