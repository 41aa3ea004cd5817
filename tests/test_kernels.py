"""Parsers and writers in plain Python, case by case."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.kernels import blocks, encoding, export, html, latex, markdown, markup, office, omml, package, purify, records, scholarly, segments, spelling, tables, tex, typst
from foliant.sinks.files import EXPORTERS
from foliant.sources.files import IMPORTERS, import_file

MD = "# T *x*\n\npara **b _i_** `c` [l](u) ![a](p.png) $x^2$ ~~s~~  \nhard\nsoft\n\n- a\n- b\n  - c\n\n1. x\n2. y\n\n> q\n\n```py\ncode\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n---\n\n$$\nE=mc^2\n$$\n"


# ---------------------------------------------------------------- cleaning


@pytest.mark.parametrize(
    ("text", "form", "wanted"),
    [
        ("a\U000e0041b\n```\nc\U000e0042\n```\n", "markdown", "ab\n```\nc\n```\n"),  # watermarks go everywhere
        ("x — y $a — b$ z", "markdown", "x - y $a — b$ z"),
        ("$$a − b$$ \\[c − d\\] \\(e − f\\) − g", "markdown", "$$a − b$$ \\[c − d\\] \\(e − f\\) - g"),
        ("r\u0430re `r\u0430re`", "markdown", "rare `r\u0430re`"),
        ("---\nt: r\u0430 — x\n---\nr\u0430", "markdown", "---\nt: r\u0430 - x\n---\nra"),
        ("a\r\nb -- c\u200b", "prose", "a\nb - c"),
        ("a --- b", "prose", "a --- b"),
        ("“q” ’", "prose", "“q” ’"),
        ("\ufeffa\ufeffb", "prose", "\ufeffab"),
        ("{—}", "frozen", "{-}"),
        ("~~~~\na -- b\n~~~\nc -- d\n~~~~\ne -- f", "markdown", "~~~~\na -- b\n~~~\nc -- d\n~~~~\ne - f"),
        ("``a -- b`` ```c -- d``` $ e -- f$", "markdown", "``a -- b`` ```c - d``` $ e - f$"),
        ("$$ open -- x", "markdown", "$$ open - x"),
    ],
)
def test_sanitize_by_zone(text, form, wanted):
    out, report = purify.purify(text, "sanitize", form)
    assert out == wanted
    assert report["applied"] + report["skipped"] == report["artifacts_found"] == sum(report["artifact_breakdown"].values())
    assert purify.purify(text, "audit", form)[0] == text


def test_formats_and_reports():
    assert [purify.detect_format(p, t) for p, t in (("a/b.MD", ""), ("x.json", ""), ("x.rs", ""), (None, " {"), (None, "---\na\n---\n"), (None, "--- x"), ("x.zzz", "y"))] == ["markdown", "frozen", "code", "frozen", "markdown", "prose", "prose"]
    _, report = purify.purify("a—b\n“c”", "audit")
    assert (report["lines"], report["size_bytes"], report["artifacts_found"], report["applied"]) == (2, 13, 3, None)
    assert report["artifact_breakdown"] == {"dash_em": 1, "sq_left_double": 1, "sq_right_double": 1}
    assert purify.purify("a\u200cb", "sanitize", safelist="\u200c")[0] == "a\u200cb"
    with pytest.raises(ValueError):
        purify.purify("", "other")


def test_decontaminate_stays_in_prose():
    from foliant.operators.cleaning import _TICS

    out, report = purify.purify("Certainly! Oui ; `Certainly! x ;`\n```\nCertainly, no ;\n```\nFurthermore, b", "decontaminate", "markdown", tics=_TICS)
    assert out == "Oui\u00a0; `Certainly! x ;`\n```\nCertainly, no ;\n```\nb" and (report["tic_changes"], report["fr_changes"]) == (2, 1)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab `$\\[]()-~\n\r—\u200b\u0430«»;\U000e0041", max_size=60))
def test_zones_cover_the_text(text):
    parts = purify.zones(text, "markdown")
    assert "".join(text[a:b] for a, b, _ in parts) == text
    once, _ = purify.purify(text, "sanitize", "prose")
    assert not [a for a in purify.artifacts(once) if a.kind not in ("double_hyphen", "crlf", "cr") and not a.kind.startswith("sq_")]


# ---------------------------------------------------------------- blocks and mathematics


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="a#$*-`>|<div/1. \n\\[]()", max_size=80))
def test_blocks_are_ordered_and_inline_runs_join(md):
    found = blocks.parse_blocks(md)
    assert all(a.stop <= b.first and a.first < a.stop for a, b in zip(found, found[1:], strict=False))
    n = len(blocks.lines_with_ends(md))
    covered = sum(b.stop - b.first for b in found)
    assert covered <= n and all(b.kind in blocks.KINDS for b in found)
    assert blocks.join_runs(blocks.split_inline(md)) == md


def test_display_equations():
    assert blocks.display_equations("```\n$$x$$\n```\n$$a$$\n$$\nb\nc\n$$\n$$\nopen\n# h\n\\[d\\]\n") == ["a", "b\nc", "d"]
    assert [(s.is_equation, s.content.strip()) for s in segments.preview_segments("t\n$$\nx\n$$\nu\n$$\nopen")] == [(False, "t"), (True, "x"), (False, "u"), (True, "open")]
    assert blocks.code_content("```py\na\nb\n```") == ("py", "a\nb")
    text, found = segments.math_placeholders("a $x$ `$no$` $$y$$ \\(z\\)")
    assert found == [(False, "x"), (True, "y"), (False, "z")] and "`$no$`" in text


def test_edits():
    assert segments.move_block("# a\n\nb\n\nc", 2, 0) == "c\n\n# a\n\nb\n"
    assert segments.replace_equation("a\n\n$$\nx\n$$\n\n$$y$$", 1, "z") == "a\n\n$$\nx\n$$\n\n$$\nz\n$$"
    assert segments.align_block("a\n\nb", 1, "center") == 'a\n\n<div style="text-align: center">\n\nb\n\n</div>'
    assert segments.div_style('<div style="text-align: right; color: #f00">\nx\n</div>') == {"text-align": "right", "color": "#f00", "body": "x"}
    assert [segments.css_color(c) for c in ("#f00", "#00ff10", "rgb(1, 2, 300)", "red")] == [(255, 0, 0), (0, 255, 16), (1, 2, 255), None]
    assert segments.standalone_image(" ![a](b) ") is not None and segments.standalone_image("![a](b) c") is None


def test_tables():
    source = "| a | b\\|c |\n|:--|--:|\n| 1 |\n"
    model = tables.Table.parse(source)
    assert (model.aligns, model.rows) == (["left", "right"], [["a", "b\\|c"], ["1"]])
    assert model.source() == "| a | b\\|c |\n| :-- | --: |\n| 1 |  |\n"
    assert tables.Table.parse(model.source()).source() == model.source()
    assert model.insert_row(0).rows == [["a", "b\\|c"], ["", ""], ["1"]] and model.delete_row(1).rows == [["a", "b\\|c"]]
    assert model.insert_column(1).rows == [["a", "", "b\\|c"], ["1", "", ""]] and model.delete_column(0).aligns == ["right"]
    assert model.align(0, "center").source().startswith("| a | b\\|c |\n| :-: |")
    cells = tables.parse_cells(source, 10)
    assert [(c.row, c.column, c.text) for c in cells] == [(0, 0, "a"), (0, 1, "b\\|c"), (1, 0, "1")]
    assert all(source[c.begin - 10 : c.end - 10] == c.text for c in cells)


# ---------------------------------------------------------------- importers


def test_encodings():
    assert encoding.decode_bytes("é".encode()) == "é" == encoding.decode_bytes("é".encode("cp1252"))
    assert encoding.decode_bytes(b"\xff\xfea\x00b") == "a" and encoding.decode_bytes(b"\xef\xbb\xbfx") == "x"
    assert encoding.decode_bytes(b"\x81\x93") == "\x81“"
    assert encoding.fix_mojibake("cafÃ© â€™ d’été déjà") == "café ’ d’été déjà"
    assert encoding.fix_mojibake("Ã clean é") == "Ã clean é" and encoding.mojibake_score("Ã©") == 1


def test_html():
    md = html.html_to_md("<h1>A &amp; B</h1><p>x <strong>y</strong> <a href='u'>l</a></p><ul><li>i<ol><li>j</li></ol></li></ul><pre class='language-py'>a  b</pre><table><tr><th>k</th></tr><tr><td>v</td></tr></table><!-- c --><img src=s alt='t'>")
    assert md.startswith("# A & B\n\nx **y**l\n\n- i\n  1. j\n") and "```py\na  b\n```" in md and "| k |\n| --- |\n| v |" in md and "![t](s)" in md
    assert html.html_to_md('<math display="block"><annotation encoding="application/x-tex">x^2</annotation></math>').split() == ["$$", "x^2", "$$"]
    assert "$a$" in html.html_to_md("<p><math><mi>a</mi></math></p>") and "$t$" in html.html_to_md('<script type="math/tex">t</script>')


def test_tex():
    md = tex.tex_to_md("\\newcommand{\\R}{r}\n\\begin{document}\\title{T}\nL\\'eon \\l{} \\textbf{a\nb} $x\n + y$ \\cite[1]{k}\\foo{kept}% gone\n\\begin{abstract}Some \\emph{text}.\\end{abstract}\n\\begin{figure}\\includegraphics[w]{p.png}\\caption{C --- d}\\end{figure}\\begin{enumerate}\\item a\\item[z] b\\end{enumerate}\\begin{align*}q\\end{align*}\\begin{unknown}u\\end{unknown}\\end{document}")
    for part in ("# T", "Léon ł", "**a\nb**", "$x + y$", "kept", "> Some *text*.", "![C — d](p.png)", "1. a\n2. b", "$$\nq\n$$"):
        assert part in md
    assert "cite" not in md and "gone" not in md and "unknown" not in md


def test_markups():
    assert markup.org_to_md("* A :t:\n#+BEGIN_QUOTE\nq\n#+END_QUOTE\n2) x\nhttp://a/b/c /i/") == "# A\n\n> q\n\n1. x\nhttp://a/b/c *i*\n"
    assert markup.rst_to_md("A\n~\n\nB\n=\n\nC\n~\n\n.. note:: n\n   body\n\nx::\n\n   lit\n\n#. y :ref:`z`") == "# A\n\n\n## B\n\n\n# C\n\n\n> **note:** body\n\nx\n\n```\nlit\n```\n\n1. y z\n"
    assert markup.wiki_to_md("=\n==\n=== H ===\n<pre>\nx\n</pre>\n''i'' <ref>r</ref> <math>m</math>") == "=\n==\n### H\n\n```\nx\n```\n\n*i* r $m$\n"
    assert markup.adoc_to_md("== H\n[source,py]\n----\nx\n----\n.. n\nimage::p[a]\n====\nq\n====\nlink:u[t] stem:[y]") == "## H\n\n```py\nx\n```\n\n  1. n\n![a](p)\n\n> q\n\n[t](u) $y$\n"
    assert markup.typst_to_md("== H\n#let x = 1\n+ a _b_\n#strike[s]") == "## H\n\n1. a *b*\n~~s~~\n"


def test_records():
    book = json.dumps({"cells": [{"cell_type": "markdown", "source": ["a\n", "b"]}, {"cell_type": "code", "source": "x", "outputs": [{"output_type": "execute_result", "data": {"text/plain": ["1"]}}, {"output_type": "error"}]}, {"cell_type": "raw", "source": "r"}]})
    assert records.notebook_to_md(book) == "a\nb\n\n```python\nx\n```\n\n```\n1\n```\n\n"
    assert records.book_to_md("<x>no</x><body><section><title><p>T</p></title><p>a <emphasis>b</emphasis></p><cite>c</cite></section></body>") == "# T\n\n\na *b*\n\n\n> c\n"
    assert records.csv_to_md('a\t"b\tc"\n\n1') == "| a | b\tc |\n| --- | --- |\n| 1 |  |\n" and records.csv_to_md(" \n") == ""
    assert records.mail_to_md("subject: S\ncontent-type: text/html\n\n<b>x</b>") == "# S\n\n\n---\n\n**x**\n"
    assert records.bib_to_md("@article{k, title = {A}, url = u}") == "# References\n\n- **A**. [Link](u)\n"


HOSTILE = ["", "\0", "\\", "{" * 50, "<" * 50, "$" * 51, "[[" * 30, "\\begin{", "é" * 20, "@a{", "|" * 40, "=" * 30, "#+" * 20, "\\'", ":`" * 20]


@pytest.mark.parametrize("ext", sorted(set(IMPORTERS) - {"docx", "odt", "epub", "pptx", "ipynb"}))
def test_importers_take_anything(ext):
    for text in HOSTILE:
        assert isinstance(import_file(text.encode(), ext), str)
    with pytest.raises(ValueError):
        import_file(b"", "xyz")


# ---------------------------------------------------------------- scholarly and LaTeX


def test_references():
    md = "# A {#sec:a}\n## B \\label{b}\n\\cref{sec:a} \\ref{b} \\eqref{e} \\ref{f} \\ref{zz}\n```\n# no \\ref{b}\n```\n$$\nx\n\\label{e}\n$$\n![f](p) \\label{f}\n"
    assert scholarly.resolve_references(md) == "# 1 A\n## 1.1 B \n1 1.1 (1) 1 ?\n```\n# no \\ref{b}\n```\n$$\nx\n\n$$\n![f](p) "
    assert scholarly.resolve_references("plain\n# x\n") == "plain\n# x\n"


def test_citations():
    bib = scholarly.parse_bibtex('@comment{c}\n@article{a, Author = {X and Y}, title={T {q}}, journal="J", year=2020}\n@book{b, title={U}, publisher={P}}\n@misc{broken')
    assert set(bib) == {"a", "b"} and bib["a"].numeric() == "X, Y. T {q}. J, 2020." and bib["b"].numeric() == "U. P."
    assert scholarly.cite("[@b; @a] [@zz] \\cite{a,b}", bib)[0] == "[1, 2] [@zz] [2, 1]\n\n## References\n\n[1] U. P.\n\n[2] X, Y. T {q}. J, 2020."
    assert scholarly.cite("[@zz]", bib) == ("[@zz]", [])


def test_macros():
    known = latex.macros_of("\\newcommand{\\a}[2]{#1+#2}\\def\\b#1{no}\\def\\c{C#1}\\newcommand\\d{D}\\renewcommand{\\d}{\\a{x}{y}}\\newcommand{\\e}[1][z]{}")
    assert {n: m.argc for n, m in known.items()} == {"a": 2, "c": 1, "d": 0, "e": 1}
    assert latex.expand("\\d \\a 1\\alpha \\zz \\a{1}", known) == "x+y 1+\\alpha \\zz \\a{1}"
    assert latex.expand("\\loop", {"loop": latex.Macro(0, "\\loop x")}).count("x") == 8
    assert latex.sanitize("\\label{x}\\reflect\\ref{y} a\\quad b\\begin{equation*}c\\end{equation*}\\notag") == "\\reflect a  bc"


def test_unicode_and_typst():
    assert latex.to_unicode("\\left( \\alpha \\le x_1^2 \\right) \\frac{1}{ab} \\sqrt{y} \\mathbb{R} \\\\beta") == "( α ≤ x₁² ) 1/(ab) √(y) R β"
    assert latex.to_unicode("x_{ij}^{n+1} \\unknown{z}") == "xᵢⱼⁿ⁺¹ unknown{z}"
    assert latex.normalize_escapes("a\\\\alpha \\_ \\\\ b") == "a\\alpha _   b"
    assert len(latex.SYMBOLS) == 238
    assert typst.to_typst("ERV") == "E R V" and typst.to_typst("R(VIF)") == "R(V I F)"
    assert typst.to_typst("\\mathrm{rank} \\varepsilon \\frac{a}{bc} \\text{if x}") == 'upright("rank") epsilon a/(b c) "if x"'
    assert typst.to_typst("\\begin{pmatrix}a & b \\\\c & d\\end{pmatrix}") == "mat(a b ,c d)"


# ---------------------------------------------------------------- Markdown and exporters


def tags(md):
    return [(e.what, e.tag) for e in markdown.events(md) if e.tag]


def test_markdown_events():
    assert [t for w, t in tags(MD) if w == "start"] == ["heading", "emphasis", "paragraph", "strong", "emphasis", "link", "image", "strike", "list", "item", "item", "list", "item", "list", "item", "item", "quote", "paragraph", "codeblock", "table", "head", "cell", "cell", "row", "cell", "cell", "paragraph"]
    assert [t for _, t in tags("*a **b** c*")] == ["paragraph", "emphasis", "strong", "strong", "emphasis", "paragraph"]
    assert [t for _, t in tags("**a*")] == ["paragraph", "emphasis", "emphasis", "paragraph"]
    assert [t for _, t in tags("a_b_c __d__")] == ["paragraph", "strong", "strong", "paragraph"]
    assert [e.value for e in markdown.events("`a``b` <http://x> &amp; \\*") if e.value] == ["a``b", " ", "http://x", "http://x", "http://x", " & *"]
    assert [e.what for e in markdown.events("- [x] a\n- [ ] b")].count("task") == 2
    assert [t for w, t in tags("Title\n===\n\n    code\n\n***") if w == "start"] == ["heading", "codeblock"]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab*_~`[]()!#>-|$\\<&; \n1.", max_size=60))
def test_events_balance_and_exporters_take_anything(md):
    depth = []
    for e in markdown.events(md):
        if e.what == "start":
            depth.append(e.tag)
        elif e.what == "end":
            assert depth.pop() == e.tag
    assert not depth
    for make in EXPORTERS.values():
        assert isinstance(make(md, "T", "A"), bytes)
    assert office.recover_word(package.to_word(md)) == (md, True) or "\0" in md


def test_exports():
    assert "[Image: a]" in export.to_txt(MD) and "E=mc²" in export.to_txt(MD) and "  • a" in export.to_txt(MD)
    told = export.to_tex(MD, "T & U", "A")
    assert "\\title{T \\& U}" in told and "\\textbf{b \\textit{i}}" in told and "\\begin{equation}\nE=mc^2\n\\end{equation}" in told and "1 & 2 \\\\ \\hline" in told
    assert "#table(\n  columns: 2," in export.to_typst_source(MD) and '#link("u")[l]' in export.to_typst_source(MD)
    assert "\\trowd" in export.to_rtf(MD) and export.to_rtf("é").count("\\u233?") == 1
    assert "|---+---|" in export.to_org(MD) and ".. list-table::" in export.to_rst(MD) and "|===" in export.to_adoc(MD)
    assert [c["cell_type"] for c in json.loads(export.to_notebook(MD))["cells"]] == ["markdown", "code", "markdown"]
    page = export.to_html(MD, "T", "A", images={"p.png": b"x"})
    assert "data:image/png;base64,eA==" in page and "<td>2</td>" in page and "<title>T</title>" in page
    assert export.split_display("a $$x$$ ```\n$$no$$\n``` \\[y\\] $$open")[1] == (True, "x")
    assert (export.fit_width(10, 5, 600), export.fit_width(1200, 601, 600)) == ((10, 5), (600, 300))


# ---------------------------------------------------------------- packages


def test_word():
    data = package.to_word(MD)
    md = office.word_to_md(data)
    assert md.startswith("# T *x*") and "**b** ***i***" in md and "[l](u)" in md and "- a\n- b\n" in md and "| 1 | 2 |" in md
    kept, lossless = office.recover_word(_without(data, office.SOURCE_ENTRY))
    assert not lossless and "$$\nE=mc^2\n$$" in kept and kept.startswith("<!--")
    with pytest.raises(Exception):
        office.recover_word(b"no package")


def _without(data, name):
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(out, "w") as o:
        for n in z.namelist():
            if n != name:
                o.writestr(n, z.read(n))
    return out.getvalue()


def _word(body, notes=""):
    names = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'
    return package._zipped([("word/document.xml", f"<w:document {names}><w:body>{body}</w:body></w:document>"), ("word/comments.xml", f"<w:comments {names}>{notes}</w:comments>")])


def test_word_runs_and_mathematics():
    run = lambda t, p="": f"<w:r><w:rPr>{p}</w:rPr><w:t>{t}</w:t></w:r>"
    md = office.word_to_md(_word(f'<w:p>{run("a ", "<w:b/>")}{run("b", "<w:b/>")}{run(" c", "<w:b w:val=&quot;false&quot;/>".replace("&quot;", chr(34)))}</w:p><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr>{run("H")}</w:p>'))
    assert md == "**a b** c\n\n## H\n"
    math = "<w:p><m:oMath><m:f><m:num><m:r><m:t>α</m:t></m:r></m:num><m:den><m:r><m:t>2</m:t></m:r></m:den></m:f><m:sSup><m:e><m:r><m:t>x</m:t></m:r></m:e><m:sup><m:r><m:t>n</m:t></m:r></m:sup></m:sSup><m:nary><m:naryPr><m:chr m:val=\"∫\"/></m:naryPr><m:sub><m:r><m:t>0</m:t></m:r></m:sub><m:sup/><m:e><m:r><m:t>é</m:t></m:r></m:e></m:nary></m:oMath></w:p>"
    assert office.word_to_md(_word(math)) == "$\\frac{ \\alpha }{2}x^{n}\\int_{0} \\text{é}$\n"
    deep = "<m:d><m:e>" * 150 + "<m:r><m:t>x</m:t></m:r>" + "</m:e></m:d>" * 150
    assert "x" not in omml.to_latex(office.ElementTree.fromstring(f'<m:oMath xmlns:m="{omml.M[1:-1]}">{deep}</m:oMath>'))


def test_review():
    body = '<w:p><w:ins w:author="A" w:date="d"><w:r><w:t>new</w:t></w:r></w:ins><w:del w:author="B"><w:r><w:delText>old</w:delText></w:r></w:del><w:commentRangeStart w:id="1"/><w:r><w:t>about</w:t></w:r><w:commentRangeEnd w:id="1"/></w:p>'
    notes = '<w:comment w:id="1" w:author="C"><w:p><w:r><w:t>why</w:t></w:r></w:p></w:comment><w:comment w:id="2" w:author="foliant"><w:p><w:r><w:t>LaTeX: x</w:t></w:r></w:p></w:comment>'
    assert [tuple(i) for i in office.review_items(_word(body, notes))] == [("insertion", "A", "d", "new", ""), ("deletion", "B", "", "old", ""), ("comment", "C", "", "why", "about")]


def test_carriers():
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + b"\0" * 17 + b"\0\0\0\0IEND\xaeB`\x82"
    assert office.extract_from_png(office.embed_in_png(png, "x^2 é")) == "x^2 é" and office.extract_from_png(png) is None and office.embed_in_png(b"x", "y") == b"x"
    assert office.extract_from_svg(office.embed_in_svg("<svg></svg>", "a]]>b")) == "a]]>b"
    assert office.parse_source_xml(office.source_xml("a]]>b<&")) == "a]]>b<&"


def test_other_packages():
    assert office.opendocument_to_md(package.to_opendocument(MD)).startswith("# T *x*\n\npara **b** ***i***")
    book = office.epub_to_md(package.to_epub(MD, "T"))
    assert book.startswith("# T *x*") and "E=mc^2" in book
    slide = '<p:sp><p:ph type="title"/><a:p><a:t>T</a:t></a:p></p:sp><p:sp><p:ph/><a:p><a:t>a</a:t></a:p></p:sp><p:sp><p:ph/><a:p><a:t>b &amp; c</a:t></a:p></p:sp>'
    deck = package._zipped([("ppt/slides/slide10.xml", slide), ("ppt/slides/slide2.xml", "<x/>")])
    assert office.slides_to_md(deck) == "## Slide 1\n\n\n## Slide 2: T\n\n- a\n- b & c\n"
    assert office.rtf_to_md("{\\rtf1{\\fonttbl x}{\\*\\y z}\\b a\\b0  \\i b\\i0\\par \\'92\\~\\{c\\}}") == "**a** *b*\n\n’\u00a0{c}\n"
    assert office.part(office.zipfile.ZipFile(office.io.BytesIO(deck)), "ppt/slides/slide10.xml", 5) == "<p:sp"


def test_spelling():
    words = spelling.words("Ab `no` $no$ <no> \\no [yes](no(no)no) a don't x'\n```\nno\n```\nend")
    assert [w for w, _, _ in words] == ["Ab", "yes", "don't", "end"]
    known = spelling.expand_dictionary("SFX S Y 1\nSFX S 0 s [^s]\nPFX U Y 1\nPFX U 0 un .\n", "3\ndo/SU\nbus/S\ncat")
    assert known == {"do", "dos", "undo", "undos", "bus", "cat"}


def test_visible_text_and_edits():
    block = "## a **b c** `d` [e](u) $x^2$ f"
    assert segments.visible_text(block) == "a b c d e x^2 f"
    for s in segments.visible_map(block):
        assert s.vis_end - s.vis_begin == s.src_end - s.src_begin
    assert segments.sync_edit(block, "a b NEW c d e x^2 f") == "## a **b NEW c** `d` [e](u) $x^2$ f"
    assert segments.sync_edit(block, "a b c d e x^2 f") == block
    assert segments.sync_edit(block, "a b c d e x^3 f") is None and segments.sync_edit(block, "a f") is None
