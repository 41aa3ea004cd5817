"""Queries over imported, transcoded and cleaned documents.

Sources of other formats are built around the whole text of each document; what they have to become is built by the SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import artifacts as A
from .kernels.export import _TEX_PREAMBLE, escape_xml
from .kernels.package import _zipped
from .kernels.text import ENTITIES
from .operators import cleaning, mathematics, parts, scholarly
from .operators.rowwise import each
from .plans.decorate import SQL, decorated
from .queries import ORACLES, QUERIES, register
from .sinks.files import export_documents
from .sources.files import import_documents, recover_documents
from .sources.files import review_items as word_review_items
from .sources.html import import_html

_NL = "chr(10)"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _source(lines: str) -> F.Column:
    """Lines of a source; {id} is the document's id and {text} its whole text."""
    parts = [F.col("text") if p == "text" else F.col("doc_id").cast("string") if p == "id" else F.lit(p) for p in _pieces(lines)]
    return F.concat(*parts)


def _pieces(lines: str) -> list[str]:
    out, rest = [], lines
    while rest:
        at = min((rest.find(m) for m in ("{id}", "{text}") if m in rest), default=-1)
        if at == -1:
            return [*out, rest]
        out += [rest[:at]] if at else []
        name = "id" if rest.startswith("{id}", at) else "text"
        out.append(name)
        rest = rest[at + len(name) + 2 :]
    return out


def _sql(lines: str, text: str = "t") -> str:
    """The same for the SQL side."""
    quoted = ["doc_id" if p == "id" else text if p == "text" else "'" + p.replace("'", "''") + "'" for p in _pieces(lines)]
    return " || ".join(quoted)


#: extension, source, Markdown, and the text that the Markdown has, in SQL.
_MARKUPS = (
    ("org", "#+TITLE: Doc {id}\n#+OPTIONS: x\n* Part :tag:\nsee *bold* and /it/ [[http://x][y]]\n- item\n#+BEGIN_EXAMPLE\n{text}\n#+END_EXAMPLE\n", "# Doc {id}\n\n# Part\n\nsee **bold** and *it* [y](http://x)\n- item\n```\n{text}\n```\n", "t"),
    ("rst", "Doc {id}\n" + "=" * 40 + "\n\nsee ``code`` and :math:`x`\n\nSub\n---\n\n.. code-block:: text\n\n   {text}\n", "# Doc {id}\n\n\nsee `code` and $x$\n\n## Sub\n\n\n```text\n{text}\n```\n", "rtrim(t, ' ' || chr(10))"),
    ("wiki", "== Part {id} ==\n'''b''' [[http://x|y]] {{gone}}\n<pre>\n{text}\n</pre>\n* item\n", "## Part {id}\n\n**b** [y](http://x) \n```\n{text}\n```\n\n- item\n", "t"),
    ("adoc", "= Doc {id}\n:attr: v\n\nNOTE: careful\n** item\n----\n{text}\n----\n", "# Doc {id}\n\n\n> **NOTE:** careful\n\n  - item\n```\n{text}\n```\n", "t"),
    ("typ", '= Doc {id}\n#set page()\n*b* _i_ #link("http://x")[y]\n```\n{text}\n```\n+ one\n', "# Doc {id}\n\n**b** *i* [y](http://x)\n```\n{text}\n```\n\n1. one\n", "t"),
    ("tex", "\\newcommand{\\R}{r}\n\\begin{document}\n\\section{Part {id}}\n\\textbf{b} $x$ \\'e % note\n\\begin{verbatim}\n{text}\n\\end{verbatim}\n\\end{document}\n", "<!-- latex-macros\n\\newcommand{\\R}{r}\n-->\n\n\n## Part {id}\n\n\n**b** $x$ é \n\n```\n{text}\n```\n", "trim(t, ' ' || chr(10))"),
    ("html", "<html><head><title>x</title></head><body><h1>Doc {id}</h1><ol><li>a<li>b</ol><pre class=\"language-py\">{text}</pre><table><tr><th>k</th></tr><tr><td>v</td></tr></table></body>", "# Doc {id}\n\n1. a2. b\n\n```py\n{text}{end}```\n\n\n| k |\n| --- |\n| v |\n", "t"),
)


def _markup(docs: DataFrame) -> DataFrame:
    kind = F.col("doc_id") % len(_MARKUPS)
    source, ext = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (name, lines, _, _) in enumerate(_MARKUPS):
        told = _source(lines)
        if name == "rst":  # a literal body is indented
            told = F.replace(told, F.col("text"), F.replace("text", F.lit("\n"), F.lit("\n   ")))
        if name == "html":
            told = F.replace(told, F.col("text"), F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")))
        source, ext = F.when(kind == i, told).otherwise(source), F.when(kind == i, name).otherwise(ext)
    return docs.select("doc_id", F.encode(source, "utf-8").alias("content"), ext.alias("ext"))


def _markup_sql() -> str:
    cases = []
    for i, (_, _, md, text) in enumerate(_MARKUPS):
        told = _sql(md, text)
        told = told.replace("t || '{end}```", "t || CASE WHEN suffix(t, chr(10)) THEN '' ELSE chr(10) END || '```")
        cases.append(f"WHEN {i} THEN {told}")
    return f"SELECT doc_id, CASE doc_id % {len(_MARKUPS)} {' '.join(cases)} END AS md, NULL::VARCHAR AS error FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"


@register(_markup_sql())
def import_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Org, reStructuredText, MediaWiki, AsciiDoc, Typst, LaTeX and HTML files as Markdown."""
    files = _markup(_documents(spark, sf_dir))
    return import_documents(files, "doc_id", "content", files["ext"])


_RECORDS_SQL = """SELECT doc_id, CASE doc_id % 5
WHEN 0 THEN t || CASE WHEN suffix(t, chr(10)) THEN '' ELSE chr(10) END || chr(10) || '```julia' || chr(10) || 'x = ' || doc_id || chr(10) || '```' || chr(10) || chr(10) || '```' || chr(10) || 'out' || chr(10) || '```' || chr(10) || chr(10)
WHEN 1 THEN '# Doc ' || doc_id || chr(10) || chr(10) || '**From:** a b@c  ' || chr(10) || '**Date:** d  ' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || CASE WHEN suffix(t, chr(10)) THEN t[:-2] ELSE t END
WHEN 2 THEN '```python' || chr(10) || rtrim(t, ' ' || chr(10)) || chr(10) || '```' || chr(10)
WHEN 3 THEN '# References' || chr(10) || chr(10) || '- **T' || doc_id || '** - Doe J., Roe (2020). *J*, **4**, pp. 1-2. [doi:d](https://doi.org/d)' || chr(10)
ELSE t END AS md, CASE WHEN doc_id % 5 = 4 AND doc_id % 2 = 0 THEN 'ValueError: import of .xyz is not supported' END AS error
FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 4 AND doc_id % 2 = 0 THEN NULL ELSE coalesce(text, '') END AS t FROM documents)"""


@register(_RECORDS_SQL)
def import_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notebooks, mail, source files and BibTeX as Markdown; a plain text in one of several encodings, or of an unknown kind."""
    docs = _documents(spark, sf_dir)
    number = F.col("doc_id").cast("string")
    stream = F.struct(F.lit("stream").alias("output_type"), F.lit("out").alias("text"))
    cells = F.array(F.struct(F.lit("markdown").alias("cell_type"), F.array("text").alias("source"), F.array().cast("array<struct<output_type:string,text:string>>").alias("outputs")), F.struct(F.lit("code").alias("cell_type"), F.array(F.lit("x = "), number).alias("source"), F.array(stream).alias("outputs")))
    book = F.to_json(F.struct(F.struct(F.struct(F.lit("julia").alias("language")).alias("kernelspec")).alias("metadata"), cells.alias("cells")))
    mail = F.concat(F.lit("Subject: Doc "), number, F.lit("\nFrom: a\n b@c\nDate: d\nX-Other: e\n\n"), F.col("text"))
    bib = F.concat(F.lit("@string{x = {y}}\n@article{k, title = {T"), number, F.lit('}, author = {Doe, Jane and Roe}, year = 2020, journal = "J", volume={4}, pages={1--2}, doi={d}}'))
    kind = F.col("doc_id") % 5
    coded = F.when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "utf-8"))).when(F.col("doc_id") % 3 == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "utf-16le"))).otherwise(F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "utf-16be")))
    content = F.when(kind == 0, F.encode(book, "utf-8")).when(kind == 1, F.encode(mail, "utf-8")).when(kind == 2, F.encode("text", "utf-8")).when(kind == 3, F.encode(bib, "utf-8")).otherwise(coded)
    name = F.when(kind == 0, "ipynb").when(kind == 1, "eml").when(kind == 2, "py").when(kind == 3, "bib").when(F.col("doc_id") % 2 == 0, "xyz").otherwise("txt")
    files = docs.select("doc_id", content.alias("content"), name.alias("ext"))
    return import_documents(files, "doc_id", "content", files["ext"])


_HYPHENS = "len(list_filter(regexp_extract_all(md, '-+'), lambda r: length(r) = 2))"
_FOUND = " + ".join([f"len(regexp_extract_all(md, '{p}'))" for p in A.PATTERNS.values()] + ["len(regexp_extract_all(md, '\\r\\n?'))", _HYPHENS])


@register(f"WITH {SQL} SELECT doc_id, 'prose' AS format, strlen(md)::BIGINT AS size_bytes, (length(md) - length(replace(md, chr(10), '')) + 1)::BIGINT AS lines, ({_FOUND})::BIGINT AS artifacts_found, len(regexp_extract_all(md, '[{A.WATERMARK}]'))::BIGINT AS watermarks, length(md)::BIGINT AS chars_before FROM decorated")
def purify_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a cleaning pass over prose."""
    done = cleaning.purify(decorated(spark, sf_dir), "sanitize")
    return done.select("doc_id", *[f"report.{c}" for c in ("format", "size_bytes", "lines", "artifacts_found", "watermarks", "chars_before")])


def purify_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone-aware cleaning of whole documents, stock phrases and French spacing included: code, mathematics and front matter stay."""
    return cleaning.purify(decorated(spark, sf_dir), "decontaminate", form="markdown").select("doc_id", "text", "error")


def zone_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every anomaly of every document with its zone and whether it is applied, by an as-of join; counted."""
    docs = decorated(spark, sf_dir)
    told = cleaning.decisions(cleaning.artifacts(docs), cleaning.zones(docs))
    return told.groupBy("kind", "zone", "applied").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))


_NUMBERED = "regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(md, '# Doc ', '# 1 Doc '), '## Part {#sec:a}', '## 1.1 Part'), '#### Deep', '#### 1.1.0.1 Deep'), '### Sub {#sec:b}', '### 1.1.1 Sub'), '## End {#sec:z}', '## 1.2 End'), chr(92) || 'ref{sec:b}', CASE WHEN doc_id % 3 = 0 THEN '1.1.1' ELSE '?' END), chr(92) || 'cref{sec:a}', '1.1'), chr(13) || chr(10), chr(10)), '\\n$', '')"


@register(f"WITH {SQL} SELECT doc_id, {_NUMBERED} AS md FROM decorated")
def resolved_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with numbered headings and resolved references."""
    return scholarly.resolve_references(decorated(spark, sf_dir)).select("doc_id", "md")


@register("SELECT 'c' || c_custkey AS cited, 'article' AS kind, c_name || ', Roe. On ' || c_mktsegment || '. ' || CASE WHEN c_nationkey % 2 = 0 THEN 'J' || c_nationkey || ', ' ELSE '' END || '2020.' AS reference FROM customer")
def bibliography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of BibTeX sources, one source for each nation."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    entry = F.format_string('@comment{x}\n@Article{c%s,\n  author = {%s and Roe}, title = "On   %s",%s year = 2020\n}\n', "c_custkey", "c_name", "c_mktsegment", F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit(" journal={J"), F.col("c_nationkey").cast("string"), F.lit("},"))).otherwise(""))
    sources = rows.groupBy("c_nationkey").agg(F.array_join(F.collect_list(entry), "\n").alias("text"))
    return scholarly.bibliography(sources, "c_nationkey").select("cited", "kind", "reference")


_CITED = "replace(md, '[@k' || doc_id % 4 || '; @k1]', CASE doc_id % 4 WHEN 1 THEN '[1, 1]' WHEN 3 THEN '[@k3; @k1]' ELSE '[1, 2]' END)"


@register(f"WITH {SQL} SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN md ELSE {_CITED} || {_NL} || {_NL} || '## References' || {_NL} || {_NL} || '[1] A' || doc_id % 4 || '. T.' || CASE WHEN doc_id % 4 = 1 THEN '' ELSE {_NL} || {_NL} || '[2] A1. T.' END END AS md FROM decorated")
def cited_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with numbered citations and their reference lists."""
    bib = spark.sql("SELECT concat('k', id) AS cited, 'misc' AS kind, map('author', concat('A', id), 'title', 'T') AS fields FROM range(3)")
    return scholarly.cite(decorated(spark, sf_dir), bib).select("doc_id", "md")


@register("SELECT doc_id, 'A' || doc_id || '²/(2b) ≤ αᵢ ' || CASE WHEN doc_id % 2 = 0 THEN '√(x)' ELSE 'y' END AS unicode, 'A' || doc_id || '^2/(2b) \\le \\alpha_{i} ' || CASE WHEN doc_id % 2 = 0 THEN '\\sqrt{x}' ELSE 'y' END AS clean, 'A' || doc_id || '^2/(2b) <= alpha_(i) ' || CASE WHEN doc_id % 2 = 0 THEN 'sqrt(x)' ELSE 'y' END AS typst FROM documents")
def latex_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A formula of each document, with the macros that the document defines (the later definition wins), cleaned and as plain text."""
    define = F.concat(F.lit("\\newcommand{\\foo}[1]{no}\n\\def\\half#1{}\n"), F.lit("\\renewcommand{\\foo}[1]{A#1^2}\n\\newcommand{\\end}{"), F.when(F.col("doc_id") % 2 == 0, "\\sqrt{x}").otherwise("y"), F.lit("}\n"))
    docs = _documents(spark, sf_dir).select("doc_id", F.concat("text", F.lit("\n"), define).alias("md"))
    formula = F.concat(F.lit("\\label{eq:1}\\foo{"), F.col("doc_id").cast("string"), F.lit("}/(2b) \\le\\nonumber \\alpha_{i}\\;\\end"))
    known = mathematics.macro_map(mathematics.macros(docs))
    met = docs.join(known, "doc_id", "left").select("doc_id", formula.alias("latex"), "macros")
    return mathematics.convert_latex(met, "doc_id", "latex", "macros").select("doc_id", "unicode", "clean", "typst")


_EXPORTED = "# Doc {id}\n\npara **b** *i* `c` [l](u)\n\n```text\n{text}\n```\n\n- x\n- y\n\n| a | b |\n| --- | --- |\n| 1 | {id} |\n"
#: extension, what it has to become, and the text that it has, in SQL.
_EXPORTS = (
    ("txt", "# Doc {id}\n\npara b i `c` l\n\n\n    {text}\n\n  • x\n  • y\n\nab1{id}", "replace(t, chr(10), chr(10) || '    ')"),
    ("tex", _TEX_PREAMBLE + "\\date{}\n\n\\begin{document}\n\n\n\\section{\nDoc {id}\n}\n\npara \\textbf{b} \\textit{i} \\texttt{c} \\href{u}{\nl}\n\n\\begin{lstlisting}[language=text]\n{text}\n\\end{lstlisting}\n\n\\begin{itemize}\n  \\item x\n  \\item y\n\\end{itemize}\n\n\n\\begin{table}[h]\\centering\n\\begin{tabular}{|l|l|}\n\\hline\na & b \\\\ \\hline\n1 & {id} \\\\ \\hline\n\\end{tabular}\n\\end{table}\n\n\\end{document}\n", "t"),
    ("org", "#+OPTIONS: toc:t num:t\n\n* Doc {id}\n\npara *b* /i/ =c= [[u][l]]\n\n#+begin_src text\n{text}\n#+end_src\n\n- x\n- y\n\n\n| a | b |\n|---+---|\n| 1 | {id} |\n\n", "rtrim(t, ' ' || chr(10))"),
    ("rst", "\nDoc {id}\n{line}\n\npara **b** *i* \\ ``c``\\  l\n\n.. code-block:: text\n\n   {text}\n\n- x\n- y\n\n\n.. list-table::\n   :header-rows: 1\n\n   * - a\n     - b\n   * - 1\n     - {id}\n\n", "replace(t, chr(10), chr(10) || '   ')"),
    ("adoc", ":toc:\n:stem: latexmath\n\n== Doc {id}\n\npara *b* _i_ `c` l\n\n[source,text]\n----\n{text}\n----\n\n* x\n* y\n\n\n[options=\"header\"]\n|===\n| a | b \n| 1 | {id} \n|===\n\n", "rtrim(t, ' ' || chr(10))"),
)


def _exports_sql() -> str:
    cases = []
    for i, (_, told, text) in enumerate(_EXPORTS):
        cases.append(f"WHEN {i} THEN " + _sql(told, text).replace("{line}", "' || repeat('=', 4 + length(doc_id::VARCHAR)) || '"))
    return f"SELECT doc_id, CASE doc_id % {len(_EXPORTS)} {' '.join(cases)} END AS text FROM (SELECT doc_id, replace(coalesce(text, ''), '$$', 'SS') AS t FROM documents)"


@register(_exports_sql())
def export_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as plain text, LaTeX, Org, reStructuredText and AsciiDoc. Two dollars, which would open an equation inside the fence, are written SS on both sides."""
    kind = F.element_at(F.array(*[F.lit(e) for e, _, _ in _EXPORTS]), (F.col("doc_id") % len(_EXPORTS) + 1).cast("int"))
    plain = _documents(spark, sf_dir).select("doc_id", F.replace("text", F.lit("$$"), F.lit("SS")).alias("text"))
    docs = plain.select("doc_id", _source(_EXPORTED).alias("md"), kind.alias("ext"))
    return export_documents(docs, docs["ext"], "doc_id", "md").select("doc_id", F.decode("content", "utf-8").alias("text"))


@register(f"WITH {SQL} SELECT doc_id, sha256(md) AS sha256, true AS lossless, length(md)::BIGINT AS chars, strlen(md)::BIGINT AS bytes, left(md, 200) AS preview FROM decorated")
def word_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as Word files and read back: exactly what they were."""
    files = export_documents(decorated(spark, sf_dir), "docx")
    return recover_documents(files, "doc_id").select("doc_id", F.sha2("md", 256).alias("sha256"), "lossless", "chars", "bytes", "preview")


_PACKAGED = "# Doc {id}\n\npara **b** *i* [l](u)\n\n```\n{text}\n```\n\n- x\n- y\n\n| a | b |\n| --- | --- |\n| 1 | {id} |\n"


@register("""SELECT doc_id, CASE doc_id % 2
WHEN 0 THEN '# Doc ' || doc_id || chr(10) || chr(10) || 'para **b** *i* l' || chr(10) || chr(10) || coalesce(t || chr(10) || chr(10), '') || '- x' || chr(10) || '- y' || chr(10) || chr(10) || '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 | ' || doc_id || ' |' || chr(10)
ELSE '# Doc ' || doc_id || chr(10) || chr(10) || 'para **b***i*l' || chr(10) || chr(10) || '```' || chr(10) || raw || CASE WHEN suffix(raw, chr(10)) THEN '' ELSE chr(10) END || '```' || chr(10) || chr(10) || '- x' || chr(10) || '- y' || chr(10) || chr(10) || chr(10) || '| a| b |' || chr(10) || '| --- | --- |' || chr(10) || '| 1| ' || doc_id || ' |' || chr(10) END AS md
FROM (SELECT doc_id, text AS raw, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10) || chr(10)) AS t FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))""")
def package_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as OpenDocument texts and EPUB books and imported again."""
    docs = _documents(spark, sf_dir).select("doc_id", _source(_PACKAGED).alias("md"), F.when(F.col("doc_id") % 2 == 0, "odt").otherwise("epub").alias("ext"))
    files = export_documents(docs, docs["ext"]).join(docs.select("doc_id", "ext"), "doc_id")
    return import_documents(files, "doc_id", "content", files["ext"]).select("doc_id", "md")


@register(f"""WITH {SQL}, found AS (SELECT doc_id, strpos(md, '| a | b |') AS p FROM decorated WHERE doc_id % 5 = 0)
SELECT doc_id, 0 AS tbl, c.r AS row, c.k AS col, c.t AS text, p - 1 + c.o AS begin, p + c.o AS "end" FROM found,
(VALUES (0, 0, 'a', 2), (0, 1, 'b', 6), (1, 0, '1', 26), (1, 1, '2', 30)) AS c(r, k, t, o)""")
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of all pipe tables with their places."""
    return parts.table_cells(decorated(spark, sf_dir)).drop("ord")


@register(f"WITH {SQL} SELECT doc_id, 'fig' AS alt, 'img_' || doc_id || '.png' AS path, strpos(md, '![fig]') - 1 AS begin, strpos(md, '![fig]') - 1 + length('![fig](img_' || doc_id || '.png)') AS \"end\" FROM decorated WHERE doc_id % 7 = 0")
def located_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image references with their places."""
    return parts.located_images(decorated(spark, sf_dir)).drop("ord")


@register(f"WITH {SQL}, e AS (SELECT doc_id, md, strpos(md, chr(10) || '$$' || chr(10) || 'E_') AS p FROM decorated WHERE doc_id % 4 = 0) SELECT doc_id, 1 AS ord, 'E_' || doc_id || ' = mc^2' AS content, p AS begin, p + length('$$' || chr(10) || 'E_' || doc_id || ' = mc^2' || chr(10) || '$$' || chr(10)) AS \"end\" FROM e")
def equation_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display equations as segments between texts, with their places."""
    return parts.segments(decorated(spark, sf_dir)).where("is_equation").select("doc_id", "ord", "content", "begin", "end")


_HTML = """'<h1>Doc ' || doc_id || '</h1>' || n || '<p>para <strong>b</strong> <em>i</em> <code>c</code> <a href="u">l</a></p>' || n || '<pre><code class="language-text">' || t || n || '</code></pre>' || n || '<ul>' || n || '<li>x</li>' || n || '<li>y</li>' || n || '</ul>' || n || '<table><thead><tr><th>a</th><th>b</th></tr>' || n || '</thead><tbody>' || n || '<tr><td>1</td><td>' || doc_id || '</td></tr>' || n || '</tbody></table>' || n"""


@register(f"SELECT doc_id, {_HTML} AS body FROM (SELECT doc_id, chr(10) AS n, replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS t FROM documents)")
def export_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bodies of documents written as HTML pages."""
    docs = _documents(spark, sf_dir).select("doc_id", _source(_EXPORTED).alias("md"))
    pages = export_documents(docs, "html").select("doc_id", F.decode("content", "utf-8").alias("page"))
    return pages.select("doc_id", F.regexp_extract("page", r"(?s)<body>\n(.*)</body>", 1).alias("body"))


def _reviewed(doc_id: int, text: str) -> tuple[bytes]:
    """A Word file with an insertion, a deletion and a comment."""
    names, told = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"', escape_xml(text)
    body = f'<w:p><w:ins w:author="A{doc_id}" w:date="2020"><w:r><w:t>{told}</w:t></w:r></w:ins><w:del w:author="B"><w:r><w:delText>old {doc_id}</w:delText></w:r></w:del><w:commentRangeStart w:id="7"/><w:r><w:t>about</w:t></w:r><w:commentRangeEnd w:id="7"/></w:p>'
    notes = f'<w:comment w:id="7" w:author="C"><w:p><w:r><w:t>why {doc_id}</w:t></w:r></w:p></w:comment><w:comment w:id="8" w:author="foliant"><w:p><w:r><w:t>LaTeX: x</w:t></w:r></w:p></w:comment>'
    return (_zipped([("word/document.xml", f"<w:document {names}><w:body>{body}</w:body></w:document>"), ("word/comments.xml", f"<w:comments {names}>{notes}</w:comments>")]),)


@register("""SELECT doc_id, 'insertion' AS kind, 'A' || doc_id AS author, '2020' AS date, text, '' AS context FROM documents WHERE trim(text, ' ' || chr(9) || chr(10)) <> ''
UNION ALL SELECT doc_id, 'deletion', 'B', '', 'old ' || doc_id, '' FROM documents UNION ALL SELECT doc_id, 'comment', 'C', '', 'why ' || doc_id, 'about' FROM documents""")
def review_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracked changes and comments of Word files; our own comments do not count."""
    files = each(_documents(spark, sf_dir).withColumn("id", F.col("doc_id")), "doc_id", {"doc_id": "id", "text": "text"}, "content binary", _reviewed)
    return word_review_items(files, "doc_id").drop("ord")


@register("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'f_' || o_orderkey || '_x.html' ELSE 'x_f_' || o_orderkey || '.html' END AS name,
CASE WHEN o_orderkey % 4 = 0 THEN 'image/jpeg' WHEN o_orderkey % 4 = 1 THEN 'image/svg+xml' ELSE 'image/png' END AS mime, CASE WHEN o_orderkey % 4 = 2 THEN NULL ELSE 'a b/f_' || o_orderkey || '.x' END AS local,
least(1 + o_custkey, 600)::BIGINT AS width, (CASE WHEN 1 + o_custkey <= 600 THEN 1 + o_orderkey ELSE (1 + o_orderkey) * 600 // (1 + o_custkey) END)::BIGINT AS height, o_orderkey % 5 <> 0 AS safe FROM orders""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, media types, local paths and sizes of images."""
    from .functions import files as N

    k = F.col("o_orderkey")
    base = F.concat(F.lit("dir/f_"), k.cast("string"))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", F.concat(base, F.lit(".md")).alias("path"), F.concat(base, F.element_at(F.array(F.lit(".JPG"), F.lit(".svg"), F.lit(".png"), F.lit("")), (k % 4 + 1).cast("int"))).alias("image"))
    source = F.when(k % 4 == 2, F.concat(F.lit("HTTPS://h/f_"), k.cast("string"))).otherwise(F.concat(F.lit(" file://a%20b/f_"), k.cast("string"), F.lit(".x")))
    size = N.fit_width(F.col("o_custkey") + 1, k + 1, 600)
    name = F.when(k % 3 == 0, N.output_name(F.col("path"), "html", "x")).otherwise(N.output_name(F.col("path"), "html", "x", True))
    tried = F.element_at(F.array(F.lit("../x"), F.lit("a/b"), F.lit("a..b"), F.lit("x.y"), F.lit("a/c/..d")), (k % 5 + 1).cast("int"))
    return rows.select("o_orderkey", name.alias("name"), N.image_mime(F.col("image")).alias("mime"), N.local_image(source).alias("local"), size["width"].alias("width"), size["height"].alias("height"), N.safe_name(tried).alias("safe"))


def _pages_sql() -> str:
    """Tags one kind after the other. \\x01 stands for what begins a paragraph and \\x02 for what begins a line, until all breaks are known."""
    steps = [
        ("(?s)^.*?</head>", ""), ("(?s)<!--.*?-->", "<x>"), (">[ \\t\\n\\f\\r]+", ">"), ("[ \\t\\n\\f\\r]+", " "),
        ("<ul[^>]*>|</li>", "\x02"), ("</ul>", "\n"), ("<li[^>]*>", "- "), ("<h1[^>]*>", "\x01# "), ("</h1>", "\n\n"), ("</?(?:p|div|article|section|main|header|footer|aside)(?:[ /][^>]*)?>", "\x01"), ("</?b>", "**"), ("<br ?/?>", "  \n"), ("<[^>]*>", ""),
        ("^[\x01\x02]+", ""), ("[\x01\x02]*\x01[\x01\x02]*", "\x01"), ("(\n)\x02+", "\\1"), ("\x02+", "\n"), ("(\n\n+)\x01", "\\1"), ("\n\x01", "\n\n"), ("\x01", "\n\n"),
        ("\n +\n", "\n\n"), ("\n{4,}", "\n\n\n"), ("^\n+|\n+$", ""),
    ]
    out = "html"
    for what, by in steps:
        out = f"regexp_replace({out}, '{what}', '{by}', 'g')"
    for name, char in ENTITIES:
        out = f"replace({out}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return f"SELECT page_id, {out} || chr(10) AS md, NULL::VARCHAR AS error FROM pages"


@register(_pages_sql())
def html_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as Markdown."""
    return import_html(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES |= {"purify_markdown": purify_markdown, "zone_decisions": zone_decisions}
__all__ = ["ORACLES", "QUERIES"]
