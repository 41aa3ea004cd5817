"""Files of many formats as Markdown: a table of importers by extension, over binary files in batch or as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels import html, markup, office, records, tex
from ..kernels.encoding import read_text
from ..operators.rowwise import each, many


def _texts(f: Callable[[str], str]) -> Callable[[bytes], str]:
    return lambda data: f(read_text(data))


def _code(language: str) -> Callable[[bytes], str]:
    return _texts(lambda text: records.code_to_md(text, language))


_TEXT_FORMATS = {
    "md markdown txt rmd qmd rmarkdown": lambda text: text,
    "html htm": html.html_to_md,
    "tex latex": tex.tex_to_md,
    "org": markup.org_to_md,
    "rst": markup.rst_to_md,
    "wiki mediawiki": markup.wiki_to_md,
    "adoc asciidoc asc": markup.adoc_to_md,
    "typ": markup.typst_to_md,
    "ipynb": records.notebook_to_md,
    "bib": records.bib_to_md,
    "eml": records.mail_to_md,
    "csv tsv": records.csv_to_md,
}
#: extension -> what makes Markdown of a file's bytes.
IMPORTERS: dict[str, Callable[[bytes], str]] = {ext: _texts(f) for exts, f in _TEXT_FORMATS.items() for ext in exts.split()}
IMPORTERS |= {ext: _code(language) for ext, language in records.LANGUAGES.items()}
IMPORTERS |= {
    "fb2": lambda data: records.book_to_md(data.decode("utf-8")),
    "rtf": lambda data: office.rtf_to_md(data.decode("utf-8")),
    "docx": lambda data: office.recover_word(data)[0] if office.SOURCE_ENTRY.encode() in data else office.word_to_md(data),
    "odt": office.opendocument_to_md,
    "epub": office.epub_to_md,
    "pptx": office.slides_to_md,
}
IMAGES = ("png", "jpg", "jpeg", "gif", "svg", "webp")


def extension(path: Column) -> Column:
    """The lower-cased extension of a path, empty without one."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def import_file(data: bytes, ext: str) -> str:
    if ext not in IMPORTERS:
        raise ValueError(f"import of .{ext} is not supported")
    return IMPORTERS[ext](data)


def import_documents(files: DataFrame, key: str = "path", content: str = "content", ext: Column | None = None) -> DataFrame:
    """(key, md, error) of every file. One that cannot be read has an error and a null text, and stops nothing.

    ``content`` is binary; the extension comes from the key if it is not given. Works on a stream as on a table.
    """

    def one(data: bytes | None, ext: str) -> tuple:
        return (None if data is None else import_file(bytes(data), ext),)

    return each(files, key, {"data": content, "ext": extension(files[key]) if ext is None else ext}, "md string", one)


def recover_documents(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, md, lossless, fidelity, chars, bytes, preview, error) of Word files: their Markdown, and whether it is exactly what was exported."""

    def one(data: bytes | None) -> tuple:
        return (None, None) if data is None else office.recover_word(bytes(data))

    found = each(files, key, {"data": content}, "md string, lossless boolean", one)
    return found.select(key, "md", "lossless", F.when(F.col("lossless"), "lossless").otherwise(F.when(~F.col("lossless"), "partial")).alias("fidelity"), F.length("md").cast("long").alias("chars"), F.octet_length("md").cast("long").alias("bytes"), F.left("md", F.lit(200)).alias("preview"), "error")


def review_items(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, ord, kind, author, date, text, context) of tracked changes and comments in Word files."""
    return many(files, key, {"data": content}, "kind string, author string, date string, text string, context string", lambda data: [] if data is None else office.review_items(bytes(data)))


def read_folder(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """All files of a folder as Markdown."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return import_documents(files)


def stream_folder(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """The same as a stream: files are imported as they arrive in the folder."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).load(folder)
    return import_documents(files)


def sibling_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the images beside a source, not below it."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(IMAGES) + "}").load(folder).select("path", "content")


def formats(spark: SparkSession, exports: tuple[str, ...] = ()) -> DataFrame:
    """(ext, direction) of what can be imported and exported."""
    return spark.createDataFrame([(e, "import") for e in IMPORTERS] + [(e, "export") for e in exports], "ext string, direction string")
