"""Markdown as files of many formats: a column of bytes, and one file for each row of a table."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kernels import export as X
from ..kernels import package, pdf
from ..operators.rowwise import each

#: extension -> what makes a file's text of Markdown, a title and an author.
TEXT_EXPORTERS: dict[str, Callable[[str, str, str], str]] = {
    "md": lambda md, title, author: md,
    "markdown": lambda md, title, author: md,
    "txt": lambda md, title, author: X.to_txt(md),
    "html": X.to_html,
    "htm": X.to_html,
    "tex": X.to_tex,
    "latex": X.to_tex,
    "typ": X.to_typst_source,
    "rtf": X.to_rtf,
    "org": X.to_org,
    "rst": X.to_rst,
    "adoc": X.to_adoc,
    "asciidoc": X.to_adoc,
    "ipynb": lambda md, title, author: X.to_notebook(md),
}
#: extension -> what makes a file's bytes.
EXPORTERS: dict[str, Callable[[str, str, str], bytes]] = {ext: (lambda md, title, author, f=f: f(md, title, author).encode("utf-8", "surrogatepass")) for ext, f in TEXT_EXPORTERS.items()}
EXPORTERS |= {"docx": package.to_word, "odt": package.to_opendocument, "epub": package.to_epub, "pdf": pdf.to_pdf}


def export_documents(docs: DataFrame, ext: str | Column, key: str = "doc_id", md: str = "md", title: str | None = None, author: str | None = None) -> DataFrame:
    """(key, content, error): each document's bytes in the format of ``ext``, which may differ from row to row. A null text stays null."""

    def one(md: str | None, ext: str, title: str | None, author: str | None) -> tuple:
        if ext not in EXPORTERS:
            raise ValueError(f"export to .{ext} is not supported")
        return (None if md is None else EXPORTERS[ext](md, title or "", author or ""),)

    blank = F.lit("")
    return each(docs, key, {"md": md, "ext": F.lit(ext) if isinstance(ext, str) else ext, "title": title or blank, "author": author or blank}, "content binary", one)


def write_files(files: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """Writes one file for each row below a folder that the executors share; (name, bytes, error) of each, once it is collected.

    Names that are absolute, or lead out of the folder, are refused. A file is written beside its place and then renamed, so that a task
    that runs again leaves whole files only.
    """
    import os
    import uuid

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, errors = batch.column(0).to_pylist(), [], []
            for to, data in zip(names, batch.column(1).to_pylist(), strict=True):
                try:
                    if not to or to.startswith("/") or re.search(r"(^|[/\\])\.\.([/\\]|$)", to) or ":" in to:
                        raise ValueError(f"no name for a file: {to}")
                    path = os.path.join(folder, to)
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    aside = f"{path}.{uuid.uuid4().hex}"
                    with open(aside, "wb") as f:
                        f.write(data or b"")
                    os.replace(aside, path)
                    sizes.append(len(data or b""))
                    errors.append(None)
                except Exception as e:  # a file never fails its task
                    sizes.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(errors, pa.string())], ["name", "bytes", "error"])

    return files.select(F.col(name).alias("name"), F.col(content).alias("content")).mapInArrow(run, "name string, bytes long, error string")


def batch_summary(jobs: DataFrame) -> DataFrame:
    """(total, converted, failed) of rows with an ``error``."""
    return jobs.agg(F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("converted"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def write_annotations(annotations: DataFrame, folder: str) -> None:
    """Notes on documents as JSON lines beside them; (key, items, …) rows without items are not written."""
    annotations.where(F.size("items") > 0).write.mode("overwrite").json(folder)


def referenced_assets(images: DataFrame, files: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, path, content) of the local files that documents show and that may be copied beside an export: relative names below the folder, each once.

    ``images`` has (key, path), ``files`` has (path, content) with names relative to the documents.
    """
    from ..functions.files import local_image, safe_name

    wanted = images.select(key, local_image(F.col("path")).alias("path")).where("path IS NOT NULL").where(safe_name(F.col("path"))).distinct()
    return wanted.join(files.select("path", "content"), "path").select(key, "path", "content")
