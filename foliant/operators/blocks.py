"""Blocks, inline mathematics and display equations of Markdown, parsed per document in Arrow batches."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..kernels.blocks import KINDS, display_equations, lines_with_ends, parse_blocks, split_inline
from .rowwise import many


def blocks(docs: DataFrame, key: str = "doc_id", md: str = "md") -> DataFrame:
    """(key, ord, kind, level, info, first_line, n_lines, content, latex) of every block; null texts have none."""

    def parsed(md: str | None) -> list[tuple]:
        lines = lines_with_ends(md or "")
        return [(b.kind, b.level, b.info, b.first, b.stop - b.first, "\n".join(lines[b.first : b.stop]), b.latex) for b in parse_blocks(md or "")]

    return many(docs, key, {"md": md}, "kind string, level int, info string, first_line long, n_lines long, content string, latex string", parsed)


def block_counts(docs: DataFrame, key: str = "doc_id", md: str = "md") -> DataFrame:
    """(key, one column for each kind): how many blocks of each kind a document has."""
    found = blocks(docs, key, md).select(key, "kind")
    counts = found.groupBy(key).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in KINDS])
    return docs.select(key).join(counts, key, "left").fillna(0)


def analysis(docs: DataFrame, key: str = "doc_id", md: str = "md") -> DataFrame:
    """(key, measures): what a whole document holds, a row for every row; a null text is empty.

    Words, characters, lines (as text editors count them), reading minutes, images and links are native; outline (headings as
    they stand, without the marks), equations, code blocks and their languages, lists, quotes, tables, rules, HTML
    blocks and paragraphs come from the parser.
    """
    text = F.coalesce(F.col(md), F.lit(""))
    words = T.word_count(text)
    n_lines = F.size(T.lines(text)) - F.when((text == "") | F.endswith(text, F.lit("\n")), 1).otherwise(0)
    scalars = {"words": words, "chars": F.length(text), "n_lines": n_lines, "reading_minutes": T.reading_minutes(words), "images": T.image_count(text), "links": T.link_count(text)}
    native = list(scalars)
    ready = docs.select(F.col(key), text.alias("_md"), *[c.cast("long").alias(n) for n, c in scalars.items()])
    kinds = {"headings": "heading", "display_equations": "equation", "code_blocks": "code", "bullet_lists": "bullets", "ordered_lists": "ordered", "quotes": "quote", "tables": "table", "rules": "rule", "html_blocks": "html", "paragraphs": "paragraph"}
    heading = pa.struct([("level", pa.int32()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for small in range(0, batch.num_rows, 256):
                part = batch.slice(small, 256)
                counts, inline, outlines, languages = {n: [] for n in kinds}, [], [], []
                for text in part.column("_md").to_pylist():
                    lines, found = lines_with_ends(text), parse_blocks(text)
                    held = Counter(b.kind for b in found)
                    for n, kind in kinds.items():
                        counts[n].append(held[kind])
                    outlines.append([{"level": level, "text": "\n".join(lines[a:b]).strip().lstrip("#").strip()} for kind, level, _, a, b, _ in found if kind == "heading"])
                    languages.append([info for kind, _, info, *_ in found if kind == "code" and info])
                    inline.append(sum(r.is_equation for kind, _, _, a, b, _ in found if kind not in ("code", "equation") for r in split_inline("\n".join(lines[a:b]))))
                total = [a + b for a, b in zip(counts["display_equations"], inline, strict=True)]
                numbers = [pa.array(c, pa.int64()) for c in (*counts.values(), inline, total)]
                yield pa.RecordBatch.from_arrays([part.column(key), *(part.column(n) for n in native), *numbers, pa.array(outlines, pa.list_(heading)), pa.array(languages, pa.list_(pa.string()))], names)

    names = [key, *native, *kinds, "inline_equations", "equations", "outline", "languages"]
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names[1:-2]) + ", outline array<struct<level: int, text: string>>, languages array<string>"
    return ready.mapInArrow(run, schema)


def equations(docs: DataFrame, key: str = "doc_id", md: str = "md") -> DataFrame:
    """(key, ord, latex) of display equations, delimiters taken off; those of unclosed openers do not count."""
    return many(docs, key, {"md": md}, "latex string", lambda md: [(x,) for x in display_equations(md or "")])


def inline_equations(docs: DataFrame, key: str = "doc_id", md: str = "md") -> DataFrame:
    """(key, ord, latex) of inline equations in all blocks but code and display mathematics."""

    def listed(md: str | None) -> list[tuple]:
        md = md or ""
        if "$" not in md and "\\(" not in md:
            return []
        lines = lines_with_ends(md)
        return [(r.text,) for b in parse_blocks(md) if b.kind not in ("code", "equation") for r in split_inline("\n".join(lines[b.first : b.stop])) if r.is_equation]

    return many(docs, key, {"md": md}, "latex string", listed)
