"""Tables, segments, images and misspelt words of documents as child tables, and edits of whole blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..kernels import segments as K
from ..kernels import spelling, tables
from ..kernels.blocks import parse_blocks
from .rowwise import each, many


def table_cells(docs: DataFrame, key: str = "doc_id", md: str = "md") -> DataFrame:
    """(key, ord, tbl, row, col, text, begin, end) of every cell of every table; places count characters of the document."""

    def cells(md: str | None) -> list[tuple]:
        md, out = md or "", []
        if "|" not in md:
            return []
        lines = md.split("\n")
        starts = [0]
        for line in lines:
            starts.append(starts[-1] + len(line) + 1)
        for n, b in enumerate(b for b in parse_blocks(md) if b.kind == "table"):
            out += [(n, *c) for c in tables.parse_cells("\n".join(lines[b.first : b.stop]), starts[b.first])]
        return out

    return many(docs, key, {"md": md}, "tbl long, row long, col long, text string, begin long, `end` long", cells)


def segments(docs: DataFrame, key: str = "doc_id", md: str = "md") -> DataFrame:
    """(key, ord, is_equation, content, begin, end): text and display equations in turn."""
    return many(docs, key, {"md": md}, "is_equation boolean, content string, begin long, `end` long", lambda md: K.preview_segments(md or ""))


def located_images(docs: DataFrame, key: str = "doc_id", md: str = "md") -> DataFrame:
    """(key, ord, alt, path, begin, end) of image references."""
    return many(docs, key, {"md": md}, "alt string, path string, begin long, `end` long", lambda md: K.images(md or ""))


def figures(docs: DataFrame, key: str = "doc_id", md: str = "md") -> DataFrame:
    """(key, path, ord): the images of a document, each once, by first appearance."""
    return located_images(docs, key, md).groupBy(key, "path").agg(F.min("ord").alias("ord"))


def located_words(docs: DataFrame, key: str = "doc_id", md: str = "md") -> DataFrame:
    """(key, ord, word, begin, end) of the words that a spell check looks at."""
    return many(docs, key, {"md": md}, "word string, begin long, `end` long", lambda md: spelling.words(md or ""))


def located_misspellings(docs: DataFrame, dictionary: DataFrame, key: str = "doc_id", md: str = "md") -> DataFrame:
    """located_words() that a dictionary (word) has neither as they stand nor in lower case."""
    known = dictionary.select("word").distinct()
    found = located_words(docs, key, md).withColumn("low", F.lower("word"))
    return found.join(known, "word", "left_anti").join(known.withColumnRenamed("word", "low"), "low", "left_anti").drop("low")


def dictionary(sources: DataFrame, aff: str = "aff", dic: str = "dic") -> DataFrame:
    """(word) of Hunspell dictionaries, whose texts are columns."""
    numbered = sources.select(F.monotonically_increasing_id().alias("id"), aff, dic)
    return many(numbered, "id", {"aff": aff, "dic": dic}, "word string", lambda aff, dic: [(w,) for w in sorted(spelling.expand_dictionary(aff or "", dic or ""))]).select("word").distinct()


def move_blocks(docs: DataFrame, source: Column, target: Column, key: str = "doc_id", md: str = "md") -> DataFrame:
    """(key, md, error): a block of each document moved to another place."""
    return each(docs, key, {"md": md, "source": source, "target": target}, "md string", lambda md, source, target: (None if md is None else K.move_block(md, source, target),))


def equation_images(equations: DataFrame, latex: str = "latex") -> DataFrame:
    """(latex, uses): what has to be rendered, each formula once."""
    return equations.groupBy(latex).agg(F.count("*").alias("uses"))


def unique_names(files: DataFrame, folder: str, name: str) -> DataFrame:
    """Adds ``unique``: names as they are, and name_1, name_2, … for the second and later files of a name in a folder."""
    nth = F.row_number().over(Window.partitionBy(folder, name).orderBy(F.monotonically_increasing_id())) - 1
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    return files.withColumn("unique", F.when(nth == 0, F.col(name)).otherwise(F.concat(stem, F.lit("_"), nth.cast("string"), ext)))


def messages(keys: DataFrame, texts: DataFrame, language: str, fallback: str = "en") -> DataFrame:
    """(key, text): each key's message in a language, else in the fallback, else the key. ``texts`` has (language, key, text)."""
    own = texts.where(F.col("language") == language).select("key", F.col("text").alias("own"))
    other = texts.where(F.col("language") == fallback).select("key", F.col("text").alias("other"))
    return keys.select("key").join(own, "key", "left").join(other, "key", "left").select("key", F.coalesce("own", "other", "key").alias("text"))


def jobs(files: DataFrame, batch_target: str) -> DataFrame:
    """Files, each path once, with ``target``: its own, else the batch's."""
    return files.dropDuplicates(["path"]).withColumn("target", F.coalesce("target", F.lit(batch_target)))
