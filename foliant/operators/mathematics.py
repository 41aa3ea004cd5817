"""Macros and LaTeX transcoding over a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import latex as K
from ..kernels.typst import to_typst
from .rowwise import each, many


def macros(docs: DataFrame, key: str = "doc_id", md: str = "md") -> DataFrame:
    """(key, ord, name, argc, body) of the macros that each document defines; of one defined twice, the later."""
    return many(docs, key, {"md": md}, "name string, argc int, body string", lambda md: [(n, m.argc, m.body) for n, m in K.macros_of(md or "").items()])


def macro_map(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, macros): macros() as one map for each document."""
    return found.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("argc", "body")))).alias("macros"))


def convert_latex(equations: DataFrame, key: str, latex: str = "latex", macros: str | None = None) -> DataFrame:
    """(key, clean, unicode, typst, error): each formula expanded and cleaned, as plain text and as Typst mathematics. ``macros`` is a column of macro_map()."""

    def one(latex: str | None, macros: object) -> tuple:
        if latex is None:
            return None, None, None
        known = {n: K.Macro(m["argc"], m["body"]) for n, m in dict(macros or {}).items()}
        return K.expand_and_sanitize(latex, known), K.to_unicode(latex, known), to_typst(latex, known)

    return each(equations, key, {"latex": latex, "macros": macros or F.lit(None).cast("map<string,struct<argc:int,body:string>>")}, "clean string, unicode string, typst string", one)
