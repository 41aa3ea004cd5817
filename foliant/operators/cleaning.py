"""Zone-aware cleaning of a corpus: anomalies and zones as child tables, the decision as a join, and the whole pass."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.artifacts import HINTS, TICS
from ..kernels import purify as K
from .rowwise import each, many

#: The stock phrases for Python's engine, whose line anchors and classes are those of the patterns without flags d and U.
_TICS = [re.compile(p[p.index(")") + 1 :], re.I | (re.M if "m" in p[: p.index(")")] else 0)) for p in TICS]
#: Fields of a report.
REPORT = "format: string, size_bytes: bigint, lines: bigint, mode: string, artifacts_found: bigint, watermarks: bigint, artifact_breakdown: map<string,bigint>, segments: bigint, applied: bigint, skipped: bigint, tic_changes: bigint, fr_changes: bigint, chars_before: bigint, chars_after: bigint"


def detect_format(text: Column, path: Column | None = None) -> Column:
    """markdown, prose, frozen or code: by extension, else by content (data begins with a brace or bracket, Markdown with front matter)."""
    front = r"(?s)\A---[ \t]*\r?\n(?:.*\n)?---[ \t]*\r*(?:\n|\z)"
    found = F.when(F.regexp_replace(text, r"(?U)\A\s+", "").rlike(r"\A[{\[]"), "frozen").when(text.rlike(front), "markdown").otherwise("prose")
    if path is None:
        return found
    extension = F.lower(F.element_at(F.split(path, r"\."), -1))
    known = F.create_map(*[F.lit(x) for ext, kind in K.FORMATS.items() for x in (ext, kind)])
    return F.coalesce(known[extension], found)


def artifacts(docs: DataFrame, key: str = "doc_id", text: str = "md", safelist: str = "") -> DataFrame:
    """(key, ord, offset, length, kind, replacement, is_watermark, is_code_safe) of every anomaly; offsets count code points. A null text has none."""
    kinds = "offset long, length long, kind string, replacement string, is_watermark boolean, is_code_safe boolean"
    return many(docs, key, {"text": text}, kinds, lambda text: K.artifacts(text or "", safelist))


def zones(docs: DataFrame, key: str = "doc_id", text: str = "md", form: str | None = "markdown") -> DataFrame:
    """(key, ord, begin, end, zone) of each text; ``form`` is a format, or None to detect it. A null text has none."""
    return many(docs, key, {"text": text}, "begin long, end long, zone string", lambda text: [] if text is None else K.zones(text, form or K.detect_format(None, text)))


def decisions(found: DataFrame, parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """artifacts() with ``zone`` and ``applied``.

    An as-of join: zones and anomalies of a document in order of place, each anomaly takes the last zone that has begun.
    """
    blank = lambda kind: F.lit(None).cast(kind)
    kinds = dict(found.dtypes)
    both = found.withColumn("at", F.col("offset")).withColumn("_zone", blank("string")).unionByName(parts.select(key, "ord", F.col("begin").alias("at"), F.col("zone").alias("_zone"), *[blank(kinds[c]).alias(c) for c in found.columns if c not in (key, "ord")]))
    order = Window.partitionBy(key).orderBy("at", F.col("_zone").isNull(), "ord").rowsBetween(Window.unboundedPreceding, 0)
    told = both.withColumn("zone", F.last("_zone", ignorenulls=True).over(order)).where("_zone IS NULL").drop("_zone", "at")
    applied = F.col("is_watermark") | ((F.col("zone") != "math") & (F.col("is_code_safe") | (F.col("zone") == "prose")))
    return told.withColumn("applied", applied)


def purify(docs: DataFrame, mode: str = "sanitize", key: str = "doc_id", text: str = "md", form: str | None = None, path: str | None = None, tics: bool = True, french: bool = True, safelist: str = "") -> DataFrame:
    """(key, text, report, error) for every row; mode audit, sanitize or decontaminate.

    ``form`` is the format of all texts; without it, it comes from the column ``path`` or the text. A null text counts as empty. What a mode does
    not measure is null in the report.
    """
    if mode not in ("audit", "sanitize", "decontaminate"):
        raise ValueError(f"no such mode: {mode}")
    phrases, hints = (_TICS, HINTS) if tics else ([], None)

    def one(text: str | None, path: str | None) -> tuple:
        out, report = K.purify(text or "", mode, form, path, phrases, french, safelist, hints)
        return out, report | {"artifact_breakdown": list(report["artifact_breakdown"].items())}

    return each(docs, key, {"text": text, "path": path or F.lit(None).cast("string")}, f"text string, report struct<{REPORT}>", one)


def report_json(report: Column) -> Column:
    """The report without what its mode does not measure."""
    return F.to_json(report)
