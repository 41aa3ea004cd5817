"""Markdown made from the plain shared documents, by one expression that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_NL = "chr(10)"
_BS = "chr(92)"
_PARTS = (
    f"'# Doc ' || CAST(doc_id AS STRING) || {_NL}",
    f"CASE WHEN doc_id % 8 = 0 THEN CASE WHEN lang = 'fr' THEN 'Bien sûr, ' ELSE 'Certainly, ' END ELSE '' END || 'see ' || {_BS} || 'ref{{sec:b}} and ' || {_BS} || 'cref{{sec:a}} and [@k' || CAST(doc_id % 4 AS STRING) || '; @k1].' || {_NL}",
    f"'## Part {{#sec:a}}' || {_NL}",
    f"CASE WHEN doc_id % 3 = 0 THEN '#### Deep' || {_NL} || '### Sub {{#sec:b}}' || {_NL} ELSE '' END",
    f"coalesce(text, '') || {_NL}",
    f"CASE WHEN doc_id % 2 = 0 THEN '```python' || {_NL} || '# no heading' || {_NL} || 'x = 1' || {_NL} || '```' || {_NL} ELSE '' END",
    f"CASE WHEN doc_id % 3 = 0 THEN 'Inline $a_' || CAST(doc_id AS STRING) || '$ here.' || {_NL} ELSE '' END",
    f"CASE WHEN doc_id % 4 = 0 THEN {_NL} || '$$' || {_NL} || 'E_' || CAST(doc_id AS STRING) || ' = mc^2' || {_NL} || '$$' || {_NL} || {_NL} ELSE '' END",
    f"CASE WHEN doc_id % 5 = 0 THEN {_NL} || '| a | b |' || {_NL} || '| --- | --- |' || {_NL} || '| 1 | 2 |' || {_NL} || {_NL} ELSE '' END",
    f"CASE WHEN doc_id % 7 = 0 THEN '![fig](img_' || CAST(doc_id AS STRING) || '.png) and [site](http://example.org)\U000e0041' || {_NL} ELSE '' END",
    f"CASE WHEN doc_id % 3 = 1 THEN 'in\u200bvis\u200bible\u202e' || {_NL} ELSE '' END",
    f"CASE WHEN doc_id % 4 = 1 THEN 'a \u2013 b \u2014 c -- d --- e' || {_NL} ELSE '' END",
    f"CASE WHEN doc_id % 6 = 0 THEN 'one' || chr(13) || {_NL} || 'two' || chr(13) || 'three' || {_NL} ELSE '' END",
    f"CASE WHEN doc_id % 5 = 1 THEN 'r\u0430r\u0435 \u201cquote\u201d' || {_NL} ELSE '' END",
    f"CASE WHEN lang = 'fr' THEN 'Oui ; non ! « mot »' || {_NL} ELSE '' END",
    f"'## End {{#sec:z}}' || {_NL} || '- item' || {_NL} || '1. first' || {_NL} || '> quoted' || {_NL}",
)
EXPRESSION = " || ".join(f"({p.replace('{{', '{').replace('}}', '}')})" for p in _PARTS)
#: A common table expression for the SQL side.
SQL = f"decorated AS (SELECT doc_id, lang, source, {EXPRESSION} AS md FROM documents)"


def decorated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as Markdown; a null text counts as empty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    literal = EXPRESSION.replace("chr(92)", "char(92)")
    return docs.selectExpr("doc_id", "lang", "source", f"{literal} AS md")
