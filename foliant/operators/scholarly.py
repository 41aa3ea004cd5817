"""Cross-references, bibliographies and citations over a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import scholarly as K
from ..rows import with_uid
from .rowwise import each, many


def resolve_references(docs: DataFrame, key: str = "doc_id", md: str = "md") -> DataFrame:
    """(key, md, error): numbered headings, labels removed, references resolved. A null text stays null."""
    return each(docs, key, {"md": md}, "md string", lambda md: (None if md is None else K.resolve_references(md),))


def labels(docs: DataFrame, key: str = "doc_id", md: str = "md") -> DataFrame:
    """(key, ord, label, number) of sections, display equations and figures."""
    return many(docs, key, {"md": md}, "label string, number string", lambda md: list(K.labels_of(md or "").items()))


def bibliography(sources: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, ord, cited, kind, fields, reference) of every entry of BibTeX texts; ``reference`` is the line of a numbered list."""
    return many(sources, key, {"text": text}, "cited string, kind string, fields map<string,string>, reference string", lambda text: [(e.key, e.kind, list(e.fields.items()), e.numeric()) for e in K.parse_bibtex(text or "").values()])


def cite(docs: DataFrame, bib: DataFrame, key: str = "doc_id", md: str = "md") -> DataFrame:
    r"""(key, md, cited, error): citations as numbers, with a reference list, and the cited keys in order.

    ``bib`` (cited, kind, fields), one row for each key, is not collected: each document gets the entries among the keys that it could cite, by a join.
    """
    rows = with_uid(docs.select(docs[key].alias("key"), docs[md].alias("md")))
    citing = rows.where(F.contains("md", F.lit("[@")) | F.contains("md", F.lit("\\cite{")))
    asked = many(citing, "uid", {"md": "md"}, "cited string", lambda md: [(k,) for k in sorted(_candidates(md))])
    known = asked.join(bib.select("cited", "kind", "fields"), "cited").groupBy("uid").agg(F.collect_list(F.struct("cited", "kind", "fields")).alias("bib"))
    met = rows.join(known, "uid", "left").select(F.col("key").alias(key), "md", "bib")

    def one(md: str | None, bib: list | None) -> tuple:
        if md is None or not bib:
            return md, []
        return K.cite(md, {e["cited"]: K.Entry(e["cited"], e["kind"], dict(e["fields"])) for e in bib})

    return each(met, key, {"md": "md", "bib": "bib"}, "md string, cited array<string>", one)


def _candidates(md: str) -> set[str]:
    """All keys of all groups."""
    found: set[str] = set()
    for m in K.CITED.finditer(md):
        pandoc = m[0] == "[@"
        close = md.find("]" if pandoc else "}", m.end())
        if close != -1:
            inner = md[m.start() + 1 : close] if pandoc else md[m.end() : close]
            for k in inner.split("; " if pandoc else ","):
                k = k.strip().lstrip("@").strip() if pandoc else k.strip()
                if k:
                    found.add(k)
    return found
