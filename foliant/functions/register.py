"""The kernels as SQL functions of a session: ``register(spark)``, then ``SELECT to_markdown(content, 'org')``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..kernels import blocks, export, html, latex, purify, scholarly, typst
from ..sinks.files import EXPORTERS
from ..sources.files import import_file


def _guarded(f: Callable) -> Callable:
    """Null in, null out; an error is null as well."""

    def call(*values):
        if any(v is None for v in values):
            return None
        try:
            return f(*values)
        except Exception:  # a row never fails its task
            return None

    return call


def _cleaned(mode: str) -> Callable[[str, str], str]:
    from ..operators.cleaning import HINTS, _TICS

    return lambda text, form: purify.purify(text, mode, form or None, tics=_TICS, hints=HINTS)[0]


#: name -> (function, type of its result)
FUNCTIONS: dict[str, tuple[Callable, str]] = {
    "to_markdown": (lambda content, ext: import_file(bytes(content), ext), "string"),
    "from_markdown": (lambda md, ext: EXPORTERS[ext](md, "", ""), "binary"),
    "html_to_markdown": (html.html_to_md, "string"),
    "markdown_to_html": (export.to_html_body, "string"),
    "latex_to_unicode": (latex.to_unicode, "string"),
    "latex_to_typst": (typst.to_typst, "string"),
    "clean_latex": (latex.sanitize, "string"),
    "display_equations": (blocks.display_equations, "array<string>"),
    "block_kinds": (lambda md: [b.kind for b in blocks.parse_blocks(md)], "array<string>"),
    "resolve_references": (scholarly.resolve_references, "string"),
    "detect_format": (lambda text: purify.detect_format(None, text), "string"),
    "purify_audit": (lambda text: dict(purify.purify(text)[1]["artifact_breakdown"]), "map<string,bigint>"),
    "purify_sanitize": (lambda text, form: purify.purify(text, "sanitize", form or None)[0], "string"),
    "purify_decontaminate": (lambda text, form: _cleaned("decontaminate")(text, form), "string"),
}


def register(spark: SparkSession) -> list[str]:
    """Registers all functions; returns their names."""
    for name, (f, kind) in FUNCTIONS.items():
        spark.udf.register(name, F.udf(_guarded(f), kind, useArrow=True))
    return list(FUNCTIONS)
