"""Names, kinds and sizes of files and images as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Media types by extension; others count as PNG.
MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "svg": "image/svg+xml"}


def stem(path: Column) -> Column:
    """A file's name without its last extension; a name that only begins with a dot has none."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def output_name(path: Column, extension: str, affix: str = "", before: bool = False) -> Column:
    """affix_stem.ext or stem_affix.ext."""
    parts = [F.lit(affix), stem(path)] if before else [stem(path), F.lit(affix)]
    return F.concat(F.concat_ws("_", *parts), F.lit(f".{extension}"))


def image_mime(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return F.coalesce(known[F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))], F.lit("image/png"))


def local_image(source: Column) -> Column:
    """The path of a local image, without scheme and with its blanks; null for remote and embedded ones."""
    bare = F.trim(source)
    remote = F.lower(bare).rlike("^(https?://|data:)") | (bare == "")
    return F.when(~remote, F.replace(F.regexp_replace(bare, "^file:///?", ""), F.lit("%20"), F.lit(" ")))


def fit_width(width: Column, height: Column, most: int) -> Column:
    """struct(width, height) of an image at most so wide, in proportion, in whole numbers."""
    w, h = F.greatest(width, F.lit(1)).cast("long"), F.greatest(height, F.lit(1)).cast("long")
    high = F.when(w <= most, h).otherwise(F.floor(h * most / w)).cast("long")
    return F.struct(F.least(w, F.lit(most)).cast("long").alias("width"), high.alias("height"))


def safe_name(path: Column) -> Column:
    """Whether a name is relative and stays below its folder."""
    return ~path.rlike(r"^([/\\]|[A-Za-z]:)|(^|[/\\])\.\.([/\\]|$)|^$")


def embed_svg(svg: Column, snippet: Column) -> Column:
    """A snippet right before the closing tag; a bare fragment becomes an image first."""
    whole = F.when(F.contains(svg, F.lit("<svg")), svg).otherwise(F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg">'), svg, F.lit("</svg>")))
    at = F.instr(whole, "</svg>")
    return F.when(at > 0, F.concat(F.substring(whole, F.lit(1), at - 1), snippet, F.substring(whole, at, F.length(whole)))).otherwise(F.concat(whole, snippet))


def settings(json: Column, defaults: dict[str, str]) -> Column:
    """A struct of settings: those of a JSON text, with a default for each that it lacks; a broken text gives the defaults."""
    found = F.from_json(json, "map<string,string>", {"mode": "PERMISSIVE"})
    return F.struct(*[F.coalesce(F.try_element_at(found, F.lit(k)), F.lit(v)).alias(k) for k, v in defaults.items()])
