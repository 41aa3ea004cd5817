"""Character anomalies: native counts and rewrites (no Python runs on executors)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The character classes that cleaning is defined by.
WATERMARK = r"\x{E0000}-\x{E007F}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}\x{FFF9}-\x{FFFB}"
ZERO_WIDTH = r"\x{200B}\x{200C}\x{200D}\x{FEFF}\x{2060}\x{2061}\x{2062}\x{2063}\x{2064}"
DIRECTIONAL = r"\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}"
CONTROL = r"\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}"
SEPARATOR = r"\x{2028}\x{2029}"
SPECIAL_SPACE = r"\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"
CYRILLIC, CYRILLIC_AS = "аеорсхАВЕКМНОРСТХУ", "aeopcxABEKMHOPCTXY"
GREEK, GREEK_AS = "οΟνκ", "oOvk"
SMART_QUOTE = r"\x{2018}-\x{201B}\x{201C}-\x{201F}\x{2032}\x{2033}\x{2035}"
DASH = r"\x{2011}\x{2013}\x{2014}\x{2015}\x{2212}\x{FE58}\x{FE63}\x{FF0D}"

FULL_WIDTH = "".join(chr(0xFF41 + i) for i in range(26))
LOOKALIKE = CYRILLIC + GREEK + FULL_WIDTH
LOOKALIKE_AS = CYRILLIC_AS + GREEK_AS + "".join(chr(97 + i) for i in range(26))

#: kind -> pattern that counts it; a byte order mark at the very begin is none.
PATTERNS = {
    "watermark": f"[{WATERMARK}]",
    "zero_width": f"[{ZERO_WIDTH}]",
    "directional": f"[{DIRECTIONAL}]",
    "control": f"[{CONTROL}]",
    "separator": f"[{SEPARATOR}]",
    "special_space": f"[{SPECIAL_SPACE}]",
    "homoglyph": f"[{LOOKALIKE}]",
    "smart_quote": f"[{SMART_QUOTE}]",
    "dash": f"[{DASH}]",
}


def odd_characters(text: Column) -> Column:
    """What is left of a text without a byte order mark at its begin, and without printable ASCII, tabs and line feeds: little, in most texts."""
    return F.regexp_replace(F.coalesce(F.regexp_replace(text, r"\A\x{FEFF}", ""), F.lit("")), r"[\t\n -~]++", "")


def carriage_returns(text: Column) -> Column:
    """CRLF pairs and lone CRs; a pair counts once."""
    return F.regexp_count(text, F.lit(r"\r"))


def double_hyphens(text: Column) -> Column:
    """Runs of exactly two hyphens."""
    runs = F.size(F.filter(F.regexp_extract_all(text, F.lit("(-+)"), F.lit(1)), lambda r: F.length(r) == 2))
    return F.when(F.contains(text, F.lit("--")), runs).otherwise(0)


def audit(text: Column, odd: Column | None = None) -> dict[str, Column]:
    """kind -> count, as columns; a null text counts as empty. ``odd`` is odd_characters() where that is at hand."""
    odd = odd_characters(text) if odd is None else odd
    counts = {kind: F.regexp_count(odd, F.lit(p)) for kind, p in PATTERNS.items()} | {"line_end": carriage_returns(odd)}
    return {k: c.cast("long") for k, c in (counts | {"double_hyphen": F.coalesce(double_hyphens(text), F.lit(0))}).items()}


def sanitize(text: Column, safelist: str = "") -> Column:
    """Prose without anomalies: invisible characters go, look-alikes, dashes, spaces and line ends become plain.

    Every anomaly is one of the input: two hyphens or a line end that only come together when something between them goes
    stay two. ``safelist`` names zero-width characters to keep. Null stays null.
    """
    keep = "".join(f"&&[^{c}]" for c in safelist)
    out = F.regexp_replace(text, "(?<!-)--(?!-)", "-")
    out = F.regexp_replace(out, r"\r\n?|[\x{2028}\x{2029}]", "\n")
    out = F.regexp_replace(out, f"[{WATERMARK}{DIRECTIONAL}{CONTROL}]|(?!\\A\\x{{FEFF}})[{ZERO_WIDTH}{keep}]", "")
    out = F.replace(out, F.lit("\u202f"), F.lit("\u00a0"))
    out = F.regexp_replace(out, f"[{SPECIAL_SPACE}]", " ")
    out = F.translate(out, LOOKALIKE, LOOKALIKE_AS)
    return F.regexp_replace(out, f"[{DASH}]", "-")


def french_typography(text: Column) -> Column:
    """Spaces that stand before ; ! ? and inside guillemets become non-breaking; none is inserted."""
    out = F.regexp_replace(text, "[ \\t]+([;!?])", "\u00a0$1")
    out = F.regexp_replace(out, "«[ \\t]+", "«\u00a0")
    return F.regexp_replace(out, "[ \\t]+»", "\u00a0»")


# The stock phrases that cleaning takes out, in the order in which they are taken out.
TICS = (
    r"(?imdU)^(?:Certainly|Absolutely|Of course|Sure|Great|Excellent|Wonderful|Fantastic|Awesome|Perfect)[!,.]?\s+",
    r"(?imdU)^It(?:'s| is) worth noting(?: that)?[,.]?\s*",
    r"(?imdU)^It(?:'s| is) important to note(?: that)?[,.]?\s*",
    r"(?imdU)^Additionally[,.]?\s+",
    r"(?imdU)^Furthermore[,.]?\s+",
    r"(?imdU)^Moreover[,.]?\s+",
    r"(?imdU)^In conclusion[,.]?\s+",
    r"(?imdU)^In summary[,.]?\s+",
    r"(?imdU)^To summarize[,.]?\s+",
    r"(?imdU)\s+I hope this helps?[!.]?\s*$",
    r"(?imdU)\s+Let me know if you(?:'d like| have) (?:more |any )?(?:questions?|clarifications?)\.?\s*$",
    r"(?imdU)\s+Feel free to (?:ask|reach out)(?:[^.]*)?\.?\s*$",
    r"(?iU)\bAs an AI(?: language model)?,?\s+",
    r"(?iU)\bAs a large language model,?\s+",
    r"(?imdU)^(?:Bien s[uû]r|Absolument|Certainement|Effectivement|Tout [àa] fait|Parfait|Excellent|Avec plaisir)[!,.]?\s+",
    r"(?imdU)^Il est important de (?:noter|souligner|pr[eé]ciser)(?: que)?[,.]?\s*",
    r"(?imdU)^Il convient de (?:noter|souligner|pr[eé]ciser|mentionner)(?: que)?[,.]?\s*",
    r"(?imdU)^Il est (?:int[eé]ressant|fascinant|important|essentiel)(?: de noter| de souligner)?(?: que)?[,.]?\s*",
    r"(?imdU)^(?:De plus|En outre|Par ailleurs|[ÀA] noter que?)[,.]?\s+",
    r"(?imdU)^(?:En conclusion|En r[eé]sum[eé]|Pour r[eé]sumer|En somme|Pour conclure)[,.]?\s+",
    r"(?imdU)\s+J'esp[eè]re(?: que cela| que cette r[eé]ponse)(?: vous)?(?: aide| r[eé]pond [àa] votre question)?\.?\s*$",
    r"(?imdU)\s+N'h[eé]sitez pas [àa] (?:me demander|poser vos questions)(?:[^.]*)?\.?\s*$",
    r"(?imdU)\s+Si vous avez d'autres questions[^.]*\.?\s*$",
    r"(?iU)\bEn tant qu(?:'IA|e (?:mod[eè]le d'IA|assistant IA)),?\s+",
    r"(?iU)\bEn tant que grand mod[eè]le de langage,?\s+",
)


#: For each phrase, lower-case ASCII strings of which every match has one at least.
HINTS = (
    ("certainly", "absolutely", "of course", "sure", "great", "excellent", "wonderful", "fantastic", "awesome", "perfect"),
    ("worth noting",),
    ("important to note",),
    ("additionally",),
    ("furthermore",),
    ("moreover",),
    ("in conclusion",),
    ("in summary",),
    ("to summarize",),
    ("i hope this help",),
    ("let me know if you",),
    ("feel free to ",),
    ("as an ai",),
    ("as a large language model",),
    ("bien s", "absolument", "certainement", "effectivement", "tout ", "parfait", "excellent", "avec plaisir"),
    ("il est important de ",),
    ("il convient de ",),
    ("il est ",),
    ("de plus", "en outre", "par ailleurs", " noter qu"),
    ("en conclusion", "sum", "en somme", "pour conclure"),
    ("j'esp",),
    ("sitez pas ",),
    ("si vous avez d'autres questions",),
    ("en tant qu",),
    ("en tant que grand mod",),
)


def remove_tics(text: Column) -> Column:
    """Prose without stock openings, closings and self-references."""
    for pattern in TICS:
        text = F.regexp_replace(text, pattern, "")
    return text
