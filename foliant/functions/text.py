"""Scalar text functions as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..kernels.text import ENTITIES

FENCE = r"^\s*(```|~~~)"
#: A token with a letter or digit: from its begin over what is neither to the first that is, then to its end, so that each place is tried once.
TOKEN = r"(?U)(?<!\S)[^\s\p{IsAlphabetic}\p{N}]*+[\p{IsAlphabetic}\p{N}]\S*+"


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def word_count(md: Column) -> Column:
    """Tokens with a letter or digit outside fenced regions (the fence lines are not counted)."""
    start = F.struct(F.lit(False).alias("fenced"), F.lit(0).alias("n"))

    def step(state: Column, line: Column) -> Column:
        fence = line.rlike(FENCE)
        return F.struct((state["fenced"] != fence).alias("fenced"), (state["n"] + F.when(fence | state["fenced"], 0).otherwise(F.regexp_count(line, F.lit(TOKEN)))).alias("n"))

    return F.coalesce(F.aggregate(lines(md), start, step, lambda s: s["n"]), F.lit(0)).cast("long")


def line_count(text: Column) -> Column:
    """Lines as editors count them: an end at the very end begins no further line."""
    return (F.size(lines(text)) - F.when((text == "") | F.endswith(text, F.lit("\n")), 1).otherwise(0)).cast("long")


def reading_minutes(words: Column) -> Column:
    return F.ceil(words / 200).cast("long")


def image_count(md: Column) -> Column:
    return F.regexp_count(md, F.lit(r"!\[")).cast("long")


def link_count(md: Column) -> Column:
    return F.greatest(F.regexp_count(md, F.lit(r"\]\(")) - F.regexp_count(md, F.lit(r"!\[")), F.lit(0)).cast("long")


def heading_level(line: Column) -> Column:
    """1 to 6 for an ATX heading, else null."""
    return F.when(line.rlike(r"^\s*#{1,6}([ \t]|$)"), F.length(F.regexp_extract(line, r"^\s*(#{1,6})", 1)))


def is_rule(line: Column) -> Column:
    return F.regexp_replace(line, r"[ \t]", "").rlike(r"^(-{3,}|\*{3,}|_{3,})$")


def is_bullet(line: Column) -> Column:
    return line.rlike(r"^\s*[-*+](?: |\s*$)")


def is_ordered(line: Column) -> Column:
    return line.rlike(r"^\s*\d+[.)] ")


def is_table_row(line: Column) -> Column:
    return F.trim(line).rlike(r"^\|")


def decode_entities(text: Column) -> Column:
    """The 13 named entities that importers know, one after the other, the ampersand first."""
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def collapse_space(text: Column) -> Column:
    return F.ltrim(F.regexp_replace(text, "[ \\t\\n\\f\\r]+", " "))


def collapse_blank_lines(text: Column) -> Column:
    """At most two blank lines in a row, none at the ends, one newline at the end."""
    out = F.regexp_replace(text, r"(?m)^[ \t]+$", "")
    out = F.regexp_replace(out, "\n{4,}", "\n\n\n")
    return F.concat(F.regexp_replace(out, r"\A\n+|\n+\z", ""), F.lit("\n"))


def code_block(text: Column, language: str) -> Column:
    return F.concat(F.lit(f"```{language}\n"), F.regexp_replace(text, r"(?U)\s+\z", ""), F.lit("\n```\n"))


def escape_xml(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_tex(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\u0000"))
    text = F.regexp_replace(text, r"([&%$#_{}])", r"\\$1")
    for a, b in (("~", r"\textasciitilde{}"), ("^", r"\^{}"), ("\u0000", r"\textbackslash{}")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_rtf(text: Column) -> Column:
    """Braces and backslashes; the writer also spells out line ends and characters beyond ASCII."""
    return F.regexp_replace(text, r"([\\{}])", r"\\$1")


def find_count(text: Column, what: str, case: bool = False) -> Column:
    return F.regexp_count(text, F.lit(("" if case else "(?iu)") + r"\Q" + what + r"\E")).cast("long")


def replace_all(text: Column, what: str, by: str, case: bool = False) -> Column:
    return F.regexp_replace(text, ("" if case else "(?iu)") + r"\Q" + what + r"\E", by.replace("\\", "\\\\").replace("$", "\\$"))


def indent(text: Column, by: str = "  ") -> Column:
    return F.array_join(F.transform(lines(text), lambda x: F.when(x == "", x).otherwise(F.concat(F.lit(by), x))), "\n")


def outdent(text: Column, width: int = 2) -> Column:
    return F.array_join(F.transform(lines(text), lambda x: F.regexp_replace(x, f"^ {{1,{width}}}", "")), "\n")


def subsequence(text: Column, query: str) -> Column:
    """Whether the query's characters occur in this order, ignoring case."""
    return F.rlike(F.lower(text), F.lit("(?s)" + ".*".join(r"\Q" + c + r"\E" for c in query.lower())))


def byte_offset(text: Column, chars: Column) -> Column:
    return F.octet_length(F.left(text, chars))


def csv_table(text: Column) -> Column:
    """CSV or TSV text as a pipe table: a tab anywhere makes tabs the delimiter; a quote turns it off and on and is dropped, blanks stay.

    Delimiters outside quotes become a mark of their own first: in what a line's quotes cut it into, every second piece is quoted.
    """
    rows = F.filter(F.transform(lines(text), lambda x: F.regexp_replace(x, "\\r$", "")), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s", " ")) != "")
    mark = F.when(F.contains(text, F.lit("\t")), "\t").otherwise(",")
    plain = lambda row: F.array_join(F.transform(F.split(row, '"', -1), lambda piece, i: F.when(i % 2 == 0, F.replace(piece, mark, F.lit("\u0001"))).otherwise(piece)), "")
    cells = F.transform(rows, lambda r: F.split(plain(r), "\u0001", -1))

    def padded(rows: Column, width: Column) -> Column:
        lines = F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |")))
        rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
        return once(lines, lambda x: F.concat(F.array_join(F.concat(F.slice(x, 1, 1), F.array(rule), F.slice(x, F.lit(2), F.size(x))), "\n"), F.lit("\n")))

    # the cells and the width are made once, not for every row
    once = lambda value, f: F.transform(F.array(value), f)[0]
    return once(cells, lambda rows: once(F.array_max(F.transform(rows, F.size)), lambda width: padded(rows, width)))


def escape_typst(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\#*_`$@])", r"\\$1")


def escape_rst(text: Column) -> Column:
    return F.regexp_replace(text, r"([*`|])", r"\\$1")


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def collapse_newlines(text: Column) -> Column:
    """At most one blank line in a row, and one line end at the end."""
    return F.concat(F.regexp_replace(F.regexp_replace(text, "\n{3,}", "\n\n"), r"(?U)\s+\z", ""), F.lit("\n"))


def line_number(text: Column, chars: Column) -> Column:
    """The line, from 1, that a place in characters is on."""
    return (F.regexp_count(F.left(text, chars), F.lit("\n")) + 1).cast("long")


def set_alignment(div: Column, how: str) -> Column:
    """A div with another text alignment."""
    return F.regexp_replace(div, r"text-align\s*:\s*[\w-]+", f"text-align: {how}")


def toggle_comment(line: Column) -> Column:
    """A line as a comment, or a comment's line."""
    return F.when(line.rlike("^\\s*<!-- .* -->\\s*$"), F.regexp_replace(line, "^(\\s*)<!-- (.*) -->\\s*$", "$1$2")).otherwise(F.concat(F.lit("<!-- "), line, F.lit(" -->")))


def duplicate_line(text: Column, number: Column) -> Column:
    """The text with a line (from 1) twice."""
    parts = lines(text)
    return F.array_join(F.concat(F.slice(parts, F.lit(1), number), F.slice(parts, number, F.greatest(F.size(parts) - number + 1, F.lit(0)))), "\n")
