"""Small steps that several parsers share."""

from __future__ import annotations

import re

# The named entities that importers know and what they stand for, in the order of replacement (the ampersand first).
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&mdash;", "-"), ("&ndash;", "-"), ("&hellip;", "..."), ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™"))


def decode_entities(text: str) -> str:
    if "&" in text:
        for name, char in ENTITIES:
            text = text.replace(name, char)
    return text


def lines_of(text: str) -> list[str]:
    """Lines without their ends (LF or CRLF); an end at the very end begins no further line."""
    found = text.split("\n")
    if found[-1] == "":
        found.pop()
    return [x[:-1] if x.endswith("\r") else x for x in found]


def collapse_blank_lines(text: str) -> str:
    """At most two blank lines in a row, none at either end, one line end at the end."""
    out, blank = [], 0
    for line in lines_of(text):
        blank = 0 if line.strip() else blank + 1
        if blank <= 2:
            out.append("" if blank else line)
    return "\n".join(out).strip("\n") + "\n"


def swap_marks(text: str, mark: str, new: str) -> str:
    """Every mark, opening or closing, becomes the new one."""
    return text.replace(mark, new)


def rewrap(text: str, begin: str, end: str, before: str, after: str) -> str:
    """``begin``…``end`` becomes ``before``…``after``; an opener that nothing closes is dropped."""
    out, at = [], 0
    while (opened := text.find(begin, at)) != -1:
        out.append(text[at:opened])
        at = opened + len(begin)
        closed = text.find(end, at)
        if closed != -1:
            out += [before, text[at:closed], after]
            at = closed + len(end)
        elif begin == end or text.find(begin, at) == -1:
            break
    return "".join(out) + text[at:]


def relink(text: str, begin: str, end: str, middle: str) -> str:
    """``[[target<middle>words]]`` and ``[[target]]`` become Markdown links."""

    def link(m: re.Match) -> str:
        target, found, words = m[1].partition(middle)
        return f"[{words if found else target}]({target})"

    out = re.sub(f"{re.escape(begin)}(.*?){re.escape(end)}", link, text, flags=re.S)
    return out.replace(begin, "")  # openers that nothing closes


def attribute(tag: str, name: str) -> str | None:
    """The value of an attribute in a tag's text, in double, then single quotes, then bare."""
    low = tag.lower()
    for quote in ('"', "'"):
        at = low.find(f"{name}={quote}")
        if at != -1:
            begin = at + len(name) + 2
            end = tag.find(quote, begin)
            if end != -1:
                return tag[begin:end]
    at = low.find(f"{name}=")
    if at == -1:
        return None
    return re.match(r"[^\s>/]*", tag[at + len(name) + 1 :], re.A)[0]


def xml_attribute(tag: str, name: str) -> str | None:
    found = re.search(rf"""{re.escape(name)}=(?:"([^"]*)"|'([^']*)')""", tag)
    return None if found is None else found[1] if found[1] is not None else found[2]


def brace_end(text: str, at: int) -> int:
    """The place of the brace that closes the one opened right before ``at``; -1 if none does."""
    depth = 1
    for m in re.finditer(r"[{}]", text[at:]):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return at + m.start()
    return -1
