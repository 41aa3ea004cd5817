"""Inline formats of a selection: put on, taken off, or merged with what is partly there."""

from __future__ import annotations

import re

MARKS = {"bold": ("**", "**"), "italic": ("*", "*"), "strike": ("~~", "~~"), "code": ("`", "`"), "underline": ("<u>", "</u>")}


def toggle(text: str, begin: int, end: int, form: str) -> tuple[str, int, int]:
    """The text with the format of [begin, end) toggled, and where the selection is then.

    A selection that has the format, with the marks just outside or inside of it, loses them; marks of the same format inside
    a selection are taken up into the new ones.
    """
    before, after = MARKS[form]
    a, b = len(before), len(after)
    inner = text[begin:end]
    bare = lambda s: before != "*" or not s  # a star of bold is none of italic
    if text[:begin].endswith(before) and text[end:].startswith(after) and (bare("x") or not (text[:begin].endswith("**") or text[end:].startswith("**"))):
        return text[: begin - a] + inner + text[end + b :], begin - a, end - a
    if len(inner) >= a + b and inner.startswith(before) and inner.endswith(after) and (before != "*" or not inner.startswith("**")):
        return text[:begin] + inner[a : len(inner) - b] + text[end:], begin, end - a - b
    if before == "*":
        merged = re.sub(r"(?<!\*)\*(?!\*)", "", inner)
    else:
        merged = inner.replace(before, "").replace(after, "")
    return text[:begin] + before + merged + after + text[end:], begin + a, begin + a + len(merged)


def value_span(text: str, begin: int, end: int, name: str, value: str) -> tuple[str, int, int]:
    """A styled span around a selection. A span of the same property right around it gets the new value, or goes if it has that one."""
    opener = f'<span style="{name}:{value}">'
    around = re.search(rf'<span style="{re.escape(name)}:([^";]*)">\Z', text[:begin])
    if around and text[end:].startswith("</span>"):
        head = text[: around.start()]
        if around[1].strip() == value:
            return head + text[begin:end] + text[end + 7 :], len(head), len(head) + end - begin
        return head + opener + text[begin:], len(head) + len(opener), len(head) + len(opener) + end - begin
    return text[:begin] + opener + text[begin:end] + "</span>" + text[end:], begin + len(opener), end + len(opener)


def formats_at(text: str, at: int) -> set[str]:
    """The formats in which a place of a line is."""
    begin = text.rfind("\n", 0, at) + 1
    end = text.find("\n", at)
    line, here = text[begin : end if end != -1 else len(text)], at - begin
    found = set()
    for form, pattern in (("code", r"`[^`]+`"), ("bold", r"\*\*.+?\*\*"), ("italic", r"(?<!\*)\*(?!\*)[^*]+\*(?!\*)"), ("strike", r"~~.+?~~"), ("underline", r"<u>.*?</u>")):
        if any(m.start() < here < m.end() for m in re.finditer(pattern, line)):
            found.add(form)
    return found
