r"""Cross-references and citations of one document, and the BibTeX they come from."""

from __future__ import annotations

import re
from typing import NamedTuple

from .text import brace_end, lines_of

_MARKERS = ("\\ref{", "\\eqref{", "\\cref{", "\\Cref{", "\\label{", "{#")
_HEADING = re.compile(r"(#{1,6}) ")
_LABEL = re.compile(r"\\label\{([^}]*)\}")
_ID = re.compile(r"\{#([^}]*)\}")
_REFS = [(re.compile(rf"\\{name}\{{([^}}]*)\}}"), form) for name, form in (("eqref", "({})"), ("ref", "{}"), ("cref", "{}"), ("Cref", "{}"))]


class Counters:
    """Dotted section numbers; a counter begins anew below a shallower heading, a skipped level shows 0."""

    def __init__(self) -> None:
        self.now = [0] * 6

    def next(self, level: int) -> str:
        self.now[level - 1] += 1
        self.now[level:] = [0] * (6 - level)
        return ".".join(map(str, self.now[:level]))


def _unfenced(md: str):
    """(line, whether it is outside fences), a fence's own lines counting as inside."""
    inside = False
    for line in lines_of(md):
        fence = line.lstrip().startswith(("```", "~~~"))
        yield line, not (inside or fence)
        inside ^= fence


def labels_of(md: str) -> dict[str, str]:
    """label -> number: of sections, and of display equations and figures, which are counted each for themselves."""
    labels, sections, equations, figures = {}, Counters(), 0, 0
    pending, inside = None, False
    for line, plain in _unfenced(md):
        if not plain:
            continue
        bare = line.lstrip()
        label = _LABEL.search(line)
        label = label[1] if label else None
        dollars = bare.count("$$")
        if inside:
            pending = label if label is not None else pending
            if dollars % 2:
                inside = False
                if pending is not None:
                    labels[pending] = str(equations)
        elif bare.startswith("$$"):
            equations += 1
            if dollars < 2:
                inside, pending = True, label
            elif label is not None:
                labels[label] = str(equations)
        elif heading := _HEADING.match(bare):
            number = sections.next(len(heading[1]))
            named = _ID.search(line)
            if label is None and named and named[1].strip():
                label = named[1].strip()
            if label is not None:
                labels[label] = number
        elif bare.startswith("![") and "](" in bare:
            figures += 1
            if label is not None:
                labels[label] = str(figures)
    return labels


def resolve_references(md: str) -> str:
    """Headings are numbered, labels go, references become numbers (? if unknown). A text without any marker stays as it is."""
    if not any(m in md for m in _MARKERS):
        return md
    labels, sections, out = labels_of(md), Counters(), []
    for line, plain in _unfenced(md):
        if plain:
            bare = line.lstrip()
            if heading := _HEADING.match(bare):
                indent = line[: len(line) - len(bare)]
                line = f"{indent}{heading[1]} {sections.next(len(heading[1]))} {bare[heading.end():].lstrip()}"
            line = re.sub(r"\\label\{[^}]*\} ?", "", line)
            if named := _ID.search(line):
                line = line[: named.start()].rstrip() + line[named.end() :]
            for pattern, form in _REFS:
                line = pattern.sub(lambda m, form=form: form.format(labels.get(m[1], "?")), line)
        out.append(line)
    return "\n".join(out)


class Entry(NamedTuple):
    key: str
    kind: str
    fields: dict[str, str]

    def numeric(self) -> str:
        """Authors. Title. Venue, Year."""
        get = lambda *names: next((self.fields[n] for n in names if self.fields.get(n)), "")
        where = ", ".join(x for x in (get("journal", "booktitle", "publisher"), get("year")) if x)
        return " ".join(f"{x}." for x in (get("author").replace(" and ", ", "), get("title"), where) if x)


_HEAD = re.compile(r"@([A-Za-z]*)[ \t\n\f\r]*")
_NAME = re.compile(r"[\s,]*([^=\s]+)[^=]*=\s*", re.A)


def parse_bibtex(source: str) -> dict[str, Entry]:
    """key -> entry; a later one wins. Values are in braces, in quotes or bare; comments, strings and preambles are passed over."""
    found, at = {}, 0
    while head := _HEAD.search(source, at):
        at = head.end()
        if not source.startswith("{", at):
            continue
        end = brace_end(source, at + 1)
        if end == -1:
            break
        body, at = source[at + 1 : end], end + 1
        kind = head[1].lower()
        if kind in ("comment", "string", "preamble"):
            continue
        key, comma, rest = body.partition(",")
        fields = _fields(rest) if comma and key.strip() else None
        if fields is not None:
            found[key.strip()] = Entry(key.strip(), kind, fields)
    return found


def _fields(text: str) -> dict[str, str] | None:
    fields, at = {}, 0
    while name := _NAME.match(text, at):
        at = name.end()
        if at >= len(text):
            break
        if text[at] == "{":
            end = brace_end(text, at + 1)
            if end == -1:
                return None
            value, at = text[at + 1 : end], end + 1
        elif text[at] == '"':
            value = text[at + 1 :].partition('"')[0]
            at += len(value) + 2
        else:
            value = re.compile(r"[^,\s]*", re.A).match(text, at)[0]
            at += len(value)
        fields[name[1].lower()] = " ".join(value.split())
    return fields


CITED = re.compile(r"\[@|\\cite\{")


def cite(md: str, bib: dict[str, Entry]) -> tuple[str, list[str]]:
    r"""The text with ``[@k; @k2]`` and ``\cite{a,b}`` as numbers by first appearance and a reference list, and the cited keys in order.

    A group that names an unknown key stays as it is; known keys before that one get their number all the same.
    """
    order: dict[str, int] = {}
    out, at = [], 0
    while opened := CITED.search(md, at):
        pandoc = opened[0] == "[@"
        close = md.find("]" if pandoc else "}", opened.end())
        shown = None
        if close != -1:
            inner = md[opened.start() + 1 : close] if pandoc else md[opened.end() : close]
            keys = [k.strip().lstrip("@").strip() if pandoc else k.strip() for k in inner.split("; " if pandoc else ",")]
            shown = []
            for key in filter(None, keys):
                if key not in bib:
                    shown = None
                    break
                shown.append(str(order.setdefault(key, len(order) + 1)))
        if shown:
            out += [md[at : opened.start()], f"[{', '.join(shown)}]"]
            at = close + 1
        else:
            out.append(md[at : opened.end()])
            at = opened.end()
    if not order:
        return md, []
    listed = "".join(f"[{n}] {bib[k].numeric()}\n\n" for k, n in order.items())
    return f"{''.join(out)}{md[at:]}\n\n## References\n\n{listed}".rstrip(), list(order)


def scholarly(md: str, bib: dict[str, Entry] | None = None) -> str:
    """References first, then, where there is a bibliography, citations."""
    md = resolve_references(md)
    return cite(md, bib)[0] if bib else md
