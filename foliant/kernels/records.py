"""Notebooks, reference lists, books, mail, tables and source files to Markdown."""

from __future__ import annotations

import json
import re
from itertools import zip_longest

from .html import html_to_md
from .text import brace_end, collapse_blank_lines, decode_entities, lines_of


def _joined(value: object) -> str:
    return value if isinstance(value, str) else "".join(x for x in value if isinstance(x, str)) if isinstance(value, list) else ""


def _at(value: object, *path: str) -> object:
    for name in path:
        value = value.get(name) if isinstance(value, dict) else None
    return value


def notebook_to_md(text: str) -> str:
    """Markdown cells as they are, code cells and the text of their outputs in fences."""
    book = json.loads(text)
    language = _at(book, "metadata", "kernelspec", "language")
    language, cells, out = language if isinstance(language, str) else "python", _at(book, "cells"), []
    if not isinstance(cells, list):
        raise ValueError("a notebook without cells")
    for cell in cells:
        source = _joined(_at(cell, "source"))
        if _at(cell, "cell_type") == "markdown":
            out.append(source + ("\n" if source.endswith("\n") else "\n\n"))
        elif _at(cell, "cell_type") == "code":
            if source.rstrip():
                out.append(f"```{language}\n{source.rstrip()}\n```\n\n")
            outputs = _at(cell, "outputs")
            for found in outputs if isinstance(outputs, list) else ():
                kind = _at(found, "output_type")
                told = _joined(_at(found, "text") if kind == "stream" else _at(found, "data", "text/plain") if kind in ("execute_result", "display_data") else "")
                if told.strip():
                    out.append(f"```\n{told.rstrip()}\n```\n\n")
    return "".join(out)


_ENTRY = re.compile(r"@([^{(]*)[{(]")
_FIELD = re.compile(r"([^=}]*)=\s*", re.A)


def _fields(text: str, at: int) -> tuple[dict[str, str], int]:
    """The fields of an entry, from behind its key, and the place behind the entry."""
    fields: dict[str, str] = {}
    blank = re.compile(r"[\s]*", re.A)
    while True:
        at = blank.match(text, at).end()
        found = _FIELD.match(text, at) if at < len(text) and text[at] != "}" else None
        if not found:
            close = text.find("}", at)
            return fields, len(text) if close == -1 else close + 1
        at, name = found.end(), found[1].strip().lower()
        if text.startswith("{", at):
            end = brace_end(text, at + 1)
            value, at = (text[at + 1 : end], end + 1) if end != -1 else (text[at + 1 :], len(text))
            value = value.replace("\n", " ")
        elif text.startswith('"', at):
            value, _, _ = text[at + 1 :].partition('"')
            at += len(value) + 2
        else:
            value = re.compile(r"[^,}]*").match(text, at)[0]
            at += len(value)
        at = re.compile(r"[,\s]*", re.A).match(text, at).end()
        if name:
            fields[name] = value.strip()


def short_authors(authors: str) -> str:
    def short(name: str) -> str:
        last, comma, first = name.strip().partition(",")
        return f"{last.strip()} {first.strip()[:1] + '.' if first.strip() else ''}" if comma else name.strip()

    return ", ".join(map(short, authors.split(" and ")))


def bib_to_md(text: str) -> str:
    """A list of references: bold title, authors, year, venue, volume, pages, link."""
    out, at = ["# References\n\n"], 0
    while found := _ENTRY.search(text, at):
        at = found.end()
        if found[1].strip().lower() in ("string", "preamble", "comment"):
            end = brace_end(text, at)
            at = len(text) if end == -1 else end + 1
            continue
        comma = text.find(",", at)
        fields, at = _fields(text, len(text) if comma == -1 else comma + 1)
        get = lambda *names: next((fields[n] for n in names if n in fields), "")
        parts = [f"- **{get('title')}**"]
        for value, form in ((short_authors(get("author")), " - {}"), (get("year"), " ({})"), (get("journal", "booktitle"), ". *{}*"), (get("volume"), ", **{}**"), (get("pages").replace("--", "-"), ", pp. {}")):
            parts += [form.format(value)] if value else []
        if get("doi"):
            parts.append(f". [doi:{get('doi')}](https://doi.org/{get('doi')})")
        elif get("url"):
            parts.append(f". [Link]({get('url')})")
        out.append("".join(parts) + "\n")
    return "".join(out)


_TAG = re.compile(r"<([^>]*)>?|([^<]+)")
_BOOK_MARKS = {"strong": "**", "b": "**", "emphasis": "*", "i": "*", "em": "*"}
_BOOK_QUOTES = ("poem", "epigraph", "cite")


def book_to_md(xml: str) -> str:
    """FictionBook: the text of bodies, a title's level by the depth of its section."""
    out, inside, depth, open_marks = [], False, 0, {"**": False, "*": False}
    for m in _TAG.finditer(xml):
        if m[2] is not None:
            out += [decode_entities(m[2])] if inside else []
            continue
        closing = m[1].startswith("/")
        name = re.match(r"(?:[^\W_]|:)*", m[1].removeprefix("/").strip())[0].lower()
        if name == "body":
            inside = not closing
        elif name == "section":
            depth = max(0, depth - 1) if closing else depth + 1
            out += ["\n"] if closing else []
        elif name == "title":
            out.append("\n\n" if closing else "#" * min(6, max(1, depth)) + " ")
        elif name == "p":
            out += ["\n\n"] if closing else []
        elif name in _BOOK_MARKS:
            mark = _BOOK_MARKS[name]
            if not closing or open_marks[mark]:
                open_marks[mark] = not closing
                out.append(mark)
        elif name == "code":
            out.append("`")
        elif name in _BOOK_QUOTES:
            out.append("\n\n" if closing else "\n> ")
        elif name == "v":
            out.append("  \n")
        elif name == "subtitle":
            out.append("*\n\n" if closing else "*")
        elif name == "empty" and m[1].lstrip("/").strip().lower().startswith("empty-line"):
            pass  # names end at the hyphen, so that this tag has never any effect
    return collapse_blank_lines("".join(out))


_SHOWN = ("from", "to", "cc", "date", "reply-to")


def mail_to_md(text: str) -> str:
    """Subject as title, the usual headers, and the body (HTML is converted)."""
    lines = lines_of(text)
    end = lines.index("") if "" in lines else len(lines)
    headers: list[list[str]] = []
    for line in lines[:end]:
        if line.startswith((" ", "\t")):
            if headers:
                headers[-1][1] += f" {line.strip()}"
        elif ":" in line:
            key, _, value = line.partition(":")
            headers.append([key.strip(), value.strip()])
    headers = [h for h in headers if h[0]]
    get = lambda name, other: next((v for k, v in headers if k.lower() == name), other)
    shown = "".join(f"**{k}:** {v}  \n" for k, v in headers if k.lower() in _SHOWN)
    body = "\n".join(lines[end + 1 :])
    return f"# {get('subject', '(no subject)')}\n\n{shown}\n---\n\n{html_to_md(body) if 'text/html' in get('content-type', '').lower() else body}"


def csv_row(line: str, mark: str) -> list[str]:
    """Cells of a line. A quote only turns the mark off and on, and is dropped; blanks stay."""
    cells, quoted = [""], False
    for part in re.split(f'([{mark}"])', line):
        if part == '"':
            quoted = not quoted
        elif part == mark and not quoted:
            cells.append("")
        else:
            cells[-1] += part
    return cells


def csv_to_md(text: str) -> str:
    mark = "\t" if "\t" in text else ","
    rows = [csv_row(line, mark) for line in lines_of(text) if line.strip()]
    if not rows:
        return ""
    columns = list(zip(*zip_longest(*rows, fillvalue=""), strict=True))
    told = ["".join(f"| {c} " for c in row) + "|" for row in columns]
    return "\n".join([told[0], "|" + " --- |" * len(columns[0]), *told[1:]]) + "\n"


# Languages by extension.
LANGUAGES = {"py": "python", "js": "javascript", "ts": "typescript", "rs": "rust", "c": "c", "cpp": "cpp", "cxx": "cpp", "cc": "cpp", "java": "java", "go": "go", "rb": "ruby", "php": "php", "sh": "bash", "bash": "bash", "zsh": "bash", "r": "r"}


def code_to_md(text: str, language: str) -> str:
    return f"```{language}\n{text.rstrip()}\n```\n"
