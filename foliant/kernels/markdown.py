"""Markdown as a stream of events: a subset of CommonMark with tables, strike-through, task lists and dollar mathematics.

Blocks: headings (ATX and underlined), fences, indented code, quotes, lists, tables, rules, HTML, paragraphs. Inline: code, emphasis by
the delimiter rules, links, images, autolinks, breaks, entities, mathematics. Reference links and footnotes are text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple


class Event(NamedTuple):
    """``what`` is start, end, text, code, math, display, html, soft, hard, rule or task; ``tag`` names what starts or ends."""

    what: str
    tag: str = ""
    value: object = None


_FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})[ \t]*([^`]*?)[ \t]*$")
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r"( {0,3})([-+*]|[0-9]{1,9}[.)])([ \t]+|$)")
_UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_DELIMITERS = re.compile(r"[ \t]*\|?(?:[ \t]*:?-+:?[ \t]*\|)*[ \t]*:?-+:?[ \t]*\|?[ \t]*$")
_TASK = re.compile(r"\[([ xX])\][ \t]+")
_HTML = re.compile(r" {0,3}<(?:[A-Za-z/!?])")


#: What a block other than a paragraph or table may begin with; a line's first character decides which are tried.
_LINES = frozenset("=-")
_BLOCKS = frozenset("`~#*-_>+0123456789<") | {""}


def split_row(line: str) -> list[str]:
    r"""Cells of a table row; ``\|`` is no border."""
    row = line.strip()
    row = row.removeprefix("|")
    if row.endswith("|") and not row.endswith("\\|"):
        row = row[:-1]
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", row)]


def _is_table(lines: list[str], i: int) -> bool:
    return "|" in lines[i] and i + 1 < len(lines) and "-" in lines[i + 1] and bool(_DELIMITERS.match(lines[i + 1])) and len(split_row(lines[i])) == len(split_row(lines[i + 1]))


def _interrupts(line: str) -> bool:
    """Whether a line ends a paragraph."""
    if line.lstrip()[:1] not in _BLOCKS:  # and none where the line is blank
        return False
    item = _ITEM.match(line)
    return not line.strip() or bool(_FENCE.match(line) or (line.lstrip().startswith("#") and _ATX.match(line)) or _RULE.match(line)) or line.lstrip().startswith(">") or bool(item and item[3] and (not item[2][0].isdigit() or item[2][:-1] == "1") and line[item.end() :].strip())


def events(md: str, math: bool = True) -> Iterator[Event]:
    """All events of a text; with ``math`` dollars mean mathematics."""
    yield from _blocks([x.rstrip("\r").expandtabs(4) if x.startswith("\t") or "\t" in x[:4] else x.rstrip("\r") for x in md.split("\n")], math, False)


def _blocks(lines: list[str], math: bool, tight: bool) -> Iterator[Event]:
    i, n = 0, len(lines)
    while i < n:
        line = lines[i]
        if not line.strip():
            i += 1
            continue
        sign = line.lstrip()[:1]
        if sign in "`~" and (fence := _FENCE.match(line)):
            indent, mark, info = len(fence[1]), fence[2], fence[3]
            body, i = [], i + 1
            closing = re.compile(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$")
            while i < n and not closing.match(lines[i]):
                body.append(re.sub(rf"^ {{0,{indent}}}", "", lines[i]) if indent else lines[i])
                i += 1
            while i == n and body and not body[-1] and lines[-1] == "":  # the text's own last line end
                body.pop()
                break
            i += 1
            yield from _code(html.unescape(info), body)
        elif line.startswith("    "):
            body = []
            while i < n and (lines[i].startswith("    ") or not lines[i].strip()):
                body.append(lines[i][4:])
                i += 1
            while body and not body[-1].strip():
                body.pop()
            yield from _code(None, body)
        elif sign == "#" and (heading := _ATX.match(line)):
            yield from _heading(len(heading[1]), (heading[2] or "").strip(), math)
            i += 1
        elif sign in "*-_" and _RULE.match(line):
            yield Event("rule")
            i += 1
        elif sign == ">":
            body = []
            while i < n and lines[i].strip() and (lines[i].lstrip().startswith(">") or (body and body[-1].strip() and not _interrupts(lines[i]))):
                body.append(re.sub(r"^ {0,3}> ?", "", lines[i]))
                i += 1
            yield Event("start", "quote")
            yield from _blocks(body, math, False)
            yield Event("end", "quote")
        elif sign in "-+*0123456789" and _ITEM.match(line):
            i = yield from _list(lines, i, math)
        elif _is_table(lines, i):
            yield Event("start", "table")
            width, first = len(split_row(line)), True
            while i < n and lines[i].strip() and (first or not _interrupts(lines[i])):
                yield from _row(split_row(lines[i]), width, "head" if first else "row", math)
                i += 2 if first else 1
                first = False
            yield Event("end", "table")
        elif sign == "<" and _HTML.match(line) and re.match(r" {0,3}</?(?:address|article|aside|blockquote|body|center|dd|details|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|nav|ol|option|p|param|pre|script|section|style|summary|table|tbody|td|tfoot|th|thead|title|tr|ul)\b|^ {0,3}<[!?]", line, re.I):
            body = []
            end = "-->" if line.lstrip().startswith("<!--") else None
            while i < n and (end or lines[i].strip()):
                body.append(lines[i])
                i += 1
                if end and end in body[-1]:
                    break
            yield Event("html", value="\n".join(body) + "\n")
        else:
            body, level = [line.lstrip(" ")], 0
            i += 1
            while i < n:
                if lines[i].lstrip(" ")[:1] in _LINES and (found := _UNDERLINE.match(lines[i])):
                    level = 1 if "=" in found[1] else 2
                    i += 1
                    break
                if _interrupts(lines[i]):
                    break
                body.append(lines[i].lstrip(" "))
                i += 1
            text = "\n".join(body).rstrip()
            if level:
                yield from _heading(level, text, math)
            elif tight:
                yield from inline(text, math)
            else:
                yield Event("start", "paragraph")
                yield from inline(text, math)
                yield Event("end", "paragraph")


def _code(info: str | None, body: list[str]) -> Iterator[Event]:
    yield Event("start", "codeblock", info)
    if body:
        yield Event("text", value="\n".join(body) + "\n")
    yield Event("end", "codeblock", info)


def _heading(level: int, text: str, math: bool) -> Iterator[Event]:
    yield Event("start", "heading", level)
    yield from inline(text, math)
    yield Event("end", "heading", level)


def _row(cells: list[str], width: int, tag: str, math: bool) -> Iterator[Event]:
    yield Event("start", tag)
    for cell in (cells + [""] * width)[:width]:
        yield Event("start", "cell")
        yield from inline(cell, math)
        yield Event("end", "cell")
    yield Event("end", tag)


def _list(lines: list[str], i: int, math: bool) -> Iterator[Event]:
    """One list; returns the line after it."""
    first = _ITEM.match(lines[i])
    kind = first[2][-1]
    start = int(first[2][:-1]) if first[2][0].isdigit() else None
    items, loose, blank = [], False, False
    while i < len(lines):
        found = _ITEM.match(lines[i])
        if not found or found[2][-1] != kind or _RULE.match(lines[i]):
            break
        loose |= blank
        gap = len(found[3].expandtabs(4))
        width = len(found[1]) + len(found[2]) + (gap if 1 <= gap <= 4 and lines[i][found.end() :] else 1)
        body, i, blank = [lines[i][width:]], i + 1, False
        while i < len(lines):
            line = lines[i]
            if not line.strip():
                blank = True
                body.append("")
            elif line.startswith(" " * width):
                loose |= blank and not (body[-2:] and any(_ITEM.match(b) for b in body if b.strip()) and _ITEM.match(line[width:]))
                blank = False
                body.append(line[width:])
            elif not blank and not _interrupts(line) and body[-1].strip() and not _ITEM.match(line):
                body.append(line.lstrip())
            else:
                break
            i += 1
        while body and not body[-1].strip():
            body.pop()
        items.append(body)
    yield Event("start", "list", start)
    for body in items:
        yield Event("start", "item")
        task = _TASK.match(body[0]) if body else None
        if task:
            yield Event("task", value=task[1] != " ")
            body = [body[0][task.end() :], *body[1:]]
        yield from _blocks(body, math, not loose)
        yield Event("end", "item")
    yield Event("end", "list", start)
    return i


# ---------------------------------------------------------------- inline

#: One set of characters at the front, which the engine skims a text for; a line end takes the blanks before it as well.
_SPECIAL = re.compile(r"[\\`*_~!\[<&$\n](?:(?<=[\\\[<&\n])|(?<=`)`*|(?<=\*)\**|(?<=_)_*|(?<=~)~?|(?<=!)\[|(?<=\$)\$?)")
_AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.+-]+@[\w.-]+)>")
_TAG = re.compile(r"<(?:/?[A-Za-z][^<>]*|!--.*?--|[!?][^>]*)>", re.S)
_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);")
_TARGET = re.compile(r"""\(\s*(?:<([^<>\n]*)>|((?:[^\s()\\]|\\.|\([^\s()]*\))*))(?:\s+(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)""")
_PUNCTUATION = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


class _Mark:
    """A run of delimiters that may open or close emphasis."""

    def __init__(self, char: str, count: int, opens: bool, closes: bool):
        self.char, self.count, self.opens, self.closes = char, count, opens, closes


def inline(text: str, math: bool = True) -> Iterator[Event]:
    """Events of a run of text."""
    if not _SPECIAL.search(text):
        return iter([Event("text", value=text)] if text else [])
    return _emphasized(_pieces(text, math))


def _pieces(text: str, math: bool) -> list[Event | _Mark]:
    out: list[Event | _Mark] = []
    at = 0

    def put(s: str) -> None:
        if s:
            if out and isinstance(out[-1], Event) and out[-1].what == "text":
                out[-1] = Event("text", value=out[-1].value + s)
            else:
                out.append(Event("text", value=s))

    while m := _SPECIAL.search(text, at):
        here, mark = m.start(), m[0]
        if mark == "\n":
            here = at + len(text[at:here].rstrip(" "))
            mark = text[here : m.end()]
        put(text[at:here])
        at = m.end()
        if mark == "\\":
            following = text[at : at + 1]
            if following == "\n":
                out.append(Event("hard"))
                at += 1
            elif following in _PUNCTUATION and following:
                put(following)
                at += 1
            else:
                put(mark)
        elif mark[0] == "`":
            close = re.compile(rf"(?<!`)`{{{len(mark)}}}(?!`)").search(text, at)
            if close:
                body = text[at : close.start()].replace("\n", " ")
                out.append(Event("code", value=body[1:-1] if body[:1] == body[-1:] == " " and body.strip() else body))
                at = close.end()
            else:
                put(mark)
        elif mark[0] in "*_~":
            before, after = text[here - 1 : here] or " ", text[at : at + 1] or " "
            left = not after.isspace() and (after not in _PUNCTUATION or before.isspace() or before in _PUNCTUATION)
            right = not before.isspace() and (before not in _PUNCTUATION or after.isspace() or after in _PUNCTUATION)
            if mark[0] == "_":
                left, right = left and (not right or before in _PUNCTUATION), right and (not left or after in _PUNCTUATION)
            out.append(_Mark(mark[0], len(mark), left, right))
        elif mark in ("[", "!["):
            found = _link(text, at)
            if found:
                inner, target, at = found
                tag = "image" if mark == "![" else "link"
                out.append(Event("start", tag, target))
                out.extend(_emphasized(_pieces(inner, math)))
                out.append(Event("end", tag, target))
            else:
                put(mark)
        elif mark == "<":
            if auto := _AUTOLINK.match(text, here):
                target = auto[1] if ":" in auto[1] else f"mailto:{auto[1]}"
                out += [Event("start", "link", target), Event("text", value=auto[1]), Event("end", "link", target)]
                at = auto.end()
            elif tag := _TAG.match(text, here):
                out.append(Event("html", value=tag[0]))
                at = tag.end()
            else:
                put(mark)
        elif mark == "&":
            entity = _ENTITY.match(text, here)
            put(html.unescape(entity[0]) if entity else mark)
            at = entity.end() if entity else at
        elif mark[0] == "$":
            close = text.find(mark, at) if math else -1
            if mark == "$" and close != -1 and (text[at].isspace() or text[close - 1].isspace() or text[close + 1 : close + 2].isdigit()):
                close = -1
            if close > at:
                out.append(Event("display" if mark == "$$" else "math", value=text[at:close]))
                at = close + len(mark)
            else:
                put(mark)
        else:
            out.append(Event("hard" if len(mark) > 2 else "soft"))
    put(text[at:])
    return out


def _link(text: str, at: int) -> tuple[str, str, int] | None:
    depth = 1
    for m in re.compile(r"\\.|\[|\]", re.S).finditer(text, at):
        depth += {"[": 1, "]": -1}.get(m[0], 0)
        if not depth:
            target = _TARGET.match(text, m.end())
            if not target:
                return None
            url = target[1] if target[1] is not None else re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", target[2])
            return text[at : m.start()], html.unescape(url), target.end()
    return None


_TAGS = {"*": ("emphasis", "strong"), "_": ("emphasis", "strong"), "~": ("strike", "strike")}


def _emphasized(pieces: list[Event | _Mark]) -> Iterator[Event]:
    """Resolves delimiter runs, the nearest opener for each closer; what is left over is text."""
    marks = [i for i, p in enumerate(pieces) if isinstance(p, _Mark)]
    if not marks:
        yield from _joined(pieces)
        return
    before: list[list[Event]] = [[] for _ in pieces]
    after: list[list[Event]] = [[] for _ in pieces]
    stack: list[int] = []
    for i in marks:
        closer = pieces[i]
        while closer.closes and closer.count:
            k = next((k for k in range(len(stack) - 1, -1, -1) if pieces[stack[k]].char == closer.char and pieces[stack[k]].count and not (closer.char != "~" and (closer.opens or pieces[stack[k]].closes) and (closer.count + pieces[stack[k]].count) % 3 == 0 and (closer.count % 3 or pieces[stack[k]].count % 3))), None)
            if k is None:
                break
            opener = pieces[stack[k]]
            used = 2 if closer.count >= 2 and opener.count >= 2 else 1
            if closer.char == "~" and opener.count != closer.count:
                break
            tag = _TAGS[closer.char][used - 1]
            after[stack[k]].insert(0, Event("start", tag))
            before[i].append(Event("end", tag))
            opener.count -= used
            closer.count -= used
            del stack[k + 1 :]
            if not opener.count:
                stack.pop()
        if closer.opens and closer.count:
            stack.append(i)
    out: list[Event] = []
    for i, piece in enumerate(pieces):
        out += [*before[i], *([piece] if isinstance(piece, Event) else [Event("text", value=piece.char * piece.count)] if piece.count else []), *after[i]]
    yield from _joined(out)


def _joined(found: list[Event]) -> Iterator[Event]:
    """Texts that follow each other are one."""
    held: list[str] = []
    for event in found:
        if event.what == "text":
            held.append(event.value)
        else:
            if held:
                yield Event("text", value="".join(held))
                held = []
            yield event
    if held:
        yield Event("text", value="".join(held))
