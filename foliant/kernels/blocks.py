"""Blocks and inline mathematics of a Markdown text, line by line."""

from __future__ import annotations

import re
from bisect import bisect_left
from typing import NamedTuple

_HEADING = re.compile(r"\s*(#{1,6})(?:[ \t]|$)")
_BULLET, _ORDERED = re.compile(r"[-*+](?: |$)"), re.compile(r"[0-9]+[.)] ")
_RULE = re.compile(r"([-*_]) *(?:\1 *){2,}")
# Environments that are display mathematics, and tags that do not open an HTML block.
MATH = ("equation", "align", "aligned", "gather", "gathered", "multline", "eqnarray", "displaymath", "math", "split", "alignat", "flalign", "cases")
INLINE_TAGS = ("span", "mark", "u", "sup", "sub", "b", "i", "s", "em", "strong", "del", "ins", "a", "code", "small", "abbr", "kbd")
_BEGIN = re.compile(r"\\begin\{((?:" + "|".join(MATH) + r")\**)\}")
_INLINE = re.compile(r"</?(?:" + "|".join(INLINE_TAGS) + r")(?:[ >/]|$)", re.I)
KINDS = ("heading", "paragraph", "equation", "code", "rule", "table", "quote", "bullets", "ordered", "html")


class Block(NamedTuple):
    """A run of lines [first, stop); ``info`` is a code block's language or an environment's name, ``latex`` the body of an equation."""

    kind: str
    level: int
    info: str
    first: int
    stop: int
    latex: str | None = None


def heading_level(line: str) -> int:
    found = _HEADING.match(line)
    return len(found[1]) if found else 0


def is_rule(bare: str) -> bool:
    return bool(_RULE.fullmatch(bare))


def _starts_block(line: str) -> bool:
    """Whether a line ends the paragraph before it; HTML does not."""
    bare = line.strip()
    if not bare or bare[0] not in "#$\\`-*+_|>0123456789":
        return not bare
    return bool(_HEADING.match(line) or bare.startswith(("$$", "\\[", "```", "|", ">")) or _BEGIN.match(bare) or _BULLET.match(bare) or _ORDERED.match(bare) or is_rule(bare))


def lines_with_ends(md: str) -> list[str]:
    """Lines without LF or CRs before it; an end at the very end begins no further line."""
    lines = md.split("\n")
    if lines[-1] == "":
        lines.pop()
    return [x.rstrip("\r") for x in lines]


class _Parser:
    def __init__(self, md: str):
        self.lines = lines_with_ends(md)
        self.bare = [x.strip() for x in self.lines]
        self.last_close = max((i for i, b in enumerate(self.bare) if "</div" in b.lower()), default=-1)

    def run(self, i: int, goes_on) -> int:
        """The line after the run of lines from i + 1 that ``goes_on`` accepts."""
        i += 1
        while i < len(self.lines) and goes_on(i):
            i += 1
        return i

    def environment(self, i: int, name: str) -> Block:
        """Up to the line that has the end of the environment, or to the end of the text."""
        end = f"\\end{{{name}}}"
        stop = next((k + 1 for k in range(i + 1, len(self.lines)) if end in self.lines[k]), len(self.lines))
        return Block("equation", 0, name, i, stop, "\n".join(self.lines[i:stop]).strip())

    def display(self, i: int) -> Block:
        """Closed on the same or a later line; one that meets a blank line or heading first is a paragraph of one line."""
        opener = self.bare[i][:2]
        close = "$$" if opener == "$$" else "\\]"
        after = self.bare[i]
        while after.startswith(opener):
            after = after[2:]
        after = after.strip()
        if close in after:
            return Block("equation", 0, "", i, i + 1, after[: after.index(close)].strip())
        body = [after] if after else []
        for k in range(i + 1, len(self.lines)):
            bare = self.bare[k]
            if close in bare:
                before = bare[: bare.index(close)].strip()
                return Block("equation", 0, "", i, k + 1, "\n".join(body + ([before] if before else [])))
            if not bare or heading_level(self.lines[k]):
                break
            body.append(bare)
        return Block("paragraph", 0, "", i, i + 1)

    def listed(self, i: int, item: re.Pattern) -> int:
        """Items, indented lines, and a blank line before another item."""
        is_item = lambda k: k < len(self.lines) and bool(item.match(self.bare[k]))
        return self.run(i, lambda k: is_item(k) or self.lines[k].startswith(("  ", "\t")) if self.bare[k] else is_item(k + 1))

    def html(self, i: int) -> int:
        if not self.bare[i].lower().startswith("<div"):
            stop = i + 1
            while stop < len(self.lines):
                bare = self.bare[stop]
                stop += 1
                if not bare or (bare.startswith("</") and bare.endswith(">")):
                    break
            return stop
        if i > self.last_close:
            return i + 1
        depth = 0
        for k in range(i, len(self.lines)):
            low = self.lines[k].lower()
            depth += low.count("<div") - low.count("</div")
            if depth <= 0:
                return k + 1
        return i + 1

    def at(self, i: int) -> Block:
        line, bare = self.lines[i], self.bare[i]
        if level := heading_level(line):
            return Block("heading", level, "", i, i + 1)
        if found := _BEGIN.match(bare):
            return self.environment(i, found[1])
        if bare.startswith(("$$", "\\[")):
            return self.display(i)
        if bare.startswith("```"):
            stop = self.run(i, lambda k: not self.bare[k].startswith("```"))
            return Block("code", 0, bare.lstrip("`").strip(), i, min(stop + 1, len(self.lines)))
        if is_rule(bare):
            return Block("rule", 0, "", i, i + 1)
        if bare.startswith("|"):
            return Block("table", 0, "", i, self.run(i, lambda k: self.bare[k].startswith("|")))
        if bare.startswith(">"):
            return Block("quote", 0, "", i, self.run(i, lambda k: self.bare[k].startswith(">") or not _starts_block(self.lines[k])))
        for kind, item in (("bullets", _BULLET), ("ordered", _ORDERED)):
            if item.match(bare):
                return Block(kind, 0, "", i, self.listed(i, item))
        if bare.startswith("<") and not _INLINE.match(bare):
            return Block("html", 0, "", i, self.html(i))
        return Block("paragraph", 0, "", i, self.run(i, lambda k: not _starts_block(self.lines[k])))


def parse_blocks(md: str) -> list[Block]:
    """All blocks in order; blank lines between them belong to none."""
    parser, out, i = _Parser(md), [], 0
    while i < len(parser.lines):
        if parser.bare[i]:
            out.append(parser.at(i))
            i = out[-1].stop
        else:
            i += 1
    return out


def code_content(raw: str) -> tuple[str, str]:
    """Language and body of a fenced block."""
    lines = lines_with_ends(raw)
    body = []
    for line in lines[1:]:
        if line.strip().startswith("```"):
            break
        body.append(line)
    return (lines[0].strip().lstrip("`").strip() if lines else ""), "\n".join(body).removesuffix("\n")


class Run(NamedTuple):
    """Text, or an equation with its delimiters taken off."""

    is_equation: bool
    text: str
    begin: str = ""
    end: str = ""


def split_inline(text: str) -> list[Run]:
    r"""Runs of text and of ``\(..\)`` or ``$..$`` mathematics without white space inside the dollars; ``\$`` and ``$$`` are text."""
    closers = [m.start() for m in re.finditer(r"(?<![\s\\])\$", text)] if "$" in text else []
    runs, begin, i = [], 0, 0
    opener = re.compile(r"\\\(|\\\$|\$\$|\$(?!\s|$)")
    no_more = False
    while found := opener.search(text, i):
        i, end, size = found.start(), -1, len(found[0])
        if found[0] == "\\(":
            end = -1 if no_more else text.find("\\)", i + 2)
            no_more = end == -1
        elif found[0] == "$":
            k = bisect_left(closers, i + 1)
            end = closers[k] if k < len(closers) else -1
        if end == -1:
            i = found.end()
            continue
        if begin < i:
            runs.append(Run(False, text[begin:i]))
        close = text[end : end + size]
        runs.append(Run(True, text[i + size : end], found[0], close))
        begin = i = end + size
    return runs + ([Run(False, text[begin:])] if begin < len(text) else [])


def join_runs(runs: list[Run]) -> str:
    return "".join(r.begin + r.text + r.end for r in runs)


def display_equations(md: str) -> list[str]:
    """Display equations in order, outside ``` fences, closed only at the end of a line; a blank line or one that begins with # gives one up."""
    out, code, close, body = [], False, "", []
    for line in lines_with_ends(md):
        bare = line.strip()
        if line.lstrip().startswith("```"):
            code = not code
        elif code:
            continue
        elif close:
            if not bare or bare.startswith("#"):
                close = ""
            elif bare.endswith(close):
                while bare.endswith(close):
                    bare = bare.removesuffix(close)
                out.append("\n".join(body + ([bare.strip()] if bare.strip() else [])))
                close = ""
            else:
                body.append(bare)
        elif line.lstrip().startswith(("$$", "\\[")):
            after = line.lstrip()
            opener = after[:2]
            close = "$$" if opener == "$$" else "\\]"
            while after.startswith(opener):
                after = after[2:]
            after = after.strip()
            if after and after.endswith(close):
                while after.endswith(close):
                    after = after.removesuffix(close)
                out.append(after.strip())
                close = ""
            else:
                body = [after] if after else []
    return out
