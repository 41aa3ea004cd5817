"""Text and equations of a document in turn, containers, images, and edits of whole blocks."""

from __future__ import annotations

import re
from typing import NamedTuple

from .blocks import parse_blocks


class Segment(NamedTuple):
    is_equation: bool
    content: str
    begin: int
    end: int


def preview_segments(md: str) -> list[Segment]:
    """Runs of text and display equations with their places in characters; an equation that nothing closes ends with the text."""
    out: list[Segment] = []
    text: list[str] = []
    begin = end = at = 0
    code, close, body, opened = False, "", [], 0

    def flush() -> None:
        if "".join(text).strip():
            out.append(Segment(False, "".join(text), begin, end))
        text.clear()

    for raw in re.findall(r"[^\n]*\n|[^\n]+", md):
        line, here, at = raw.removesuffix("\n").rstrip("\r"), at, at + len(raw)
        bare = line.strip()
        fence = line.lstrip().startswith("```")
        opener = line.lstrip()[:2]
        if close and not fence and not code:
            if bare.endswith(close):
                while bare.endswith(close):
                    bare = bare.removesuffix(close)
                out.append(Segment(True, "\n".join(body + ([bare.strip()] if bare.strip() else [])), opened, at))
                close = ""
            else:
                body.append(bare)
            continue
        if not fence and not code and opener in ("$$", "\\["):
            flush()
            after = line.lstrip()
            while after.startswith(opener):
                after = after[2:]
            after, close = after.strip(), "$$" if opener == "$$" else "\\]"
            if after and after.endswith(close):
                while after.endswith(close):
                    after = after.removesuffix(close)
                out.append(Segment(True, after.strip(), here, at))
                close = ""
            else:
                body, opened = [after] if after else [], here
            continue
        code ^= fence
        begin = here if not text else begin
        end = at
        text.append(line + "\n")
    if close:
        out.append(Segment(True, "\n".join(body), opened, len(md)))
    flush()
    return out


def math_placeholders(md: str, mark: str = "MATH{:04d}END") -> tuple[str, list[tuple[bool, str]]]:
    """The text with a placeholder for each formula outside code, and the formulas (is display, LaTeX) in order."""
    found: list[tuple[bool, str]] = []

    def told(m: re.Match) -> str:
        if m["code"]:
            return m[0]
        found.append((bool(m["dd"] or m["br"]), (m["dd"] or m["br"] or m["pr"] or m["in"] or "").strip()))
        return mark.format(len(found) - 1)

    pattern = r"(?P<code>^```.*?(?:^```[^\n]*$|\Z)|`[^`\n]+`)|\$\$(?P<dd>.+?)\$\$|\\\[(?P<br>.+?)\\\]|\\\((?P<pr>.+?)\\\)|(?<!\\)\$(?P<in>(?!\s)[^$\n]+?(?<!\s))\$"
    return re.sub(pattern, told, md, flags=re.S | re.M), found


class Image(NamedTuple):
    alt: str
    path: str
    begin: int
    end: int


def images(md: str) -> list[Image]:
    """Image references with their places in characters."""
    return [Image(m[1], m[2], *m.span()) for m in re.finditer(r"!\[([^\]]*)\]\(([^)]*)\)", md)]


def standalone_image(line: str) -> Image | None:
    """The image that is all of a line."""
    found = images(line.strip())
    return found[0] if len(found) == 1 and (found[0].begin, found[0].end) == (0, len(line.strip())) else None


def serialize_image(image: Image) -> str:
    return f"![{image.alt}]({image.path})"


def css_value(style: str, name: str) -> str | None:
    """The value of a property in a style attribute."""
    for part in style.split(";"):
        key, colon, value = part.partition(":")
        if colon and key.strip().lower() == name:
            return value.strip()
    return None


def css_color(value: str) -> tuple[int, int, int] | None:
    """#rgb, #rrggbb or rgb(r, g, b)."""
    value = value.strip().lower()
    if found := re.fullmatch("#([0-9a-f]{3})", value):
        return tuple(int(c * 2, 16) for c in found[1])
    if found := re.fullmatch("#([0-9a-f]{6})", value):
        return tuple(int(found[1][i : i + 2], 16) for i in (0, 2, 4))
    if found := re.fullmatch(r"rgb\(\s*(\d{1,3})\s*,\s*(\d{1,3})\s*,\s*(\d{1,3})\s*\)", value):
        return tuple(min(255, int(x)) for x in found.groups())
    return None


def div_style(block: str) -> dict[str, str] | None:
    """Alignment, colour and background of a div container, with its body; None for anything else."""
    found = re.fullmatch(r"\s*<div\b([^>]*)>(.*)</div\s*>\s*", block, re.S | re.I)
    if not found:
        return None
    style = re.search(r"""style=(?:"([^"]*)"|'([^']*)')""", found[1])
    told = (style[1] or style[2] or "") if style else ""
    shown = {n: v for n in ("text-align", "color", "background", "background-color", "border") if (v := css_value(told, n))}
    return shown | {"body": found[2].strip("\n")}


def _parts(md: str) -> list[str]:
    lines = md.split("\n")
    return ["\n".join(lines[b.first : b.stop]).strip("\n") for b in parse_blocks(md)]


def move_block(md: str, source: int, target: int) -> str:
    """Block ``source`` in place ``target``; blocks are joined with blank lines."""
    parts = _parts(md)
    if not (0 <= source < len(parts) and 0 <= target < len(parts)):
        return md
    parts.insert(target, parts.pop(source))
    return "\n\n".join(parts) + "\n"


def replace_equation(md: str, index: int, latex: str) -> str:
    """Display equation ``index`` with another body."""
    lines = md.split("\n")
    found = [b for b in parse_blocks(md) if b.kind == "equation"]
    if not 0 <= index < len(found):
        return md
    b = found[index]
    body = latex if b.info else f"$$\n{latex}\n$$"
    return "\n".join([*lines[: b.first], body, *lines[b.stop :]])


def align_block(md: str, index: int, how: str) -> str:
    """Block ``index`` in a div of that alignment; a div gets it in place of its own. Code stays, and left is no change."""
    lines = md.split("\n")
    found = parse_blocks(md)
    if not 0 <= index < len(found) or found[index].kind == "code" or how == "left":
        return md
    b = found[index]
    raw = "\n".join(lines[b.first : b.stop])
    if div_style(raw) is not None:
        head, _, rest = raw.partition(">")
        head = re.sub(r"text-align\s*:\s*[\w-]+", f"text-align: {how}", head) if "text-align" in head else head + f' style="text-align: {how}"'
        raw = f"{head}>{rest}"
    else:
        raw = f'<div style="text-align: {how}">\n\n{raw}\n\n</div>'
    return "\n".join([*lines[: b.first], raw, *lines[b.stop :]])


class Span(NamedTuple):
    """A stretch of a block's visible text and the source that it comes from; ``linear`` if both are the same characters."""

    vis_begin: int
    vis_end: int
    src_begin: int
    src_end: int
    kind: str
    linear: bool


_VISIBLE = re.compile(
    r"(?P<image>!\[(?P<alt>[^\]]*)\]\([^)]*\))|\[(?P<words>[^\]]*)\]\([^)]*\)|`(?P<code>[^`]+)`|\*\*(?P<strong>.+?)\*\*|~~(?P<strike>.+?)~~|(?<![\w*])\*(?P<em>[^*\s][^*]*)\*|\$(?P<math>(?!\s)[^$\n]+?(?<!\s))\$|<(?P<tag>/?[A-Za-z][^>]*)>"
)


def visible_map(block: str) -> list[Span]:
    """Spans of a block in order: text as it is, and marked stretches without their marks; marks inside marks stay as they are."""
    lead = re.match(r"\s*(?:#{1,6}[ \t]+|[-*+][ \t]+|\d+[.)][ \t]+|>[ \t]?)?", block).end()
    out: list[Span] = []
    at, shown = lead, 0

    def put(begin: int, end: int, kind: str, linear: bool = True) -> None:
        nonlocal shown
        if end > begin:
            out.append(Span(shown, shown + end - begin, begin, end, kind, linear))
            shown += end - begin

    for m in _VISIBLE.finditer(block, lead):
        put(at, m.start(), "text")
        name = next((k for k in ("alt", "words", "code", "strong", "strike", "em", "math") if m[k] is not None), None)
        if name:
            put(m.start(name), m.end(name), name, name not in ("math", "alt"))
        at = m.end()
    put(at, len(block), "text")
    return out


def visible_text(block: str) -> str:
    return "".join(block[s.src_begin : s.src_end] for s in visible_map(block))


def sync_edit(block: str, visible: str) -> str | None:
    """The block after its visible text has been edited in one place; None if the edit crosses the edge of a span or meets one that is not linear."""
    before = visible_text(block)
    begin = next((i for i, (a, b) in enumerate(zip(before, visible, strict=False)) if a != b), min(len(before), len(visible)))
    end = 0
    while end < min(len(before), len(visible)) - begin and before[-1 - end] == visible[-1 - end]:
        end += 1
    last, new = len(before) - end, visible[begin : len(visible) - end]
    if begin == last and not new:
        return block
    for s in visible_map(block):
        if s.linear and s.vis_begin <= begin and last <= s.vis_end:
            place = s.src_begin - s.vis_begin
            return block[: begin + place] + new + block[last + place :]
    return None
