"""HTML to Markdown in one pass over tags; nothing needs to be closed."""

from __future__ import annotations

import re

from .text import attribute, collapse_blank_lines, decode_entities, lines_of

_TOKEN = re.compile(r"""<(?=!--)(?:.*?-->|.*)|<(?P<tag>(?:[^>"']++|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+)>?|(?P<text>[^<]+)""", re.S)
_NAME = re.compile(r"[^\W_]*")
#: Tags that only begin a new paragraph, and tags with the same mark on both sides.
_PARAGRAPH = {"p", "div", "article", "section", "main", "header", "footer", "aside"}
_MARKS = {"s": "~~", "del": "~~", "strike": "~~"}
_PAIRED = {"strong": "**", "b": "**", "em": "*", "i": "*"}
_HIDDEN = ("head", "script", "style")


class _Page:
    def __init__(self) -> None:
        self.out: list[str] = []
        self.end = ""  # the last two characters
        self.hidden = dict.fromkeys(_HIDDEN, False)
        self.open = {"**": 0, "*": 0, "`": 0}
        self.pre = False
        self.lists: list[int | None] = []  # the running number, or None for bullets

    def put(self, text: str) -> None:
        if text:
            self.out.append(text)
            self.end = (self.end + text)[-2:]

    def paragraph(self) -> None:
        if self.end and self.end != "\n\n":
            self.put("\n" if self.end[-1] == "\n" else "\n\n")

    def line(self) -> None:
        if self.end[-1:] != "\n":
            self.put("\n")

    def text(self, raw: str) -> None:
        if not any(self.hidden.values()):
            told = decode_entities(raw)
            self.put(told if self.pre else re.sub(r"[ \t\n\f\r]+", " ", told).removeprefix(" "))

    def paired(self, mark: str, closing: bool, shown: bool = True) -> None:
        if not closing:
            self.open[mark] += 1
        elif not self.open[mark]:
            return
        else:
            self.open[mark] -= 1
        if shown:
            self.put(mark)

    def tag(self, inner: str) -> None:
        closing = inner.startswith("/")
        name = _NAME.match(inner.removeprefix("/").strip())[0].lower()
        if name in self.hidden:
            self.hidden[name] = not closing
        elif re.fullmatch("h[1-6]", name):
            if closing:
                self.put("\n\n")
            else:
                self.paragraph()
                self.put("#" * int(name[1]) + " ")
        elif name in _PARAGRAPH:
            if closing or not inner.endswith("/"):
                self.paragraph()
        elif name in _PAIRED:
            self.paired(_PAIRED[name], closing)
        elif name in _MARKS:
            self.put(_MARKS[name])
        elif name in ("sup", "sub"):
            self.put(f"</{name}>" if closing else f"<{name}>")
        elif name == "code":
            self.paired("`", closing, not self.pre)
        elif name == "pre":
            self.pre = not closing
            if closing:
                self.line()
                self.put("```\n\n")
            else:
                kind = attribute(inner, "class") or ""
                self.paragraph()
                self.put(f"```{kind.removeprefix('language-') if kind.startswith('language-') else ''}\n")
        elif name in ("ul", "ol"):
            if closing:
                self.lists = self.lists[:-1]
                self.put("\n")
            else:
                self.lists.append(0 if name == "ol" else None)
                self.line()
        elif name == "li":
            if closing:
                self.line()
            else:
                if self.lists and self.lists[-1] is not None:
                    self.lists[-1] += 1
                self.put("  " * max(0, len(self.lists) - 1) + (f"{self.lists[-1]}. " if self.lists and self.lists[-1] is not None else "- "))
        elif name == "blockquote":
            if closing:
                self.put("\n\n")
            else:
                self.paragraph()
                self.put("> ")
        elif name == "br":
            self.put("  \n")
        elif name == "hr":
            self.paragraph()
            self.put("---\n\n")
        elif name == "img":
            self.put(f"![{attribute(inner, 'alt') or ''}]({attribute(inner, 'src') or ''})")
        elif name == "tr":
            self.put(" |" if closing else "\n")
        elif name in ("th", "td") and not closing:
            self.put("| ")


def html_to_md(html: str) -> str:
    """Links keep their words only; every run of text loses its leading white space."""
    page = _Page()
    for m in _TOKEN.finditer(math_first(html)):
        if m["text"] is not None:
            page.text(m["text"])
        elif m["tag"] is not None:
            page.tag(m["tag"])
    return collapse_blank_lines(with_table_rules("".join(page.out)))


def with_table_rules(md: str) -> str:
    """A delimiter row after the first row of each pipe table that lacks one."""
    out: list[str] = []
    lines = lines_of(md)
    is_row = lambda line: line.lstrip().startswith("|")
    for i, line in enumerate(lines):
        first = is_row(line) and not (out and is_row(out[-1]))
        out.append(line)
        following = lines[i + 1].strip() if i + 1 < len(lines) else ""
        if first and not re.fullmatch(r"\|[|\-: ]*-[|\-: ]*", following):
            out.append("|" + " --- |" * max(1, sum(bool(c.strip()) for c in line.split("|"))))
    return "\n".join(out)


_TEX = re.compile(r"""<annotation encoding=(["'])application/x-tex\1>(.*?)</annotation>""", re.S)
_LEAF = re.compile(r"<(mi|mn|mo|mtext)>(.*?)</\1>", re.S)
_MATH = re.compile(r"(<math[^>]*>)(.*?)</math>", re.S)
_SCRIPT = re.compile(r"(<script[^>]*math/tex[^>]*>)(.*?)</script>", re.S)
_SPAN = re.compile(r"(<span[^>]*math[ -](inline|display)[^>]*>)(.*?)</span>", re.S | re.I)


def annotation(math: str) -> str | None:
    """The TeX source that a formula carries."""
    found = [m for m in _TEX.finditer(math)]
    double = next((m for m in found if m[1] == '"'), found[0] if found else None)
    return double[2].strip() if double else None


def leaf_text(math: str) -> str:
    return "".join(m[2] for m in _LEAF.finditer(math))


def math_first(html: str) -> str:
    """Formulas (MathML, TeX scripts, marked spans) as dollar mathematics, before tags are read."""

    def told(latex: str, display: bool) -> str:
        return f"\n$$\n{latex}\n$$\n" if display else f"${latex}$"

    def math(m: re.Match) -> str:
        latex = annotation(m[2])
        latex = leaf_text(m[2]).strip() if latex is None else latex
        return told(latex, "display" in m[1] or "block" in m[1]) if latex or annotation(m[2]) is not None else ""

    if "<math" in html:
        html = _MATH.sub(math, html)
    if "math/tex" in html:
        html = _SCRIPT.sub(lambda m: told(m[2].strip(), "mode=display" in m[1] or "mode%3Ddisplay" in m[1]), html)
    if "<span" in html and "math" in html.lower():
        html = _SPAN.sub(lambda m: f"\n{m[3].strip()}\n" if m[2].lower() == "display" else m[3].strip(), html)
    return html
