"""Markdown to other formats. A writer turns the events of a text into its format; what formats share is in the base class."""

from __future__ import annotations

import base64
import html as _html
import json
import re
from collections.abc import Iterable

from .latex import Macro, macros_of, to_unicode
from .markdown import Event, events
from .scholarly import resolve_references
from .text import lines_of
from .typst import to_typst


def escape_xml(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&apos;")


# Characters that formats treat specially, and how they are written.
_TEX = str.maketrans({"\\": "\\textbackslash{}", "{": "\\{", "}": "\\}", "$": "\\$", "#": "\\#", "%": "\\%", "^": "\\^{}", "&": "\\&", "_": "\\_", "~": "\\textasciitilde{}"})
_TYPST = str.maketrans({c: f"\\{c}" for c in "\\#*_`$@"})
_RST = str.maketrans({c: f"\\{c}" for c in "*`|"})


def escape_tex(text: str) -> str:
    return text.translate(_TEX)


def escape_typst(text: str) -> str:
    return text.translate(_TYPST)


def escape_rst(text: str) -> str:
    return text.translate(_RST)


def escape_rtf(text: str) -> str:
    return "".join("\\line " if c == "\n" else f"\\{c}" if c in "\\{}" else f"\\u{ord(c)}?" if ord(c) > 127 else c for c in text)


def split_display(md: str) -> list[tuple[bool, str]]:
    """(is equation, text) parts: display mathematics between dollars or brackets, outside ``` fences; an opener that nothing closes is text."""
    out, at, code = [], 0, False
    if "$$" not in md and "\\[" not in md:
        return [(False, md)]
    opener = re.compile(r"\$\$|\\\[")
    while at < len(md):
        found = opener.search(md, at)
        before = md[at : found.start() if found else len(md)]
        if "```" in before:
            code ^= sum(line.lstrip().startswith("```") for line in before.split("\n")) % 2 == 1
        if code:
            end = found.end() if found else len(md)
            out.append((False, md[at:end]))
            at = end
            continue
        close = md.find("$$" if found[0] == "$$" else "\\]", found.end()) if found else -1
        if not found:
            out.append((False, md[at:]))
            break
        out += [(False, before)] if before else []
        if close == -1:
            out.append((False, md[found.start() :]))
            break
        latex = md[found.end() : close].strip()
        out += [(True, latex)] if latex else []
        at = close + 2
    return out


class Writer:
    """Collects inline text in a buffer that blocks flush. ``marks`` go around inline tags; ``on_…`` methods handle events."""

    math = True
    marks: dict[str, tuple[str, str]] = {}

    def __init__(self, macros: dict[str, Macro] | None = None):
        self.macros = macros or {}
        self.out: list[str] = []
        self.buf = ""
        self.ordered, self.number, self.depth = False, 0, 0
        self.code = False
        self.image: str | None = None  # the words of the image that is being read
        self.rows: list[list[str]] = []

    # what writers differ in
    def escape(self, text: str) -> str:
        return text

    def table(self, rows: list[list[str]]) -> str:
        return ""

    def flush(self) -> None:
        self.put(self.take())

    # shared
    def put(self, text: str) -> None:
        self.out.append(text)

    def take(self) -> str:
        text, self.buf = self.buf, ""
        return text

    def write(self, found: Iterable[Event]) -> str:
        for e in found:
            if e.what in ("start", "end"):
                if e.tag in self.marks:
                    self.buf += self.marks[e.tag][e.what == "end"]
                elif e.tag in ("table", "cell", "head", "row"):
                    self._table(e)
                else:
                    if e.tag == "image":
                        self.image = "" if e.what == "start" else self.image
                    if e.tag == "list" and e.what == "start":
                        self.ordered, self.number = e.value is not None, (e.value or 1) - 1
                    getattr(self, f"{e.what}_{e.tag}", lambda value: None)(e.value)
                    if e.tag == "image" and e.what == "end":
                        self.image = None
            elif e.what == "text":
                if self.image is not None:
                    self.image += e.value
                elif self.code:
                    self.buf += e.value
                else:
                    self.on_text(e.value)
            else:
                getattr(self, f"on_{e.what}", lambda value: None)(e.value)
        return "".join(self.out)

    def on_text(self, text: str) -> None:
        self.buf += self.escape(text)

    def on_soft(self, _: object) -> None:
        self.buf += " "

    def _table(self, e: Event) -> None:
        if e.tag == "table" and e.what == "start":
            self.flush()
            self.rows = []
        elif e.tag == "table":
            self.put(self.table(self.rows))
        elif e.what == "start" and e.tag in ("head", "row"):
            self.rows.append([])
        elif e.what == "end" and e.tag == "cell":
            self.rows[-1].append(self.take())

    def cells(self, rows: list[list[str]]) -> list[list[str]]:
        """Rows with trimmed cells, padded to the widest."""
        width = max([1, *map(len, rows)])
        return [[c.strip() for c in r] + [""] * (width - len(r)) for r in rows]


class TextWriter(Writer):
    math = False

    def flush(self) -> None:
        self.put(self.take())

    def on_text(self, text: str) -> None:
        self.buf += ("#" * self.depth + " " if self.depth else "") + text

    def start_heading(self, level: int) -> None:
        self.flush()
        self.depth = min(4, level)

    def end_heading(self, level: int) -> None:
        self.buf += "\n\n"
        self.depth = 0

    def end_paragraph(self, _: object) -> None:
        self.buf += "\n\n"

    def end_list(self, _: object) -> None:
        self.buf += "\n"

    def start_item(self, _: object) -> None:
        self.number += 1
        self.buf += f"  {self.number}. " if self.ordered else "  • "

    def end_item(self, _: object) -> None:
        self.buf += "\n"

    def start_codeblock(self, _: object) -> None:
        self.buf += "\n"
        self.flush()
        self.code = True

    def end_codeblock(self, _: object) -> None:
        self.put("".join(f"    {line}\n" for line in lines_of(self.take())) + "\n")
        self.code = False

    def start_quote(self, _: object) -> None:
        self.buf += "  │ "

    def end_quote(self, _: object) -> None:
        self.buf += "\n"

    def end_image(self, _: object) -> None:
        self.buf += f"[Image: {self.image or 'image'}]"

    def on_rule(self, _: object) -> None:
        self.buf += "─" * 60 + "\n\n"

    def on_code(self, text: str) -> None:
        self.buf += f"`{text}`"

    def on_hard(self, _: object) -> None:
        self.buf += "\n"

    def _table(self, e: Event) -> None:  # cells follow one another
        pass


def to_txt(md: str) -> str:
    """Plain text; display equations in Unicode."""
    writer = TextWriter()
    text = writer.write(events(md, False)) + writer.take()
    macros = macros_of(md)
    return re.sub(r"\$\$(.*?)\$\$", lambda m: to_unicode(m[1].strip(), macros), text, flags=re.S).rstrip()


class TexWriter(Writer):
    marks = {"strong": ("\\textbf{", "}"), "emphasis": ("\\textit{", "}"), "strike": ("\\sout{", "}")}
    commands = ("section", "subsection", "subsubsection", "paragraph", "subparagraph")

    def escape(self, text: str) -> str:
        return escape_tex(text)

    def flush(self) -> None:
        text = self.take().strip()
        self.put(f"{text}\n" if text else "")

    def start_heading(self, level: int) -> None:
        self.flush()
        self.put(f"\n\\{self.commands[min(5, level) - 1]}{{\n")

    def end_heading(self, _: object) -> None:
        self.flush()
        self.put("}\n\n")

    def end_paragraph(self, _: object) -> None:
        text = self.take().strip()
        self.put(f"{text}\n\n" if text else "")

    def start_list(self, start: int | None) -> None:
        self.flush()
        self.put(f"\\begin{{{'itemize' if start is None else 'enumerate'}}}\n")

    def end_list(self, _: object) -> None:
        self.put(f"\\end{{{'enumerate' if self.ordered else 'itemize'}}}\n\n")

    def start_item(self, _: object) -> None:
        self.put("  \\item ")

    def end_item(self, _: object) -> None:
        self.put(self.take().strip() + "\n")

    def start_codeblock(self, language: str | None) -> None:
        self.flush()
        self.code = True
        self.put(f"\\begin{{lstlisting}}{f'[language={language}]' if language else ''}\n")

    def end_codeblock(self, _: object) -> None:
        self.put(self.take() + "\\end{lstlisting}\n\n")
        self.code = False

    def start_quote(self, _: object) -> None:
        self.flush()
        self.put("\\begin{quote}\n\\itshape ")

    def end_quote(self, _: object) -> None:
        self.put(self.take().strip() + "\n\\end{quote}\n\n")

    def start_link(self, url: str) -> None:
        self.buf += f"\\href{{{escape_tex(url)}}}{{\n"

    def end_link(self, _: object) -> None:
        self.buf += "}"

    def end_image(self, url: str) -> None:
        self.buf += f"\\includegraphics[width=0.8\\linewidth]{{{url}}}"

    def on_rule(self, _: object) -> None:
        self.put("\n\\noindent\\rule{\\textwidth}{0.4pt}\n\n")

    def on_math(self, latex: str) -> None:
        self.buf += f"${latex}$"

    def on_display(self, latex: str) -> None:
        self.flush()
        self.put(f"\\[{latex}\\]\n\n")

    def on_code(self, text: str) -> None:
        self.buf += f"\\texttt{{{escape_tex(text)}}}"

    def on_hard(self, _: object) -> None:
        self.buf += "\\\\\n"

    def table(self, rows: list[list[str]]) -> str:
        rows = self.cells(rows)
        body = "".join(" & ".join(r) + " \\\\ \\hline\n" for r in rows)
        return f"\n\\begin{{table}}[h]\\centering\n\\begin{{tabular}}{{|{'l|' * len(rows[0])}}}\n\\hline\n{body}\\end{{tabular}}\n\\end{{table}}\n\n" if rows else ""


_TEX_PREAMBLE = r"""\documentclass[12pt,a4paper]{article}
\usepackage[utf8]{inputenc}
\usepackage[T1]{fontenc}
\usepackage{amsmath,amssymb,amsfonts}
\usepackage{graphicx,xcolor}
\usepackage[colorlinks,linkcolor=blue,urlcolor=blue]{hyperref}
\usepackage{listings,geometry}
\geometry{a4paper,margin=2.5cm}
\setlength{\parskip}{0.5em}\setlength{\parindent}{0pt}
\lstset{basicstyle=\ttfamily\small,breaklines=true,frame=single,backgroundcolor=\color{gray!10}}

"""


def to_tex(md: str, title: str = "", author: str = "", date: str = "") -> str:
    head = _TEX_PREAMBLE + (f"\\title{{{escape_tex(title)}}}\n" if title else "") + (f"\\author{{{escape_tex(author)}}}\n" if author else "") + f"\\date{{{escape_tex(date)}}}\n"
    body = [f"\\begin{{equation}}\n{part}\n\\end{{equation}}\n\n" if is_eq else _whole(TexWriter(), part) for is_eq, part in split_display(md)]
    return head + "\n\\begin{document}\n" + ("\\maketitle\n" if title or author else "") + "\n" + "".join(body) + "\\end{document}\n"


def _whole(writer: Writer, md: str) -> str:
    writer.write(events(md, writer.math))
    writer.flush()
    return "".join(writer.out)


class TypstWriter(Writer):
    marks = {"strong": ("*", "*"), "emphasis": ("_", "_"), "strike": ("#strike[", "]")}

    def escape(self, text: str) -> str:
        return escape_typst(text)

    def start_heading(self, level: int) -> None:
        self.flush()
        self.put("=" * min(4, level) + " ")

    def end_heading(self, _: object) -> None:
        self.flush()
        self.put("\n\n")

    end_paragraph = end_heading

    def start_list(self, _: object) -> None:
        self.flush()
        self.depth += 1

    def end_list(self, _: object) -> None:
        self.depth -= 1
        self.put("\n")

    def start_item(self, _: object) -> None:
        self.put("  " * (self.depth - 1) + ("+ " if self.ordered else "- "))

    def end_item(self, _: object) -> None:
        self.flush()
        self.put("\n")

    def start_codeblock(self, language: str | None) -> None:
        self.flush()
        self.code = True
        self.put(f"```{language or ''}\n")

    def end_codeblock(self, _: object) -> None:
        self.flush()
        self.put("```\n\n")
        self.code = False

    def start_quote(self, _: object) -> None:
        self.flush()
        self.put("#quote[\n")

    def end_quote(self, _: object) -> None:
        self.flush()
        self.put("]\n\n")

    def start_link(self, url: str) -> None:
        self.buf += f'#link("{url}")['

    def end_link(self, _: object) -> None:
        self.buf += "]"

    def end_image(self, url: str) -> None:
        self.buf += f'#figure(image("{url}", width: 80%), caption: [{escape_typst(self.image)}])' if self.image else f'#image("{url}", width: 80%)'

    def on_rule(self, _: object) -> None:
        self.flush()
        self.put("#line(length: 100%)\n\n")

    def on_math(self, latex: str) -> None:
        self.buf += f"${to_typst(latex, self.macros)}$"

    def on_display(self, latex: str) -> None:
        self.flush()
        self.put(f"$ {to_typst(latex, self.macros)} $\n\n")

    def on_code(self, text: str) -> None:
        self.buf += f"`{text}`"

    def on_hard(self, _: object) -> None:
        self.flush()
        self.put("\\\n")

    def table(self, rows: list[list[str]]) -> str:
        rows = self.cells(rows)
        body = "".join("  " + ", ".join(f"[{c}]" for c in r) + ",\n" for r in rows)
        return f"\n#table(\n  columns: {len(rows[0])},\n{body})\n\n" if rows else ""


def to_typst_source(md: str, title: str = "", author: str = "", language: str = "en") -> str:
    macros = macros_of(md)
    head = f'#set page(paper: "a4", margin: (x: 2.5cm, y: 2.5cm))\n#set text(font: "New Computer Modern", size: 11pt, lang: "{language}")\n#set heading(numbering: "1.")\n#set par(justify: true)\n\n'
    if title:
        head += f'#align(center)[#text(size: 18pt, weight: "bold")[{title}]]\n' + (f'#align(center)[#text(size: 12pt, style: "italic")[{author}]]\n' if author else "") + "#v(1em)\n\n"
    return head + "".join(f"$ {to_typst(part, macros)} $\n\n" if is_eq else _whole(TypstWriter(macros), part) for is_eq, part in split_display(md))


class RtfWriter(Writer):
    def __init__(self, macros: dict[str, Macro] | None = None, figures: dict[str, tuple[bytes, int, int]] | None = None):
        super().__init__(macros)
        self.figures = figures or {}

    def escape(self, text: str) -> str:
        return escape_rtf(text)

    def write(self, found: Iterable[Event]) -> str:
        return super().write(self._marked(found))

    def _marked(self, found: Iterable[Event]) -> Iterable[Event]:
        words = {"strong": ("\\b ", "\\b0 "), "emphasis": ("\\i ", "\\i0 "), "strike": ("\\strike ", "\\strike0 ")}
        for e in found:
            if e.tag in words and e.what in ("start", "end"):
                self.buf += words[e.tag][e.what == "end"]
            else:
                yield e

    def start_heading(self, level: int) -> None:
        self.flush()
        size, space = ((40, 280), (32, 220), (28, 180))[min(3, level) - 1]
        self.put(f"\\pard\\sb{space}\\b\\fs{size} ")

    def end_heading(self, _: object) -> None:
        self.flush()
        self.put("\\b0\\fs24\\par\n")

    def end_paragraph(self, _: object) -> None:
        self.flush()
        self.put("\\par\n")

    def start_list(self, _: object) -> None:
        self.flush()

    def end_list(self, _: object) -> None:
        self.put("\\par\n")

    def start_item(self, _: object) -> None:
        self.number += 1
        self.put(f"\\pard\\li720\\fi-360 {self.number}.\\ " if self.ordered else "\\pard\\li720\\fi-360 \\bullet\\ ")

    def end_item(self, _: object) -> None:
        self.flush()
        self.put("\\par\n")

    def start_codeblock(self, _: object) -> None:
        self.flush()
        self.code = True
        self.put("\\pard\\f1\\fs20\\cf3 ")

    def end_codeblock(self, _: object) -> None:
        self.put(escape_rtf(self.take()) + "\\f0\\fs24\\cf1\\par\n")
        self.code = False

    def start_quote(self, _: object) -> None:
        self.flush()
        self.put("\\pard\\li720\\i\\cf3 ")

    def end_quote(self, _: object) -> None:
        self.flush()
        self.put("\\i0\\cf1\\par\n")

    def start_image(self, _: object) -> None:
        self.flush()

    def end_image(self, url: str) -> None:
        if url in self.figures:
            png, width, height = self.figures[url]
            wide, high = fit_width(width, height, 600)
            self.put(f"\\pard\\qc {{\\pict\\pngblip\\picwgoal{wide * 15}\\pichgoal{high * 15}\n{png.hex()}}}\n\\par\n")
        else:
            self.put(escape_rtf(self.image or ""))

    def on_rule(self, _: object) -> None:
        self.flush()
        self.put("\\pard\\brdrb\\brdrs\\brdrw10\\brsp20 \\par\n")

    def on_math(self, latex: str) -> None:
        self.buf += escape_rtf(to_unicode(latex, self.macros))

    def on_display(self, latex: str) -> None:
        self.flush()
        self.put(f"\\pard\\qc\\i {escape_rtf(to_unicode(latex, self.macros))}\\i0\\par\n")

    def on_code(self, text: str) -> None:
        self.buf += f"\\f1\\fs20 {escape_rtf(text)}\\f0\\fs24 "

    def on_hard(self, _: object) -> None:
        self.buf += "\\line "

    def table(self, rows: list[list[str]]) -> str:
        rows = self.cells(rows)
        width = max(800, 9000 // max(1, len(rows[0]) if rows else 1))
        out = []
        for i, row in enumerate(rows):
            edges = "".join(f"\\cellx{width * (k + 1)}" for k in range(len(row)))
            out.append(f"\\trowd\\trgaph108{edges}" + "".join(f"\\intbl \\b {c}\\b0\\cell " if i == 0 else f"\\intbl {c}\\cell " for c in row) + "\\row\n")
        return "".join(out) + "\\pard\n" if rows else ""


def to_rtf(md: str, title: str = "", author: str = "", figures: dict[str, tuple[bytes, int, int]] | None = None) -> str:
    macros = macros_of(md)
    out = ["{\\rtf1\\ansi\\ansicpg1252\n{\\fonttbl\\f0\\froman\\fcharset0 Times New Roman;\\f1\\fmodern\\fcharset0 Courier New;}\n{\\colortbl;\\red0\\green0\\blue0;\\red70\\green130\\blue200;\\red85\\green85\\blue85;}\n\\widowctrl\\hyphauto\\widctlpar\\f0\\fs24\\cf1\n"]
    if title:
        out.append(f"\\pard\\qc\\sb240\\b\\fs36 {escape_rtf(title)}\\b0\\fs24\\par\n" + (f"\\pard\\qc\\fs22\\cf3 {escape_rtf(author)}\\cf1\\fs24\\par\n" if author else "") + "\\pard\\sb200\\par\n")
    for is_eq, part in split_display(md):
        out.append(f"\\pard\\qc\\sb100\\sa100\\i {escape_rtf(to_unicode(part, macros))}\\i0\\par\n" if is_eq else _whole(RtfWriter(macros, figures), part))
    return "".join(out) + "}"


class OrgWriter(Writer):
    marks = {"strong": ("*", "*"), "emphasis": ("/", "/"), "strike": ("+", "+")}

    def flush(self) -> None:
        self.put(self.take().strip())

    def start_heading(self, level: int) -> None:
        self.flush()
        self.put("*" * min(5, level) + " ")

    def end_heading(self, _: object) -> None:
        self.flush()
        self.put("\n\n")

    end_paragraph = end_heading

    def end_list(self, _: object) -> None:
        self.put("\n")

    def start_item(self, _: object) -> None:
        self.put("1. " if self.ordered else "- ")

    def end_item(self, _: object) -> None:
        self.flush()
        self.put("\n")

    def start_codeblock(self, language: str | None) -> None:
        self.flush()
        self.code = True
        self.put(f"#+begin_src {language or ''}\n")

    def end_codeblock(self, _: object) -> None:
        self.put(self.take().rstrip() + "\n#+end_src\n\n")
        self.code = False

    def start_quote(self, _: object) -> None:
        self.flush()
        self.put("#+begin_quote\n")

    def end_quote(self, _: object) -> None:
        self.flush()
        self.put("\n#+end_quote\n\n")

    def start_link(self, url: str) -> None:
        self.buf += f"[[{url}]["

    def end_link(self, _: object) -> None:
        self.buf += "]]"

    def end_image(self, url: str) -> None:
        self.buf += f"[[file:{url}]]"

    def on_rule(self, _: object) -> None:
        self.flush()
        self.put("-----\n\n")

    def on_display(self, latex: str) -> None:
        self.flush()
        self.put(f"\n\\begin{{equation}}\n{latex}\n\\end{{equation}}\n\n")

    def on_math(self, latex: str) -> None:
        self.buf += f"${latex}$"

    def on_code(self, text: str) -> None:
        self.buf += f"={text}="

    def on_hard(self, _: object) -> None:
        self.flush()
        self.put("\n")

    def table(self, rows: list[list[str]]) -> str:
        rows = self.cells(rows)
        told = [f"| {' | '.join(r)} |\n" for r in rows]
        return "\n" + "".join([*told[:1], f"|{'+'.join(['---'] * len(rows[0]))}|\n", *told[1:]]) + "\n" if rows else ""


def to_org(md: str, title: str = "", author: str = "") -> str:
    head = (f"#+TITLE: {title}\n" if title else "") + (f"#+AUTHOR: {author}\n" if author else "") + "#+OPTIONS: toc:t num:t\n\n"
    return head + OrgWriter().write(events(md))


class RstWriter(Writer):
    marks = {"strong": ("**", "**"), "emphasis": ("*", "*")}

    def escape(self, text: str) -> str:
        return escape_rst(text)

    def flush(self) -> None:
        self.put(self.take().strip())

    def start_heading(self, _: object) -> None:
        self.flush()
        self.put("\n")

    def end_heading(self, level: int) -> None:
        text = self.take().strip()
        line = ("=-~^"[level - 1 : level] or '"') * max(4, len(text.encode()))
        self.put(f"{text}\n{line}\n\n")

    def end_paragraph(self, _: object) -> None:
        self.flush()
        self.put("\n\n")

    def end_list(self, _: object) -> None:
        self.put("\n")

    def start_item(self, _: object) -> None:
        self.put("#. " if self.ordered else "- ")

    def end_item(self, _: object) -> None:
        self.flush()
        self.put("\n")

    def start_codeblock(self, language: str | None) -> None:
        self.flush()
        self.code = True
        self.put(f".. code-block:: {language or ''}\n\n")

    def end_codeblock(self, _: object) -> None:
        self.put("".join(f"   {line}\n" for line in lines_of(self.take())) + "\n")
        self.code = False

    def end_quote(self, _: object) -> None:
        self.put("".join(f"   {line.strip()}\n" for line in lines_of(self.take())) + "\n")

    def start_image(self, _: object) -> None:
        self.flush()

    def end_image(self, url: str) -> None:
        self.put(f"\n\n.. image:: {url}\n" + (f"   :alt: {self.image}\n" if self.image else "") + "\n")

    def on_rule(self, _: object) -> None:
        self.flush()
        self.put("\n----\n\n")

    def on_display(self, latex: str) -> None:
        self.flush()
        self.put(".. math::\n\n   " + latex.replace("\n", "\n   ") + "\n\n")

    def on_math(self, latex: str) -> None:
        self.buf += f"\\ :math:`{latex}`\\ "

    def on_code(self, text: str) -> None:
        self.buf += f"\\ ``{text}``\\ "

    def on_hard(self, _: object) -> None:
        self.flush()
        self.put("\n\n")

    def table(self, rows: list[list[str]]) -> str:
        body = "".join(("   * - " if i == 0 else "     - ") + (c or " ") + "\n" for r in self.cells(rows) for i, c in enumerate(r))
        return f"\n.. list-table::\n   :header-rows: 1\n\n{body}\n" if rows else ""


def to_rst(md: str, title: str = "", author: str = "") -> str:
    line = "=" * len(title.encode())
    head = (f"{line}\n{title}\n{line}\n\n" if title else "") + (f":Author: {author}\n\n" if author else "")
    return head + RstWriter().write(events(md))


class AdocWriter(Writer):
    marks = {"strong": ("*", "*"), "emphasis": ("_", "_"), "strike": ("[.line-through]#", "#")}

    def flush(self) -> None:
        self.put(self.take().strip())

    def start_heading(self, level: int) -> None:
        self.flush()
        self.put("=" * min(6, level + 1) + " ")

    def end_heading(self, _: object) -> None:
        self.flush()
        self.put("\n\n")

    end_paragraph = end_heading

    def end_list(self, _: object) -> None:
        self.put("\n")

    def start_item(self, _: object) -> None:
        self.put(". " if self.ordered else "* ")

    def end_item(self, _: object) -> None:
        self.flush()
        self.put("\n")

    def start_codeblock(self, language: str | None) -> None:
        self.flush()
        self.code = True
        self.put((f"[source,{language}]\n" if language else "") + "----\n")

    def end_codeblock(self, _: object) -> None:
        self.put(self.take().rstrip() + "\n----\n\n")
        self.code = False

    def start_quote(self, _: object) -> None:
        self.flush()
        self.put("____\n")

    def end_quote(self, _: object) -> None:
        self.flush()
        self.put("\n____\n\n")

    def start_image(self, _: object) -> None:
        self.flush()

    def end_image(self, url: str) -> None:
        self.put(f"\n\nimage::{url}[{self.image}]\n\n")

    def on_rule(self, _: object) -> None:
        self.flush()
        self.put("'''\n\n")

    def on_display(self, latex: str) -> None:
        self.flush()
        self.put(f"[stem]\n++++\n{latex}\n++++\n\n")

    def on_math(self, latex: str) -> None:
        self.buf += f"stem:[{latex}]"

    def on_code(self, text: str) -> None:
        self.buf += f"`{text}`"

    def on_hard(self, _: object) -> None:
        self.flush()
        self.put(" +\n")

    def table(self, rows: list[list[str]]) -> str:
        body = "".join("".join(f"| {c} " for c in r) + "\n" for r in self.cells(rows))
        return f'\n[options="header"]\n|===\n{body}|===\n\n' if rows else ""


def to_adoc(md: str, title: str = "", author: str = "") -> str:
    head = (f"= {title}\n" if title else "") + (f"{author}\n" if author else "") + ":toc:\n:stem: latexmath\n\n"
    return head + AdocWriter().write(events(md))


class NotebookWriter(Writer):
    marks = {"strong": ("**", "**"), "emphasis": ("*", "*")}

    def __init__(self, macros: dict[str, Macro] | None = None):
        super().__init__(macros)
        self.book: list[dict] = []

    def _cell(self, kind: str) -> None:
        text = self.take()
        if text.strip():
            source = [f"{line}\n" for line in text.rstrip().split("\n")]
            more = {"outputs": [], "execution_count": None} if kind == "code" else {}
            self.book.append({"cell_type": kind, "metadata": {}, "source": source} | more)

    def start_codeblock(self, _: object) -> None:
        self._cell("markdown")
        self.code = True

    def end_codeblock(self, _: object) -> None:
        self._cell("code")
        self.code = False

    def start_heading(self, level: int) -> None:
        self.buf += "#" * min(4, level) + " "

    def end_heading(self, _: object) -> None:
        self.buf += "\n\n"

    end_paragraph = end_heading

    def start_item(self, _: object) -> None:
        self.buf += "- "

    def end_item(self, _: object) -> None:
        self.buf += "\n"

    def end_image(self, url: str) -> None:
        self.buf += f"![{self.image}]({url})"

    def on_rule(self, _: object) -> None:
        self.buf += "\n---\n\n"

    def on_display(self, latex: str) -> None:
        self.buf += f"\n$$\n{latex}\n$$\n\n"

    def on_math(self, latex: str) -> None:
        self.buf += f"${latex}$"

    def on_code(self, text: str) -> None:
        self.buf += f"`{text}`"

    def on_hard(self, _: object) -> None:
        self.buf += "\n"

    def _table(self, e: Event) -> None:  # cells follow one another
        pass


def to_notebook(md: str) -> str:
    writer = NotebookWriter()
    writer.write(events(md))
    writer._cell("markdown")
    about = {"kernelspec": {"name": "python3", "display_name": "Python 3", "language": "python"}, "language_info": {"name": "python"}}
    return json.dumps({"nbformat": 4, "nbformat_minor": 5, "metadata": about, "cells": writer.book}, indent=2, ensure_ascii=False)


class HtmlWriter(Writer):
    """Mathematics is written as its source in a marked span; there is no renderer here."""

    marks = {"strong": ("<strong>", "</strong>"), "emphasis": ("<em>", "</em>"), "strike": ("<del>", "</del>")}

    def __init__(self, macros: dict[str, Macro] | None = None, images: dict[str, bytes] | None = None):
        super().__init__(macros)
        self.images = images or {}
        self.stack: list[str] = []
        self.marks = self.marks | {"paragraph": ("<p>", "</p>\n"), "item": ("<li>", "</li>\n"), "quote": ("<blockquote>\n", "</blockquote>\n")}

    def escape(self, text: str) -> str:
        return _html.escape(text, quote=False)

    def start_heading(self, level: int) -> None:
        self.buf += f"<h{level}>"

    def end_heading(self, level: int) -> None:
        self.buf += f"</h{level}>\n"

    def start_list(self, start: int | None) -> None:
        self.stack.append("ul" if start is None else "ol")
        self.buf += f"<{self.stack[-1]}{f' start={chr(34)}{start}{chr(34)}' if start not in (None, 1) else ''}>\n"

    def end_list(self, _: object) -> None:
        self.buf += f"</{self.stack.pop()}>\n"

    def start_codeblock(self, language: str | None) -> None:
        kind = f' class="language-{_html.escape(language.split()[0])}"' if language else ""
        self.buf += f"<pre><code{kind}>"
        self.put(self.take())
        self.code = True

    def end_codeblock(self, _: object) -> None:
        self.put(self.escape(self.take()) + "</code></pre>\n")
        self.code = False

    def start_link(self, url: str) -> None:
        self.buf += f'<a href="{_html.escape(url)}">'

    def end_link(self, _: object) -> None:
        self.buf += "</a>"

    def end_image(self, url: str) -> None:
        data = self.images.get(url)
        src = f"data:{mime_of(url)};base64,{base64.b64encode(data).decode()}" if data is not None else _html.escape(url)
        self.buf += f'<img src="{src}" alt="{_html.escape(self.image)}" />'

    def on_task(self, done: bool) -> None:
        self.buf += f'<input type="checkbox" disabled=""{" checked=" + chr(34) * 2 if done else ""} />\n'

    def on_html(self, raw: str) -> None:
        self.buf += raw

    def on_rule(self, _: object) -> None:
        self.buf += "<hr />\n"

    def on_math(self, latex: str) -> None:
        self.buf += f'<span class="math inline">{self.escape(latex)}</span>'

    def on_display(self, latex: str) -> None:
        self.buf += f'<span class="math display">{self.escape(latex)}</span>'

    def on_code(self, text: str) -> None:
        self.buf += f"<code>{self.escape(text)}</code>"

    def on_hard(self, _: object) -> None:
        self.buf += "<br />\n"

    def table(self, rows: list[list[str]]) -> str:
        told = lambda tag, row: "<tr>" + "".join(f"<{tag}>{c}</{tag}>" for c in row) + "</tr>\n"
        return f"<table><thead>{told('th', rows[0])}</thead><tbody>\n{''.join(told('td', r) for r in rows[1:])}</tbody></table>\n" if rows else ""


def to_html_body(md: str, images: dict[str, bytes] | None = None) -> str:
    writer = HtmlWriter(macros_of(md), images)
    return writer.write(events(md)) + writer.take()


def to_html(md: str, title: str = "", author: str = "", language: str = "en", images: dict[str, bytes] | None = None) -> str:
    """A page of its own: references resolved, local images inside, a footer with the author."""
    about = f'<meta name="author" content="{_html.escape(author)}">\n' if author else ""
    foot = f"<footer>{_html.escape(author)}</footer>\n" if author else ""
    style = "body{max-width:48em;margin:2em auto;padding:0 1em;line-height:1.5}pre{overflow:auto}table{border-collapse:collapse}th,td{border:1px solid;padding:.3em}"
    return f'<!DOCTYPE html>\n<html lang="{_html.escape(language)}">\n<head>\n<meta charset="utf-8">\n{about}<title>{_html.escape(title)}</title>\n<style>{style}</style>\n</head>\n<body>\n{to_html_body(resolve_references(md), images)}{foot}</body>\n</html>\n'


_MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp"}


def mime_of(path: str) -> str:
    return _MIME.get(path.rsplit(".", 1)[-1].lower(), "application/octet-stream")


def fit_width(width: int, height: int, most: int) -> tuple[int, int]:
    """At most so wide, the height in proportion, in whole numbers."""
    return (width, height) if width <= most or not width else (most, max(1, height * most // width))
