"""LaTeX to Markdown: one scanner for whole documents and for the fragments in arguments."""

from __future__ import annotations

import re
import unicodedata

from .text import collapse_blank_lines, lines_of

_MACRO = ("\\newcommand", "\\renewcommand", "\\providecommand", "\\def")
#: What a document's macros are kept in, a comment that renderers read.
MACROS_OPEN = "<!-- latex-macros\n"
_HEADINGS = {"section": "\n## {}\n\n", "subsection": "\n### {}\n\n", "subsubsection": "\n#### {}\n\n", "paragraph": "\n##### {}\n\n", "chapter": "\n# {}\n\n", "author": "*{}*\n\n", "date": "*{}*\n\n"}
_DISPLAY = {f"{n}{s}" for n in ("equation", "align", "gather", "multline") for s in ("", "*")}
_LITERAL = {"verbatim", "lstlisting", "minted", "alltt"}
_QUOTES = {"quote", "quotation", "displayquote"}
_PASSED = set("center flushleft flushright minipage multicols column columns frame block alertblock exampleblock theorem lemma proof corollary definition remark example exercise solution".split())
_WITH_ARGUMENT = set("end index vspace hspace vskip hskip setlength addtolength".split())
_SILENT = set("maketitle tableofcontents listoffigures listoftables noindent indent par item".split())
_BREAKS = {"newline": "  \n", "linebreak": "  \n", "newpage": "\n---\n\n", "clearpage": "\n---\n\n", "cleardoublepage": "\n---\n\n"}
_WRAPS = {w: ("**", "**") for w in ("textbf", "mathbf", "textsc")} | {w: ("*", "*") for w in ("textit", "emph", "textsl")} | {"underline": ("<u>", "</u>"), "textsuperscript": ("<sup>", "</sup>"), "textsubscript": ("<sub>", "</sub>")}
_CITES = set("cite citep citet citeauthor citeyear citealt citealp citenum Citep Citet".split())
_REFS = set("ref eqref autoref cref Cref pageref label vref nameref".split())
_WORDS = {"LaTeX": "LaTeX", "TeX": "TeX", "dots": "…", "ldots": "…", "cdots": "…", "textbackslash": "\\", "textquotedblleft": "“", "textquotedblright": "”"}
# Letters by command.
_LETTERS = {"l": "ł", "L": "Ł", "o": "ø", "O": "Ø", "ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "aa": "å", "AA": "Å", "i": "ı", "j": "ȷ"}
# Accents, their combining marks and the letters that take them.
_ACCENTS = {"'": ("́", "aeiouycnszAEIOU"), "`": ("̀", "aeiouAEO"), "^": ("̂", "aeiouAEO"), '"': ("̈", "aeiouyAOU"), "~": ("̃", "anoANO"), "c": ("̧", "cC")}
_WORD = re.compile(r"([A-Za-z]+)[ \t*]*")
_PLAIN = re.compile(r"[^\\${}%]+")
_FRAGMENT_PLAIN = re.compile(r"[^\\${}]+")


def preamble_macros(text: str) -> str:
    return "\n".join(x.rstrip() for x in lines_of(text) if x.lstrip().startswith(_MACRO)).rstrip()


def join_math_lines(latex: str) -> str:
    """Line ends inside inline mathematics, with the blanks around them, become one space (none at the begin)."""
    out = re.sub(r"[ \t]*[\r\n][ \t\r\n]*", " ", latex)
    return out.lstrip(" ") if latex[:1] in "\r\n" or re.match(r"[ \t]+[\r\n]", latex) else out


def accented(accent: str, base: str) -> str | None:
    mark, letters = _ACCENTS.get(accent, ("", ""))
    return unicodedata.normalize("NFC", base + mark) if base and base in letters else None


def ligatures(text: str) -> str:
    for mark, char in (("---", "—"), ("--", "–"), ("``", "“"), ("''", "”")):
        text = text.replace(mark, char)
    return text


class _Reader:
    """A place in a source, and what may be read there."""

    def __init__(self, src: str):
        self.src, self.at, self.out = src, 0, []

    def braced(self) -> str:
        """The argument in braces that follows, if one does."""
        found = re.compile(r"[ \n\t]*").match(self.src, self.at)
        self.at = found.end()
        if self.src[self.at : self.at + 1] != "{":
            return ""
        begin = self.at + 1
        depth = 1
        for m in re.compile(r"[{}]").finditer(self.src, begin):
            depth += 1 if m[0] == "{" else -1
            if not depth:
                self.at = m.end()
                return self.src[begin : m.start()]
        self.at = len(self.src)
        return self.src[begin : max(begin, len(self.src) - 1)]

    def skip(self, opener: str, closer: str) -> None:
        """An optional argument that follows right here is passed over."""
        if self.src[self.at : self.at + 1] == opener:
            end = self.src.find(closer, self.at)
            self.at = len(self.src) if end == -1 else end + 1

    def until(self, end: str) -> str:
        at = self.src.find(end, self.at)
        body = self.src[self.at : at] if at != -1 else self.src[self.at :]
        self.at = at + len(end) if at != -1 else len(self.src)
        return body

    def dollars(self) -> str:
        """Mathematics between dollars, the first of which is here."""
        if self.src.startswith("$$", self.at):
            self.at += 2
            return f"\n$$\n{self.until('$$').strip()}\n$$\n\n"
        self.at += 1
        return f"${join_math_lines(self.until('$'))}$"

    def word(self) -> str:
        found = _WORD.match(self.src, self.at)
        self.at = found.end()
        return found[1]

    def inline_word(self, word: str) -> str:
        if word in _WRAPS:
            before, after = _WRAPS[word]
            return f"{before}{fragment_to_md(self.braced())}{after}"
        if word == "texttt":
            return f"`{self.braced()}`"
        if word == "href":
            url = self.braced()
            return f"[{fragment_to_md(self.braced())}]({url})"
        if word == "url":
            return f"<{self.braced()}>"
        if word == "footnote":
            return f" [^{self.braced()[:20]}]"
        if word in _CITES or word in _REFS:
            while word in _CITES and self.src[self.at : self.at + 1] == "[":
                self.skip("[", "]")
            self.braced()
            return ""
        if word in _WORDS or word in _LETTERS:
            return _WORDS.get(word) or _LETTERS[word]
        braced = self.src[self.at : self.at + 1] == "{"
        if word in "cvuHrdbk" and len(word) == 1:
            base = self.braced() if braced else ""
            return (accented(word, base[0]) or base) if base else ""
        return fragment_to_md(self.braced()) if braced else ""

    def symbol(self) -> str:
        """What a backslash and the character here (no letter) stand for."""
        char = self.src[self.at]
        self.at += 1
        if char == "\\":
            return "  \n"
        if char in "'`^\"":
            self.at = re.compile(r"[ \t\n]*").match(self.src, self.at).end()
            if self.at >= len(self.src):
                return ""
            if self.src[self.at] == "{":
                base = self.braced()[:1]
            else:
                base = self.src[self.at]
                self.at += 1
            return accented(char, base) or base
        return " " if char in "~ ,;!.:" else char


def fragment_to_md(text: str) -> str:
    r = _Reader(text)
    while r.at < len(text):
        if plain := _FRAGMENT_PLAIN.match(text, r.at):
            r.out.append(plain[0])
            r.at = plain.end()
        elif text[r.at] == "$":
            r.out.append(r.dollars())
        elif text[r.at] in "{}":
            r.at += 1
        else:
            r.at += 1
            if r.at < len(text):
                r.out.append(r.inline_word(r.word()) if text[r.at].isascii() and text[r.at].isalpha() else r.symbol())
    return ligatures("".join(r.out))


def _flat(text: str) -> str:
    return " ".join(fragment_to_md(text).split())


def _quoted(body: str) -> str:
    return "".join(f"> {line}\n>\n" for line in map(_flat, body.split("\n\n")) if line) + "\n"


def list_to_md(body: str, ordered: bool) -> str:
    out = []
    for part in body.split("\\item"):
        part = part.strip()
        if part.startswith("[") and "]" in part:
            part = part[part.index("]") + 1 :].strip()
        line = _flat(part)
        if line:
            out.append(f"{len(out) + 1}. {line}\n" if ordered else f"- {line}\n")
    return "".join(out) + "\n"


def argument_of(body: str, command: str) -> str:
    """The argument of a command's first use."""
    at = body.find(f"\\{command}")
    if at == -1:
        return ""
    r = _Reader(body)
    r.at = at + len(command) + 1
    r.skip("[", "]")
    return r.braced()


def _environment(r: _Reader) -> str:
    name = r.braced().strip()
    r.skip("[", "]")
    end = f"\\end{{{name}}}"
    if name in _DISPLAY:
        return f"\n$$\n{r.until(end).strip()}\n$$\n\n"
    if name in ("itemize", "enumerate"):
        return list_to_md(r.until(end), name == "enumerate")
    if name in _LITERAL:
        return f"\n```\n{r.until(end).strip()}\n```\n\n"
    if name == "abstract":
        return "\n> **Abstract**\n>\n" + _quoted(r.until(end))
    if name in _QUOTES:
        return _quoted(r.until(end))
    if name in ("figure", "figure*", "wrapfigure"):
        body = r.until(end)
        image = argument_of(body, "includegraphics")
        return f"\n![{fragment_to_md(argument_of(body, 'caption')).strip()}]({image})\n\n" if image else ""
    if name in ("table", "table*"):
        caption = fragment_to_md(argument_of(r.until(end), "caption")).strip()
        return f"\n*Table: {caption}*\n\n" if caption else ""
    if name in _PASSED:
        r.skip("[", "]")
        r.skip("{", "}")
    elif name != "document":
        r.until(end)
    return ""


def _command(r: _Reader, word: str) -> str:
    if word == "title":
        end = "".join(r.out[-2:])[-2:]
        gap = "" if not r.out or end == "\n\n" else "\n" if end.endswith("\n") else "\n\n"
        return f"{gap}# {r.braced()}\n\n"
    if word in _HEADINGS:
        return _HEADINGS[word].format(r.braced())
    if word == "includegraphics":
        r.skip("[", "]")
        return f"\n![]({r.braced()})\n\n"
    if word == "begin":
        return _environment(r)
    if word in _WITH_ARGUMENT:
        r.braced()
        return ""
    if word in _SILENT:
        return ""
    return _BREAKS[word] if word in _BREAKS else r.inline_word(word)


def tex_to_md(text: str) -> str:
    """The body of a document; macros of its preamble go along in a comment. Unknown environments are dropped."""
    macros = preamble_macros(text)
    src = text.split("\\begin{document}", 1)[-1]
    src = src.split("\\end{document}", 1)[0]
    r = _Reader(src)
    if macros:
        r.out.append(f"{MACROS_OPEN}{macros}\n-->\n\n")
    while r.at < len(src):
        char = src[r.at]
        if plain := _PLAIN.match(src, r.at):
            r.out.append(plain[0])
            r.at = plain.end()
        elif char == "%":
            end = src.find("\n", r.at)
            r.at = len(src) if end == -1 else end
        elif char == "$":
            r.out.append(r.dollars())
        elif char in "{}":
            r.at += 1
        else:
            r.at += 1
            if r.at >= len(src):
                break
            following = src[r.at]
            if following.isascii() and following.isalpha():
                r.out.append(_command(r, r.word()))
            elif following in "[(":
                r.at += 1
                close = "\\]" if following == "[" else "\\)"
                if src.find(close, r.at) != -1:
                    latex = r.until(close).strip()
                    r.out.append(f"\n$$\n{latex}\n$$\n\n" if following == "[" else f"${join_math_lines(latex)}$")
            else:
                r.out.append(r.symbol())
    return collapse_blank_lines("".join(r.out))
