"""Packages of XML parts: Word, OpenDocument, EPUB and PowerPoint files to Markdown; RTF; and what Word files carry beside their text."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from typing import NamedTuple
from xml.etree import ElementTree

from . import omml
from .html import html_to_md
from .text import collapse_blank_lines, decode_entities, xml_attribute

#: Bytes of one part of a package that are read; what a part has beyond is left.
MOST = 128 << 20
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: What our own Word files keep their Markdown in, whom their comments are from, and how these begin.
SOURCE_ENTRY, AUTHOR, LATEX = "markdown-source.xml", "foliant", "LaTeX: "


def part(package: zipfile.ZipFile, name: str, most: int = MOST) -> str | None:
    """The text of a part, cut off at ``most`` bytes; None without that part."""
    try:
        with package.open(name) as f:
            return f.read(most).decode("utf-8", "replace")
    except KeyError:
        return None


class Seg(NamedTuple):
    text: str
    bold: bool = False
    italic: bool = False


def render(segs: list[Seg]) -> str:
    """Neighbours of equal format as one; emphasis marks stand inside the white space at the ends."""
    joined: list[Seg] = []
    for seg in segs:
        if joined and joined[-1][1:] == seg[1:]:
            joined[-1] = Seg(joined[-1].text + seg.text, *seg[1:])
        else:
            joined.append(seg)
    out = []
    for text, bold, italic in joined:
        mark = "**" * bold + "*" * italic
        core = text.strip()
        if not mark or not core:
            out.append(text)
            continue
        begin = len(text) - len(text.lstrip())
        end = len(text.rstrip())
        out.append(f"{text[:begin]}{mark}{core}{mark[::-1]}{text[end:]}")
    return "".join(out)


def cell(text: str) -> str:
    return re.sub(r"[\r\n]", " ", text).replace("|", "\\|").strip()


def gfm_table(rows: list[list[str]]) -> str:
    """A pipe table, padded to the widest row."""
    width = max(map(len, rows), default=0)
    if not width:
        return ""
    told = [f"| {' | '.join([cell(c) for c in r] + [''] * (width - len(r)))} |\n" for r in rows]
    return "".join([told[0], "|" + " --- |" * width + "\n", *told[1:]])


class _Page:
    """Markdown that grows block by block."""

    def __init__(self) -> None:
        self.md = ""

    def block(self, text: str) -> None:
        if self.md and not self.md.endswith("\n\n"):
            self.md += "\n" if self.md.endswith("\n") else "\n\n"
        self.md += text

    def done(self, kind: str) -> str:
        out = re.sub("\n{3,}", "\n\n", self.md).rstrip() + "\n"
        if not out.strip():
            raise ValueError(f"a {kind} file without text")
        return out


# ---------------------------------------------------------------- Word


def relationships(xml: str | None) -> dict[str, str]:
    return {} if not xml else {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(xml) if e.get("Id") and e.get("Target")}


def _heading(style: str) -> int:
    low = style.lower()
    if low == "title":
        return 1
    return min(6, max(1, int(low[-1]))) if low.startswith("heading") and low[-1].isdigit() else 0


def _on(props, name: str) -> bool:
    found = None if props is None else props.find(f"{W}{name}")
    return found is not None and found.get(f"{W}val") not in ("false", "0", "off")


class _Word:
    def __init__(self, rels: dict[str, str]):
        self.rels, self.page = rels, _Page()

    def segs(self, e) -> list[Seg]:
        """The inline content below an element."""
        out: list[Seg] = []
        for child in e:
            tag = child.tag
            if tag == f"{W}r":
                props = child.find(f"{W}rPr")
                bold, italic = _on(props, "b"), _on(props, "i")
                for piece in child:
                    if piece.tag == f"{W}t" and piece.text:
                        out.append(Seg(piece.text, bold, italic))
                    elif piece.tag == f"{W}br":
                        out.append(Seg("  \n"))
                    elif piece.tag == f"{W}tab":
                        out.append(Seg(" "))
            elif tag == f"{W}hyperlink":
                text, url = render(self.segs(child)).strip(), self.rels.get(child.get(_REL) or "")
                if text:
                    out.append(Seg(f"[{text}]({url})" if url else text))
            elif tag == f"{omml.M}oMathPara":
                out.append(Seg("\n$$\n" + "".join(omml.to_latex(m) for m in child.iter(f"{omml.M}oMath")).strip() + "\n$$\n"))
            elif tag == f"{omml.M}oMath":
                out.append(Seg(f"${omml.to_latex(child).strip()}$"))
            elif tag not in (f"{W}pPr", f"{W}del"):
                out += self.segs(child)
        return out

    def paragraph(self, p) -> None:
        props = p.find(f"{W}pPr")
        style = "" if props is None or props.find(f"{W}pStyle") is None else props.find(f"{W}pStyle").get(f"{W}val") or ""
        text = render(self.segs(p)).strip()
        if not text:
            return
        if level := _heading(style):
            self.page.block(f"{'#' * level} {text}\n\n")
        elif props is not None and props.find(f"{W}numPr") is not None:
            self.page.md += f"- {text}\n"
        else:
            self.page.block(f"{text}\n\n")

    def blocks(self, body) -> None:
        for e in body:
            if e.tag == f"{W}p":
                self.paragraph(e)
            elif e.tag == f"{W}tbl":
                rows = [[render([s for p in c.iter(f"{W}p") for s in [*self.segs(p), Seg(" ")]]).strip() for c in r.findall(f"{W}tc")] for r in e.iter(f"{W}tr")]
                self.page.block(gfm_table(rows) + "\n")
            else:
                self.blocks(e)


def word_to_md(data: bytes) -> str:
    """Titles and headings, bold and italic, links, lists (all with bullets), tables and mathematics."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        xml = part(z, "word/document.xml")
        if xml is None:
            raise ValueError("a Word file without a document")
        word = _Word(relationships(part(z, "word/_rels/document.xml.rels")))
    word.blocks(ElementTree.fromstring(xml))
    return word.page.done("Word")


def source_xml(md: str) -> str:
    """The entry that keeps a Word file's Markdown."""
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<source format="markdown/commonmark"><content><![CDATA[{md.replace("]]>", "]]]]><![CDATA[>")}]]></content></source>\n'


def parse_source_xml(xml: str) -> str | None:
    found = re.search(r"<content><!\[CDATA\[(.*)\]\]></content>", xml, re.S)
    return found[1].replace("]]]]><![CDATA[>", "]]>") if found else None


def comments(xml: str | None) -> list[tuple[str, str, str, str]]:
    """(id, author, date, text) of each comment."""
    return [] if not xml else [(c.get(f"{W}id") or "", c.get(f"{W}author") or "Unknown", c.get(f"{W}date") or "", "".join(t.text or "" for t in c.iter(f"{W}t"))) for c in ElementTree.fromstring(xml).iter(f"{W}comment")]


def recover_word(data: bytes) -> tuple[str, bool]:
    """The Markdown of a Word file, and whether it is exactly what was exported.

    First the source that our own files carry; then the text with the equations of our own comments, in their places; then any Word file's
    text. What is not exact begins with a comment that says so.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        kept = part(z, SOURCE_ENTRY)
        if kept is not None and (md := parse_source_xml(kept)) is not None:
            return md, True
        own = {i: text.removeprefix(LATEX) for i, author, _, text in comments(part(z, "word/comments.xml")) if author == AUTHOR and text.startswith(LATEX)}
        xml, names = part(z, "word/document.xml"), sorted(n for n in z.namelist() if n.startswith("word/media/"))
        images = [] if own else [latex for n in names if (latex := latex_of_image(z.read(n), n))]
    if xml is None:
        raise ValueError("a Word file without a document")
    note = "<!-- rebuilt from the document: not the exact source -->\n\n"
    if not own and not images:
        return note + word_to_md(data), False
    out = _Page()
    for p in ElementTree.fromstring(xml).iter(f"{W}p"):
        style = p.find(f"{W}pPr/{W}pStyle")
        level = min(3, _heading(style.get(f"{W}val") or "")) if style is not None else 0
        text = "".join(t.text or "" for t in p.iter(f"{W}t")).strip()
        found = [own[r.get(f"{W}id")] for r in p.iter(f"{W}commentReference") if r.get(f"{W}id") in own]
        if text and not (found and text in found):
            out.block(f"{'#' * level} {text}\n\n" if level else f"{text}\n\n")
        for latex in found:
            out.block(f"$$\n{latex}\n$$\n\n")
    for latex in images:
        out.block(f"$$\n{latex}\n$$\n\n")
    return note + out.done("Word"), False


class Review(NamedTuple):
    kind: str
    author: str
    date: str
    text: str
    context: str


def review_items(data: bytes) -> list[Review]:
    """Tracked insertions, then deletions, then comments of people with the text that they are about."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        xml, notes = part(z, "word/document.xml"), comments(part(z, "word/comments.xml"))
    if xml is None:
        raise ValueError("a Word file without a document")
    root, out = ElementTree.fromstring(xml), []
    for kind, tag, words in (("insertion", "ins", "t"), ("deletion", "del", "delText")):
        for e in root.iter(f"{W}{tag}"):
            text = "".join(t.text or "" for t in e.iter(f"{W}{words}"))
            if text.strip():
                out.append(Review(kind, e.get(f"{W}author") or "Unknown", e.get(f"{W}date") or "", text, ""))
    anchors = _anchors(root)
    return out + [Review("comment", author, date, text, anchors.get(i, "")) for i, author, date, text in notes if author != AUTHOR and not text.startswith(LATEX) and text.strip()]


def _anchors(root) -> dict[str, str]:
    """Comment id -> the text between its range marks."""
    open_: dict[str, list[str]] = {}
    found: dict[str, str] = {}
    for e in root.iter():
        if e.tag == f"{W}commentRangeStart":
            open_[e.get(f"{W}id") or ""] = []
        elif e.tag == f"{W}commentRangeEnd" and (e.get(f"{W}id") or "") in open_:
            found[e.get(f"{W}id") or ""] = "".join(open_.pop(e.get(f"{W}id") or ""))
        elif e.tag == f"{W}t":
            for texts in open_.values():
                texts.append(e.text or "")
    return found


# ---------------------------------------------------------------- equations in images

_PNG, _KEYWORD = b"\x89PNG\r\n\x1a\n", b"latex-source"
_SVG_OPEN, _SVG_CLOSE = '<metadata xmlns:f="urn:foliant:latex"><f:latex><![CDATA[', "]]></f:latex></metadata>"


def embed_in_png(png: bytes, latex: str) -> bytes:
    """The image with the source in a text chunk right behind its header; other bytes as they are."""
    if len(png) < 33 or not png.startswith(_PNG):
        return png
    body = b"tEXt" + _KEYWORD + b"\0" + latex.encode()
    return png[:33] + struct.pack(">I", len(body) - 4) + body + struct.pack(">I", zlib.crc32(body)) + png[33:]


def extract_from_png(png: bytes) -> str | None:
    at = 8
    while png.startswith(_PNG) and at + 12 <= len(png):
        size, kind = struct.unpack(">I", png[at : at + 4])[0], png[at + 4 : at + 8]
        if at + 12 + size > len(png) or kind == b"IEND":
            break
        key, zero, latex = png[at + 8 : at + 8 + size].partition(b"\0")
        if kind == b"tEXt" and zero and key == _KEYWORD:
            return latex.decode("utf-8", "replace")
        at += 12 + size
    return None


def embed_in_svg(svg: str, latex: str) -> str:
    end = svg.find(">")
    return svg if end == -1 else svg[: end + 1] + _SVG_OPEN + latex.replace("]]>", "]]]]><![CDATA[>") + _SVG_CLOSE + svg[end + 1 :]


def extract_from_svg(svg: str) -> str | None:
    begin = svg.find(_SVG_OPEN)
    end = svg.find(_SVG_CLOSE, begin)
    return None if begin == -1 or end == -1 else svg[begin + len(_SVG_OPEN) : end].replace("]]]]><![CDATA[>", "]]>")


def latex_of_image(data: bytes, name: str) -> str | None:
    return extract_from_svg(data.decode("utf-8", "replace")) if name.lower().endswith(".svg") else extract_from_png(data)


# ---------------------------------------------------------------- OpenDocument

_T, _S, _FO, _TABLE, _X = (f"{{urn:oasis:names:tc:opendocument:xmlns:{n}:1.0}}" for n in ("text", "style", "xsl-fo-compatible", "table", "xlink"))


class _OpenDocument:
    def __init__(self, root):
        self.page, self.styles = _Page(), {}
        for style in root.iter(f"{_S}style"):
            props = style.find(f"{_S}text-properties")
            if props is not None:
                self.styles[style.get(f"{_S}name")] = (props.get(f"{_FO}font-weight") in ("bold", "bolder"), props.get(f"{_FO}font-style") in ("italic", "oblique"))

    def segs(self, e, bold: bool = False, italic: bool = False) -> list[Seg]:
        out = [Seg(e.text, bold, italic)] if e.text else []
        for child in e:
            if child.tag == f"{_T}span":
                b, i = self.styles.get(child.get(f"{_T}style-name"), (False, False))
                out += self.segs(child, bold or b, italic or i)
            elif child.tag in (f"{_T}s", f"{_T}tab"):
                out.append(Seg(" "))
            elif child.tag == f"{_T}line-break":
                out.append(Seg("  \n"))
            else:
                out += self.segs(child, bold, italic)
            out += [Seg(child.tail, bold, italic)] if child.tail else []
        return out

    def blocks(self, body, depth: int = 0) -> None:
        for e in body:
            if e.tag == f"{_T}h":
                level = e.get(f"{_T}outline-level") or "1"
                text = render(self.segs(e)).strip()
                if text:
                    self.page.block(f"{'#' * min(6, max(1, int(level) if level.isdigit() else 1))} {text}\n\n")
            elif e.tag == f"{_T}p":
                text = render(self.segs(e)).strip()
                if text and depth:
                    self.page.md += f"{'  ' * (depth - 1)}- {text}\n"
                elif text:
                    self.page.block(f"{text}\n\n")
            elif e.tag == f"{_TABLE}table":
                rows = [[render([s for p in c.iter(f"{_T}p") for s in [*self.segs(p), Seg(" ")]]).strip() for c in r.findall(f"{_TABLE}table-cell")] for r in e.iter(f"{_TABLE}table-row")]
                self.page.block(gfm_table(rows) + "\n")
            else:
                self.blocks(e, depth + (e.tag == f"{_T}list"))


def opendocument_to_md(data: bytes) -> str:
    """Headings by outline level, styles that are bold or italic, nested lists and tables."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        xml = part(z, "content.xml")
    if xml is None:
        raise ValueError("an OpenDocument file without content")
    root = ElementTree.fromstring(re.sub(r'="urn:oasis:names:tc:opendocument:xmlns:xsl-fo-compatible:1\.0"', '="urn:oasis:names:tc:opendocument:xmlns:xsl-fo-compatible:1.0"', xml))
    doc = _OpenDocument(root)
    body = root.find(".//{urn:oasis:names:tc:opendocument:xmlns:office:1.0}body")
    doc.blocks(root if body is None else body)
    return doc.page.done("OpenDocument")


# ---------------------------------------------------------------- EPUB and PowerPoint


def _normal(path: str) -> str:
    parts: list[str] = []
    for p in path.split("/"):
        if p == "..":
            parts[-1:] = []
        elif p not in ("", "."):
            parts.append(p)
    return "/".join(parts)


def epub_to_md(data: bytes) -> str:
    """Chapters in the order of the spine, with rules between them."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        container = part(z, "META-INF/container.xml")
        opf_path = xml_attribute(container, "full-path") if container else None
        opf = part(z, opf_path) if opf_path else None
        if opf is None:
            raise ValueError("an EPUB file without a package document")
        items = [m[0] for m in re.finditer(r"<item [^>]*", opf)]
        hrefs = {xml_attribute(i, "id"): xml_attribute(i, "href") for i in items if "html" in (xml_attribute(i, "media-type") or "") or (xml_attribute(i, "href") or "").endswith((".xhtml", ".html", ".htm"))}
        spine = re.search(r"<spine.*?(?:</spine>|\Z)", opf, re.S)
        folder = opf_path.rpartition("/")[0]
        chapters = []
        for ref in re.findall(r"<itemref [^>]*", spine[0] if spine else ""):
            href = hrefs.get(xml_attribute(ref, "idref"))
            page = part(z, _normal(f"{folder}/{href}") if folder else href) if href else None
            md = html_to_md(page).strip() if page else ""
            chapters += [md] if md else []
    if not chapters:
        raise ValueError("an EPUB file without chapters")
    return "\n\n---\n\n".join(chapters) + "\n"


_SLIDE = re.compile(r"ppt/slides/slide([0-9]*)\.xml$")


def slide_text(xml: str) -> tuple[str, list[str]]:
    """Title and other texts of a slide; only shapes from the first placeholder of theirs on count."""
    title, texts, kind, inside, text = "", [], "", False, ""
    for m in re.finditer(r"<(/?)((?:[^\W_]|:)+)([^>]*)>([^<]*)", xml):
        closing, name = m[1] == "/", m[2].lower()
        if name == "p:ph":
            kind, inside = xml_attribute(m[3], "type") or "", True
        elif name == "a:t" and not closing and inside:
            text += decode_entities(m[4])
        elif name == "a:p" and closing and text.strip():
            text += "\n"
        elif name == "p:sp" and closing:
            if text.strip() and kind in ("title", "ctrTitle"):
                title = text.strip()
            elif text.strip():
                texts.append(text.strip())
            text, inside = "", False
    return title, texts


def slides_to_md(data: bytes) -> str:
    """Slides in numeric order, each with its title and bullets."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted((n for n in z.namelist() if _SLIDE.match(n)), key=lambda n: int(_SLIDE.match(n)[1] or 0))
        for i, name in enumerate(names, 1):
            title, texts = slide_text(part(z, name) or "")
            out.append(f"## Slide {i}{f': {title}' if title else ''}\n\n")
            out += [f"- {t}\n" if len(texts) > 1 else f"{t}\n\n" for t in texts]
            out.append("\n")
    return collapse_blank_lines("".join(out))


# ---------------------------------------------------------------- RTF

_RTF = re.compile(r"([{}])|\\([A-Za-z]+)(-?[0-9]*) ?|\\'([0-9A-Fa-f]{2})|\\(.)|[\r\n]+|([^{}\\\r\n]+)", re.S)
_RTF_WORDS = {"par": "\n\n", "pard": "\n\n", "line": "\n", "tab": "\t", "bullet": "- ", "sect": "\n---\n\n", "page": "\n---\n\n"}
_RTF_BYTES = {0x85: "…", 0x91: "‘", 0x92: "’", 0x93: '"', 0x94: '"', 0x96: "-", 0x97: "-"}
_RTF_SYMBOLS = {"\\": "\\", "{": "{", "}": "}", "_": " ", "~": " ", "\n": "\n", "\r": "\n"}


def rtf_to_md(text: str) -> str:
    """Text outside inner groups, bold and italic, paragraphs, line ends, bullets and breaks. Characters beyond ASCII are read byte by byte."""
    out, depth, skipped, marks = [], 0, 0, {"b": False, "i": False}
    shown = lambda: depth <= 1 and not skipped
    for m in _RTF.finditer(text):
        if m[1] == "{":
            depth += 1
        elif m[1]:
            skipped = 0 if skipped and depth <= skipped else skipped
            depth -= 1
        elif m[2]:
            if skipped:
                continue
            if m[2] in marks:
                on = m[3] != "0"
                if on != marks[m[2]]:
                    marks[m[2]] = on
                    out += ["**" if m[2] == "b" else "*"] if depth <= 1 else []
            elif m[2] in _RTF_WORDS and depth <= 1:
                out.append(_RTF_WORDS[m[2]])
        elif m[4]:
            byte = int(m[4], 16)
            if shown():
                out.append(chr(byte) if 0x20 <= byte <= 0x7E else _RTF_BYTES.get(byte, ""))
        elif m[5] == "*":
            skipped = depth
        elif m[5]:
            out += [_RTF_SYMBOLS.get(m[5], "")] if shown() else []
        elif m[6] and shown():
            out.append(m[6].encode("utf-8", "surrogatepass").decode("latin-1"))
    return collapse_blank_lines("".join(out))
