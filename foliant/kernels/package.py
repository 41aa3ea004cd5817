"""Markdown as packages: Word files that keep their source, OpenDocument texts and EPUB books."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterable
from functools import lru_cache

from .export import Writer, escape_xml, to_html_body
from .latex import Macro, macros_of, to_unicode
from .markdown import Event, events
from .office import AUTHOR, LATEX, SOURCE_ENTRY, source_xml

_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.styles+xml"/><Override PartName="/word/comments.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.comments+xml"/></Types>'


def _deflated(data: bytes) -> tuple[bytes, int]:
    packer = zlib.compressobj(zlib.Z_DEFAULT_COMPRESSION, zlib.DEFLATED, -15)
    return packer.compress(data) + packer.flush(), zlib.crc32(data)


#: Bytes of a part that may be remembered.
SMALL = 4096
#: Parts that all packages of a kind share are packed once.
_packed = lru_cache(64)(_deflated)


def _zipped(parts: Iterable[tuple[str, str | bytes]], stored: tuple[str, ...] = (), shared: tuple[str, ...] = ()) -> bytes:
    """A package whose bytes depend on its parts alone; those of ``shared`` names are mostly the same."""
    parts = [(name, body.encode("utf-8") if isinstance(body, str) else body) for name, body in parts]
    if sum(len(body) for _, body in parts) > 1 << 30 or not all(name.isascii() for name, _ in parts):
        return _zipped_by_library(parts, stored)
    out, ends, at = [], [], 0
    for name, body in parts:
        if name in stored:
            method, data, crc = 0, body, zlib.crc32(body)
        else:
            method, (data, crc) = 8, (_packed if name in shared and len(body) <= SMALL else _deflated)(body)
        label = name.encode("ascii")
        told = struct.pack("<HHHHHLLLHH", 20, 0, method, 0, 33, crc, len(data), len(body), len(label), 0)  # 1 January 1980
        out += [b"PK\3\4", told, label, data]
        ends += [b"PK\1\2\x14\3", told, struct.pack("<HHHLL", 0, 0, 0, 0o600 << 16, at), label]
        at += 30 + len(label) + len(data)
    ending = b"".join(ends)
    return b"".join([*out, ending, b"PK\5\6", struct.pack("<HHHHLLH", 0, 0, len(parts), len(parts), len(ending), at, 0)])


def _zipped_by_library(parts: Iterable[tuple[str, bytes]], stored: tuple[str, ...] = ()) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts:
            info = zipfile.ZipInfo(name)
            z.writestr(info, body, zipfile.ZIP_STORED if name in stored else zipfile.ZIP_DEFLATED)
    return out.getvalue()


class _Runs(Writer):
    """Writers of formatted runs: inline tags are states, and every text is a run in the present state."""

    def __init__(self, macros: dict[str, Macro] | None = None):
        super().__init__(macros)
        self.state = {"strong": 0, "emphasis": 0, "strike": 0}
        self.lists: list[bool] = []
        self.quotes = 0

    def write(self, found: Iterable[Event]) -> str:
        return super().write(self._states(found))

    def _states(self, found: Iterable[Event]) -> Iterable[Event]:
        for e in found:
            if e.tag in self.state and e.what in ("start", "end"):
                self.state[e.tag] += 1 if e.what == "start" else -1
            else:
                yield e

    def start_list(self, start: int | None) -> None:
        self.lists.append(start is not None)

    def end_list(self, _: object) -> None:
        self.lists.pop()

    def start_quote(self, _: object) -> None:
        self.quotes += 1

    def end_quote(self, _: object) -> None:
        self.quotes -= 1


class WordWriter(_Runs):
    """Paragraphs of runs; an equation is its Unicode form with a comment that holds its LaTeX."""

    def __init__(self, macros: dict[str, Macro] | None = None):
        super().__init__(macros)
        self.notes: list[str] = []
        self.links: list[str] = []

    def run(self, text: str, more: str = "") -> None:
        if not more and not any(self.state.values()):
            self.buf += f'<w:r><w:t xml:space="preserve">{escape_xml(text)}</w:t></w:r>'
            return
        props = "<w:b/>" * bool(self.state["strong"]) + "<w:i/>" * bool(self.state["emphasis"]) + "<w:strike/>" * bool(self.state["strike"]) + more
        self.buf += f'<w:r>{f"<w:rPr>{props}</w:rPr>" if props else ""}<w:t xml:space="preserve">{escape_xml(text)}</w:t></w:r>'

    def on_text(self, text: str) -> None:
        self.run(text)

    def paragraph(self, style: str = "", more: str = "") -> None:
        body = self.take()
        if body:
            props = (f'<w:pStyle w:val="{style}"/>' if style else "") + more
            self.put(f"<w:p>{f'<w:pPr>{props}</w:pPr>' if props else ''}{body}</w:p>")

    def flush(self) -> None:
        if self.lists:
            self.paragraph("ListParagraph", f'<w:numPr><w:ilvl w:val="{len(self.lists) - 1}"/><w:numId w:val="{2 if self.lists[-1] else 1}"/></w:numPr>')
        else:
            self.paragraph("Quote" if self.quotes else "")

    def start_list(self, start: int | None) -> None:
        if self.lists:
            self.flush()
        super().start_list(start)

    def end_paragraph(self, _: object) -> None:
        self.flush()

    def end_item(self, _: object) -> None:
        self.flush()

    def end_heading(self, level: int) -> None:
        self.paragraph(f"Heading{level}")

    def start_codeblock(self, _: object) -> None:
        self.flush()
        self.code = True

    def end_codeblock(self, _: object) -> None:
        text, self.code = self.take(), False
        for line in text.rstrip("\n").split("\n"):
            self.run(line, '<w:rFonts w:ascii="Courier New" w:hAnsi="Courier New"/>')
            self.paragraph("Code")

    def start_link(self, url: str) -> None:
        self.links.append(url)
        self.buf += f'<w:hyperlink r:id="rIdLink{len(self.links)}">'

    def end_link(self, _: object) -> None:
        self.buf += "</w:hyperlink>"

    def end_image(self, _: object) -> None:
        self.run(self.image or "")

    def equation(self, latex: str) -> None:
        n = len(self.notes)
        self.notes.append(latex)
        self.buf += f'<w:commentRangeStart w:id="{n}"/>'
        self.run(to_unicode(latex, self.macros), "<w:i/>" if not self.state["emphasis"] else "")
        self.buf += f'<w:commentRangeEnd w:id="{n}"/><w:r><w:commentReference w:id="{n}"/></w:r>'

    def on_math(self, latex: str) -> None:
        self.equation(latex)

    def on_display(self, latex: str) -> None:
        self.equation(latex.strip())

    def on_code(self, text: str) -> None:
        self.run(text, '<w:rFonts w:ascii="Courier New" w:hAnsi="Courier New"/>')

    def on_hard(self, _: object) -> None:
        self.buf += "<w:r><w:br/></w:r>"

    def on_soft(self, _: object) -> None:
        self.run(" ")

    def on_rule(self, _: object) -> None:
        self.put('<w:p><w:pPr><w:pBdr><w:bottom w:val="single" w:sz="6" w:space="1" w:color="auto"/></w:pBdr></w:pPr></w:p>')

    def table(self, rows: list[list[str]]) -> str:
        return "<w:tbl><w:tblPr/>" + "".join("<w:tr>" + "".join(f"<w:tc><w:p>{c}</w:p></w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"


def to_word(md: str, title: str = "", author: str = "") -> bytes:
    """A Word file that carries its Markdown: recover_word() gives exactly that back."""
    writer = WordWriter(macros_of(md))
    writer.write(events(md.replace("\0", "")))
    writer.flush()
    body = "".join(writer.out)
    document = f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_WORD}" xmlns:r="{_RELS}"><w:body>{body}<w:sectPr/></w:body></w:document>'
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="{s}"><w:name w:val="{n}"/><w:rPr><w:sz w:val="{z}"/></w:rPr></w:style>' for s, n, z in [(f"Heading{i}", f"heading {i}", 40 - 4 * i) for i in range(1, 7)] + [("ListParagraph", "List Paragraph", 24), ("Quote", "Quote", 24), ("Code", "Code", 20)])
    notes = "".join(f'<w:comment w:id="{i}" w:author="{AUTHOR}"><w:p><w:r><w:t xml:space="preserve">{escape_xml(LATEX + latex)}</w:t></w:r></w:p></w:comment>' for i, latex in enumerate(writer.notes))
    rels = f'<Relationship Id="rIdStyles" Type="{_RELS}/styles" Target="styles.xml"/><Relationship Id="rIdComments" Type="{_RELS}/comments" Target="comments.xml"/>' + "".join(f'<Relationship Id="rIdLink{i}" Type="{_RELS}/hyperlink" Target="{escape_xml(url)}" TargetMode="External"/>' for i, url in enumerate(writer.links, 1))
    package = "http://schemas.openxmlformats.org/package/2006/relationships"
    return _zipped(
        [
            ("[Content_Types].xml", _TYPES),
            ("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{package}"><Relationship Id="rId1" Type="{_RELS}/officeDocument" Target="word/document.xml"/></Relationships>'),
            ("word/document.xml", document),
            ("word/_rels/document.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{package}">{rels}</Relationships>'),
            ("word/styles.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:styles xmlns:w="{_WORD}">{styles}</w:styles>'),
            ("word/comments.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:comments xmlns:w="{_WORD}">{notes}</w:comments>'),
            (SOURCE_ENTRY, source_xml(md)),
        ],
        shared=("[Content_Types].xml", "_rels/.rels", "word/styles.xml", "word/_rels/document.xml.rels", "word/comments.xml"),
    )


class OpenDocumentWriter(_Runs):
    def on_text(self, text: str) -> None:
        name = "B" * bool(self.state["strong"]) + "I" * bool(self.state["emphasis"])
        self.buf += f'<text:span text:style-name="{name}">{escape_xml(text)}</text:span>' if name else escape_xml(text)

    def flush(self) -> None:
        text = self.take()
        self.put(f"<text:p>{text}</text:p>" if text else "")

    def start_list(self, start: int | None) -> None:
        self.flush()
        super().start_list(start)
        self.put("<text:list>")

    def end_list(self, start: object) -> None:
        super().end_list(start)
        self.put("</text:list>")

    def start_item(self, _: object) -> None:
        self.put("<text:list-item>")

    def end_item(self, _: object) -> None:
        self.flush()
        self.put("</text:list-item>")

    def end_paragraph(self, _: object) -> None:
        self.flush()

    def end_heading(self, level: int) -> None:
        self.put(f'<text:h text:outline-level="{level}">{self.take()}</text:h>')

    def start_codeblock(self, _: object) -> None:
        self.flush()
        self.code = True

    def end_codeblock(self, _: object) -> None:
        text, self.code = self.take(), False
        self.put("".join(f"<text:p>{escape_xml(line)}</text:p>" for line in text.rstrip("\n").split("\n")))

    def start_link(self, url: str) -> None:
        self.buf += f'<text:a xlink:href="{escape_xml(url)}">'

    def end_link(self, _: object) -> None:
        self.buf += "</text:a>"

    def end_image(self, _: object) -> None:
        self.on_text(self.image or "")

    def on_math(self, latex: str) -> None:
        self.buf += escape_xml(to_unicode(latex, self.macros))

    on_display = on_math

    def on_code(self, text: str) -> None:
        self.buf += escape_xml(text)

    def on_hard(self, _: object) -> None:
        self.buf += "<text:line-break/>"

    def on_rule(self, _: object) -> None:
        self.put("<text:p>────</text:p>")

    def table(self, rows: list[list[str]]) -> str:
        return "<table:table>" + "".join("<table:table-row>" + "".join(f"<table:table-cell><text:p>{c}</text:p></table:table-cell>" for c in r) + "</table:table-row>" for r in rows) + "</table:table>"


def to_opendocument(md: str, title: str = "", author: str = "") -> bytes:
    """An OpenDocument text; its type comes first and uncompressed."""
    writer = OpenDocumentWriter(macros_of(md))
    writer.write(events(md.replace("\0", "")))
    writer.flush()
    ns = "urn:oasis:names:tc:opendocument:xmlns"
    names = " ".join(f'xmlns:{p}="{ns}:{n}:1.0"' for p, n in (("office", "office"), ("text", "text"), ("table", "table"), ("style", "style"), ("fo", "xsl-fo-compatible"))) + ' xmlns:xlink="http://www.w3.org/1999/xlink"'
    bold, italic = 'fo:font-weight="bold"', 'fo:font-style="italic"'
    styles = "".join(f'<style:style style:name="{n}" style:family="text"><style:text-properties {p}/></style:style>' for n, p in (("B", bold), ("I", italic), ("BI", f"{bold} {italic}")))
    content = f'<?xml version="1.0" encoding="UTF-8"?><office:document-content {names} office:version="1.2"><office:automatic-styles>{styles}</office:automatic-styles><office:body><office:text>{"".join(writer.out)}</office:text></office:body></office:document-content>'
    kind = "application/vnd.oasis.opendocument.text"
    manifest = f'<?xml version="1.0" encoding="UTF-8"?><manifest:manifest xmlns:manifest="{ns}:manifest:1.0"><manifest:file-entry manifest:full-path="/" manifest:media-type="{kind}"/><manifest:file-entry manifest:full-path="content.xml" manifest:media-type="text/xml"/></manifest:manifest>'
    return _zipped([("mimetype", kind), ("content.xml", content), ("META-INF/manifest.xml", manifest)], ("mimetype",), ("META-INF/manifest.xml",))


def to_epub(md: str, title: str = "", author: str = "", language: str = "en") -> bytes:
    """An EPUB 3 book of one chapter."""
    body = to_html_body(md)
    name = escape_xml(title or "document")
    page = f'<?xml version="1.0" encoding="UTF-8"?><html xmlns="http://www.w3.org/1999/xhtml"><head><title>{name}</title></head><body>{body}</body></html>'
    nav = f'<?xml version="1.0" encoding="UTF-8"?><html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{name}</title></head><body><nav epub:type="toc"><ol><li><a href="chapter.xhtml">{name}</a></li></ol></nav></body></html>'
    opf = f'<?xml version="1.0" encoding="UTF-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{name}</dc:identifier><dc:title>{name}</dc:title><dc:creator>{escape_xml(author)}</dc:creator><dc:language>{language}</dc:language></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="chapter" href="chapter.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="chapter"/></spine></package>'
    container = '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
    return _zipped([("mimetype", "application/epub+zip"), ("META-INF/container.xml", container), ("OEBPS/content.opf", opf), ("OEBPS/nav.xhtml", nav), ("OEBPS/chapter.xhtml", page)], ("mimetype",), ("META-INF/container.xml",))
