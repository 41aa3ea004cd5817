"""A small PDF writer: flat text in the standard fonts, with the document's data. Characters beyond Windows-1252 are shown as question marks."""

from __future__ import annotations

import zlib

from .export import Writer
from .latex import Macro, macros_of, to_unicode
from .markdown import events

_WIDTH, _HEIGHT, _MARGIN = 595, 842, 60
#: Mean width of a character, as a part of the font's size.
_MEAN = 0.5


class _Lines(Writer):
    """(text, font, size, indent) of each paragraph."""

    def __init__(self, macros: dict[str, Macro] | None = None):
        super().__init__(macros)
        self.found: list[tuple[str, str, int, int]] = []
        self.size = 11

    def flush(self) -> None:
        text = self.take().strip()
        if text:
            self.found.append((text, "F1", 11, 16 * self.depth))

    def end_paragraph(self, _: object) -> None:
        self.flush()

    def start_heading(self, _: object) -> None:
        self.flush()

    def end_heading(self, level: int) -> None:
        self.found.append((self.take().strip(), "F2", max(12, 24 - 3 * level), 0))

    def start_list(self, _: object) -> None:
        self.flush()
        self.depth += 1

    def end_list(self, _: object) -> None:
        self.depth -= 1

    def start_item(self, _: object) -> None:
        self.number += 1
        self.buf += f"{self.number}. " if self.ordered else "• "

    def end_item(self, _: object) -> None:
        self.flush()

    def start_codeblock(self, _: object) -> None:
        self.flush()
        self.code = True

    def end_codeblock(self, _: object) -> None:
        self.found += [(line, "F3", 9, 16) for line in self.take().rstrip("\n").split("\n")]
        self.code = False

    def end_image(self, _: object) -> None:
        self.buf += f"[{self.image}]"

    def on_math(self, latex: str) -> None:
        self.buf += to_unicode(latex, self.macros)

    on_display = on_math

    def on_code(self, text: str) -> None:
        self.buf += text

    def on_hard(self, _: object) -> None:
        self.flush()

    def on_rule(self, _: object) -> None:
        self.flush()
        self.found.append(("_" * 60, "F1", 11, 0))

    def table(self, rows: list[list[str]]) -> str:
        self.found += [("   ".join(r), "F2" if i == 0 else "F1", 10, 8) for i, r in enumerate(self.cells(rows))]
        return ""


def _wrapped(text: str, size: int, room: int) -> list[str]:
    most, out, line = max(8, int(room / (_MEAN * size))), [], ""
    for word in text.split(" "):
        while len(word) > most:
            out += [line] if line else []
            line, word = "", word[most:] if not out.append(word[:most]) else word
        if line and len(line) + 1 + len(word) > most:
            out.append(line)
            line = word
        else:
            line = f"{line} {word}" if line else word
    return [*out, line]


def _string(text: str) -> bytes:
    data = text.encode("cp1252", "replace")
    return b"(" + data.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b" ").replace(b"\n", b" ") + b")"


def to_pdf(md: str, title: str = "", author: str = "") -> bytes:
    """PDF 1.4; equations as Unicode."""
    writer = _Lines(macros_of(md))
    writer.write(events(md))
    writer.flush()
    pages: list[list[bytes]] = [[]]
    y = _HEIGHT - _MARGIN
    for text, font, size, indent in writer.found:
        for line in _wrapped(text, size, _WIDTH - 2 * _MARGIN - indent):
            if y < _MARGIN + size:
                pages.append([])
                y = _HEIGHT - _MARGIN
            y -= int(size * 1.35)
            pages[-1].append(b"BT /%s %d Tf %d %d Td %s Tj ET" % (font.encode(), size, _MARGIN + indent, y, _string(line)))
        y -= 5
    fonts = {"F1": "Times-Roman", "F2": "Helvetica-Bold", "F3": "Courier"}
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< " + b" ".join(b"/%s << /Type /Font /Subtype /Type1 /BaseFont /%s /Encoding /WinAnsiEncoding >>" % (k.encode(), v.encode()) for k, v in fonts.items()) + b" >>", b"<< /Title %s /Author %s /Producer (foliant) >>" % (_string(title), _string(author))]
    kids = []
    for page in pages:
        body = zlib.compress(b"\n".join(page))
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(body), body))
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Resources << /Font 3 0 R >> /Contents %d 0 R >>" % (_WIDTH, _HEIGHT, len(objects)))
        kids.append(b"%d 0 R" % len(objects))
    objects[1] = b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(kids), len(kids))
    out, places = b"%PDF-1.4\n", []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, body)
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R /Info 4 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table, len(objects) + 1, len(out))
