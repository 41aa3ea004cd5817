"""Bytes to text: byte order marks, UTF-8, else Windows-1252; and texts that were decoded wrongly before."""

from __future__ import annotations

import re

_UNDEFINED = {0x81, 0x8D, 0x8F, 0x90, 0x9D}
#: Windows-1252 by byte; its five undefined bytes stand for the control codes of their number.
CP1252 = [chr(b) if b in _UNDEFINED else bytes([b]).decode("cp1252") for b in range(256)]
_BYTE = {c: b for b, c in enumerate(CP1252) if b not in _UNDEFINED}
_LEADS, _FOLLOWERS = "ÂÃÎÏâ", "".join(map(chr, range(0x80, 0xC0))) + "".join(c for b, c in enumerate(CP1252[0x80:0xA0], 0x80) if b not in _UNDEFINED and c not in "˜Žžź" + "Ÿ")
_SUSPECT = re.compile(f"[{_LEADS}](?=[{re.escape(_FOLLOWERS)}])")


def decode_bytes(data: bytes) -> str:
    if data.startswith(b"\xef\xbb\xbf"):
        return data[3:].decode("utf-8", "replace")
    if data.startswith((b"\xff\xfe", b"\xfe\xff")):
        body = data[2:]
        return body[: len(body) // 2 * 2].decode("utf-16-le" if data[0] == 0xFF else "utf-16-be", "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return "".join([CP1252[b] for b in data])


def mojibake_score(text: str) -> int:
    """Pairs of neighbours that look like a lead byte and what follows one, read as Windows-1252."""
    return len(_SUSPECT.findall(text))


def fix_mojibake(text: str) -> str:
    """Runs beyond ASCII that are UTF-8 read as Windows-1252 are read anew, if that makes them shorter."""
    if not mojibake_score(text):
        return text

    def again(m: re.Match) -> str:
        try:
            new = bytes([_BYTE[c] for c in m[0]]).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            return m[0]
        return new if len(new) < len(m[0]) else m[0]

    return re.sub("[^\x00-\x7f]+", again, text)


def read_text(data: bytes) -> str:
    return fix_mojibake(decode_bytes(data))
