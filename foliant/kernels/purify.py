"""Zone-aware cleaning of one text: located anomalies, zones, and what is applied where.

Offsets count code points. Every anomaly is located on the input, before anything is rewritten.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Sequence
from typing import NamedTuple

# Labels of single characters.
ZERO_WIDTH = {"​": "zwsp", "‌": "zwnj", "‍": "zwj", "﻿": "bom", "⁠": "wj", "⁡": "fa", "⁢": "it", "⁣": "is", "⁤": "ip"}
DIRECTIONAL = {"‎": "lrm", "‏": "rlm", "‪": "lre", "‫": "rle", "‬": "pdf", "‭": "lro", "‮": "rlo", "⁦": "lri", "⁧": "rli", "⁨": "fsi", "⁩": "pdi"}
SMART_QUOTES = {"‘": "sq_left_single", "’": "sq_right_single", "‚": "sq_low_single", "‛": "sq_rev_single", "“": "sq_left_double", "”": "sq_right_double", "„": "sq_low_double", "‟": "sq_rev_double", "′": "sq_prime", "″": "sq_double_prime", "‵": "sq_rev_prime"}
DASHES = {"–": "dash_en", "—": "dash_em", "―": "dash_horiz_bar", "−": "dash_minus_sign", "‑": "dash_nb_hyphen", "﹘": "dash_small_em", "﹣": "dash_small_hyphen", "－": "dash_fw_hyphen"}
# Look-alikes and what they stand for.
LOOKALIKE = dict(zip("аеорсхАВЕКМНОРСТХУοΟνκ", "aeopcxABEKMHOPCTXYoOvk", strict=True)) | {chr(0xFF41 + i): chr(97 + i) for i in range(26)}
# Extensions by format.
EXTENSIONS = {"markdown": "md mdx markdown", "prose": "txt text", "frozen": "yaml yml json toml xml css scss sql", "code": "html htm py pyw rs go js jsx ts tsx c h cpp hpp cs java rb sh bash zsh"}
FORMATS = {ext: name for name, exts in EXTENSIONS.items() for ext in exts.split()}

_BLANKS = "".join(map(chr, [*range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]))


def _kinds() -> dict[str, tuple[str, str, bool, bool]]:
    """character -> kind, replacement, is_watermark, is_code_safe of the anomaly that it begins."""
    out: dict[str, tuple[str, str, bool, bool]] = {}
    of = lambda *ranges: [chr(c) for a, b in ranges for c in range(a, b + 1)]
    for name, chars in (("tag", of((0xE0000, 0xE007F))), ("varsel", of((0xFE00, 0xFE0F), (0xE0100, 0xE01EF))), ("interlinear", of((0xFFF9, 0xFFFB)))):
        out |= {c: (f"watermark_{name}", "", True, False) for c in chars}
    out |= {c: (f"zero_width_{n}", "", False, False) for c, n in ZERO_WIDTH.items()} | {c: (f"dir_override_{n}", "", False, False) for c, n in DIRECTIONAL.items()}
    out |= {c: ("control_code", "", False, False) for c in of((0, 8), (0x0B, 0x0C), (0x0E, 0x1F), (0x7F, 0x7F))} | {c: ("line_sep", "\n", False, False) for c in of((0x2028, 0x2029))}
    out |= {c: ("special_space", "\xa0" if c == "\u202f" else " ", False, False) for c in _BLANKS} | {c: ("homoglyph", new, False, False) for c, new in LOOKALIKE.items()}
    out |= {c: (n, c, False, False) for c, n in SMART_QUOTES.items()} | {c: (n, "-", False, True) for c, n in DASHES.items()}
    return out | {"\r": ("cr", "\n", False, False), "-": ("double_hyphen", "-", False, False)}


_KINDS = _kinds()


def _anomalies(chars: str, more: str = "") -> re.Pattern:
    """One set of characters at the front, which the engine skims a text for; line ends and runs of hyphens go on behind it."""
    return re.compile(f"[{re.escape(''.join(sorted(chars)))}{more}](?:(?<=-)-+|(?<=\r)\n)?")


_FOUND_ASCII = _anomalies("".join(c for c in _KINDS if c.isascii()))
_FOUND = _anomalies("".join(c for c in _KINDS if c <= "\uffff"), "\U000e0000-\U000e007f\U000e0100-\U000e01ef")


class Artifact(NamedTuple):
    offset: int
    length: int
    kind: str
    replacement: str
    is_watermark: bool
    is_code_safe: bool


def artifacts(text: str, safelist: str = "") -> list[Artifact]:
    """All anomalies in order. A byte order mark at the begin and zero-width characters of the safelist are none."""
    out = []
    for m in (_FOUND_ASCII if text.isascii() else _FOUND).finditer(text):
        found, at = m[0], m.start()
        if found[0] == "-":
            if len(found) != 2:
                continue
        elif found in ZERO_WIDTH and (found in safelist or (found == "\ufeff" and at == 0)):
            continue
        kind, new, mark, safe = _KINDS[found[0]] if found != "\r\n" else ("crlf", "\n", False, False)
        out.append(Artifact(at, len(found), kind, new, mark, safe))
    return out


_FRONT = re.compile(r"---[ \t]*\r?\n")
_FRONT_END = re.compile(r"^---[ \t]*\r*(?:\n|\Z)", re.M)


def front_matter_end(text: str) -> int:
    """Where the text goes on behind leading front matter; 0 without any."""
    opened = _FRONT.match(text)
    closed = opened and _FRONT_END.search(text, opened.end())
    return closed.end() if closed else 0


def detect_format(path: str | None, text: str) -> str:
    """By extension, else by content."""
    known = FORMATS.get(path.rsplit(".", 1)[-1].lower()) if path else None
    if known:
        return known
    if text.lstrip().startswith(("{", "[")):
        return "frozen"
    return "markdown" if front_matter_end(text) else "prose"


_FENCE = re.compile(r"^(`{3,}|~{3,})", re.M)
_SPAN = re.compile(r"[`$\\](?:(?<=`)`*|(?<=\$)\$?|(?<=\\)[\[(])")
_CODE = {n: re.compile(rf"[^`\n]+`{{{n}}}(?!`)") for n in (1, 2)}
_MATH = re.compile(r"(?![\s$])[^$\n]*(?<!\s)\$(?!\$)")


def _fences(text: str, begin: int) -> list[tuple[int, int]]:
    out = []
    while opened := _FENCE.search(text, begin):
        at = text.find("\n", opened.end())
        end, size, char = len(text), len(opened[1]), opened[1][0]
        while at != -1:
            stop = text.find("\n", at + 1)
            line = text[at + 1 : stop if stop != -1 else len(text)].strip()
            if len(line) >= size and not line.strip(char):
                end = stop + 1 if stop != -1 else len(text)
                break
            at = stop
        out.append((opened.start(), end))
        begin = end
        if begin >= len(text):
            break
    return out


def zones(text: str, form: str) -> list[tuple[int, int, str]]:
    """(begin, end, zone) of all the text, in order: prose, math, frozen_hard (code, front matter, data) or frozen_soft (source files)."""
    if form != "markdown":
        return [(0, len(text), {"prose": "prose", "frozen": "frozen_hard", "code": "frozen_soft"}[form])]
    front = front_matter_end(text)
    fences = _fences(text, front)
    regions = ([(0, front, "frozen_hard")] if front else []) + [(a, b, "frozen_hard") for a, b in fences]
    at, fence = front, iter([*fences, (len(text), len(text))])
    closed = next(fence)
    missing: set[str] = set()  # closers that do not occur any more
    while found := _SPAN.search(text, at):
        i, mark = found.start(), found[0]
        if i >= closed[0]:  # a fence begins before; spans that began earlier may reach into it
            at = max(i if i >= closed[1] else closed[1], at)
            closed = next(fence, (len(text) + 1, len(text) + 1))
            continue
        end = -1
        if mark[0] == "`":
            code = _CODE[len(mark)].match(text, found.end()) if len(mark) <= 2 else None
            end, zone = (code.end() if code else -1), "frozen_hard"
        elif mark == "$":
            math = _MATH.match(text, found.end())
            end, zone = (math.end() if math else -1), "math"
        else:
            closer, zone = {"$$": "$$", "\\[": "\\]", "\\(": "\\)"}[mark], "math"
            if closer not in missing:
                close = text.find(closer, found.end())
                end = close + 2 if close != -1 else -1
                if close == -1:
                    missing.add(closer)
        if end == -1:
            at = found.end() if mark[0] != "\\" else i + 1
            continue
        regions.append((i, end, zone))
        at = end
        while closed[1] <= at and closed[0] < len(text):
            closed = next(fence, (len(text) + 1, len(text) + 1))
        if closed[0] < at < closed[1]:
            at = closed[1]
    out, at = [], 0
    for begin, end, zone in sorted(regions, key=lambda r: r[0]):
        if begin < at:
            continue
        if at < begin:
            out.append((at, begin, "prose"))
        out.append((begin, end, zone))
        at = end
    if at < len(text) or not out:
        out.append((at, len(text), "prose"))
    return out


def applies(artifact: Artifact, zone: str) -> bool:
    """Watermarks go everywhere, dashes everywhere but in mathematics, all else in prose only."""
    return artifact.is_watermark or (zone != "math" and (artifact.is_code_safe or zone == "prose"))


def sanitize(text: str, found: list[Artifact], parts: list[tuple[int, int, str]]) -> tuple[str, int, int]:
    """The rewritten text, and how many anomalies were applied and skipped."""
    begins, out, at, applied = [p[0] for p in parts], [], 0, 0
    for a in found:
        out.append(text[at : a.offset])
        if applies(a, parts[max(0, bisect_right(begins, a.offset) - 1)][2]):
            out.append(a.replacement)
            applied += 1
        else:
            out.append(text[a.offset : a.offset + a.length])
        at = a.offset + a.length
    return "".join(out) + text[at:], applied, len(found) - applied


_FRENCH = [(re.compile(p), r, hints) for p, r, hints in (("[ \t]+([;!?])", "\xa0\\1", [b + m for b in " \t" for m in ";!?"]), ("«[ \t]+", "«\xa0", ["« ", "«\t"]), ("[ \t]+»", "\xa0»", [" »", "\t»"]))]
#: Characters that match an ASCII letter where case does not count, and are not lower-cased to that letter alone.
_ODD_CASES = str.maketrans({"\u0130": "i", "\u0131": "i", "\u017f": "s"})


def _folded(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_ODD_CASES).lower() if any(chr(c) in text for c in _ODD_CASES) else text.lower()


def decontaminate(text: str, form: str, tics: list[re.Pattern], french: bool = True, hints: Sequence[tuple[str, ...]] | None = None) -> tuple[str, int, int]:
    """Stock phrases and French spacing, prose zone by prose zone, so that line anchors see the zone's edges; with both counts.

    ``hints`` has lower-case ASCII strings for each pattern, of which a match has one at least: a pattern without any in the text is not
    tried. Where one has taken something out, which may bring a phrase together, the rest is looked through anew.
    """
    out, n_tics, n_french = [], 0, 0
    has = lambda low: [any(h in low for h in hint) for hint in hints]
    wanted = has(_folded(text)) if hints else [True] * len(tics)
    for begin, end, zone in zones(text, form):
        part = text[begin:end]
        if zone == "prose":
            may = wanted
            for k, pattern in enumerate(tics):
                if may[k]:
                    part, n = pattern.subn("", part)
                    n_tics += n
                    may = has(_folded(part)) if n and hints else may
            for pattern, new, signs in _FRENCH if french else ():
                if any(s in part for s in signs):
                    part, n = pattern.subn(new, part)
                    n_french += n
        out.append(part)
    return "".join(out), n_tics, n_french


def purify(text: str, mode: str = "audit", form: str | None = None, path: str | None = None, tics: list[re.Pattern] = (), french: bool = True, safelist: str = "", hints: Sequence[tuple[str, ...]] | None = None) -> tuple[str, dict]:
    """The text and a report, for mode audit (text as it is), sanitize or decontaminate. What a mode does not measure is None."""
    if mode not in ("audit", "sanitize", "decontaminate"):
        raise ValueError(f"no such mode: {mode}")
    form, found = form or detect_format(path, text), artifacts(text, safelist)
    report = {
        "format": form, "size_bytes": len(text.encode("utf-8", "surrogatepass")), "lines": text.count("\n") + 1, "mode": mode, "artifacts_found": len(found), "watermarks": sum(a.is_watermark for a in found),
        "artifact_breakdown": dict(sorted(Counter(a.kind for a in found).items())), "segments": None, "applied": None, "skipped": None, "tic_changes": None, "fr_changes": None, "chars_before": None, "chars_after": None,
    }
    if mode == "audit":
        return text, report
    parts = zones(text, form)
    out, applied, skipped = sanitize(text, found, parts)
    report |= {"segments": len(parts), "applied": applied, "skipped": skipped, "chars_before": len(text)}
    if mode == "decontaminate":
        out, n_tics, n_french = decontaminate(out, form, tics, french, hints)
        report |= {"tic_changes": n_tics, "fr_changes": n_french}
    return out, report | {"chars_after": len(out)}
