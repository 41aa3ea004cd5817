"""Words of prose with their places, and Hunspell word lists."""

from __future__ import annotations

import re

_TOKEN = re.compile(r"`[^`]*(?:`|\Z)|\$[^$]*(?:\$|\Z)|<[^>]*(?:>|\Z)|\\[A-Za-z]*|\]\(|([^\W\d_](?:[^\W\d_]|['’])*)")


def words(md: str) -> list[tuple[str, int, int]]:
    """(word, begin, end) of words of two letters or more outside fences, inline code, mathematics, tags, commands and link targets."""
    out, at, fenced = [], 0, False
    for line in re.findall(r"[^\n]*\n|[^\n]+", md):
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        elif not fenced:
            here = 0
            while m := _TOKEN.search(line, here):
                here = m.end()
                if m[0] == "](":
                    depth = 1
                    while here < len(line) and depth:
                        depth += {"(": 1, ")": -1}.get(line[here], 0)
                        here += 1
                elif m[1]:
                    word = m[1].rstrip("'’")
                    if len(word) >= 2:
                        out.append((word, at + m.start(), at + m.start() + len(word)))
        at += len(line)
    return out


def expand_dictionary(aff: str, dic: str) -> set[str]:
    """All words of a Hunspell dictionary, with its prefixes and suffixes (one of each at most)."""
    rules: dict[str, list[tuple[str, bool, str, str, str]]] = {}
    cross: dict[str, bool] = {}
    for line in aff.splitlines():
        parts = line.split()
        if len(parts) == 4 and parts[0] in ("PFX", "SFX"):
            cross[parts[1]] = parts[2] == "Y"
        elif len(parts) >= 5 and parts[0] in ("PFX", "SFX"):
            strip, add = ("" if parts[2] == "0" else parts[2]), parts[3].split("/")[0]
            rules.setdefault(parts[1], []).append((parts[0], cross.get(parts[1], False), strip, "" if add == "0" else add, parts[4]))
    out: set[str] = set()
    for line in dic.splitlines()[1:]:
        stem, _, flags = line.split("\t")[0].strip().partition("/")
        if not stem:
            continue
        suffixed = [(stem, True)]
        for flag in flags:
            for kind, both, strip, add, condition in rules.get(flag, ()):
                if kind == "SFX" and stem.endswith(strip) and re.search(f"(?:{condition})$", stem):
                    suffixed.append((stem[: len(stem) - len(strip)] + add, both))
        out.update(w for w, _ in suffixed)
        for flag in flags:
            for kind, both, strip, add, condition in rules.get(flag, ()):
                if kind == "PFX" and stem.startswith(strip) and re.match(f"(?:{condition})", stem):
                    out.update(add + w[len(strip) :] for w, may in suffixed if w == stem or (may and both))
    return out
