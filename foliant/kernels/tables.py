"""Pipe tables as data: cells with their places, a model that can be edited, and writing it back."""

from __future__ import annotations

import re
from typing import NamedTuple

_BORDER = re.compile(r"(?<!\\)\|")
_MARKS = {"none": "---", "left": ":--", "center": ":-:", "right": "--:"}


class Cell(NamedTuple):
    row: int
    column: int
    text: str
    begin: int
    end: int


def is_delimiter(bare: str) -> bool:
    return "-" in bare and not bare.strip("-:| \t")


def _cells(line: str) -> list[tuple[int, int]]:
    """(begin, end) of each cell's text in a line; empty edges are no cells."""
    cuts = [m.start() for m in _BORDER.finditer(line)]
    bounds = list(zip([0, *(c + 1 for c in cuts)], [*cuts, len(line)], strict=True))
    if bounds[0][0] == bounds[0][1]:
        bounds = bounds[1:]
    if len(bounds) > 1 and bounds[-1][0] == bounds[-1][1]:
        bounds = bounds[:-1]
    out = []
    for a, b in bounds:
        text = line[a:b]
        begin = a + len(text) - len(text.lstrip())
        out.append((begin, max(begin, a + len(text.rstrip()))))
    return out


def parse_cells(source: str, offset: int = 0) -> list[Cell]:
    """All cells but those of delimiter rows; places count characters from ``offset``."""
    out, at, row = [], offset, 0
    for raw in source.splitlines(keepends=True) if "\r" not in source else re.findall(r"[^\n]*\n|[^\n]+", source):
        line = raw.rstrip("\n").rstrip("\r")
        if line.strip() and not is_delimiter(line.strip()):
            out += [Cell(row, k, line[a:b], at + a, at + b) for k, (a, b) in enumerate(_cells(line))]
            row += 1
        at += len(raw)
    return out


class Table:
    """Rows of cells and the alignment of columns; every change gives a new table."""

    def __init__(self, rows: list[list[str]], aligns: list[str] | None = None):
        self.rows = [list(r) for r in rows]
        self.aligns = list(aligns or [])
        self.aligns += ["none"] * (max(map(len, self.rows), default=0) - len(self.aligns))

    @classmethod
    def parse(cls, source: str) -> Table | None:
        rows, aligns = [], []
        for line in source.split("\n"):
            line = line.rstrip("\r")
            bare = line.strip()
            if bare and is_delimiter(bare):
                texts = [line[a:b] for a, b in _cells(line)]
                aligns = [("center" if t.endswith(":") else "left") if t.startswith(":") else "right" if t.endswith(":") else "none" for t in texts]
            elif bare:
                rows.append([line[a:b] for a, b in _cells(line)])
        return cls(rows, aligns) if rows else None

    @property
    def columns(self) -> int:
        return max([len(self.aligns), *map(len, self.rows)])

    def source(self) -> str:
        width = max(1, self.columns)
        told = lambda cells: "|" + "".join(f" {c} |" for c in cells) + "\n"
        rows = [told(r + [""] * (width - len(r))) for r in self.rows]
        return "".join([rows[0], told(_MARKS[a] for a in (self.aligns + ["none"] * width)[:width]), *rows[1:]])

    def _padded(self) -> list[list[str]]:
        return [r + [""] * (self.columns - len(r)) for r in self.rows]

    def insert_row(self, after: int) -> Table:
        at = min(after + 1, len(self.rows))
        return Table([*self.rows[:at], [""] * max(1, self.columns), *self.rows[at:]], self.aligns)

    def delete_row(self, at: int) -> Table:
        return Table(self.rows[:at] + self.rows[at + 1 :] if len(self.rows) > 1 and 0 <= at < len(self.rows) else self.rows, self.aligns)

    def insert_column(self, at: int) -> Table:
        at = min(at, self.columns)
        return Table([r[:at] + [""] + r[at:] for r in self._padded()], [*self.aligns[:at], "none", *self.aligns[at:]])

    def delete_column(self, at: int) -> Table:
        if self.columns <= 1:
            return self
        return Table([r[:at] + r[at + 1 :] for r in self.rows], self.aligns[:at] + self.aligns[at + 1 :])

    def align(self, at: int, how: str) -> Table:
        return Table(self.rows, [how if i == at else a for i, a in enumerate(self.aligns)])
