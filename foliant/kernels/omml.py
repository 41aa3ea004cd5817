"""Office mathematics (OMML) to LaTeX, over a parsed tree."""

from __future__ import annotations

from xml.etree.ElementTree import Element

M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
#: Nested deeper, mathematics is cut off.
DEPTH = 96
# Characters and their commands.
_CHARS = dict(
    zip(
        "×·⋅÷±∓∝≡≅∼∘⊆⊇⊕⊗⊙∧∨∀∃↦⟨⟩≤≥≠≈∞∂∇∈∉⊂⊃∩∪→←↔⇒⇔αβγδεθλμπσφϕωΓΔΘΛΠΣΦΨΩ∑∏∫",
        "times cdot cdot div pm mp propto equiv cong sim circ subseteq supseteq oplus otimes odot wedge vee forall exists mapsto langle rangle leq geq neq approx infty partial nabla in notin subset supset cap cup rightarrow leftarrow leftrightarrow Rightarrow Leftrightarrow alpha beta gamma delta epsilon theta lambda mu pi sigma phi phi omega Gamma Delta Theta Lambda Pi Sigma Phi Psi Omega sum prod int".split(),
        strict=True,
    )
)
_MAPPED = {c: f" \\{name} " for c, name in _CHARS.items()} | {"−": "-", "∗": "*", "√": " \\sqrt"}
_NARY = {"∑": "\\sum", "Σ": "\\sum", "∏": "\\prod", "Π": "\\prod", "∫": "\\int", "∬": "\\iint", "∭": "\\iiint", "∮": "\\oint"}
_OPEN, _CLOSE = {"(": "(", "[": "[", "{": "\\{", "|": "|"}, {")": ")", "]": "]", "}": "\\}", "|": "|"}
_TEXT = str.maketrans({"\\": "\\textbackslash{}"} | {c: f"\\{c}" for c in "{}%&#_$"})


def _run(r: Element) -> str:
    raw = "".join(t.text or "" for t in r.iter(f"{M}t"))
    mapped = "".join(_MAPPED.get(c, c) for c in raw)
    style = [e.get(f"{M}val") for e in r.iter(f"{M}sty")]
    if raw and (r.find(f".//{M}nor") is not None or "p" in style or not mapped.isascii()):
        return f"\\text{{{raw.translate(_TEXT)}}}"
    return mapped


def _value(e: Element, name: str) -> str:
    """A property, as an attribute of its element or of ``val``."""
    found = e.find(f".//{M}{name}")
    return "" if found is None else found.get(f"{M}val") or found.get(f"{M}{name}") or ""


def to_latex(e: Element | None, depth: int = 0) -> str:
    """All that stands below an element."""
    if e is None or depth > DEPTH:
        return ""
    return "".join(_node(child, depth + 1) for child in e)


def _node(e: Element, depth: int) -> str:
    part = lambda name: to_latex(e.find(f"{M}{name}"), depth)
    name = e.tag.removeprefix(M)
    if name == "f":
        return f"\\frac{{{part('num')}}}{{{part('den')}}}"
    if name == "sSup":
        return f"{part('e')}^{{{part('sup')}}}"
    if name == "sSub":
        return f"{part('e')}_{{{part('sub')}}}"
    if name == "sSubSup":
        return f"{part('e')}_{{{part('sub')}}}^{{{part('sup')}}}"
    if name == "rad":
        degree = part("deg").strip()
        return f"\\sqrt{f'[{degree}]' if degree else ''}{{{part('e')}}}"
    if name == "nary":
        low, high = part("sub"), part("sup")
        return f"{_NARY.get(_value(e, 'chr'), chr(92) + 'sum')}{f'_{{{low}}}' if low else ''}{f'^{{{high}}}' if high else ''} {part('e')}"
    if name == "d":
        return f"\\left{_OPEN.get(_value(e, 'begChr'), '(')}{part('e')}\\right{_CLOSE.get(_value(e, 'endChr'), ')')}"
    if name == "m":
        rows = [" & ".join(to_latex(c, depth) for c in row.findall(f"{M}e")) for row in e.findall(f"{M}mr")]
        return "\\begin{matrix}" + " \\\\\n".join(rows) + "\n\\end{matrix}"
    if name == "r":
        return _run(e)
    return "" if name.endswith("Pr") else to_latex(e, depth)
