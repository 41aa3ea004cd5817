r"""LaTeX mathematics: macros of a document, cleaning, and plain Unicode.

Macros are an argument, never state of the process.
"""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

from .text import brace_end


class Macro(NamedTuple):
    argc: int
    body: str


_BLANK = r"[ \t\r\n]*"
_DEFINES = re.compile(r"\\([A-Za-z]+)")
_NAME = re.compile(rf"{_BLANK}(?:\{{\s*\\([A-Za-z]+)[^{{}}]*\}}|\\([A-Za-z]+)){_BLANK}")
_COUNT = re.compile(rf"\[([^\]]*)\]{_BLANK}(?:\[[^\]]*\]{_BLANK})?")
_SPACES = re.compile(_BLANK)


def macros_of(source: str) -> dict[str, Macro]:
    r"""name -> (arguments, body) of ``\newcommand``, ``\renewcommand``, ``\providecommand`` and ``\def``; a later one wins, default arguments do not count."""
    found, at = {}, 0
    while m := _DEFINES.search(source, at):
        at = m.end()
        if m[1] not in ("newcommand", "renewcommand", "providecommand", "def"):
            continue
        name = _NAME.match(source, at)
        if not name or (m[1] == "def" and name[2] is None):
            continue
        here, argc = name.end(), 0
        count = _COUNT.match(source, here) if m[1] != "def" else None
        if count:
            here, argc = count.end(), int(count[1]) if count[1].strip().isdigit() else 0
        end = brace_end(source, here + 1) if source.startswith("{", here) else -1
        if end == -1:
            continue
        body = source[here + 1 : end]
        if m[1] == "def":
            argc = max(map(int, re.findall(r"#([0-9])", body)), default=0)
        found[name[1] or name[2]] = Macro(argc, body)
        at = end + 1
    return found


def expand(text: str, macros: dict[str, Macro]) -> str:
    """Macros and the macros in their bodies, in at most eight passes. A use that lacks arguments stays."""
    for _ in range(8 if macros else 0):
        text, changed = _expand_once(text, macros)
        if not changed:
            break
    return text


def _argument(text: str, at: int) -> tuple[str, int] | None:
    at = _SPACES.match(text, at).end()
    if at >= len(text):
        return None
    if text[at] == "{":
        end = brace_end(text, at + 1)
        return None if end == -1 else (text[at + 1 : end], end + 1)
    if text[at] == "\\":
        word = _DEFINES.match(text, at)
        return (word[0], word.end()) if word else None
    return text[at], at + 1


def _expand_once(text: str, macros: dict[str, Macro]) -> tuple[str, bool]:
    out, at, changed = [], 0, False
    for m in _DEFINES.finditer(text):
        macro = macros.get(m[1])
        if macro is None or m.start() < at:
            continue
        args, here = [], m.end()
        while len(args) < macro.argc and (found := _argument(text, here)):
            args.append(found[0])
            here = found[1]
        if len(args) < macro.argc:
            continue
        out += [text[at : m.start()], re.sub(r"#([0-9])", lambda a: args[int(a[1]) - 1] if 1 <= int(a[1]) <= len(args) else "", macro.body)]
        at, changed = here, True
    return "".join(out) + text[at:], changed


_WITH_ARGUMENT = re.compile(rf"\\(?:label|tag|eqref|ref|cite|index)(?![A-Za-z]){_BLANK}")
_FLAGS = re.compile(r"\\(?:nonumber|notag|displaystyle|textstyle|scriptstyle|limits|nolimits)(?![A-Za-z])")
# Spacing commands and what they leave, in order.
_SPACING = ((r"\qquad", "  "), (r"\quad", " "), (r"\thinspace", " "), (r"\negthinspace", ""), (r"\,", " "), (r"\;", " "), (r"\:", " "), ("\\ ", " "), (r"\!", ""))


def sanitize(latex: str) -> str:
    """Without labels, tags, references, flags and plain equation environments; spacing commands become spaces."""
    out, at = [], 0
    while m := _WITH_ARGUMENT.search(latex, at):
        out.append(latex[at : m.start()])
        at = m.end()
        if latex.startswith("{", at):
            end = brace_end(latex, at + 1)
            at = end + 1 if end != -1 else at
    latex = _FLAGS.sub("", "".join(out) + latex[at:])
    for command, space in _SPACING:
        latex = latex.replace(command, space)
    return re.sub(r"\\(?:begin|end)\{(?:equation\*?|displaymath|math)\}", "", latex).strip()


def expand_and_sanitize(latex: str, macros: dict[str, Macro]) -> str:
    return sanitize(expand(latex, macros))


def normalize_escapes(text: str) -> str:
    r"""``\\cmd`` (escaped once too often) becomes ``\cmd``, other double backslashes a space; escaped Markdown marks lose their backslash."""

    def told(m: re.Match) -> str:
        if m[1] is not None:
            return m[1]
        after = text[m.end() : m.end() + 1]
        return "\\" if after and (after.isalpha() or after in "{}_%$,;!()[]|\\") else " "

    return re.sub(r"\\(?:([{}\[\]_<>#*~`])|\\)", told, text)


def _greek() -> dict[str, str]:
    """Commands named after the letters, by the letters' Unicode names; then the variants."""
    small = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
    capital = "Gamma Delta Theta Lambda Xi Pi Sigma Upsilon Phi Psi Omega".split()
    of = lambda kind, name: unicodedata.lookup(f"GREEK {kind} LETTER {name.upper().replace('LAMBDA', 'LAMDA')}")
    letters = {f"\\{n}": of("SMALL", n) for n in small} | {f"\\{n}": of("CAPITAL", n) for n in capital}
    return letters | {r"\varepsilon": "ε", r"\varphi": "φ", r"\vartheta": "ϑ", r"\varpi": "ϖ", r"\varrho": "ϱ", r"\varsigma": "ς", r"\varkappa": "ϰ", r"\digamma": "ϝ"}


# Commands and the characters that they stand for.
_SYMBOLS = r"""
rightarrow → leftarrow ← leftrightarrow ↔ Rightarrow ⇒ Leftarrow ⇐ Leftrightarrow ⇔ cdot · times × odot ⊙ oplus ⊕ otimes ⊗ circ ∘ bullet •
sum ∑ int ∫ prod ∏ coprod ∐ infty ∞ partial ∂ nabla ∇ forall ∀ exists ∃ nexists ∄ in ∈ notin ∉ subset ⊂ supset ⊃ subseteq ⊆ supseteq ⊇ cup ∪ cap ∩
approx ≈ neq ≠ equiv ≡ leq ≤ geq ≥ ll ≪ gg ≫ le ≤ ge ≥ parallel ∥ perp ⊥ pm ± mp ∓ star ⋆ ast ∗ ldots ... cdots ⋯ vdots ⋮ ddots ⋱ langle ⟨ rangle ⟩
hbar ℏ ell ℓ Re ℜ Im ℑ aleph ℵ wp ℘ emptyset ∅ varnothing ∅ mapsto ↦ to → gets ← Longrightarrow ⟹ Longleftarrow ⟸ propto ∝ sim ∼ simeq ≃ cong ≅
angle ∠ triangle △ square □ dagger † ddagger ‡ lfloor ⌊ rfloor ⌋ lceil ⌈ rceil ⌉ % % $ $ xrightarrow → xleftarrow ← longrightarrow ⟶ longleftarrow ⟵
longleftrightarrow ⟷ longmapsto ⟼ Longleftrightarrow ⟺ iff ⟺ implies ⟹ hookrightarrow ↪ hookleftarrow ↩ rightleftharpoons ⇌ leftrightharpoons ⇋
rightharpoonup ⇀ rightharpoondown ⇁ leftharpoonup ↼ leftharpoondown ↽ uparrow ↑ downarrow ↓ updownarrow ↕ Uparrow ⇑ Downarrow ⇓ Updownarrow ⇕
nearrow ↗ searrow ↘ swarrow ↙ nwarrow ↖ oint ∮ iint ∬ iiint ∭ bigcup ⋃ bigcap ⋂ bigsqcup ⨆ bigoplus ⨁ bigotimes ⨂ bigodot ⨀ bigvee ⋁ bigwedge ⋀ biguplus ⨄
wedge ∧ vee ∨ land ∧ lor ∨ neg ¬ lnot ¬ setminus ∖ smallsetminus ∖ sqcup ⊔ sqcap ⊓ uplus ⊎ sqsubseteq ⊑ sqsupseteq ⊒ sqsubset ⊏ sqsupset ⊐
prec ≺ succ ≻ preceq ⪯ succeq ⪰ ni ∋ owns ∋ models ⊨ vdash ⊢ dashv ⊣ doteq ≐ asymp ≍ bowtie ⋈ lll ⋘ ggg ⋙ therefore ∴ because ∵ top ⊤ bot ⊥
complement ∁ measuredangle ∡ sphericalangle ∢ hslash ℏ imath ı jmath ȷ Vert ‖ lVert ‖ rVert ‖ | ‖ vert | lvert | rvert | dots ... dotsc ... dotsb ⋯ dotsi ⋯
lozenge ◊ Diamond ◇ blacksquare ■ blacktriangle ▲ flat ♭ sharp ♯ natural ♮ colon :
""".split()
# Commands for space, and sizes, which leave nothing.
_GAPS = {r"\quad": "  ", r"\qquad": "    ", r"\,": " ", r"\;": " ", r"\!": "", r"\bmod": " mod "} | {f"\\{n}": "" for n in "left right Big big bigg Bigg bigl bigr Bigl Bigr biggl biggr".split()}
SYMBOLS = _greek() | {f"\\{c}": s for c, s in zip(_SYMBOLS[::2], _SYMBOLS[1::2], strict=True)} | _GAPS
_BY_LENGTH = sorted(SYMBOLS.items(), key=lambda kv: -len(kv[0]))
# Characters that have a low or a high form.
_LOW = dict(zip("0123456789aehijklmnoprstuvx+-=()", "₀₁₂₃₄₅₆₇₈₉ₐₑₕᵢⱼₖₗₘₙₒₚᵣₛₜᵤᵥₓ₊₋₌₍₎", strict=True))
_HIGH = dict(zip("0123456789abcdefghijklmnoprstuvwxyzABDEGHIJKLMNOPRTUVW+-=()*", "⁰¹²³⁴⁵⁶⁷⁸⁹ᵃᵇᶜᵈᵉᶠᵍʰⁱʲᵏˡᵐⁿᵒᵖʳˢᵗᵘᵛʷˣʸᶻᴬᴮᴰᴱᴳᴴᴵᴶᴷᴸᴹᴺᴼᴾᴿᵀᵁⱽᵂ⁺⁻⁼⁽⁾⃰", strict=True))
_LOW_TABLE, _HIGH_TABLE = str.maketrans(_LOW), str.maketrans(_HIGH)
_ISOLATED_LOW = re.compile("_([" + re.escape("".join(c for c in _LOW if c.isalnum())) + r"])(?!\w)")
_ISOLATED_HIGH = re.compile(r"\^([" + re.escape("".join(_HIGH)) + r"])(?!\w)")
_ENVIRONMENTS = re.compile(r"\\(?:begin|end)\{(?:align|aligned|equation|gather|gathered|split|cases|matrix|pmatrix|bmatrix|vmatrix|array)\}")
_PASSED = "text textbf textit textrm texttt mathrm mathit mathbf mathbb mathcal mathsf mathfrak operatorname boldsymbol hat tilde bar vec dot ddot overline underline widehat widetilde bm rm color".split()


def _unwrap(text: str, opener: str, told) -> str:
    """``opener`` (which ends in a brace) with its argument becomes told(argument), until none is left or one is unclosed."""
    at = text.find(opener)
    while at != -1:
        begin = at + len(opener)
        end = brace_end(text, begin)
        if end == -1:
            break
        text = text[:at] + told(text[begin:end]) + text[end + 1 :]
        at = text.find(opener)
    return text


def _fractions(text: str) -> str:
    group = lambda x: f"({x})" if len(x.encode()) > 1 else x
    while (at := text.find(r"\frac{")) != -1:
        top = brace_end(text, at + 6)
        if top == -1 or not text.startswith("{", top + 1):
            break
        bottom = brace_end(text, top + 2)
        if bottom == -1:
            break
        text = f"{text[:at]}{group(text[at + 6 : top])}/{group(text[top + 2 : bottom])}{text[bottom + 1 :]}"
    return text


def _roots(text: str) -> str:
    while found := re.search(r"\\sqrt(?:\[([^\]]*)\])?", text):
        if not text.startswith("{", found.end()):
            break
        end = brace_end(text, found.end() + 1)
        if end == -1:
            break
        text = f"{text[: found.start()]}{(found[1] or '').translate(_HIGH_TABLE)}√({text[found.end() + 1 : end]}){text[end + 1 :]}"
    return text


def to_unicode(latex: str, macros: dict[str, Macro] | None = None) -> str:
    """Plain text: macros, escapes, fractions, roots, symbols (the longest command first), low and high characters; other commands lose their backslash."""
    # macros, escapes and commands all begin with a backslash
    text = sanitize(normalize_escapes(expand(latex, macros or {}))) if "\\" in latex else latex.strip()
    text = text.replace("\r\n", " ").replace("\n", " ")
    for char in "{}_":
        text = text.replace(f"\\{char}", char)
    text = _ENVIRONMENTS.sub("", text).replace("&=", " = ").replace("&", " ")
    if "\\" in text:
        for command in _PASSED:
            text = _unwrap(text, f"\\{command}{{", lambda inner: inner)
        text = _roots(_fractions(text))
    for command, char in _BY_LENGTH:
        if "\\" not in text:
            break
        text = text.replace(command, char)
    text = _unwrap(text, "_{", lambda inner: inner.translate(_LOW_TABLE))
    text = _unwrap(text, "^{", lambda inner: inner.translate(_HIGH_TABLE))
    text = _ISOLATED_HIGH.sub(lambda m: _HIGH[m[1]], _ISOLATED_LOW.sub(lambda m: _LOW[m[1]], text)).replace("\\", "")
    text = re.sub(" {2,}", " ", text)
    return text.replace("{ ", "").replace(" }", "").replace("{}", "").strip()
