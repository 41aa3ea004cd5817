"""LaTeX mathematics to Typst mathematics."""

from __future__ import annotations

import re

from .latex import Macro, expand, sanitize
from .text import brace_end

# Commands whose argument is left as it is.
_PROTECTED = set("text mathrm operatorname mathbf mathit mathsf mathfrak mathtt mathbb mathcal mathscr textbf textit texttt textrm boldsymbol begin end".split())
_DROPPED = re.compile(r"\\(?:begin|end)\{(?:align|aligned|equation|gather|gathered|split|array|eqnarray)\}")
_MATRICES = ("matrix", "pmatrix", "bmatrix", "vmatrix", "Bmatrix")
# Commands with an argument, in order, and what goes before and after it; of the fonts, words are quoted.
_WRAPS = (
    ("text", '"', '"'), ("operatorname*", '"', '"'), ("operatorname", '"', '"'), ("DeclareMathOperator", '"', '"'), ("mathrm", "upright(", ")"), ("mathbf", "bold(", ")"), ("mathit", "italic(", ")"), ("mathbb", "bb(", ")"),
    ("mathcal", "cal(", ")"), ("mathsf", "sans(", ")"), ("mathfrak", "frak(", ")"), ("boldsymbol", "bold(", ")"), ("hat", "hat(", ")"), ("tilde", "tilde(", ")"), ("bar", "overline(", ")"), ("vec", "arrow(", ")"), ("dot", "dot(", ")"),
    ("ddot", "dot.double(", ")"), ("overline", "overline(", ")"), ("underline", "underline(", ")"), ("widehat", "hat(", ")"), ("widetilde", "tilde(", ")"), ("sqrt", "sqrt(", ")"), ("xrightarrow", " ->^(", ") "), ("xleftarrow", " <-^(", ") "), ("boxed", "", ""),
)
_FONTS = {"mathrm", "mathbf", "mathit", "mathbb", "mathcal", "mathsf", "mathfrak", "boldsymbol"}
_GREEK = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau upsilon phi chi psi omega Gamma Delta Theta Lambda Xi Pi Sigma Upsilon Phi Psi Omega".split()
_VARIANTS = {"varepsilon": "epsilon", "varphi": "phi", "vartheta": "theta.alt", "varrho": "rho.alt", "varsigma": "sigma.alt", "varpi": "pi.alt", "varkappa": "kappa.alt"}
# Commands and their names in Typst.
_NAMES = dict(
    pair.split("=", 1)
    for pair in """sum=sum prod=product coprod=product.co int=integral oint=integral.cont iint=integral.double iiint=integral.triple infty=oo partial=diff nabla=nabla cdot=dot.c times=times div=div pm=plus.minus mp=minus.plus
rightarrow=-> to=-> leftarrow=<- leftrightarrow=<-> Rightarrow==> Leftarrow=<= Leftrightarrow=<=> mapsto=|-> leq=<= le=<= geq=>= ge=>= neq=!= ne=!= approx=approx equiv=equiv sim=tilde.op simeq=tilde.eq cong=tilde.eq.rev propto=prop
in=in notin=in.not subset=subset supset=supset subseteq=subset.eq supseteq=supset.eq cup=union cap=sect setminus=without emptyset=nothing varnothing=nothing forall=forall exists=exists nexists=exists.not neg=not wedge=and vee=or
oplus=xor otimes=times.circle odot=dot.circle circ=compose bullet=bullet perp=bot parallel=parallel angle=angle ldots=... cdots=dots.c vdots=dots.v ddots=dots.down quad=quad qquad=wide Big= big= bigg= Bigg= != {={ }=} _=_ %=% $=$ sqrt=sqrt""".split()
)
_SPACED = {"gg": " ≫ ", "ll": " ≪ ", "hbar": " planck.reduce ", "iff": " <=> ", "langle": " lr(angle.l ", "rangle": " angle.r)", "lfloor": " lr(floor.l ", "rfloor": " floor.r)", "lceil": " lr(ceil.l ", "rceil": " ceil.r)", ",": " ", ";": " ", ":": " "}
_FENCES = {"left(": " lr((", "right)": "))", "left[": " lr([", "right]": "])", "left\\{": " lr({", "right\\}": "})", "left|": " lr(|", "right|": "|)", "left.": " lr(", "right.": ")", "left": " lr(", "right": ")"}
_BY_LENGTH = sorted((_NAMES | _SPACED | _FENCES).items(), key=lambda kv: -len(kv[0]))
_WORD = re.compile(r"\\([A-Za-z]+)(\*?)|\\.?|[A-Za-z]+|[0-9]", re.S)


def space_identifiers(latex: str) -> str:
    """Runs of letters become single letters, as in LaTeX; arguments of text commands stay."""
    out, at = [], 0
    while m := _WORD.search(latex, at):
        out.append(latex[at : m.start()])
        at = m.end()
        if m[1]:
            out.append(m[0])
            if m[1] in _PROTECTED:
                body = re.compile(r" *\{").match(latex, at)
                blank = re.compile(" *").match(latex, at).end()
                end = brace_end(latex, body.end()) + 1 if body else blank
                end = end if end else len(latex)
                out.append(latex[at:end])
                at = end
            if re.match(r"[A-Za-z\\]", latex[at : at + 1]):
                out.append(" ")
        elif m[0][0] == "\\":
            out.append(m[0])
        else:
            out.append(" ".join(m[0]))
            if latex[at : at + 1] == "\\":
                out.append(" ")
    return "".join(out) + latex[at:]


def _is_words(text: str) -> bool:
    return len(text.strip()) > 1 and not re.search(r"[_^+/=(\\]", text) and all(c.isalpha() or c in " -" or (c.isascii() and c.isdigit()) for c in text.strip())


def _wrap(text: str, command: str, before: str, after: str) -> str:
    opener, out, at = f"\\{command}{{", [], 0
    while (found := text.find(opener, at)) != -1:
        begin = found + len(opener)
        end = brace_end(text, begin)
        out.append(text[at:found])
        if end == -1:
            out.append(opener)
            at = begin
            continue
        inner = text[begin:end]
        out += [before, f'"{inner}"' if command in _FONTS and _is_words(inner) else inner, after]
        at = end + 1
    return "".join(out) + text[at:]


def _fractions(text: str) -> str:
    group = lambda x: x if len(x.encode()) == 1 else f"({x})"
    out, at = [], 0
    while (found := text.find("\\frac{", at)) != -1:
        out.append(text[at:found])
        at = found + 6
        top = brace_end(text, at)
        if top == -1:
            out.append("frac(")
            continue
        bottom = brace_end(text, top + 2) if text.startswith("{", top + 1) else -1
        if bottom == -1:
            out.append(f"frac({text[at:top]})")
            at = top + (2 if text.startswith("{", top + 1) else 1)
            continue
        out.append(f"{group(text[at:top])}/{group(text[top + 2 : bottom])}")
        at = bottom + 1
    return "".join(out) + text[at:]


def _environment(text: str, name: str, told) -> str:
    begin, end = text.find(f"\\begin{{{name}}}"), text.find(f"\\end{{{name}}}")
    if begin == -1 or end == -1 or end < begin:
        return text
    return text[:begin] + told(text[begin + len(name) + 8 : end].strip()) + text[end + len(name) + 6 :]


def to_typst(latex: str, macros: dict[str, Macro] | None = None) -> str:
    """Identifiers apart, matrices and cases, fractions, fonts and accents, names (the longest command first), braces as parentheses."""
    text = space_identifiers(sanitize(expand(latex, macros or {})).strip())
    text = _DROPPED.sub("", text)
    for name in _MATRICES:
        text = _environment(text, name, lambda inner: f"mat({inner.replace(chr(92) * 2, ',').replace('&', ' ')})")
    text = _environment(text, "cases", lambda inner: f"cases({', '.join(x.replace('&', ' ') for x in inner.split(chr(92) * 2))})")
    text = text.replace("&=", " &= ").replace("&", " ").replace("\\\\", "\\ ")
    text = _fractions(text)
    for command, before, after in _WRAPS:
        text = _wrap(text, command, before, after)
    for name, new in (_VARIANTS | {g: g for g in _GREEK}).items():
        text = text.replace(f"\\{name}", new)
    for name, new in _BY_LENGTH:
        text = text.replace(f"\\{name}", new)
    text = text.replace("\\", "").replace("{", "(").replace("}", ")")
    return re.sub(" {2,}", " ", text).strip()
