"""Line-based markups to Markdown: Org, reStructuredText, MediaWiki, AsciiDoc, Typst."""

from __future__ import annotations

import re

from .text import collapse_blank_lines, lines_of, relink, rewrap, swap_marks

# ---------------------------------------------------------------- Org

_ORG_WORDS = {"title": "# {}\n\n", "author": "*{}*\n\n", "date": "*{}*\n\n"}
_ORG_HEADING = re.compile(r"(\*+) (.*)")
_NUMBERED = re.compile(r"[0-9]+[.)](.+)", re.S)


def org_to_md(text: str) -> str:
    """Keywords, blocks, headings without their tags, lists, inline marks and links."""
    out, literal, quoted = [], False, False
    for line in lines_of(text):
        bare = line.strip()
        word = re.match(r"#\+([a-z]+(?:_[a-z]+)?)(:?)", bare.lower())
        if bare.startswith("#+"):
            name = word[1] if word else ""
            if word and word[2] and name in _ORG_WORDS:
                out.append(_ORG_WORDS[name].format(bare.split(":", 1)[1].strip()))
                continue
            if not name.startswith(("begin", "end")):
                continue
            kind = name.partition("_")[2]
            opens = name.startswith("begin")
            if kind.startswith("src"):
                literal = opens
                words = bare.split()
                out.append(f"```{words[1].lower() if len(words) > 1 else ''}\n" if opens else "```\n\n")
                continue
            if kind.startswith(("example", "verbatim")):
                literal = opens
                out.append("```\n" if opens else "```\n\n")
                continue
            if kind.startswith(("quote", "abstract")):
                quoted = opens
                out += [] if opens else ["\n"]
                continue
        if literal:
            out.append(line + "\n")
        elif quoted:
            out.append(f"> {org_inline(bare)}\n")
        elif found := _ORG_HEADING.match(bare):
            title = []
            for w in found[2].split():
                if w.startswith(":"):
                    break
                title.append(w)
            out.append(f"{'#' * min(6, len(found[1]))} {' '.join(title)}\n\n")
        elif bare in ("-----", "---"):
            out.append("---\n\n")
        elif bare.startswith(("- ", "+ ")):
            out.append(f"- {org_inline(bare[2:])}\n")
        elif found := _NUMBERED.match(bare):
            out.append(f"1. {org_inline(found[1][1:].strip())}\n")
        else:
            out.append(org_inline(bare) + "\n")
    return collapse_blank_lines("".join(out))


def org_span(text: str, mark: str, new: str) -> str:
    """Marked words: the opener after white space, a bracket or a quote, no spaces inside the ends, no address between."""
    m = re.escape(mark)
    pattern = re.compile(rf"(?<![^\s(\[{{\"']){m}((?!\s)[^{m}\n]+){m}")
    out, at = [], 0
    while found := pattern.search(text, at):
        inner = found[1]
        if inner[-1] == " " or "://" in inner:
            out.append(text[at : found.start() + 1])
            at = found.start() + 1
        else:
            out += [text[at : found.start()], new, inner, new]
            at = found.end()
    return "".join(out) + text[at:]


def org_inline(text: str) -> str:
    for mark, new in (("*", "**"), ("/", "*"), ("=", "`"), ("~", "`")):
        if mark in text:
            text = org_span(text, mark, new)
    return relink(text, "[[", "]]", "][") if "[[" in text else text


# ---------------------------------------------------------------- reStructuredText

_UNDERLINES = "=-~^\"'#+"
_ADMONITIONS = ("note", "warning", "tip", "important")


def _indented(lines: list[str], i: int) -> tuple[str, int]:
    """The indented body below line i, without its indent, and the line after it."""
    i += 1
    while i < len(lines) and not lines[i].strip():
        i += 1
    body = []
    while i < len(lines) and (not lines[i].strip() or lines[i].startswith(("   ", "\t"))):
        line = lines[i]
        body.append("" if not line.strip() else line[3:] if line.startswith("   ") else line[1:])
        i += 1
    return "".join(b + "\n" for b in body), i


def rst_to_md(text: str) -> str:
    """A heading's level is the rank of its underline by first appearance."""
    lines, out, ranks, i = lines_of(text), [], [], 0
    while i < len(lines):
        bare = lines[i].strip()
        below = lines[i + 1].strip() if i + 1 < len(lines) else ""
        if bare and below and below[0] in _UNDERLINES and len(below.encode()) >= len(bare.encode()) and not below.strip(below[0]):
            if below[0] not in ranks:
                ranks.append(below[0])
            out.append(f"{'#' * min(6, ranks.index(below[0]) + 1)} {bare}\n\n")
            i += 2
            continue
        if bare.startswith(".. "):
            name, _, value = bare[3:].partition("::")
            known = "::" in bare
            body, i = _indented(lines, i)
            if known and name == "math":
                out.append(f"\n$$\n{body.strip()}\n$$\n\n")
            elif known and name in ("code-block", "code", "sourcecode"):
                out.append(f"```{value.strip()}\n{body.rstrip()}\n```\n\n")
            elif known and name in ("figure", "image"):
                alt = next((x.split(":", 2)[2].strip() for x in lines_of(body) if x.lstrip().startswith(":alt:")), "")
                out.append(f"![{alt}]({value.strip()})\n\n")
            elif known and name in _ADMONITIONS:
                out.append(f"> **{name}:** {body.strip()}\n\n")
            continue
        if bare.endswith("::"):
            if len(bare) > 2:
                out.append(rst_inline(bare[:-2]) + "\n\n")
            body, i = _indented(lines, i)
            out.append(f"```\n{body.rstrip()}\n```\n\n")
            continue
        i += 1
        if len(bare) >= 4 and not bare.strip("-"):
            out.append("---\n\n")
        elif bare.startswith(("- ", "* ")):
            out.append(f"- {rst_inline(bare[2:])}\n")
        elif found := re.match(r"[0-9]+\.(.+)", bare):
            out.append(f"1. {rst_inline(found[1].strip())}\n")
        elif bare.startswith("#. "):
            out.append(f"1. {rst_inline(bare[3:])}\n")
        else:
            out.append(rst_inline(bare) + "\n")
    return collapse_blank_lines("".join(out))


_ROLE = re.compile(r":((?:[^\W_]|[-_])*):`")


def strip_roles(text: str) -> str:
    out, at = [], 0
    while found := _ROLE.search(text, at):
        end = text.find("`", found.end())
        out += [text[at : found.start()], text[found.end() : end] if end != -1 else ""]
        at = end + 1 if end != -1 else found.end()
    return "".join(out) + text[at:]


def rst_inline(text: str) -> str:
    if "`" not in text:
        return text
    text = rewrap(text, "``", "``", "`", "`")
    text = rewrap(text, ":math:`", "`", "$", "$")
    return strip_roles(rewrap(text, ":code:`", "`", "`", "`"))


# ---------------------------------------------------------------- MediaWiki

_WIKI_LITERAL = ("pre", "syntaxhighlight", "source")
_WIKI_LISTS = (("* ", "- "), ("** ", "  - "), ("# ", "1. "), (": ", "> "))


def wiki_to_md(text: str) -> str:
    out, literal = [], False
    for line in lines_of(text):
        bare = line.strip()
        level = min(6, len(bare) - len(bare.lstrip("=")))
        title = bare[level : len(bare) - level].strip() if bare.startswith("=") and bare.endswith("=") else ""
        if title:
            out.append(f"{'#' * level} {title}\n\n")
        elif bare.startswith(tuple(f"<{t}" for t in _WIKI_LITERAL)):
            literal = True
            out.append("```\n")
        elif bare.startswith(tuple(f"</{t}>" for t in _WIKI_LITERAL)):
            literal = False
            out.append("```\n\n")
        elif literal:
            out.append(line + "\n")
        elif bare == "----":
            out.append("---\n\n")
        else:
            mark, new = next(((a, b) for a, b in _WIKI_LISTS if bare.startswith(a)), ("", ""))
            out.append(f"{new}{wiki_inline(bare[len(mark):])}\n")
    return collapse_blank_lines("".join(out))


def wiki_inline(text: str) -> str:
    text = swap_marks(swap_marks(text, "'''", "**"), "''", "*")
    for tag, mark in (("math", "$"), ("code", "`"), ("ref", "")):
        text = rewrap(text, f"<{tag}>", f"</{tag}>", mark, mark)
    if "[[" in text:
        text = relink(text, "[[", "]]", "|")
    return re.sub(r"\{\{.*?\}\}", "", text, flags=re.S).replace("{{", "") if "{{" in text else text


# ---------------------------------------------------------------- AsciiDoc

_ADOC_ATTRIBUTE = re.compile(r":!*(?:[^\W_]|[-_])+:")
_ADMONITION = re.compile(r"(NOTE|TIP|WARNING|IMPORTANT|CAUTION):(.*)")


def adoc_to_md(text: str) -> str:
    out, literal, quoted, stem, language = [], False, False, None, ""
    for line in lines_of(text):
        bare = line.strip()
        if bare.startswith("[source"):
            parts = bare.split(",") if "," in bare else bare.split(".")
            language = parts[1].rstrip("]").strip() if len(parts) > 1 else ""
        elif bare in ("[stem]", "[latexmath]", "[asciimath]"):
            stem = stem if stem is not None else []
        elif bare == "----" or bare == "....":
            out.append("```\n\n" if literal else f"```{language if bare == '----' else ''}\n")
            language = language if literal or bare == "...." else ""
            literal = not literal
        elif bare == "====":
            out += ["\n"] if quoted else []
            quoted = not quoted
        elif bare == "++++":
            if stem is not None:
                body = "".join(x + "\n" for x in stem)
                out.append(f"\n$$\n{body.strip()}\n$$\n\n")
                stem = None
        elif literal:
            out.append(line + "\n")
        elif stem is not None:
            stem.append(line)
        elif quoted:
            out.append(f"> {adoc_inline(bare)}\n")
        elif _ADOC_ATTRIBUTE.match(bare):
            pass
        elif found := re.match(r"(=+) (.*)", bare):
            out.append(f"{'#' * min(6, len(found[1]))} {found[2].strip()}\n\n")
        elif bare == "'''" or (len(bare) >= 3 and not bare.strip("-")):
            out.append("---\n\n")
        elif found := re.match(r"(\*+|\.+) (.*)", bare):
            out.append(f"{'  ' * (len(found[1]) - 1)}{'-' if found[1][0] == '*' else '1.'} {adoc_inline(found[2].strip())}\n")
        elif found := _ADMONITION.match(bare):
            out.append(f"> **{found[1]}:** {adoc_inline(found[2].strip())}\n\n")
        elif bare.startswith("image::"):
            path, _, rest = bare[7:].partition("[")
            out.append(f"![{rest.partition(']')[0] if ']' in rest else ''}]({path.strip()})\n\n")
        else:
            out.append(adoc_inline(bare) + "\n")
    return collapse_blank_lines("".join(out))


def adoc_inline(text: str) -> str:
    text = rewrap(text, "**", "**", "**", "**") if "**" in text else swap_marks(text, "*", "**")
    text = swap_marks(text, "_", "*")
    for name in ("stem:[", "latexmath:["):
        text = rewrap(text, name, "]", "$", "$")
    return re.sub(r"link:([^\[]*)\[([^\]]*)\]", r"[\2](\1)", text) if "link:" in text else text


# ---------------------------------------------------------------- Typst

_TYPST_DROPPED = ("#set ", "#show ", "#let ", "#import", "#include", "#align(", "#v(", "#pagebreak")


def typst_to_md(text: str) -> str:
    out, literal = [], False
    for line in lines_of(text):
        bare = line.strip()
        if literal:
            literal = bare != "```"
            out.append(line + "\n" if literal else "```\n\n")
        elif bare.startswith("```"):
            literal = True
            out.append(line + "\n")
        elif bare.startswith(_TYPST_DROPPED):
            continue
        elif found := re.match(r"(=+) (.*\S)", bare):
            out.append(f"{'#' * min(6, len(found[1]))} {found[2].strip()}\n\n")
        elif bare.startswith("#line("):
            out.append("---\n\n")
        elif bare.startswith(("- ", "+ ")):
            out.append(f"{'-' if bare[0] == '-' else '1.'} {typst_inline(bare[2:])}\n")
        else:
            out.append(typst_inline(bare) + "\n")
    return collapse_blank_lines("".join(out))


def typst_inline(text: str) -> str:
    text = swap_marks(swap_marks(text, "*", "**"), "_", "*")
    text = rewrap(text, "#strike[", "]", "~~", "~~")
    if '#link("' not in text:
        return text
    text = re.sub(r'#link\("([^"]*)"\)\[([^\]]*)\]', r"[\2](\1)", text)
    return re.sub(r'#link\("([^"]*)"', r"<\1>", text).replace('#link("', "")
