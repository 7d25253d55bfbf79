"""Pieces of markup in a text: HTML (publishers' XML and character references included), Markdown, wiki and LaTeX.

``KINDS`` has one scanner per piece: a pattern, or a function where a pattern would have to look for a closing mark again and again. No
piece has a greatest length, and every scanner is linear: what lies between two marks excludes the mark, and possessive quantifiers never
give back. They are anchored on what plain scientific prose does not hold, so comparisons, prices, grades, arc seconds, nested
brackets, file paths and footnote numbers do not match. ``WEAK`` pieces are no markup by themselves: ``blocks`` decides by their surroundings.
"""

from __future__ import annotations

import html.entities
import re
from collections.abc import Iterator

# Element names of HTML; publishers' XML comes with the prefixes in XML_PREFIX.
TAGS = (
    "a abbr address article aside b big blockquote body br caption center cite code col colgroup dd del details div dl dt em figcaption figure "
    "font footer h1 h2 h3 h4 h5 h6 head header hr html i img ins kbd li link main mark math meta nav ol p pre q s samp script section small "
    "span strike strong style sub sup table tbody td tfoot th thead title tr tt u ul var"
).split()
XML_PREFIX = "jats mml m xlink tei oai dc xsl".split()
ENTITIES = frozenset(n[:-1] for n in html.entities.html5 if n.endswith(";"))

_ATTRIBUTES = r"(?:\s++[\w:.-]++\s*+=\s*+(?:\"[^\"<>]*+\"|'[^'<>]*+'|[^\s\"'<>]++))*+"
_NAME = rf"(?:(?:{'|'.join(XML_PREFIX)}):[a-zA-Z][\w.-]*+|(?:{'|'.join(sorted(TAGS, key=len, reverse=True))})(?![\w:]))"
TAG = rf"</?(?i:{_NAME}){_ATTRIBUTES}\s*+/?>"
REFERENCE = r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});"
#: No letter or digit of an alphabet in front or behind; Han text has no spaces around emphasis.
_L, _R = r"(?<![A-Za-zÀ-ɏЀ-ӿ0-9\\{0}])", r"(?![A-Za-zÀ-ɏЀ-ӿ0-9{0}])"


def _around(mark: str, own: str) -> str:
    """Emphasis by a mark on both sides of a phrase; ``B*`` at its end is a grade."""
    m = re.escape(mark)
    return _L.format(own) + m + rf"(?=[^\s{own}])[^{own}\n$\\]++(?<=[^\s{own}])(?<!\s[A-F])" + m + _R.format(own)


def between(text: str, opener: re.Pattern, closer: re.Pattern | str) -> Iterator[tuple[re.Match, int, int]]:
    """(opening match, start and end of the closing mark) of the spans that are closed, in order and without overlaps, in linear time: an
    opening mark that is never closed ends the search. The closing mark is a text or a pattern."""
    at = 0
    while (m := opener.search(text, at)) is not None:
        if isinstance(closer, str):
            a = text.find(closer, m.end())
            b = a + len(closer)
        else:
            c = closer.search(text, m.end())
            a, b = c.span() if c else (-1, -1)
        if a < 0:
            return
        yield m, a, b
        at = b


def _spans(opener: str, closer: str):
    start = re.compile(opener)
    return lambda text: [(m.start(), b) for m, _, b in between(text, start, closer)]


def _references(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _REFERENCE.finditer(text) if m[0][1] == "#" or m[0][1:-1] in ENTITIES]


def _wiki_headings(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _EQUALS.finditer(text) if wiki_heading(m[0])]


def wiki_heading(line: str) -> str:
    """Text of a heading line between two or more equals signs on both sides, or ""."""
    bare = line.strip(" \t")
    inner = bare.lstrip("=")
    left = len(bare) - len(inner)
    title = inner.rstrip("=")
    return title.strip(" \t") if 2 <= left <= 6 and len(inner) - len(title) >= 2 else ""


_REFERENCE = re.compile(REFERENCE)
_EQUALS = re.compile(r"^={2,6}[ \t]*+[^=\s][^\n]*+$", re.M)

HTML = {
    "tag": TAG,
    "comment": _spans("<!--", "-->"),
    "cdata": r"<!\[CDATA\[|<!DOCTYPE|<\?xml\b",
    "reference": _references,
}
MARKDOWN = {
    "heading": r"^#{1,6} \S",
    "underlined": r"(?<=[^|\s])\n(?:={3,}+|-{3,}+)[ \t]*+$",
    "strong": r"\*\*\*?(?=[^\s*])[^*\n]++(?<=[^\s*])\*\*\*?",
    "under_strong": _around("__", "_"),
    "emphasis": _around("*", "*"),
    "under_emphasis": _around("_", "_"),
    "struck": r"~~(?=[^\s~])[^~\n]++(?<=[^\s~])~~",
    "fence": r"^```",
    "code": r"(?<!`)`(?=[^\s`])[^`\n]++`(?!`)",
    "link": r"!?\[[^\[\]\n]*+\]\((?:<[^<>\n]*+>|[^\s()]++)(?:\s++\"[^\"\n]*+\")?\)",
    "reference": r"\[[^\[\]\n]++\]\[[A-Za-z][\w-]*+\]",
    "footnote": r"\[\^[\w-]++\]",
    "quote": r"^> \S",
    "bullets": r"^[*+-] \S[^\n]*+\n[*+-] \S",
    "task": r"^[-*+] \[[ xX]\] ",
    "table": r"^\|(?:[ :]*+-{3,}+[ :]*+\|)++[ \t]*+$",
}
WIKI = {
    "heading": _wiki_headings,
    "bold": r"'''(?=[^\s'])[^\n]+?'''",
    "italic": r"(?<![\w²³>)\]}'\"])''(?=[^\s'])[^'\n]++(?<=[^\s'])''(?!')|(?<=[\u3040-\u9fff])''(?=[^\s'])[^'\n]++(?<=[^\s'])''(?!')",
    "link": r"\[\[[^\[\]\n]++\]\]",
    "template": r"\{\{[^\s{}][^{}]*+\}\}",
    "table": r"^\{\||^\|\}|^\|-[ \t]*+$",
    "url": r"\[https?://[^\s\[\]]++(?: [^\[\]\n]*+)?\]",
    "definition": r"^;[^\n]++\n:",
    "indent": r"^:++[^\s:]",
    "rule": r"(?:\A|\n\n)-{4,}+[ \t]*+$",
    "raw": r"</?(?:ref|nowiki|references|gallery|syntaxhighlight|noinclude)\b[^<>]*+>",
    "magic": r"__(?:NO)?TOC__",
}
LATEX = {
    "command": r"(?<![A-Za-z0-9_:\\])\\[a-zA-Z]++\*?(?![\w.]*+\\)|(?<=[A-Za-z0-9}$])\\(?:pm|times|cdot|sim|ldots|dots|alpha|beta|sigma|mu|cite|ref|label|footnote|emph|textbf|textit)\b",
    "escape": r"(?<!\\)\\[%&_$#{},;!]",
    "accent": r"(?<![\\:])\\['\"`^~=.](?:\{\\?[A-Za-z]\}|[A-Za-z])",
    "math": r"(?<![\\$])\$(?![\s$]|\d[\d.,]*+\s)(?:[A-Za-z]{1,3}|(?=[^$\n]*[\\^_<>={}])[^$\n]++)(?<![\s\\])\$(?!\d)",
    "display": r"\$\$[^$]++\$\$",
    "paren": r"\\[()\[\]]",
    "break": r"\\\\[ \t]*+$",
    "group": r"\{\\(?:it|bf|em|rm|tt|sc|sl)\b",
    "comment": r"(?<=[.,;:!?a-z}\])])[ \t]++% [a-zA-Z][^\n]*+$",
}
KINDS = {"html": HTML, "markdown": MARKDOWN, "wiki": WIKI, "latex": LATEX}
#: Pieces that occur in plain text as well; they count where their surroundings hold markup of the kind.
WEAK = {
    "html": {"loose": r"</?[a-zA-Z][a-zA-Z0-9:]*+(?=\s)"},
    "markdown": {"item": r"^[*+-] \S", "numbered": r"^\d{1,3}[.)] \S", "mark": r"(?<![*\w])\*(?=\w)|(?<=\w)\*(?![*\w])"},
    "wiki": {"item": r"^[*#]{1,3}[ \t]*+[^\W\d]", "quotes": r"''"},
    "latex": {"tie": r"(?<=[A-Za-z.])~(?=[A-Za-z0-9\\])", "brace": r"[{}]"},
}
LINKS = {("markdown", "link"), ("markdown", "reference"), ("wiki", "link"), ("wiki", "url")}


def _compiled(table: dict) -> dict:
    return {kind: {name: p if callable(p) else re.compile(p, re.M) for name, p in pieces.items()} for kind, pieces in table.items()}


COMPILED, COMPILED_WEAK = _compiled(KINDS), _compiled(WEAK)
#: What a text must hold for a scanner to find anything, checked before it runs.
_FIRST = {
    "html": {"tag": "<", "comment": "<!--", "cdata": "<", "reference": "&"},
    "markdown": {"heading": "# ", "strong": "**", "under_strong": "__", "emphasis": "*", "under_emphasis": "_", "struck": "~~", "fence": "```",
                 "code": "`", "link": "](", "reference": "][", "footnote": "[^", "quote": "> ", "task": "] ", "table": "|"},
    "wiki": {"heading": "==", "bold": "'''", "italic": "''", "link": "[[", "template": "{{", "url": "[http", "definition": ";", "indent": ":",
             "rule": "----", "raw": "<", "magic": "__"},
    "latex": {"command": "\\", "escape": "\\", "accent": "\\", "math": "$", "display": "$$", "paren": "\\", "break": "\\\\", "group": "{\\", "comment": " % "},
}


def pieces(text: str, kind: str, weak: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, name) of every piece of a kind, grouped by name."""
    out = []
    for name, scan in (COMPILED_WEAK if weak else COMPILED)[kind].items():
        first = None if weak else _FIRST[kind].get(name)
        if first and first not in text:
            continue
        out += [(a, b, name) for a, b in (scan(text) if callable(scan) else (m.span() for m in scan.finditer(text)))]
    return out
