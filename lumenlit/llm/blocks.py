"""Clean text from marked-up text, as flat blocks.

A field is a flat list of blocks, parted by blank lines, each with its word count and link density and those of both neighbours. Two decision
trees, trained on the small labelled tables ``RESIDUE_ROWS`` and ``LABELLED``, read them. The first says, for each kind of markup, whether the
pieces scanned in a block and around it are residue of that kind or only resemble it; a field holds the kinds of its blocks. Markup of these
kinds becomes line structure and hints, and the second tree says what each block of the text is: heading, list, code, formula, table, text or
navigation. Headings come out as ``# x``, list items as ``- x``, code between fences, formulas between ``$$``, table rows with tabs;
navigation (short blocks made of links among others of the kind) is left out.

Defined results: NULL and blank fields hold no markup and give empty text; fields and pieces of any length pass in linear time;
repeated documents repeat; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlit.llm import markup

#: Hints that converters leave in the text: start and end of link text, start of a heading, item, code, formula or table block.
LINK, KNIL, HEAD, ITEM, CODE, MATH, ROW = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004", "\ue005", "\ue006"
_HINTS = re.compile(f"[{LINK}{KNIL}{HEAD}{ITEM}{CODE}{MATH}{ROW}]")


def _put(t: str, opener: str, closer: str, make: Callable[[re.Match, str], str], flags: int = re.I) -> str:
    """The text with every closed span from ``opener`` to ``closer`` (patterns) replaced by ``make(opening match, inside)``."""
    start = re.compile(opener, flags)
    if not start.search(t):
        return t
    out, at = [], 0
    for m, a, b in markup.between(t, start, re.compile(closer, flags)):
        out += [t[at : m.start()], make(m, t[m.end() : a])]
        at = b
    return "".join(out) + t[at:]


def _code(inside: str) -> str:
    return f"\n\n{CODE}" + inside.strip("\n").replace("\n\n", "\n") + "\n\n"


def _formula(inside: str) -> str:
    return f"\n\n{MATH}" + " ".join(inside.split()) + "\n\n"


def _cells(line: str, mark: str) -> str:
    """One table row; cells with tabs between them."""
    return f"\n\n{ROW}" + "\t".join(c.strip() for c in re.split(mark, line)) + "\n\n"


def _from_html(t: str) -> str:
    sub = lambda p, r, s: re.sub(p, r, s, flags=re.I)
    none = lambda m, x: ""
    t = _put(t, "<!--", "-->", none)
    t = re.sub(r"<!DOCTYPE[^<>]*+>|<\?xml[^<>]*+\?>", "", t)
    t = t.replace("<![CDATA[", "").replace("]]>", "")
    for name in ("script", "style"):
        t = _put(t, rf"<{name}\b[^<>]*+>", rf"</{name}\s*+>", none)
    t = _put(t, r"<pre\b[^<>]*+>", r"</pre\s*+>", lambda m, x: _code(re.sub(r"</?code[^<>]*+>", "", x)))
    t = sub(r"</?code\b[^<>]*+>", "`", t)
    t = _put(t, r"<a\b[^<>]*+>", r"</a\s*+>", lambda m, x: LINK + x + KNIL)
    t = _put(t, r"<sup\b[^<>]*+>", r"</sup\s*+>", lambda m, x: "^" + x)
    t = sub(r"<(?:h[1-6]|jats:title|title)\b[^<>]*+>", f"\n\n{HEAD}", t)
    t = sub(r"<li\b[^<>]*+>\s*+", f"\n\n{ITEM}", t)
    t = sub(r"<tr\b[^<>]*+>\s*+", f"\n\n{ROW}", t)
    t = sub(r"</t[dh]\s*+>\s*+<t[dh]\b[^<>]*+>", "\t", t)
    t = sub(r"<br\b[^<>]*+>", "\n", t)
    t = sub(r"</?(?:p|div|ul|ol|nav|table|tbody|thead|h[1-6]|jats:(?:p|title|sec)|title|li|tr|blockquote|section|article|center|hr)\b[^<>]*+>", "\n\n", t)
    t = re.sub(markup.TAG, "", t)
    for _ in range(2):  # references are at times escaped twice
        t = re.sub(markup.REFERENCE, lambda m: html.unescape(m[0]) if m[0][1] == "#" or m[0][1:-1] in markup.ENTITIES else m[0], t)
    return t


def _from_markdown(t: str) -> str:
    sub = lambda p, r, s: re.sub(p, r, s, flags=re.M)
    t = _put(t, r"^```[^\n]*+\n", r"^```[^\n]*+$", lambda m, x: _code(x), re.M)
    t = sub(r"^#{1,6} ++([^\n]++)$", lambda m: f"\n\n{HEAD}" + m[1].rstrip(" ").rstrip("#").rstrip(" ") + "\n\n", t)
    t = sub(r"^([^\n]++)\n(?:={3,}+|-{3,}+)[ \t]*+$", lambda m: f"\n\n{HEAD}{m[1]}\n\n" if m[1].strip(" \t|") else m[0], t)
    t = sub(r"^\|(?:[ :]*+-{3,}+[ :]*+\|)++[ \t]*+\n?", "", t)
    t = sub(r"^\|([^\n]*)\|[ \t]*+$", lambda m: _cells(m[1], r"\|"), t)
    t = sub(r"^[*+-] (?:\[[ xX]\] )?", f"\n\n{ITEM}", t)
    t = sub(r"^> ?(?=\S)", "", t)
    t = re.sub(r"!\[([^\[\]\n]*+)\]\([^()\n]*+\)", r"\1", t)
    t = re.sub(r"\[([^\[\]\n]*+)\]\((?:<[^<>\n]*+>|[^\s()]++)(?:\s++\"[^\"\n]*+\")?\)", f"{LINK}\\1{KNIL}", t)
    t = re.sub(markup.MARKDOWN["footnote"], "", t)
    t = re.sub(r"\[([^\[\]\n]++)\]\[[A-Za-z][\w-]*+\]", f"{LINK}\\1{KNIL}", t)
    for name, n in (("strong", None), ("under_strong", 2), ("struck", 2), ("emphasis", 1), ("under_emphasis", 1)):
        t = re.sub(markup.MARKDOWN[name], lambda m, n=n: m[0].strip("*") if n is None else m[0][n:-n], t)
    return t


def _from_wiki(t: str) -> str:
    sub = lambda p, r, s: re.sub(p, r, s, flags=re.M)
    t = sub(r"\{\{code\|([^{}]*+)\}\}", lambda m: _code(m[1].replace("; ", "\n")), t)
    t = sub(r"\{\{[^\s{}][^{}]*+\}\}", "", t)
    t = sub(r"^\{\|[^\n]*+\n?|^\|\}[ \t]*+$|^\|-[^\n]*+\n?", "", t)
    t = sub(r"^[|!] ?([^\n]*+)$", lambda m: _cells(m[1], r"\|\||!!"), t)
    t = sub(r"^={2,6}[^\n]++$", lambda m: f"\n\n{HEAD}{h}\n\n" if (h := markup.wiki_heading(m[0])) else m[0], t)
    t = sub(r"\[\[(?:File|Image|Category|Datei|Fichier|Файл):[^\[\]\n]*+\]\]", "", t)
    t = sub(r"\[\[([^\[\]\n]*+)\]\]", lambda m: LINK + m[1].rpartition("|")[2] + KNIL, t)
    t = sub(r"\[https?://[^\s\[\]]++ ?([^\[\]\n]*+)\]", f"{LINK}\\1{KNIL}", t)
    t = sub(r"<ref\b[^<>]*+(?<=/)>", "", t)
    t = _put(t, r"<ref\b[^<>]*+>", "</ref>", lambda m, x: "")
    t = sub(r"</?(?:nowiki|references|gallery|noinclude)\b[^<>]*+>|__(?:NO)?TOC__", "", t)
    t = sub(r"^;([^\n]++)\n:[ \t]*+", r"\1: ", t)
    t = sub(r"^[*#]{1,3}[ \t]*+(?=[^\W\d])", f"\n\n{ITEM}", t)
    t = sub(r"^:++[ \t]*+", "", t)
    t = sub(r"(?:\A|\n\n)-{4,}+[ \t]*+$", "\n", t)
    t = sub(r"'''([^\n]+?)'''", r"\1", t)
    return re.sub(markup.WIKI["italic"], lambda m: m[0][2:-2], t)


_ACCENTS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "=": "\u0304", ".": "\u0307"}


def _from_latex(t: str) -> str:
    sub = lambda p, r, s: re.sub(p, r, s, flags=re.M)
    for name in ("verbatim", "lstlisting"):
        t = _put(t, rf"\\begin\{{{name}\}}[^\n]*+\n", rf"\\end\{{{name}\}}", lambda m, x: _code(x), 0)
    t = sub(markup.LATEX["comment"], "", t)
    for name in ("equation", "align", "displaymath", "eqnarray"):
        t = _put(t, rf"\\begin\{{{name}\*?\}}", rf"\\end\{{{name}\*?\}}", lambda m, x: _formula(x), 0)
    t = _put(t, r"\\\[", r"\\\]", lambda m, x: _formula(x), 0)
    t = sub(r"^\$\$([^$]++)\$\$$", lambda m: _formula(m[1]), t)
    t = _put(t, r"\\begin\{tabular\}(?:\{[^{}]*+\})?", r"\\end\{tabular\}", lambda m, x: "".join(_cells(r.strip(), r"(?<!\\)&") for r in x.replace("\\hline", "").split("\\\\") if r.strip()) + "\n\n", 0)
    t = sub(r"\\(?:sub)*+(?:section|paragraph|chapter)\*?\{([^{}]*+)\}", f"\n\n{HEAD}\\1\n\n", t)
    t = sub(r"\\(?:label|cite[pt]?|ref|eqref|bibliography|input|includegraphics)(?:\[[^\[\]]*+\])?\{[^{}]*+\}", "", t)
    t = sub(r"\\item(?:\[[^\[\]]*+\])?[ \t]*+", f"\n\n{ITEM}", t)
    t = sub(r"\\(?:begin|end)\{[^{}]*+\}(?:\{[^{}]*+\}|\[[^\[\]]*+\])*+", "\n\n", t)
    t = sub(r"\\footnote\{([^{}]*+)\}", r" (\1)", t)
    t = sub(r"\{\\(?:it|bf|em|rm|tt|sc|sl)\s++([^{}]*+)\}", r"\1", t)
    kept: list[str] = []

    def keep(whole: str) -> str:
        kept.append(whole)
        return f"\ue010{len(kept) - 1}\ue011"

    t = sub(markup.LATEX["display"], lambda m: keep(m[0]), t)
    t = _put(t, r"\\\(", r"\\\)", lambda m, x: keep(m[0] + x + "\\)"), 0)
    t = sub(markup.LATEX["math"], lambda m: keep(m[0]), t)
    t = sub(r"(?<![\\:])\\(['\"`^~=.])(?:\{\\?([A-Za-z])\}|([A-Za-z]))", lambda m: unicodedata.normalize("NFC", (m[2] or m[3]) + _ACCENTS[m[1]]), t)
    t = sub(r"\\(?:emph|textbf|textit|texttt|text|mathrm|underline|url)\{([^{}]*+)\}", r"\1", t)
    t = sub(r"(?<!\\)\\([%&_$#{}])", r"\1", t)
    t = sub(r"(?<!\\)\\[,;! ]", " ", t)
    t = sub(r"(?<=[A-Za-z.])~(?=[A-Za-z0-9\\(\ue010])", " ", t)
    t = sub(r"\\\\[ \t]*+$", "", t)
    return re.sub("\ue010(\\d++)\ue011", lambda m: kept[int(m[1])] if int(m[1]) < len(kept) else m[0], t)


FROM = {"html": _from_html, "markdown": _from_markdown, "wiki": _from_wiki, "latex": _from_latex}

# The labelled table the tree is trained on. Columns: words, link density, the same of the block before and of
# the block behind (-1: none), hint (0 none, 1 heading, 2 item, 3 code, 4 formula, 5 row), share of letters, ends with a stop, label.
LABELLED = """
1 0 -1 -1 40 0 0 1.00 0 heading
1 0 35 0 60 0 0 1.00 0 heading
2 0 80 0 45 0 0 0.95 0 heading
2 0 -1 -1 22 0 1 1.00 0 heading
1 0 55 0 30 0 1 1.00 0 heading
4 0 30 0 12 0 1 0.90 0 heading
6 0 44 0 50 0 1 0.92 1 heading
3 0 12 0 25 0 0 0.90 0 heading
8 0 9 0 7 0 2 0.85 1 list
5 0 6 0 11 0 2 0.90 0 list
1 0 30 0 2 0 2 1.00 0 list
14 0 20 0 12 0 2 0.88 1 list
6 1 7 1 6 1 2 0.90 0 list
4 0 30 0 22 0 3 0.50 0 code
9 0 41 0 18 0 3 0.60 0 code
15 0 12 0 -1 -1 3 0.55 0 code
2 0 30 0 22 0 3 0.80 0 code
6 0 6 0 -1 -1 3 0.35 0 code
6 0 5 0 12 0 3 0.40 0 code
3 0 30 0 5 0 3 0.30 1 code
5 0 2 0 -1 -1 3 0.45 0 code
8 0 20 0 9 0 3 0.40 1 code
4 0 3 0 9 0 3 0.50 0 code
4 0 3 0 8 0 4 0.35 0 formula
5 0 40 0 9 0 4 0.40 1 formula
6 0 33 0 1 0 4 0.40 0 formula
3 0 25 0 -1 -1 4 0.35 0 formula
9 0 18 0 40 0 4 0.45 0 formula
5 0 30 0 1 0 0 0.35 0 formula
4 0 44 0 -1 -1 0 0.40 0 formula
3 0 22 0 2 0 0 0.30 0 formula
7 0 28 0 30 0 0 0.42 0 formula
3 0 40 0 3 0 5 0.40 0 table
4 0 3 0 4 0 5 0.45 0 table
3 0 4 0 20 0 5 0.60 0 table
9 0 20 0 30 0 0 0.40 0 table
12 0 44 0 35 0 0 0.35 0 table
15 0 1 0 40 0 0 0.30 0 table
12 0 28 0 1 0 0 0.42 0 table
30 0 1 0 28 0 0 0.85 1 text
44 0 30 0 1 0 0 0.82 1 text
12 0 25 0 33 0 0 0.80 1 text
70 0.05 2 0 50 0 0 0.83 1 text
9 0 40 0 35 0 0 0.85 1 text
25 0.1 18 0 22 0 0 0.80 0 text
1 0 30 0 60 0 0 0.90 1 text
5 0 22 0 27 0 0 0.80 1 text
18 0.5 30 0 20 0 0 0.85 1 text
6 0.2 35 0 40 0 0 0.85 1 text
40 0 -1 -1 -1 -1 0 0.60 0 text
50 0 1 0 1 0 0 0.88 1 text
22 0 1 0 -1 -1 0 0.90 1 text
35 0 2 0 40 0 0 0.92 1 text
60 0 -1 -1 2 0 0 0.95 1 text
15 0 1 0 15 0 0 0.90 1 text
28 0 3 0 6 0 0 0.97 1 text
80 0 1 0 30 0 0 0.78 0 text
13 0 4 0 1 0 0 0.96 0 text
18 0 1 0 9 0 0 0.95 0 text
10 0 1 0 20 0 0 0.98 1 text
7 0 1 0 22 0 0 0.98 1 text
3 0 1 0 45 0 0 0.97 1 text
33 0 -1 -1 1 0 0 0.99 0 text
90 0 2 0 80 0 0 0.99 1 text
1 0 45 0 38 0 0 1.00 0 heading
1 0 60 0 44 0 0 1.00 0 heading
2 0 33 0 70 0 0 1.00 0 heading
3 0 41 0 65 0 0 0.98 0 heading
1 0 -1 -1 52 0 0 1.00 0 heading
2 0 -1 -1 29 0 0 1.00 0 heading
2 0 51 0 1 0 0 1.00 0 heading
5 0 28 0 1 0 0 0.55 1 formula
4 0 50 0 2 0 0 0.60 1 formula
3 0 31 0 45 0 0 0.50 1 formula
5 0 1 0 33 0 0 0.52 0 formula
2 1 28 0 31 0 0 0.95 0 text
1 1 30 0 40 0 0 0.95 0 text
1 1 1 1 1 1 2 1.00 0 navigation
1 1 -1 -1 1 1 2 1.00 0 navigation
2 1 1 1 40 0 2 0.97 0 navigation
2 1 2 1 1 1 2 1.00 0 navigation
1 1 2 1 2 1 0 1.00 0 navigation
2 1 1 1 1 1 0 0.98 0 navigation
3 1 2 1 2 1 0 0.95 0 navigation
4 1 -1 -1 30 0 0 0.90 0 navigation
5 0.9 1 1 45 0 0 0.90 0 navigation
7 0.85 2 0 50 0 0 0.85 0 navigation
3 1 25 0 3 1 0 0.90 0 navigation
2 1 60 0 2 1 2 0.95 0 navigation
2 1 60 0 -1 -1 2 0.95 0 list
2 1 30 0 35 0 2 0.95 0 list
2 0.5 3 0.4 4 0.3 2 0.95 0 list
14 0 38 0 1 0 3 0.79 0 code
14 0 17 0 -1 -1 3 0.80 0 code
20 0 30 0 30 0 3 0.85 0 code
1 0 1 0 59 0 2 0.60 0 list
15 0 54 0 16 0 2 0.61 1 list
8 0 11 0 12 0 2 0.57 1 list
1 0 1 0 24 0 2 0.62 0 list
6 0 28 0 8 0 2 0.96 1 list
5 0 8 0 7 0 2 0.95 1 list
7 0 5 0 1 0 2 0.90 1 list
7 0 32 0 12 0 2 0.96 1 list
3 0 25 0 4 0 5 0.75 0 table
3 0 61 0 4 0 5 0.75 0 table
4 0 4 0 4 0 5 0.60 0 table
24 0 2 0 2 0 0 0.66 1 text
27 0 2 0 2 0 0 0.60 1 text
1 1 11 0 16 0.06 1 1.00 0 heading
2 0 12 0 25 0 1 0.95 0 heading
3 0.33 -1 -1 1 0 0 1.00 0 text
4 0.25 4 0 2 0 0 0.95 1 text
3 0.5 20 0 20 0 0 0.95 0 text
"""

# The labelled table of the tree that tells residue from resemblance. Columns: pieces of the kind in the block, weak pieces
# in the block, pieces of the kind in the block before and behind, words and link density of the block, of the one before and the one
# behind (-1: none), label.
RESIDUE_ROWS = """
1 0 0 0 40 0 30 0 50 0 markup
1 0 0 0 12 0 -1 -1 -1 -1 markup
1 0 0 0 300 0 -1 -1 -1 -1 markup
1 0 0 0 2000 0 40 0 -1 -1 markup
1 0 0 0 3 0 1 0 60 0 markup
1 2 0 0 25 0 -1 -1 30 0 markup
1 0 0 0 1 1 -1 -1 -1 -1 markup
1 0 0 0 5 0.8 20 0 30 0 markup
1 1 0 0 15 0.2 12 0 60 0 markup
2 0 0 0 60 0 -1 -1 -1 -1 markup
2 3 0 1 18 0 10 0 10 0 markup
2 0 1 0 33 0.1 15 0 -1 -1 markup
3 1 2 2 22 0.3 41 0.1 25 0.2 markup
4 0 0 0 70 0 -1 -1 -1 -1 markup
6 4 1 3 120 0.05 33 0 20 0 markup
9 0 4 0 12 0 30 0 -1 -1 markup
20 8 0 0 500 0.02 -1 -1 -1 -1 markup
1 0 5 3 2 0 30 0 30 0 markup
0 1 1 0 8 0 2 0 30 0 markup
0 1 0 1 8 0 30 0 3 0 markup
0 2 2 2 20 0 15 0 15 0 markup
0 3 1 1 14 0.2 9 0 12 0 markup
0 1 3 0 6 0 7 0 -1 -1 markup
0 1 0 4 2 0 -1 -1 20 0 markup
0 0 1 0 30 0 12 0 40 0 plain
0 0 0 1 30 0 12 0 40 0 plain
0 0 2 2 45 0 20 0 21 0 plain
0 0 0 0 80 0 -1 -1 -1 -1 plain
0 0 0 0 9 0 30 0 30 0 plain
0 1 0 0 20 0 30 0 30 0 plain
0 1 0 0 60 0 -1 -1 -1 -1 plain
0 2 0 0 15 0 10 0 10 0 plain
0 3 0 0 60 0 -1 -1 40 0 plain
0 5 0 0 200 0 60 0 -1 -1 plain
0 9 0 0 400 0 -1 -1 -1 -1 plain
0 1 0 0 2 0 50 0 50 0 plain
0 2 0 0 3 0 3 0 3 0 plain
"""


def _grow(x: np.ndarray, y: np.ndarray, depth: int) -> tuple:
    """CART with the Gini index; a leaf is (label,), a node (feature, threshold, left, right)."""
    names, counts = np.unique(y, return_counts=True)
    if depth == 0 or len(names) == 1:
        return (str(names[counts.argmax()]),)
    impure = lambda part: 1 - ((np.unique(part, return_counts=True)[1] / len(part)) ** 2).sum()
    best = (np.inf, 0, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= cut
            cost = left.mean() * impure(y[left]) + (~left).mean() * impure(y[~left])
            if cost < best[0] - 1e-12:
                best = (cost, f, float(cut))
    if not np.isfinite(best[0]):
        return (str(names[counts.argmax()]),)
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], _grow(x[left], y[left], depth - 1), _grow(x[~left], y[~left], depth - 1)


@cache
def tree(table: str) -> tuple:
    """The decision tree grown on a labelled table: features, then the label, on every line."""
    rows = [line.split() for line in table.strip().splitlines()]
    return _grow(np.array([[float(v) for v in r[:-1]] for r in rows]), np.array([r[-1] for r in rows]), 8)


def _label(features: tuple, table: str = LABELLED) -> str:
    node = tree(table)
    while len(node) > 1:
        node = node[2] if features[node[0]] <= node[1] else node[3]
    return node[0]


_STOP = tuple(".!?;:…。！？；：”\"')]")
_LINKED = re.compile(f"{LINK}([^{LINK}{KNIL}]*+){KNIL}")
_HAN = re.compile("[\u3400-\u9fff]")
_PARTS = re.compile(r"\n[ \t]*+\n\s*+")


def _words(t: str) -> int:
    return len(t.split()) + len(_HAN.findall(t)) // 2


def _linked_words(text: str, scanned: dict[str, list], part: Callable[[int], int]) -> Counter:
    """Words inside links, by block."""
    out, start = Counter(), None
    for kind, pieces in scanned.items():
        for a, b, name in sorted(pieces) if kind == "html" else pieces:
            if (kind, name) in markup.LINKS:
                out[part(a)] += _words(text[a:b])
            elif name == "tag" and text[a : a + 2].lower() == "<a" and text[a + 2 : a + 3] in (" ", ">", "\n"):
                start = b
            elif name == "tag" and text[a : a + 3].lower() == "</a" and start is not None:
                out[part(start)] += _words(text[start:a])
                start = None
    return out


def found(text: str | None) -> list[str]:
    """The markups of which some block of a text holds residue, in the order of ``KINDS``."""
    if not text or not text.strip():
        return []
    scanned = {k: p for k in markup.KINDS if (p := markup.pieces(text, k))}
    if not scanned:  # weak pieces alone are never residue
        return []
    starts = [0, *(m.end() for m in _PARTS.finditer(text))]
    part = lambda at: bisect_right(starts, at) - 1
    linked = _linked_words(text, scanned, part)

    @cache
    def size(i: int) -> tuple:
        if not 0 <= i < len(starts):
            return -1, -1
        n = _words(text[starts[i] : starts[i + 1] if i + 1 < len(starts) else len(text)])
        return n, min(1.0, linked[i] / max(n, 1))

    out = []
    for kind, pieces in scanned.items():
        strong = Counter(part(a) for a, _, _ in pieces)
        weak = Counter(part(a) for a, _, _ in markup.pieces(text, kind, weak=True))
        for i in sorted({*strong, *weak}):
            if _label((strong[i], weak[i], strong[i - 1], strong[i + 1], *size(i), *size(i - 1), *size(i + 1)), RESIDUE_ROWS) == "markup":
                out.append(kind)
                break
    return out


def blocks(text: str, kinds: list[str]) -> list[tuple[str, str]]:
    """(label, clean text) of every block of a text that holds the markups ``kinds``."""
    t = _HINTS.sub("", text.replace("\r\n", "\n")) if kinds else text.replace("\r\n", "\n")
    for kind in kinds:
        t = FROM[kind](t)
    parts = [p for p in (x.strip("\n") for x in re.split(r"\n[ \t]*\n\s*?", t)) if p.strip(" \t\n" + LINK + KNIL + HEAD + ITEM + CODE + MATH + ROW)]
    linked = bool(kinds) and LINK in t
    sizes = [(n := _words(_HINTS.sub("", p) if kinds else p), sum(_words(x) for x in _LINKED.findall(p)) / max(n, 1) if linked else 0.0) for p in parts]
    out = []
    for i, p in enumerate(parts):
        hint = {HEAD: 1, ITEM: 2, CODE: 3, MATH: 4, ROW: 5}.get(p.lstrip()[:1], 0)
        body = _HINTS.sub("", p) if kinds else p
        body = body.strip("\n") if hint == 3 else body.strip()
        before = sizes[i - 1] if i else (-1, -1)
        behind = sizes[i + 1] if i + 1 < len(sizes) else (-1, -1)
        letters = sum(map(str.isalpha, body)) / max(1, len(body) - body.count(" "))
        out.append((_label((*sizes[i], *before, *behind, hint, letters, float(body.endswith(_STOP)))), body))
    return out


def clean(text: str | None, kinds: list[str] | None = None) -> str:
    """The text without markup, with headings, lists, code, formulas and tables kept."""
    if not text or not text.strip():
        return ""
    out, before = [], ""
    for label, body in blocks(text, found(text) if kinds is None else kinds):
        if label == "navigation":
            continue
        shaped = {"heading": "# {}", "list": "- {}", "code": "```\n{}\n```", "formula": "$$ {} $$"}.get(label, "{}").format(body)
        out.append(("\n" if label == before and label in ("list", "table") else "\n\n") + shaped if out else shaped)
        before = label
    return "".join(out)


RESIDUE = T.StructType([T.StructField("markup", T.ArrayType(T.StringType())), T.StructField("clean", T.StringType())])


@F.pandas_udf(RESIDUE)
def residue(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """(markups found, clean text) of a text column."""
    for s in batches:
        kinds = [found(t) for t in s]
        yield pd.DataFrame({"markup": kinds, "clean": [clean(t, k) for t, k in zip(s, kinds)]})


@F.pandas_udf(T.ArrayType(T.StringType()))
def kinds_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The markups found in a text column."""
    for s in batches:
        yield s.map(found)


def _fields(documents: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("t")) for f in fields])).alias("e")
    return documents.select("doc_id", each).select("doc_id", "e.field_name", "e.t")


def clean_fields(documents: DataFrame, fields: tuple[str, ...] = ("abstract", "body")) -> DataFrame:
    """(doc_id, field_name, markup, clean): one row per document and field; one pass over the documents, no shuffle."""
    rows = _fields(documents, fields).select("doc_id", "field_name", residue("t").alias("r"))
    return rows.select("doc_id", "field_name", F.col("r.markup").alias("markup"), F.col("r.clean").alias("clean"))


def found_markup(documents: DataFrame, fields: tuple[str, ...] = ("abstract", "body")) -> DataFrame:
    """(doc_id, field_name, markup): one row for each markup of which some block of a field holds residue."""
    rows = _fields(documents, fields).select("doc_id", "field_name", kinds_of("t").alias("markup"))
    return rows.select("doc_id", "field_name", F.explode("markup").alias("markup"))
