"""Text functions as Column expressions; the few Catalyst lacks are Arrow UDFs."""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable
from difflib import SequenceMatcher
from functools import cache
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Python's ``str.split`` knows it, as the inside of a Java character class.
PY_SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
TOKEN = r"[\p{L}\p{N}\p{Co}]+"


@cache
def fold_table() -> tuple[str, str]:
    """(from, to) for ``translate``: lower case and, for Latin letters, no diacritics; combining marks at the end vanish."""
    src, dst = [], []
    for i in range(0x80, 0x2000):
        c = chr(i)
        low = c.lower()
        base = unicodedata.normalize("NFD", low)
        folded = base[0] if base[0].isascii() and base[0].isalpha() and all(map(unicodedata.combining, base[1:])) else low
        if len(folded) == 1 and folded != c:
            src.append(c)
            dst.append(folded)
    return "".join(src) + "".join(map(chr, range(0x300, 0x370))), "".join(dst)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row. A lambda would otherwise compute an expression it refers to for every element."""
    return F.transform(F.array(value), body)[0]


def sanitize(c: Column) -> Column:
    """Control characters other than tab and line ends become spaces."""
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ")


def tokens(c: Column) -> Column:
    """Words of a text, folded; NULL gives none. Folding before extracting keeps the whole in native code."""
    src, dst = fold_table()
    return F.coalesce(F.regexp_extract_all(F.translate(F.lower(sanitize(c)), src, dst), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def fold_words(text: str) -> list[str]:
    """The words of a query text, on the driver, as ``tokens`` has them."""
    src, dst = fold_table()
    table = {ord(c): dst[i] if i < len(dst) else None for i, c in enumerate(src)}
    return re.findall(r"[^\W_]+", text.lower().translate(table))


def split_words(c: Column) -> Column:
    """White-space separated words, as Python splits them."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), f"[{PY_SPACE}]+"), lambda w: w != "")


def windows(c: Column, size: int = 350, overlap: int = 50) -> Column:
    """Overlapping word windows of a text; the last one reaches its end; no words give none."""
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the window")
    step = size - overlap

    def cut(words: Column) -> Column:
        n = F.size(words)
        count = F.when(n == 0, 0).otherwise(1 + F.ceil(F.greatest(n - size, F.lit(0)) / step)).cast("int")
        starts = F.when(count > 0, F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i * step + 1, size), " "))

    return let(split_words(c), cut)


def chunked(rows: DataFrame, column: str = "text", chunker: Callable[[Column], Column] = windows) -> DataFrame:
    """One row per passage of a text: ``chunk_index`` and ``text``; ``chunker`` turns a text column into an array of passages."""
    keep = [c for c in rows.columns if c not in (column, "chunk_index", "text")]
    return rows.select(*keep, F.posexplode(chunker(F.col(column))).alias("chunk_index", "text"))


def merge_windows(passages: Column, overlap: int = 50) -> Column:
    """Text of windows in order, leaving out the words a window repeats from the one before.

    What is left out was there already, so the text so far ends as the windows themselves do: whether a window repeats is read off the few in
    front of it, and no text is copied for each."""
    spaced = lambda t: F.trim(F.regexp_replace(F.coalesce(t, F.lit("")), f"[{PY_SPACE}]+", " "))
    parts = F.filter(F.transform(passages, spaced), lambda t: t != "")
    if not overlap:
        return F.array_join(parts, " ")
    end = lambda ws: F.when(F.size(ws) > overlap, F.slice(ws, -overlap, overlap)).otherwise(ws)

    def rest(ts: Column) -> Column:
        # Each has a word, so as many as the words asked for suffice.
        several = lambda k: F.flatten(F.transform(F.slice(ts, F.greatest(k - overlap, F.lit(0)) + 1, F.least(k, F.lit(overlap))), lambda t: let(F.split(t, " "), end)))
        tail = lambda k: let(F.split(F.get(ts, k - 1), " "), lambda ws: F.when(F.size(ws) >= overlap, end(ws)).otherwise(let(several(k), end)))
        left = lambda ws, t, k: F.when(F.size(ws) < overlap, t).when(F.slice(ws, 1, overlap) == tail(k), F.array_join(F.slice(ws, overlap + 1, F.size(ws)), " ")).otherwise(t)
        return F.transform(ts, lambda t, k: let(F.split(t, " "), lambda ws: left(ws, t, k)))

    return F.array_join(F.filter(let(parts, rest), lambda t: t != ""), " ")


# What a paper's list of references begins with.
REFERENCE_HEADS = (
    r"\\begin\{thebibliography\}",
    r"\\bibliography\{",
    r"\\printbibliography",
    r"\n\s*references\s*\n",
    r"\n\s*bibliography\s*\n",
    r"\n\s*acknowledgments?\s*\n",
    r"\n\s*literature cited\s*\n",
)


def trim_references(c: Column, heads: tuple[str, ...] = REFERENCE_HEADS) -> Column:
    """The text in front of its reference list, without white space at its end; NULL and empty stay."""
    at = F.regexp_instr(c, F.lit("(?iU)(?:" + "|".join(heads) + ")"))
    return F.when(at > 0, F.regexp_replace(F.substring(c, F.lit(1), at - 1), f"[{PY_SPACE}]+$", "")).otherwise(c)


def year_prefix(c: Column) -> Column:
    """The four digits a date text begins with, else NULL."""
    return F.nullif(F.regexp_extract(c, r"^([0-9]{4})(?![0-9])", 1), F.lit(""))


def partial_date(year: Column, month: Column, day: Column) -> Column:
    """ISO date of the precision its parts allow; a month may be a number or a name."""
    names = "jan feb mar apr may jun jul aug sep oct nov dec".split()
    named = F.array_position(F.array(*map(F.lit, names)), F.lower(F.substring(F.trim(month), 1, 3)))
    m = F.when(F.trim(month).rlike(r"^\d{1,2}$"), F.trim(month).cast("int")).otherwise(F.nullif(named, F.lit(0)).cast("int"))
    m = F.when(m.between(1, 12), m)
    d = F.when(F.trim(day).rlike(r"^\d{1,2}$"), F.trim(day).cast("int"))
    full = F.when(F.try_make_timestamp(year.cast("int"), m, d, F.lit(0), F.lit(0), F.lit(0)).isNotNull(), F.format_string("%04d-%02d-%02d", year.cast("int"), m, d))
    return F.when(year.rlike(r"^\d{4}$"), F.coalesce(full, F.when(m.isNotNull(), F.format_string("%04d-%02d", year.cast("int"), m)), year))


def paper_id(url: Column) -> Column:
    """Identifier in an abstract or PDF address."""
    return F.regexp_replace(F.regexp_replace(url, r"^.*/(?:abs|pdf)/", ""), r"\.pdf$", "")


def without_version(c: Column) -> Column:
    return F.regexp_replace(c, r"v\d+$", "")


def abstract_from_positions(index: Column) -> Column:
    """Text of a word -> positions map; of two words at one position the last in the map stays."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e, i: F.transform(e["value"], lambda p: F.struct(p.alias("p"), i.alias("i"), e["key"].alias("w")))))

    def last_ones(ordered: Column) -> Column:
        kept = F.filter(ordered, lambda x, i: (i == F.size(ordered) - 1) | (F.get(ordered, i + 1)["p"] != x["p"]))
        return F.array_join(F.transform(kept, lambda x: x["w"]), " ")

    return let(F.array_sort(pairs), last_ones)


def escape_cell(c: Column) -> Column:
    """A quote in front of text a spreadsheet would run as a formula; plain numbers stay."""
    number = c.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$")
    return F.when(c.startswith("'") | (c.rlike(r"^[=+\-@\t\r]") & ~number), F.concat(F.lit("'"), c)).otherwise(c)


def unescape_cell(c: Column) -> Column:
    """What ``escape_cell`` was given."""
    rest = F.substring(c, F.lit(2), F.length(c))
    return F.when(c.startswith("'") & rest.rlike(r"^['=+\-@\t\r]"), rest).otherwise(c)


def bounded_error(c: Column, most: int = 4096) -> Column:
    """An error text cut to ``most`` characters, the marker of the cut included."""
    mark = "... [truncated]"
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - len(mark)), F.lit(mark))).otherwise(c)


def document_text(title: Column, abstract: Column) -> Column:
    """Title and abstract joined by a blank line; blank ones left out."""
    return F.array_join(F.filter(F.array(title, abstract), lambda x: x.isNotNull() & (F.trim(x) != "")), "\n\n")


def normal_key(value: object) -> str:
    """Comparison key of a value: compatibility-folded, case-folded letters, marks, numbers and symbols; containers and missing give ""."""
    if value is None or isinstance(value, (list, dict, tuple, set)) or value != value:
        return ""
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", str(value)).casefold())
    return unicodedata.normalize("NFC", "".join(c for c in folded if unicodedata.category(c)[0] in "LMNS"))


@F.pandas_udf(T.StringType())
def _normal_key_udf(s: pd.Series) -> pd.Series:
    return s.map(normal_key)


def key_of(c: Column) -> Column:
    """``normal_key`` of a text column; plain ASCII never leaves the JVM."""
    t = F.coalesce(c.cast("string"), F.lit(""))
    plain = F.regexp_replace(F.lower(t), r"[^\p{L}\p{M}\p{N}\p{S}]", "")
    return F.when(t.rlike(r"[^\x00-\x7f]"), _normal_key_udf(F.when(t.rlike(r"[^\x00-\x7f]"), t))).otherwise(plain)


def compatibility_folded(value: str) -> str:
    """One spelling of a text's letters: compatibility forms and case folded."""
    return unicodedata.normalize("NFKC", value).casefold()


@F.pandas_udf(T.StringType())
def _folded_udf(s: pd.Series) -> pd.Series:
    return s.map(compatibility_folded, na_action="ignore")


WORD_RUNS = r"[\p{L}\p{M}]+|\p{N}+"


def keyword_tokens(c: Column) -> Column:
    """Runs of letters and runs of digits as separate words, compatibility and case folded; plain ASCII never leaves the JVM."""
    other = c.rlike(r"[^\x00-\x7f]")
    folded = F.when(other, _folded_udf(F.when(other, c))).otherwise(F.lower(c))
    return F.coalesce(F.regexp_extract_all(folded, F.lit(WORD_RUNS), F.lit(0)), F.array().cast("array<string>"))


def keyword_words(text: str) -> tuple[str, ...]:
    """``keyword_tokens`` of one text, on the driver."""
    import regex

    return tuple(regex.findall(WORD_RUNS, compatibility_folded(text)))


def content_hash(value: object) -> str:
    """SHA-256 of compact JSON with sorted keys."""
    return sha256(json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True).encode()).hexdigest()


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
# Abbreviations of scientific prose whose full stop ends no sentence.
ABBREVIATIONS = frozenset("al app approx ca cf ch eq eqs fig figs no nos pp ref refs resp sec sect sects tab tabs viz vol vs".split())
_CLOSING = re.compile(r"[.!?]+[\"')\]]*(?=\s)")
_BLANK_LINES = re.compile(r"\n[ \t]*\n\s*")
_LAST_WORD = re.compile(r"\S{0,40}\Z")
_LETTERS_WITH_STOPS = re.compile(r"(?:[A-Za-z]\.)+[A-Za-z]")
_SOLID = re.compile(r"\S")


def sentence_bounds(text: str) -> list[tuple[int, int]]:
    """[start, end) of every sentence, without the white space between them. A text is cut at blank lines and behind marks of an end that white
    space follows; no cut lies in front of a small letter, or behind the full stop of an abbreviation or of letters with stops (``e.g.``)."""
    cuts = {0, len(text), *(m.end() for m in _BLANK_LINES.finditer(text))}
    for m in _CLOSING.finditer(text):
        after = _SOLID.search(text, m.end())
        if after is None or after[0].islower():
            continue
        if m[0][0] == ".":
            word = _LAST_WORD.search(text[max(0, m.start() - 40) : m.start()])[0].lstrip("([\"'")
            if word.lower() in ABBREVIATIONS or _LETTERS_WITH_STOPS.fullmatch(word):
                continue
        cuts.add(m.end())
    out, places = [], sorted(cuts)
    for a, b in zip(places, places[1:]):
        inside = text[a:b]
        if bare := inside.strip():
            start = a + inside.index(bare[0])
            out.append((start, start + len(bare)))
    return out


@F.pandas_udf(SPANS)
def _sentences_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda t: [{"start": a, "end": b} for a, b in sentence_bounds(t)] if t else [])


def sentences(c: Column) -> Column:
    """Array of sentence spans of a text."""
    return _sentences_udf(c)


def locate_quote(text: str | None, quote: str | None, least: float = 0.9) -> tuple[int, int, float] | None:
    """(start, end, ratio) of the sentences of a text that hold a quote, or None.

    A quote that occurs up to white space has ratio 1 and gives the sentences it reaches into. Otherwise every sentence and pair of
    neighbours is aligned with it: twice the characters in common runs of three or more, over the quote's length and the length of the stretch
    those runs span. The best ratio of at least ``least`` wins, of equal ones the shortest, then the first.
    """
    if not 0 <= least <= 1:
        raise ValueError("a ratio lies between 0 and 1")
    wanted = " ".join((quote or "").split())
    bounds = sentence_bounds(text) if text and wanted else []
    if not bounds:
        return None
    exact = re.search(r"\s+".join(map(re.escape, wanted.split(" "))), text)
    if exact:
        starts = [a for a, _ in bounds]
        first, last = (max(bisect_right(starts, at) - 1, 0) for at in (exact.start(), exact.end() - 1))
        return bounds[first][0], max(bounds[last][1], exact.end()), 1.0
    letters, found = Counter(wanted), None
    for size in (1, 2):
        for (a, _), (_, b) in zip(bounds, bounds[size - 1 :]):
            ratio = _overlap(wanted, letters, re.sub(r"\s+", " ", text[a:b]), found[0] if found else least)
            if ratio is not None and (found is None or (ratio, a - b, -a) > found):
                found = (ratio, a - b, -a)
    return (-found[2], -found[2] - found[1], found[0]) if found else None


def _overlap(wanted: str, letters: Counter, span: str, need: float) -> float | None:
    """Ratio of two texts if it can reach ``need``. No alignment has more characters than both sides share, nor spans fewer than it has."""
    most = (letters & Counter(span)).total()
    if 2 * most / (len(wanted) + most) < need:
        return None
    runs = [r for r in SequenceMatcher(None, wanted, span, autojunk=False).get_matching_blocks() if r.size >= 3]
    if not runs:
        return None
    ratio = 2 * sum(r.size for r in runs) / (len(wanted) + runs[-1].b + runs[-1].size - runs[0].b)
    return ratio if ratio >= need else None


LOCATED = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("ratio", T.DoubleType())])


@F.pandas_udf(LOCATED)
def _locate_udf(text: pd.Series, quote: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([locate_quote(t, q) or (None, None, None) for t, q in zip(text, quote)], columns=["start", "end", "ratio"]).astype({"start": "Int32", "end": "Int32", "ratio": "float64"})


def located(text: Column, quote: Column) -> Column:
    """Where a text holds a quote; NULL fields when it does not."""
    return _locate_udf(text, quote)
