"""Splitting oversized texts at natural boundaries.

Atomic segments are paragraphs (cut at blank lines); one that is over the limit falls into sentences (line ends and ends of sentences), a
sentence over the limit into words (white space), and a run without white space over the limit anywhere. Adjacent segments then merge
agglomeratively: a heap holds the boundaries of all adjacent pairs, the weakest is removed first while both sides plus the overlap fit the
limit. The weakest boundary that is left says at which level the text had to be cut. Consecutive pieces share up to ``overlap`` characters,
less where a segment leaves no room for them, from a segment or word boundary where there is one. Every character of the text is in some
piece; pieces in order, without their overlaps, give the text back.

Defined results: NULL texts and texts within the limit are not cut (one piece; none for NULL and empty). Replays of a
chunk collapse. Length counts code points; white space at a segment's ends does not make it oversized. A text of any length costs n log n.
"""

from __future__ import annotations

import bisect
import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT, OVERLAP = 2_000, 200

# Abbreviations that end in a full stop inside a sentence, in lower case without it.
ABBREVIATIONS = frozenset(
    "fig figs tab tabs eq eqs sec sect secs ref refs no nos vol vols pp p ch chap app ed eds et al etc cf vs approx ca resp incl excl e.g i.e viz "
    "dr mr mrs ms prof st jr sr inc ltd co dept univ min max avg temp obs abb nr z.b z d.h u.a bzw usw vgl ggf evtl sog s.o s.u bd hrsg aufl ders env "
    "par ex p.ex c.-à-d art pág págs núm cap dcha izq sra sr dña ej рис табл см стр гл др т.е т.д т.п напр ср изд рр jan feb mar apr jun jul aug sep "
    "sept oct nov dec".split()
)
_END = re.compile(r"(?:[.!?…]+[\"'”’»)\]]*(?=\s)|[。！？]+[”’」』）]*)\s*")
_BLANK = re.compile(r"\s*(?:\r\n|\r|\n)[^\S\r\n]*(?:\r\n|\r|\n)\s*")
_LINE = re.compile(r"(?:\r\n|\r|\n)\s*")
_SPACE = re.compile(r"\s+")
_WORD_BEFORE = re.compile(r"[^\s(\[\"'“«]*$")


def _cuts(text: str, pattern: re.Pattern) -> list[int]:
    return [m.end() for m in pattern.finditer(text) if 0 < m.end() < len(text)]


def sentence_cuts(text: str) -> list[int]:
    """Places behind the ends of sentences; abbreviations, initials and a following small letter do not end one."""
    out = []
    for m in _END.finditer(text):
        if not 0 < m.end() < len(text):
            continue
        mark = text[m.start()]
        after = text[m.end()]
        if mark in "。！？":
            out.append(m.end())
            continue
        if after.islower():
            continue
        if mark == "." and text[m.start() : m.start() + 2] != "..":
            word = _WORD_BEFORE.search(text, max(0, m.start() - 24), m.start())[0]
            if word.lower() in ABBREVIATIONS or (len(word) == 1 and word.isalpha() and word.isupper()) or re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", word):
                continue
        out.append(m.end())
    return out


PARAGRAPH, LINE, SENTENCE, WORD, ANYWHERE = 3, 2, 1, 0, -1


def atoms(text: str, limit: int = LIMIT) -> tuple[list[int], list[int]]:
    """(starts, strengths of the boundaries there) of the atomic segments; none is longer than the limit."""
    segments = [(0, len(text), 9, PARAGRAPH)]

    def refine(cuts: list[tuple[int, int]], level: int) -> None:
        """Cuts the segments over the limit at the places that lie inside them."""
        nonlocal segments
        places, out = [c for c, _ in cuts], []
        for a, b, s, own in segments:
            if b - a > limit and len(text[a:b].strip()) > limit:
                inside = cuts[bisect.bisect_right(places, a) : bisect.bisect_left(places, b)]
                starts = [(a, s), *inside]
                out += [(x, y, w, level) for (x, w), y in zip(starts, [*(c for c, _ in inside), b])]
            else:
                out.append((a, b, s, own))
        segments = out

    refine([(c, PARAGRAPH) for c in _cuts(text, _BLANK)], PARAGRAPH)
    if any(b - a > limit for a, b, *_ in segments):
        lines = _cuts(text, _LINE)
        refine(sorted({**dict.fromkeys(sentence_cuts(text), SENTENCE), **dict.fromkeys(lines, LINE)}.items()), SENTENCE)
        refine([(c, WORD) for c in _cuts(text, _SPACE)], WORD)
    starts, strengths = [], []
    for a, b, s, own in segments:
        starts.append(a), strengths.append(s)
        if b - a <= limit:
            continue
        # A run without white space is cut anywhere; white space that makes a segment too long parts as its level does.
        solid = len(text[a:b].strip()) > limit
        begin = a + len(text[a:b]) - len(text[a:b].lstrip())
        end = b if solid else max(len(text[a:b].rstrip()) + a, a)
        at = a
        while b - at > limit:
            if at < begin:
                at = min(begin, at + limit)
            elif at < end and end - at <= limit and not solid:
                at = end if end > at else at + limit
            else:
                at += limit
            if at < b:
                starts.append(at), strengths.append(ANYWHERE if solid and at > begin else own)
    return starts, strengths


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[str, list[tuple[int, int, int]]]:
    """(boundary level, pieces as (start, end, length of the overlap with the piece before))."""
    if limit <= 0 or not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    a, s = atoms(text, limit)
    b, n = [*a[1:], len(text)], len(a)
    left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
    room = lambda i: limit if left[i] < 0 else limit - overlap  # the first piece shares nothing
    # Weakest boundary first; of equal ones that of the smaller pair, then the earlier.
    heap = [(s[i], b[i] - a[i - 1], i) for i in range(1, n)]
    heapq.heapify(heap)
    while heap:
        w, size, i = heapq.heappop(heap)
        if not alive[i] or left[i] < 0:
            continue
        j = left[i]
        if size != b[i] - a[j]:
            if b[i] - a[j] <= room(j):
                heapq.heappush(heap, (w, b[i] - a[j], i))
            continue
        if size > room(j):
            continue
        b[j], right[j], alive[i] = b[i], right[i], False
        if right[i] >= 0:
            left[right[i]] = j
            heapq.heappush(heap, (s[right[i]], b[right[i]] - a[j], right[i]))
        if left[j] >= 0:
            heapq.heappush(heap, (s[j], b[j] - a[left[j]], j))
    kept = [i for i in range(n) if alive[i]]
    weakest = min((s[i] for i in kept[1:]), default=PARAGRAPH)
    pieces = []
    for i in kept:
        shared, most = 0, min(overlap, limit - (b[i] - a[i]))
        if pieces and most > 0:
            low = max(a[i] - most, pieces[-1][0] + 1)
            inside = a[_first(a, low) : _first(a, a[i])]
            space = next((m.end() for m in _SPACE.finditer(text, low, a[i]) if m.end() < a[i]), None) if not inside else None
            start = inside[0] if inside else space if space is not None else low
            shared = a[i] - start
        pieces.append((a[i] - shared, b[i], shared))
    return {PARAGRAPH: "paragraph", LINE: "sentence", SENTENCE: "sentence", WORD: "word", ANYWHERE: "none"}.get(weakest, "paragraph"), pieces


def _first(values: list[int], low: int) -> int:
    return bisect.bisect_left(values, low)


PIECES = T.StructType(
    [
        T.StructField("boundary", T.StringType()),
        T.StructField("pieces", T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("overlap", T.IntegerType())]))),
    ]
)


@F.pandas_udf(PIECES)
def _split_udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in batches:
        rows = []
        for t in s:
            level, pieces = split(t) if t is not None else (None, [])
            rows.append((level, [(t[x:y], o) for x, y, o in pieces]))
        yield pd.DataFrame(rows, columns=["boundary", "pieces"])


def oversized(chunks: DataFrame) -> DataFrame:
    """(chunk_id, record_id, chunk_index, r): split texts of the distinct chunks over the limit. Short ones never leave the JVM."""
    long = chunks.where(F.length("text") > LIMIT).select("chunk_id", "record_id", "chunk_index", "text").dropDuplicates(["chunk_id"])
    return long.select("chunk_id", "record_id", "chunk_index", _split_udf("text").alias("r"))


def split_chunks(chunks: DataFrame) -> DataFrame:
    """(chunk_id, record_id, chunk_index, piece, text, overlap, boundary) of every distinct chunk with a non-empty text."""
    cut = oversized(chunks).select("chunk_id", "record_id", "chunk_index", F.col("r.boundary").alias("boundary"), F.posexplode("r.pieces").alias("piece", "p"))
    cut = cut.select("chunk_id", "record_id", "chunk_index", "piece", F.col("p.text").alias("text"), F.col("p.overlap").alias("overlap"), "boundary")
    short = chunks.where(F.length("text").between(1, LIMIT)).select("chunk_id", "record_id", "chunk_index", "text").dropDuplicates(["chunk_id"])
    whole = short.select("chunk_id", "record_id", "chunk_index", F.lit(0).alias("piece"), "text", F.lit(0).alias("overlap"), F.lit("whole").alias("boundary"))
    return cut.unionByName(whole)


def boundaries(chunks: DataFrame) -> DataFrame:
    """(chunk_id, boundary): the coarsest level at which all pieces of an oversized chunk fit."""
    return oversized(chunks).select("chunk_id", F.col("r.boundary").alias("boundary"))
