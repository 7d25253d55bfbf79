"""Matching papers across sources that share no identifier.

1. Evidence per document, in the JVM: folded title words, years and parts of a series, author keys (surname and initial, from any of the
   metadata shapes), year, venue, and the set of hashed abstract words.
2. Candidates share a composite key: an adjacent pair of title words and an author, in neighbouring years (the year may be missing on one
   side); or the beginning of the abstract and a year, an author, or a pair of title words. A document without authors is looked for by all
   words of its title but one, and by an exact join of similar titles, whose keys are sets of up to three title words, rarest first: every title
   that holds three quarters of its words, or begins with three quarters of the shorter one's, is met, however common the words
   (``similar_titles``). Titles whose numbers differ are other titles.
3. Ten heuristic functions vote match, no match or abstain on each candidate: title, title words, numbers, authors, first author, year, venue,
   abstract, part of a series, kind of notice.
4. A generative label model learns each function's accuracy from the votes alone, with correlations as a tree of dependencies per class
   (Chow-Liu), by EM over the counts of vote patterns of pairs that both have authors. Its posterior is the confidence, and nothing overrules
   it: that a part of a series or a correction is another paper shows in the accuracy its function gets.

Defined results: documents with NULL source or without title and abstract match nothing; broken or NULL metadata abstains; several rows
of one record each match the other sources' rows; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlit.functions.text import let
from lumenlit.session import checkpoint

#: Posterior from which two documents describe one paper.
CONFIDENT = 0.9
FUNCTIONS = ("title", "words", "numbers", "authors", "first", "year", "venue", "abstract", "series", "notice")
#: Slots of the words' counts, by which the words of a title are ordered; any order finds the same pairs, rarest first with the fewest rows.
SLOTS = 1 << 16
#: Keys (of eight bytes) that are broadcast to sift the other side's.
BROADCAST_KEYS = 1_000_000
#: What the label model assumes of each function before it sees votes: how often it votes against, abstains, votes for, on pairs that are no match and on
#: matches; and what share of a class's pairs that opinion weighs.
PRIOR = {
    "title": ((0.75, 0.15, 0.10), (0.01, 0.09, 0.90)),
    "words": ((0.75, 0.15, 0.10), (0.01, 0.09, 0.90)),
    "numbers": ((0.50, 0.40, 0.10), (0.01, 0.50, 0.49)),
    "authors": ((0.40, 0.30, 0.30), (0.02, 0.10, 0.88)),
    "first": ((0.50, 0.30, 0.20), (0.05, 0.10, 0.85)),
    "year": ((0.20, 0.20, 0.60), (0.02, 0.10, 0.88)),
    "venue": ((0.20, 0.75, 0.05), (0.05, 0.75, 0.20)),
    "abstract": ((0.75, 0.20, 0.05), (0.10, 0.30, 0.60)),
    "series": ((0.20, 0.78, 0.02), (0.005, 0.80, 0.195)),
    "notice": ((0.20, 0.78, 0.02), (0.005, 0.80, 0.195)),
}
PRIOR_SHARE = 0.1
#: What the vote of one more function counts for at first: they look at the same two papers, so they are far from independent.
DISCOUNT = 0.5

# Accented letters and their plain forms; letters with a stroke have no decomposition.
ACCENTED = "àáâãäåāăąçćĉċčďđèéêëēĕėęěĝğġģĥħìíîïĩīĭįıĵķĺļľŀłñńņňòóôõöøōŏőŕŗřśŝşšţťŧùúûüũūŭůűųŵýÿŷźżžёй"
PLAIN = "aaaaaaaaacccccddeeeeeeeeegggghhiiiiiiiiijklllllnnnnoooooooooorrrsssstttuuuuuuuuuuwyyyzzzеи"
#: Words in front of a title that make it another paper about the same one.
NOTICE = r"^\W*(erratum|errata|corrigendum|correction|addendum|retraction|comment|commentary|reply|response|retracted|berichtigung|korrektur|kommentar|rectificatif|commentaire|corrección|fe de erratas|comentario|исправление|поправка|комментарий|更正|勘误|评论)\b"


def fold(c: Column) -> Column:
    """Lower case without markup, accents and combining marks; full-width forms narrowed."""
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"</?[a-zA-Z][^<>]*>|&[a-zA-Z]+;|&#\w+;", " ")
    c = F.translate(F.lower(F.translate(c, wide, "".join(map(chr, range(0x21, 0x7F))))), ACCENTED, PLAIN)
    c = F.regexp_replace(c, "\\p{Mn}|[\u00ad\u200b-\u200f\u2060\ufeff]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "ß", "ss"), "æ", "ae"), "œ", "oe")


def words(c: Column) -> Column:
    """Runs of letters or digits; Han characters stand alone."""
    return F.regexp_extract_all(c, F.lit(r"\p{IsHan}|[\p{L}&&[^\p{IsHan}]]+|\p{N}+"), F.lit(0))


def author_keys(metadata: Column) -> Column:
    """Distinct ``surname/initial`` keys of the authors in any of the known shapes; empty when there are none."""
    strings = lambda path: F.from_json(F.get_json_object(metadata, path), "array<string>")
    named = F.from_json(F.get_json_object(metadata, "$.authorships"), "array<struct<name:string>>")
    line = F.coalesce(F.when(~F.get_json_object(metadata, "$.authors").rlike(r"^\s*\["), F.get_json_object(metadata, "$.authors")), F.get_json_object(metadata, "$.author"))
    lists = F.coalesce(
        F.when(F.get_json_object(metadata, "$.authors").rlike(r"^\s*\["), strings("$.authors")), strings("$.observers"),
        F.transform(named, lambda x: x["name"]), F.split(line, r"\s*;\s*"), F.array().cast("array<string>"),
    )

    def key(name: Column) -> Column:
        n = F.trim(fold(name))
        raw = F.trim(name)
        last = F.when(n.contains(","), F.substring_index(n, ",", 1)).when(raw.rlike(r"\s\p{Lu}{1,3}$"), F.regexp_replace(n, r"\s+\S+$", "")).otherwise(F.regexp_extract(n, r"(\S+)$", 1))
        first = F.when(n.contains(","), F.trim(F.substring_index(n, ",", -1))).when(raw.rlike(r"\s\p{Lu}{1,3}$"), F.regexp_extract(n, r"(\S+)$", 1)).otherwise(n)
        return F.concat(F.regexp_replace(last, r"[^\p{L}]", ""), F.lit("/"), F.substring(first, 1, 1))

    return F.array_distinct(F.filter(F.transform(F.filter(lists, lambda x: x.isNotNull() & (F.trim(x) != "")), key), lambda k: F.length(k) > 3))


def acronym(venue: Column) -> Column:
    """First letters of a venue's words; a venue of one word is taken as its own acronym. NULL where there is none."""
    w = F.filter(F.split(F.trim(venue), r"\s+"), lambda x: x != "")
    return F.nullif(F.when(F.size(w) > 1, F.array_join(F.transform(w, lambda x: F.substring(x, 1, 1)), "")).otherwise(F.get(w, F.lit(0))), F.lit(""))


def evidence(documents: DataFrame) -> DataFrame:
    """id, source, title words and text, series marks, authors, year, abstract words; rows without a source are left out."""
    meta = F.col("metadata")
    year = F.regexp_extract(
        F.coalesce(*[F.get_json_object(meta, p) for p in ("$.year", "$.publication_year", "$.published", "$.pub_date", "$.date")], F.lit("")), r"(\d{4})", 1
    )
    title = F.trim(F.regexp_replace(fold(F.col("title")), r"^\s*\[(.*)\]\.?\s*$", "$1"))
    notice = F.regexp_extract(title, NOTICE, 1)
    bare = F.regexp_replace(title, NOTICE + r"\s*(?:to|on|zu|sur|a|к)?\s*:?\s*", "")
    part = F.regexp_extract(bare, r"[\s.,:;(—–-]+(?:part|teil|partie|parte|часть)?\s*((?:[ivx]{1,4}|\d{1,2}))\s*[).]*$", 1)
    part = F.when(part.rlike(r"^[ivx]+$") | bare.rlike(r"(?:part|teil|partie|parte|часть)\s*\d{1,2}\s*[).]*$"), part).otherwise("")
    annual = F.regexp_extract(bare, r"[:,.(]\s*((?:19|20)\d\d)\s*[).]*$", 1)
    stem = F.trim(F.regexp_replace(F.when(annual != "", F.regexp_replace(bare, r"[:,.(]\s*(?:19|20)\d\d\s*[).]*$", "")).when(part != "", F.regexp_replace(bare, r"[\s.,:;(—–-]+\S+\s*[).]*$", "")).otherwise(bare), r"\s*(?:…|\.\.\.)\s*$", ""))
    short = bare.rlike(r"(?:…|\.\.\.)\s*$")
    abstract = words(fold(F.col("abstract")))
    filler = F.size(abstract) < 4
    base = documents.where(F.col("source").isNotNull()).select(
        F.col("doc_id").alias("id"), "source", words(stem).alias("tw"), short.alias("short"),
        author_keys(meta).alias("authors"), acronym(F.coalesce(*[F.get_json_object(meta, p) for p in ("$.journal", "$.venue", "$.host_venue")])).alias("venue"),
        F.concat_ws("|", part, annual).alias("part"), notice.alias("notice"), F.when(year != "", year).cast("int").alias("year"),
        F.when(~filler, F.transform(F.array_distinct(abstract), lambda w: F.hash(w))).alias("aw"),
        F.when(~filler, F.concat_ws(" ", F.slice(abstract, 1, 10))).alias("lead"),
    )
    return base.where((F.size("tw") > 0) | F.col("aw").isNotNull()).withColumn("title", F.concat_ws(" ", "tw"))


def _runs(tw: Column, n: int) -> Column:
    """Hashes of the runs of ``n`` adjacent words; Han characters run twice as long."""
    k = F.when(F.exists(tw, lambda w: w.rlike(r"\p{IsHan}")), F.lit(2 * n)).otherwise(F.lit(n))
    starts = F.when(F.size(tw) >= k, F.sequence(F.lit(1), F.greatest(F.size(tw) - k + 1, F.lit(1)))).otherwise(F.array(F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(tw, i, k), " "))))


def _keyed(docs: DataFrame, keys: Column, where: Column) -> DataFrame:
    return docs.where(where).select("id", "source", F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("k"))


def _meet(x: DataFrame, y: DataFrame, once: bool) -> DataFrame:
    """(a, b) of rows of different sources with one key; ``once``: both sides are the same rows."""
    x, y = x.select("k", F.col("id").alias("x"), F.col("source").alias("sx")), y.select("k", F.col("id").alias("y"), F.col("source").alias("sy"))
    apart = (F.col("sx") != F.col("sy")) & ((F.col("x") < F.col("y")) if once else F.lit(True))
    return x.join(y, "k").where(apart).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _sifted(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b) of rows with one key, where few rows are on the left. A broadcast of counted size spares the right side a shuffle of all its keys;
    more keys than that are joined by one."""
    left = checkpoint(left)
    keys = left.select("k").distinct()
    wanted = F.broadcast(keys) if left.count() <= BROADCAST_KEYS else keys
    return _meet(left, right.join(wanted, "k", "left_semi"), False)


def _occurrences(tw: Column) -> Column:
    """Hash of each word and which of its occurrences it is, in order: a title of n words has n different ones."""
    return F.transform(tw, lambda w, i: F.xxhash64(w, F.size(F.filter(F.slice(tw, F.lit(1), i + 1), lambda v: v == w))))


def _differing(p: Column) -> Column:
    """How many of ``p`` words may differ in similar beginnings of ``p`` words: a quarter, and one of two or three."""
    return F.when(p < 2, 0).otherwise(F.greatest(F.floor(p / 4).cast("int"), F.lit(1)))


def _subsets(o: Column, n: Column, tag: Column) -> Column:
    """Hashes of all sets of ``n`` (1, 2 or 3) of the values of ``o``, in its order."""
    after = lambda i: F.slice(o, i + 2, F.size(o))
    two = F.flatten(F.transform(o, lambda x, i: F.transform(after(i), lambda y: F.xxhash64(tag, x, y))))
    three = F.flatten(F.transform(o, lambda x, i: F.flatten(F.transform(after(i), lambda y, j: F.transform(after(i + j + 1), lambda z: F.xxhash64(tag, x, y, z))))))
    return F.when(n == 1, F.transform(o, lambda x: F.xxhash64(tag, x))).when(n == 2, two).otherwise(three)


def _beginning_keys(ranked: Column, lengths: Column, tag: str) -> Column:
    """Keys of the title's first p words, for each p of ``lengths``. Where two rows of p words differ in d, the shared ones are p - d at least, so the first
    n of them in the common order are among the first d + n of either: a set of n words is a key of both."""
    n = lambda p: F.when(p < 3, 1).when((p == 3) | p.between(24, 63), 2).when(p > 63, 1).otherwise(3)

    def keys(p: Column) -> Column:
        first = F.transform(F.filter(ranked, lambda e: e["at"] <= p), lambda e: e["word"])
        return let(F.slice(first, F.lit(1), _differing(p) + n(p)), lambda o: _subsets(o, n(p), F.xxhash64(F.lit(tag), p)))

    return F.flatten(F.transform(lengths, keys))


def _set_keys(ranked: Column) -> Column:
    """Keys of the title's set of words for sets that share three quarters of their union, whatever the words' order: of m words at most m / 4 are missing."""
    words = F.transform(F.filter(ranked, lambda e: e["first"]), lambda e: e["word"])
    n = lambda m: F.when(m < 3, m).when(m < 24, 3).when(m < 64, 2).otherwise(1)

    def keys(o: Column) -> Column:
        m = F.size(o)
        of = lambda k: let(F.slice(o, F.lit(1), F.floor(m / 4).cast("int") + k), lambda x: _subsets(x, k, F.xxhash64(F.lit("set"))))
        own, partner = n(m), n(F.floor(m * 4 / 3).cast("int"))  # the larger set decides; it has a third more at most
        return F.when(own == partner, of(own)).otherwise(F.concat(of(own), of(partner)))

    return let(words, keys)


def similar_titles(docs: DataFrame) -> DataFrame:
    """(a, b) of all rows of different sources, one of them at least without authors, whose titles are similar: their sets of words share three quarters of the
    union, or the shorter title and as many words of the longer one's beginning differ in a quarter (one of two or three). Shorter is a title of 15 letters, one that
    is marked as cut, or one as long as the other. Titles that both have numbers share one; the last word of a cut title is no number."""
    occurrences = docs.select(F.explode(_occurrences(F.col("tw"))).alias("word"))
    counts = [0] * SLOTS
    for slot, n in occurrences.groupBy(F.pmod("word", F.lit(SLOTS)).cast("int").alias("slot")).count().collect():  # SLOTS rows, whatever the data
        counts[slot] = n
    weights = docs.sparkSession.createDataFrame([(counts,)], "t array<bigint>").scalar()
    tw, n = F.col("tw"), F.size("tw")
    entry = lambda t: lambda x, i: F.struct(F.get(t, F.pmod(x, F.lit(SLOTS)).cast("int")).alias("n"), x.alias("word"), (i + 1).alias("at"), (F.array_position(tw, F.get(tw, i)) == i + 1).alias("first"))
    counted = docs.where(n > 0).select("id", "source", "authors", "tw", weights.alias("counts"))
    titled = counted.select("id", "source", "authors", "tw", let(F.col("counts"), lambda t: F.array_sort(F.transform(_occurrences(tw), entry(t)))).alias("ranked"))
    ranked, whole, upto = F.col("ranked"), F.array(n), lambda last: F.when(last > 0, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    left = _keyed(titled, F.concat(_beginning_keys(ranked, whole, "of longer"), _beginning_keys(ranked, upto(n - 1), "of shorter"), _set_keys(ranked)), F.size("authors") == 0)
    right = _keyed(titled, F.concat(_beginning_keys(ranked, upto(n), "of longer"), _beginning_keys(ranked, whole, "of shorter"), _set_keys(ranked)), F.lit(True))
    numbers = F.filter(F.when(F.col("short"), F.slice("tw", F.lit(1), F.greatest(n - 1, F.lit(0)))).otherwise(tw), lambda w: w.rlike(r"^\p{N}+$"))
    side = lambda s: docs.select(F.col("id").alias(s), tw.alias("t" + s), _occurrences(tw).alias("o" + s), F.length("title").alias("l" + s), F.col("short").alias("s" + s), numbers.alias("n" + s))
    j = _sifted(left, right).join(side("a"), "a").join(side("b"), "b")
    p = F.least(F.size("oa"), F.size("ob"))
    begin = F.size(F.array_intersect(F.slice("oa", F.lit(1), p), F.slice("ob", F.lit(1), p))) >= p - _differing(p)
    cut = F.col("sa") | F.col("sb") | (F.least("la", "lb") >= 15) | (F.size("oa") == F.size("ob"))
    words = 4 * F.size(F.array_intersect("ta", "tb")) >= 3 * F.size(F.array_union("ta", "tb"))
    numbered = (F.size("na") == 0) | (F.size("nb") == 0) | F.arrays_overlap("na", "nb")
    return j.where(((begin & cut) | words) & numbered).select("a", "b")


def candidates(docs: DataFrame) -> DataFrame:
    """(a, b) with a < b, of different sources, that share a composite key. ``docs``: rows of ``evidence``."""
    years = F.array(F.col("year"), F.col("year") + 1)
    grid = lambda xs, ys: F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.xxhash64(x, y))))
    pairs = _runs(F.col("tw"), 2)
    lead = F.when(F.col("lead").isNotNull(), F.array(F.xxhash64(F.lit("l"), "lead"))).otherwise(F.array().cast("array<bigint>"))
    known, every = F.size("authors") > 0, F.lit(True)
    found = []
    for keys, where in ((grid(grid(pairs, F.col("authors")), years), known), (grid(lead, F.concat(years.cast("array<string>"), F.col("authors"))), every)):
        rows = _keyed(docs, keys, where)
        found.append(_meet(rows, rows, True))
    # All words of a title, and all but one that is no number.
    set_ = F.array_sort(F.array_distinct("tw"))
    letters = F.filter(set_, lambda w: ~w.rlike(r"^\p{N}+$"))
    but_one = F.concat(F.array(F.xxhash64(F.lit("s"), set_)), F.transform(letters, lambda w: F.xxhash64(F.lit("s"), F.array_remove(set_, w))))
    with_lead = grid(lead, pairs)
    left = [_keyed(docs, grid(pairs, F.col("authors")), known & F.col("year").isNull()), _keyed(docs, F.concat(but_one, with_lead), ~known)]
    right = _keyed(docs, F.concat(grid(pairs, F.col("authors")), but_one, with_lead), every)
    found += [_sifted(reduce(DataFrame.unionByName, left), right), similar_titles(docs)]
    return reduce(DataFrame.unionAll, found).distinct()


def votes(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b, one vote (1, 0, -1) for each of ``FUNCTIONS``, and whether both documents have authors."""
    side = lambda s: docs.select(*[F.col(c).alias(c + s if c != "id" else s) for c in ("id", "title", "tw", "short", "part", "notice", "authors", "venue", "year", "aw")])
    j = pairs.join(side("a"), "a").join(side("b"), "b")
    ta, tb = F.col("titlea"), F.col("titleb")
    shorter, longer = F.when(F.length(ta) <= F.length(tb), ta).otherwise(tb), F.when(F.length(ta) <= F.length(tb), tb).otherwise(ta)
    cut = F.when((F.col("shorta") | F.col("shortb")) | (F.length(shorter) >= 15), F.substring(longer, F.lit(1), F.length(shorter))).otherwise(longer)
    likeness = lambda x, y: 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))
    common = F.size(F.array_intersect("twa", "twb")) / F.greatest(F.size(F.array_union("twa", "twb")), F.lit(1))  # subtitle and title may change places
    sim = F.greatest(likeness(ta, tb), F.when(F.length(shorter) > 0, likeness(shorter, cut) - 0.02), common)
    alike = (F.col("parta") == F.col("partb")) & (F.col("noticea") == F.col("noticeb"))
    marks = lambda x, y, none: F.when((x == none) & (y == none), 0).when(x == y, 1).otherwise(-1)
    digits = lambda c: F.array_distinct(F.filter(c, lambda w: w.rlike(r"^\p{N}+$")))
    na, nb = digits(F.col("twa")), digits(F.col("twb"))
    both = F.size(F.array_intersect(na, nb))
    shared = F.size(F.array_intersect("authorsa", "authorsb"))
    fewest = F.least(F.size("authorsa"), F.size("authorsb"))
    inter = F.size(F.array_intersect("awa", "awb"))
    contained = inter / F.least(F.size("awa"), F.size("awb"))
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    return j.select(
        "a", "b",
        # A title with another part, year or notice is another title.
        vote((sim >= 0.88) & alike, (sim < 0.7) | ~alike).alias("title"),
        vote((common >= 0.75) & alike, (common < 0.4) | ~alike).alias("words"),
        vote((both > 0) & ((both == F.size(na)) | (both == F.size(nb))), (F.size(na) > 0) & (F.size(nb) > 0) & (both == 0)).alias("numbers"),
        vote((shared > 0) & (shared >= fewest * 0.5), (fewest > 0) & (shared == 0)).alias("authors"),
        F.coalesce(vote(F.get("authorsa", F.lit(0)) == F.get("authorsb", F.lit(0)), F.get("authorsa", F.lit(0)) != F.get("authorsb", F.lit(0))), F.lit(0)).alias("first"),
        vote(F.abs(F.col("yeara") - F.col("yearb")) <= 1, F.abs(F.col("yeara") - F.col("yearb")) > 1).alias("year"),
        F.coalesce(vote(F.col("venuea") == F.col("venueb"), F.col("venuea") != F.col("venueb")), F.lit(0)).alias("venue"),
        F.coalesce(vote(contained >= 0.6, contained < 0.4), F.lit(0)).alias("abstract"),
        marks(F.col("parta"), F.col("partb"), "|").alias("series"), marks(F.col("noticea"), F.col("noticeb"), "").alias("notice"), (fewest > 0).alias("signed"), sim.alias("title_sim"), contained.alias("abstract_sim"),
    )


def _dependencies(counts: np.ndarray, patterns: np.ndarray) -> list[int]:
    """Parent of every function in the Chow-Liu tree of its votes; -1 for the root."""
    k, total = patterns.shape[1], counts.sum()
    info = np.zeros((k, k))
    for i, j in itertools.combinations(range(k), 2):
        joint = np.zeros((3, 3))
        np.add.at(joint, (patterns[:, i], patterns[:, j]), counts)
        joint = (joint + 0.01) / (total + 0.09)
        info[i, j] = info[j, i] = (joint * np.log(joint / joint.sum(1, keepdims=True) / joint.sum(0, keepdims=True))).sum()
    parent, inside = [-1] * k, {0}
    while len(inside) < k:
        i, j = max(((i, j) for i in inside for j in range(k) if j not in inside), key=lambda p: info[p])
        parent[j] = i
        inside.add(j)
    return parent


def fit(rows: list[tuple], rounds: int = 100, functions: tuple[str, ...] = FUNCTIONS) -> dict[tuple, float]:
    """Posterior of every vote pattern. ``rows``: votes and their count, 0 for patterns that are only judged. EM, begun from the prior's own opinion of the patterns."""
    if not rows:
        return {}
    patterns = np.array([r[:-1] for r in rows], int) + 1
    counts = np.array([r[-1] for r in rows], float)
    k = patterns.shape[1]
    prior = np.array([PRIOR[f] for f in functions])  # function, class, vote
    begin = DISCOUNT * sum(np.log(prior[f][:, patterns[:, f]]) for f in range(k))
    q = 1 / (1 + np.exp(np.clip(begin[0] - begin[1], -50, 50)))
    for _ in range(rounds):
        log = np.zeros((2, len(rows)))
        for c, weight in enumerate((counts * (1 - q), counts * q)):
            parent = _dependencies(weight, patterns)
            log[c] = np.log(weight.sum() + 1) - np.log(counts.sum() + 2)
            for f in range(k):
                above = patterns[:, parent[f]] if parent[f] >= 0 else np.zeros(len(rows), int)
                table = np.zeros((3, 3))
                np.add.at(table, (above, patterns[:, f]), weight)
                # Smoothed towards the function's own rates, and those towards the prior, so a rare pair of votes says no more than each alone.
                own = max(4.0, PRIOR_SHARE * weight.sum())
                alone = table.sum(0) + own * prior[f, c]
                table = table + own * alone / alone.sum()
                log[c] += np.log((table / table.sum(1, keepdims=True))[above, patterns[:, f]])
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        done, q = np.abs(new - q).max() < 1e-6, new
        if done:
            break
    return {tuple(int(v) for v in r[:-1]): float(p) for r, p in zip(rows, q)}


def link(documents: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b, confidence and the votes) of every candidate pair."""
    docs = checkpoint(evidence(documents))
    voted = checkpoint(votes(candidates(docs), docs))
    # Pairs with a document without authors are chosen by their titles, so how often titles agree in them tells nothing: the others are learnt from.
    patterns = voted.groupBy(*FUNCTIONS).agg(F.count_if("signed"), F.count("*")).collect()  # at most 3 ** 10, whatever the data
    learnt = -2 if any(r[-2] for r in patterns) else -1
    counted = [(*r[:-2], r[learnt]) for r in patterns]
    table = documents.sparkSession.createDataFrame([(*k, v) for k, v in fit(counted).items()], ", ".join(f"{f} int" for f in FUNCTIONS) + ", p double")
    scored = voted.join(F.broadcast(table), list(FUNCTIONS), "left")
    return scored.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"), F.coalesce("p", F.lit(0.0)).alias("confidence"), *FUNCTIONS, "title_sim", "abstract_sim")


def same_paper(documents: DataFrame, confident: float = CONFIDENT) -> DataFrame:
    """(doc_id_a, doc_id_b): documents of two sources that describe one paper."""
    return link(documents).where(F.col("confidence") >= confident).select("doc_id_a", "doc_id_b")
