"""Lexical search over documents: matching, BM25, filters, facets and counts, as single DataFrame plans.

``index`` turns documents (record_id, title, abstract, body, metadata) into token arrays; ``postings`` into an inverted index for corpora
that are queried often. Filters are plain columns and reach the scan; ranking selects ids and scores only, the shown hits are joined back.
Rows with NULL fields have no tokens there; ties are ordered by record_id; an empty index gives no hits and zero counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlit.errors import FilterError, QueryError
from lumenlit.functions.text import sanitize, tokens
from lumenlit.plans.evaluate import document_snippets, near_kept, passage_snippet
from lumenlit.plans.query import FIELDS, TOKENS, Leaf, Many, Near, Not, View, leaves, matches, parse, parse_ranked

WEIGHTS = {"title": 10.0, "abstract": 4.0, "body": 1.0}
K1, B = 1.2, 0.75


def newest_documents(documents: DataFrame) -> DataFrame:
    """One row per record: the last indexing (``indexed_at``, then ``doc_id``). The choice shuffles keys only; the documents stay where they are
    unless the chosen keys are too many to broadcast. ``doc_id`` names one row."""
    rows = documents.where(F.col("record_id").isNotNull())
    last = rows.groupBy("record_id").agg(F.max(F.struct(F.col("indexed_at").isNotNull().alias("k"), "indexed_at", "doc_id")).alias("m"))
    chosen = last.select(F.col("record_id").alias("_r"), F.col("m.doc_id").alias("_d"))
    return rows.join(chosen, (F.col("record_id") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi")


def index(documents: DataFrame, tokenizer: Callable[[Column], Column] = tokens) -> DataFrame:
    """Documents with token arrays ``tok_title``, ``tok_abstract``, ``tok_body`` and their total ``length``. ``tokenizer`` turns a text column into an array
    of words."""
    toks = {f"tok_{f}": tokenizer(F.col(f)) for f in FIELDS}
    return documents.withColumns(toks).withColumn("length", sum((F.size(f"tok_{f}") for f in FIELDS), F.lit(0)))


def postings(documents: DataFrame) -> DataFrame:
    """Inverted index (term, record_id, field, positions); write it partitioned by a hash of the term and sorted by term."""
    rows = documents.select("record_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("t")) for f in FIELDS])).alias("x"))
    each = rows.select("record_id", "x.field", F.posexplode("x.t").alias("pos", "term"))
    return each.groupBy("term", "record_id", "field").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


@dataclass(frozen=True)
class Tag:
    """Keeps documents with a tag of ``key`` among ``values``; ``negated`` those with none."""

    key: str
    values: tuple
    negated: bool = False

    def __post_init__(self):
        if isinstance(self.values, str) or not self.values:
            raise FilterError("a tag filter takes a non-empty list of values")


@dataclass(frozen=True)
class Range:
    """Keeps documents with a tag of ``key`` between the bounds, inclusive: whole numbers, or texts of which only a prefix as long as
    the upper bound is compared with it."""

    key: str
    low: object = None
    high: object = None
    negated: bool = False

    def __post_init__(self):
        kinds = {type(x) for x in (self.low, self.high) if x is not None}
        if len(kinds) != 1 or not kinds <= {int, str}:
            raise FilterError("a range has one or two bounds, both whole numbers or both texts")
        if self.low is not None and self.high is not None and (self.low > self.high if int in kinds else self.low[: len(self.high)] > self.high):
            raise FilterError("the range is empty")
        if int in kinds and any(abs(x) >= 1 << 63 for x in (self.low, self.high) if x is not None):
            raise FilterError("bounds are limited to 64 bits")


def tag_keys(indexed: DataFrame) -> tuple[str, ...]:
    """Keys whose tags are built."""
    return tuple(c.removeprefix("tag_") for c in indexed.columns if c.startswith("tag_"))


def check_filters(filters: list, keys: tuple[str, ...]) -> None:
    """At most one filter per key, and only for keys with tags; raised before any job starts."""
    names = [f.key for f in filters]
    if len(set(names)) < len(names) or not set(names) <= set(keys):
        raise FilterError(f"one filter per key, of {sorted(keys)}")


def tag_values(metadata: Column, key: str) -> Column:
    """Distinct tags of a JSON key: texts and whole numbers, lists flattened once; other values are no tags. Broken JSON has none."""
    whole = F.get_json_object(metadata, f"$.{key}")
    value = F.variant_get(F.try_parse_json(metadata), f"$.{key}", "variant")
    kind = F.schema_of_variant(value)
    many = F.from_json(whole, "array<string>")
    one = F.when(kind.isin("STRING", "BIGINT"), F.array(whole))
    listed = F.when(kind.isin("ARRAY<STRING>", "ARRAY<BIGINT>"), many)
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(one, listed, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))))


def passes(f: Tag | Range, tags: Column) -> Column:
    """Whether an array of tags passes a filter."""
    if isinstance(f, Tag):
        ok = F.arrays_overlap(tags, F.array(*[F.lit(str(v)) for v in f.values]))
    elif isinstance(f.low if f.low is not None else f.high, int):
        number = lambda t: F.when(t.rlike("^(0|-?[1-9][0-9]{0,18})$"), t.try_cast("decimal(38,0)"))
        inside = lambda t: reduce(
            Column.__and__, [*([number(t) >= f.low] if f.low is not None else []), *([number(t) <= f.high] if f.high is not None else [])]
        )
        ok = F.exists(tags, lambda t: F.coalesce(inside(t), F.lit(False)))
    else:
        inside = lambda t: reduce(
            Column.__and__, [*([t >= f.low] if f.low is not None else []), *([F.substring(t, 1, len(f.high)) <= f.high] if f.high is not None else [])]
        )
        ok = F.exists(tags, inside)
    ok = F.coalesce(ok, F.lit(False))
    return ~ok if f.negated else ok


def _filtered(docs: DataFrame, filters: list, without: str | None = None) -> Column:
    cols = [passes(f, F.col(f"tag_{f.key}")) for f in filters if f.key != without]
    return reduce(Column.__and__, cols) if cols else F.lit(True)


def with_tags(docs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Adds ``tag_<key>`` arrays."""
    return docs.withColumns({f"tag_{k}": tag_values(F.col("metadata"), k) for k in keys})


def match_ids(indexed: DataFrame, query: str | None, filters: list = ()) -> DataFrame:
    """(record_id,) of the matching documents, in no order; pure negations are allowed, None matches all."""
    check_filters(filters, tag_keys(indexed))
    tree = parse(query) if query is not None else None
    rows = indexed.where(_filtered(indexed, list(filters)))
    return (rows.where(matches(tree)) if tree else rows).select("record_id")


def filter_candidates(ids: DataFrame, indexed: DataFrame, filters: list) -> DataFrame:
    """The given ids whose documents pass the filters."""
    check_filters(filters, tag_keys(indexed))
    return ids.join(indexed.where(_filtered(indexed, list(filters))).select("record_id"), "record_id", "left_semi")


def scored_leaves(node: object) -> list[Leaf]:
    """Leaves that carry a document frequency: the parts of a NEAR group are leaves of its fields."""
    return [x for n in leaves(node) for x in ([Leaf(p.words, n.fields, p.prefix) for p in n.parts] if isinstance(n, Near) else [n])]


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _near_counts(starts: pd.Series, lengths: pd.Series, distance: pd.Series) -> pd.Series:
    """Kept occurrences of every part of a NEAR group in one field."""
    return pd.Series([[len(k) for k in near_kept([list(p) for p in s], list(n), int(d))] for s, n, d in zip(starts, lengths, distance)])


def near_groups(tree: object) -> list[Near]:
    """The distinct NEAR groups of a query."""
    return list(dict.fromkeys(n for n in leaves(tree) if isinstance(n, Near)))


def with_near(rows: DataFrame, tree: object, view: View) -> DataFrame:
    """Adds ``near_<group>_<field>``: kept occurrences of every part of a NEAR group. The walk runs only where every part occurs in the field."""
    places, cols = [], {}
    for g, node in enumerate(near_groups(tree)):
        lengths = F.array(*[F.lit(len(p.words)) for p in node.parts])
        for f in node.fields:
            starts = F.array(*[view.starts(p, f) for p in node.parts])
            some = F.when(F.forall(starts, lambda s: F.size(s) > 0), starts).otherwise(F.array().cast("array<array<int>>"))
            places.append(some.alias(f"s_{g}_{f}"))
            cols[f"near_{g}_{f}"] = _near_counts(F.col(f"_starts.s_{g}_{f}"), lengths, F.lit(node.distance))
    if not cols:
        return rows
    # A generator keeps the places apart from the call: Spark takes no Python function whose arguments hold lambdas.
    return rows.select("*", F.explode(F.array(F.struct(*places))).alias("_starts")).withColumns(cols).drop("_starts")


def bm25(rows: DataFrame, tree: object, idf: list[float], average: float, weights: dict[str, float], view: View) -> DataFrame:
    """(record_id, score) of matching documents with ``length``: a leaf counts only in parts of the query that match. ``idf`` follows
    ``scored_leaves``."""
    place, groups = iter(idf), near_groups(tree)

    def frequencies(node: object) -> list[Column]:
        if not isinstance(node, Near):
            return [sum((weights.get(f, 0.0) * view.count(node, f) for f in node.fields), F.lit(0.0))]
        kept = lambda f, i: F.coalesce(F.get(F.col(f"near_{groups.index(node)}_{f}"), F.lit(i)), F.lit(0))
        return [sum((weights.get(f, 0.0) * kept(f, i) for f in node.fields), F.lit(0.0)) for i in range(len(node.parts))]

    def counted(node: object) -> Column:
        if isinstance(node, Not):
            for _ in scored_leaves(node):
                next(place)
            return F.lit(0.0)
        if isinstance(node, Many):
            inner = sum((counted(p) for p in node.parts), F.lit(0.0))
        else:
            norm = K1 * (1 - B + B * F.col("length") / average)
            inner = sum((F.lit(next(place)) * f * (K1 + 1) / (f + norm) for f in frequencies(node)), F.lit(0.0))
        return F.when(matches(node, view), inner).otherwise(0.0)

    return with_near(rows, tree, view).select("record_id", counted(tree).alias("score"))


def inverse_frequency(n: int, holding: int) -> float:
    """ln((n - df + 0.5) / (df + 0.5)), and a little above zero where that is not positive."""
    value = math.log((n - holding + 0.5) / (holding + 0.5))
    return value if value > 0 else 1e-6


def checked_weights(weights: dict[str, float] | None) -> dict[str, float]:
    weights = weights or WEIGHTS
    if any(not math.isfinite(w) or w < 0 for w in weights.values()):
        raise QueryError("weights must be finite and not negative")
    return weights


def rank(indexed: DataFrame, query: str, limit: int = 20, filters: list = (), exclude: str | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """(record_id, score): the best ``limit`` documents by BM25, ties by record_id. Statistics cover all documents, in one aggregate. For a corpus
    that is queried often, ``TextIndex.rank`` gives the same from written postings."""
    weights, tree = checked_weights(weights), parse_ranked(query)
    check_filters(filters, tag_keys(indexed))
    if limit < 1:
        return indexed.sparkSession.createDataFrame([], "record_id string, score double")
    scored = scored_leaves(tree)
    stats = indexed.agg(
        F.count("*").alias("n"), F.sum("length").alias("total"), *[F.count_if(matches(x)).alias(f"n{i}") for i, x in enumerate(scored)]
    ).first()  # one row
    n, average = stats["n"] or 0, max(stats["total"] or 0, 1) / max(stats["n"] or 0, 1)
    idf = [inverse_frequency(n, stats[f"n{i}"]) for i in range(len(scored))]
    rows = indexed.where(_filtered(indexed, list(filters))).where(matches(tree))
    if exclude is not None:
        rows = rows.where(F.col("record_id") != exclude)
    return bm25(rows, tree, idf, average, weights, TOKENS).orderBy(F.desc("score"), "record_id").limit(limit)


def hydrate(ranked: DataFrame, documents: DataFrame, *columns: str) -> DataFrame:
    """Columns of the shown hits only: the ids of a ranking are at most its limit, so they are broadcast."""
    return documents.select("record_id", *columns).join(F.broadcast(ranked), "record_id")


def headers(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """(record_id, title, metadata) of the given ids; no text is read."""
    return documents.select("record_id", "title", "metadata").join(ids.select("record_id").distinct(), "record_id", "left_semi")


def checked_metadata(metadata: Column) -> Column:
    """Metadata that is a JSON object or NULL; anything else ends the query with an error that names the value's beginning."""
    bad = metadata.isNotNull() & ~F.coalesce(F.schema_of_variant(F.try_parse_json(metadata)).startswith("OBJECT"), F.lit(False))
    return F.when(bad, F.raise_error(F.concat(F.lit("metadata is no JSON object: "), F.substring(metadata, 1, 80))).cast("string")).otherwise(metadata)


def _named(key: str) -> Column:
    return F.transform(F.col(f"tag_{key}"), lambda v: F.struct(F.lit(key).alias("key"), v.alias("value")))


def facet_counts(indexed: DataFrame, keys: tuple[str, ...], query: str | None = None, filters: list = ()) -> DataFrame:
    """(key, value, n): documents per tag, the largest count of a key first, then by value; each key is counted under every filter but its own,
    in one pass over the documents."""
    check_filters(filters, tag_keys(indexed))
    check_filters([Tag(k, ("",)) for k in keys], tag_keys(indexed))
    rows = indexed.where(matches(parse(query))) if query else indexed
    each = [F.when(_filtered(indexed, list(filters), without=k), _named(k)) for k in keys]
    empty = F.array().cast("array<struct<key:string,value:string>>")
    tags = rows.select(F.explode(F.flatten(F.array(*[F.coalesce(e, empty) for e in each]))).alias("t"))
    return tags.groupBy("t.key", "t.value").agg(F.count("*").alias("n")).orderBy("key", F.desc("n"), "value")


def range_counts(indexed: DataFrame, ranges: list[Range], query: str | None = None, filters: list = ()) -> DataFrame:
    """(place, n): documents per range, each under every filter but those of its key; one aggregate."""
    check_filters(filters, tag_keys(indexed))
    check_filters(list({r.key: r for r in ranges}.values()), tag_keys(indexed))
    rows = indexed.where(matches(parse(query))) if query else indexed
    counts = [F.count_if(passes(r, F.col(f"tag_{r.key}")) & _filtered(indexed, list(filters), without=r.key)).alias(f"r{i}") for i, r in enumerate(ranges)]
    return rows.agg(*counts).select(F.posexplode(F.array(*[F.col(f"r{i}") for i in range(len(ranges))])).alias("place", "n"))


def count_matches(indexed: DataFrame, query: str | None, cap: int | None = None, filters: list = ()) -> DataFrame:
    """(n,): matching documents, at most ``cap``; a cap stops the scan early."""
    if cap is not None and cap < 1:
        raise QueryError("a cap is at least 1")
    rows = match_ids(indexed, query, filters)
    return (rows.limit(cap) if cap else rows).agg(F.count("*").alias("n"))


SPAN = "array<struct<start:int,end:int>>"
SNIPPET = f"struct<field:string,text:string,highlights:{SPAN}>"


def with_snippets(hits_: DataFrame, query: str) -> DataFrame:
    """Adds ``snippets`` to the shown hits, which carry title, abstract and body: the best field's snippet and one of every field with a match."""
    tree = parse(query)

    def cut(title: pd.Series, abstract: pd.Series, body: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([document_snippets(tree, dict(zip(FIELDS, map(lambda x: x or "", t)))) for t in zip(title, abstract, body)], columns=["best", "fields"])

    cut.__annotations__ = {"title": pd.Series, "abstract": pd.Series, "body": pd.Series, "return": pd.DataFrame}
    return hits_.withColumn("snippets", F.pandas_udf(cut, f"best {SNIPPET}, fields array<{SNIPPET}>")(*[sanitize(F.col(f)) for f in FIELDS]))


def with_passage_snippet(hits_: DataFrame, query: str, column: str, field: str = "body") -> DataFrame:
    """Adds ``snippet`` of a column read as one field, with every word of the query that is not negated."""
    if field not in FIELDS:
        raise QueryError(f"a field is one of {FIELDS}", 0, field)
    tree = parse(query)

    def cut(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([passage_snippet(tree, t or "", field) for t in s], columns=["field", "text", "highlights"])

    cut.__annotations__ = {"s": pd.Series, "return": pd.DataFrame}
    return hits_.withColumn("snippet", F.pandas_udf(cut, f"field string, text string, highlights {SPAN}")(sanitize(F.col(column))))
