"""Post-processing of extracted tables: keys, deduplication, clipping, completeness, flags, layout, validation, clustering.

Every step is a function DataFrame -> DataFrame; chained steps of projections fuse into one stage. NaN counts as missing and becomes NULL.
Operators that depend on input order take an explicit order column. Empty tables pass through; columns a step names but the table lacks
are skipped.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenlit.errors import ConfigError
from lumenlit.functions.text import key_of, keyword_tokens, keyword_words, let
from lumenlit.operators.graph import components
from lumenlit.session import checkpoint

Step = Callable[[DataFrame], DataFrame]
#: DBSCAN's boxes: the share by which rounding may be off, the boxes from zero up to which it stays below that, pairs of spots that are compared
#: one by one, and how often larger ones are halved before that.
SLACK, FAR, FEW, HALVINGS = 1e-6, 100_000_000, 2_000, 12


def chain(*steps: Step) -> Step:
    """One step from several, applied in order."""
    return lambda df: reduce(lambda d, s: s(d), steps, df)


def missing_as_null(df: DataFrame) -> DataFrame:
    """NaN in floating-point columns becomes NULL."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def normalized(column: str, key: str = "_norm_key", normalizer: Callable[[Column], Column] = key_of) -> Step:
    """Adds the comparison key of a column; ``normalizer`` turns a value's column into its key."""
    return lambda df: df.withColumn(key, normalizer(F.col(column)))


def deduplicated(key: str = "_norm_key", order: str = "_ord", source: str | None = None, sources: str = "sources") -> Step:
    """Rows with one key become one: each column's first non-missing value in input order; rows without a key stay as they are.
    ``source`` adds the sorted distinct sources of a row, joined by ``; ``. Aggregates combine map-side, so a hot key is no hot task."""

    def step(df: DataFrame) -> DataFrame:
        df = missing_as_null(df)
        rest = [c for c in df.columns if c not in (key, order)]
        firsts = [F.expr(f"min_by(`{c}`, `{order}`) FILTER (WHERE `{c}` IS NOT NULL)").alias(c) for c in rest]
        lineage = [F.array_join(F.array_sort(F.collect_set(F.nullif(F.trim(F.col(source).cast("string")), F.lit("")))), "; ").alias(sources)] if source else []
        keyed = df.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.min(order).alias(order), *firsts, *lineage)
        loose = df.where(F.coalesce(F.col(key), F.lit("")) == "")
        if source:
            loose = loose.withColumn(sources, F.coalesce(F.trim(F.col(source).cast("string")), F.lit("")))
        return keyed.unionByName(loose.select(keyed.columns))

    return step


def collapse_pairs(pairs: list[tuple[int, int]], rows: dict[int, dict]) -> list[dict]:
    """Ordered (keep, drop) pairs of one bounded component folded into its rows: a drop fills what its keeper lacks; a kept row that was
    itself dropped passes on to its keeper; a pair that would close a circle is ignored."""
    into: dict[int, int] = {}
    root = lambda i: root(into[i]) if i in into else i
    for keep, drop in pairs:
        a, b = root(keep), root(drop)
        if a == b:
            continue
        into[b] = a
        rows[a] = {c: rows[a][c] if rows[a][c] is not None else rows[b].get(c) for c in rows[a]}
    return [r for i, r in rows.items() if i not in into]


def merged(matcher: Callable[[DataFrame], DataFrame], order: str = "_ord") -> Step:
    """Rows that a matcher pairs become one. ``matcher``: table -> (keep, drop, ord), pairs of values of the order column in the order in which they
    count. Pairs only act within a connected component, so each component (rows of one thing) folds by itself, and components in parallel."""

    def step(df: DataFrame) -> DataFrame:
        df = missing_as_null(df)
        pairs = checkpoint(matcher(df).select("keep", "drop", "ord").where("keep <> drop"))
        named = components(pairs.select(F.col("keep").alias("source"), F.col("drop").alias("target"))).toDF(order, "_group")
        rows = df.join(named, order)
        again = named.toDF("keep", "_pairs")  # new column ids, as both sides come from the same pairs
        links = pairs.join(again, "keep").select("_pairs", "keep", "drop", "ord").toDF("_pairs", "keep", "drop", "ord")
        schema = df.schema

        def fold(r, p):
            import pandas as pd

            kept = {x[order]: x for x in r.drop(columns="_group").astype(object).where(r.notna(), None).to_dict("records")}
            out = collapse_pairs(list(p.sort_values("ord")[["keep", "drop"]].itertuples(index=False, name=None)), dict(sorted(kept.items())))
            return pd.DataFrame(out, columns=schema.names)

        folded = rows.groupBy("_group").cogroup(links.groupBy("_pairs")).applyInPandas(fold, schema)
        return df.join(named.select(order), order, "left_anti").select(schema.names).unionByName(folded)

    return step


def number(c: Column) -> Column:
    """A text as DOUBLE the way Python reads it: spaces around, ``inf``, ``nan``, underscores between digits; NULL if it is none."""
    t = F.lower(F.trim(c.cast("string")))
    plain = F.regexp_replace(t, r"(?<=\d)_(?=\d)", "")
    return F.when(plain.rlike(r"^[+-]?((\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?|inf(inity)?|nan)$"), F.regexp_replace(F.regexp_replace(plain, r"^(\+?)inf$", "Infinity"), "^-inf$", "-Infinity").try_cast("double"))


def clipped(bounds: dict[str, tuple[float | None, float | None]]) -> Step:
    """Columns as numbers within inclusive bounds; what is no number becomes missing."""
    for low, high in bounds.values():
        if low is not None and high is not None and low > high:
            raise ConfigError("a lower bound exceeds its upper bound")

    def step(df: DataFrame) -> DataFrame:
        out = {}
        for c, (low, high) in bounds.items():
            if c in df.columns:
                x = number(F.col(c))
                v = x if low is None else F.greatest(x, F.lit(float(low)))
                v = v if high is None else F.least(v, F.lit(float(high)))
                out[c] = F.when(x.isNotNull() & ~F.isnan(x), v)
        return df.withColumns(out)

    return step


def completeness(fields: list[str], name: str = "completeness_pct") -> Step:
    """Share of the tracked columns the table has that a row fills, in percent, rounded half to even at one decimal; none tracked: 0."""

    def step(df: DataFrame) -> DataFrame:
        kinds = dict(df.dtypes)
        have = [f for f in fields if f in kinds]
        filled = [(F.col(f).isNotNull() & ~F.isnan(f) if kinds[f] in ("double", "float") else F.col(f).isNotNull()).cast("int") for f in have]
        return df.withColumn(name, F.rint(sum(filled, F.lit(0)) / len(have) * 100 * 10) / 10 if have else F.lit(0.0))

    return step


def quality_flag(threshold: float = 50.0, source: str = "completeness_pct", name: str = "quality_flag") -> Step:
    """Confirmed at 100, Needs Review from the threshold on, else (missing too) Low Confidence."""
    c = F.col(source)
    return lambda df: df.withColumn(name, F.when(c.isNull() | F.isnan(c), "Low Confidence").when(c == 100, "Confirmed").when(c >= threshold, "Needs Review").otherwise("Low Confidence"))


def laid_out(sort: list[tuple[str, bool]], leading: list[str] = (), hidden: tuple[str, ...] = ("_",), order: str | None = None) -> Step:
    """Rows sorted by (column, ascending), missing last either way, input order within ties; leading columns first, hidden prefixes dropped."""

    def step(df: DataFrame) -> DataFrame:
        df = missing_as_null(df)
        keys = [F.asc_nulls_last(c) if up else F.desc_nulls_last(c) for c, up in sort if c in df.columns]
        df = df.orderBy(*keys, *([order] if order else [])) if keys else df
        shown = [c for c in df.columns if not c.startswith(tuple(hidden))]
        return df.select(*[c for c in leading if c in shown], *[c for c in shown if c not in leading])

    return step


def violation(code: str, field: str, message: Column, severity: str = "error") -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"), F.lit(severity).alias("severity"), message.alias("message"))


NONE = "array<struct<code:string,field:string,severity:string,message:string>>"
# Texts that stand for a missing key.
NULL_WORDS = ("", "null", "none", "unknown", "n/a", "nan")


def keyword_rule(field: str, phrases: list[str]) -> Column:
    """Violations of a text key: null-like, or holding a forbidden phrase as adjacent whole words (of the shortest such phrases the first in the
    text is reported). Keys and phrases are compared folded, letters and digits apart, so ``mock1`` holds ``mock``."""
    by_length: dict[int, list[str]] = {}
    for words in {keyword_words(p) for p in phrases} - {()}:
        by_length.setdefault(len(words), []).append(" ".join(words))

    def hit_of(words: Column, k: int, some: list[str]) -> Column:
        places = F.when(F.size(words) >= k, F.sequence(F.lit(1), F.greatest(F.size(words) - k + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.get(F.filter(F.transform(places, lambda i: F.array_join(F.slice(words, i, k), " ")), lambda r: r.isin(*some)), F.lit(0))

    def first_hit(words: Column) -> Column:
        return F.coalesce(F.lit(None).cast("string"), *[hit_of(words, k, some) for k, some in sorted(by_length.items())])

    found = let(keyword_tokens(F.col(field).cast("string")), first_hit)
    nullish = F.lower(F.trim(F.coalesce(F.col(field), F.lit("")))).isin(*NULL_WORDS)
    hit = F.when(nullish, violation("null-key", field, F.lit("the key is missing"))).when(
        found.isNotNull(), violation("forbidden-keyword", field, F.concat(F.lit("holds "), found))
    )
    return F.filter(F.array(hit), lambda v: v.isNotNull())


def range_rule(field: str, low: float, high: float) -> Column:
    """Violations of a number: missing passes, what is no number or outside the inclusive range (NaN too) does not."""
    raw = F.col(field).cast("string")
    x = number(F.col(field))
    hit = F.when(raw.isNull(), None).when(x.isNull(), violation("not-a-number", field, raw)).when(
        F.isnan(x) | ~x.between(low, high), violation("out-of-range", field, F.format_string(f"%s is outside {low:g}..{high:g}", raw))
    )
    return F.filter(F.array(hit), lambda v: v.isNotNull())


def validated(rules: list[Column]) -> Step:
    """Adds ``violations`` of all rules and ``valid``: no violation is an error."""
    every = F.concat(*rules) if rules else F.array().cast(NONE)
    return lambda df: df.withColumn("violations", every).withColumn("valid", ~F.exists("violations", lambda v: v["severity"] == "error"))


def dbscan(points: DataFrame, eps: float, min_samples: int, key: str = "id", features: str = "features") -> DataFrame:
    """(key, cluster): Euclidean DBSCAN; noise and rows without finite features get -1, clusters are numbered by their smallest core key.

    Points at one place are one weighted spot. Spots lie in boxes so small that all spots of a box are neighbours. A full box, one of
    ``min_samples`` points, holds core points only; the few spots of other boxes meet those around them by a grid over the first two features
    (cells of width ``eps``, whole boxes each). Boxes, not spots, are joined to clusters, so the pairs within a crowd are never listed.
    """
    if eps <= 0 or min_samples < 1:
        raise ConfigError("eps is positive, min_samples at least 1")
    f = F.col(features)
    good = points.where(f.isNotNull() & (F.size(f) > 0) & F.forall(f, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    placed = good.groupBy(f.cast("array<double>").alias("p")).agg(F.min(key).alias("spot"), F.count("*").alias("n"))
    placed = placed.withColumn("d", F.size("p")).withColumn("m", F.floor(F.sqrt("d") * (1 + 2 * SLACK)) + 1).withColumn("at", _boxes(eps, 0))
    # Far from zero rounding could put strangers into one box; there a spot is a box of its own.
    far = F.when(F.forall("at", lambda i: i.between(-FAR, FAR)), F.array().cast("array<double>")).otherwise(F.col("p"))
    cell = lambda i: F.floor(F.coalesce(F.get("at", F.lit(i)), F.lit(0)) / F.col("m"))
    placed = checkpoint(placed.select("*", F.struct("at", far.alias("far")).alias("box"), cell(0).alias("gx"), cell(1).alias("gy")))
    full = placed.groupBy("box").agg((F.sum("n") >= min_samples).alias("full"))
    spots = checkpoint(placed.join(full, "box"))
    left = _around(spots.where("NOT full").select(F.col("spot").alias("a"), F.col("p").alias("pa"), "d", "gx", "gy"))
    right = spots.select(F.col("spot").alias("b"), F.col("p").alias("pb"), "n", "d", "gx", "gy")
    near = checkpoint(left.join(right, ["d", "gx", "gy"]).where(_gap(F.col("pa"), F.col("pb")) <= eps * eps).select("a", "b", "n"))
    others = near.groupBy(F.col("a").alias("spot")).agg((F.sum("n") >= min_samples).alias("core"))
    core = checkpoint(spots.join(others, "spot", "left").where("full OR core").drop("n", "full", "core"))
    held = checkpoint(core.groupBy("box", "at", "d", "m", "gx", "gy").agg(F.min("spot").alias("name"), *_ends()))
    named = checkpoint(core.join(held.select("box", "name"), "box").select("name", "spot", "p", "m"))
    roots = _joined_boxes(held, named, eps)
    cores = checkpoint(named.join(roots, "name").select("spot", "root"))
    edge = near.join(cores.withColumnRenamed("spot", "b"), "b").groupBy(F.col("a").alias("spot")).agg(F.min("root").alias("edge_root"))
    numbered = ranked_by_range(roots.select("root").distinct(), "root", "cluster")
    each = spots.select("spot", "p").join(cores, "spot", "left").join(edge, "spot", "left").select("p", F.coalesce("root", "edge_root").alias("root"))
    labelled = each.join(numbered, "root", "left").select("p", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    return points.join(labelled.withColumnRenamed("p", "_p"), f.cast("array<double>") == F.col("_p"), "left").select(key, F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def _boxes(eps: float, halvings: int) -> Column:
    """Numbers of the box of ``p`` along each feature: ``m`` boxes, halved so often, are a little more than ``eps`` wide, and a box's diagonal
    is less than ``eps``."""
    return F.transform("p", lambda x: F.floor(x / (F.lit(eps * (1 + SLACK) / 2**halvings) / F.col("m"))))


def _gap(a: Column, b: Column) -> Column:
    """Squared distance; NULL for points of different length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _around(rows: DataFrame) -> DataFrame:
    """Every row in its own cell and the eight around it."""
    offsets = F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in (-1, 0, 1) for b in (-1, 0, 1)])).alias("_o")
    return rows.select("*", offsets).withColumns({"gx": F.col("gx") + F.col("_o.dx"), "gy": F.col("gy") + F.col("_o.dy")}).drop("_o")


def _ends() -> list[Column]:
    """A box's outermost spots along the first two features."""
    each = [pick("p", F.get("p", F.lit(i))) for i in (0, 1) for pick in (F.min_by, F.max_by)]
    return [F.array_compact(F.array(*each)).alias("ends")]


def _joined_boxes(held: DataFrame, spots: DataFrame, eps: float) -> DataFrame:
    """(name, root): the smallest name of the boxes that a box is joined with. Most are joined by their outermost spots; only pairs of boxes
    that are then still of two clusters are looked at closely."""
    side = lambda x: held.select(F.col("name").alias(x), F.col("at").alias(f"at_{x}"), F.col("ends").alias(f"ends_{x}"), "d", "m", "gx", "gy")
    reach = F.forall(F.zip_with("at_a", "at_b", lambda x, y: F.abs(x.cast("double") - y) <= F.col("m") + F.abs(x.cast("double")) * 1e-14), lambda near: near)
    meet = F.exists("ends_a", lambda x: F.exists("ends_b", lambda y: _gap(x, y) <= eps * eps))
    pairs = checkpoint(_around(side("a")).join(side("b").drop("m"), ["d", "gx", "gy"]).where((F.col("a") < F.col("b")) & reach).select("a", "b", meet.alias("meet")))
    comp = components(pairs.where("meet").select(F.col("a").alias("source"), F.col("b").alias("target")))
    roots = held.select("name").join(comp.withColumnRenamed("record_id", "name"), "name", "left")
    roots = checkpoint(roots.select("name", F.coalesce("component", "name").alias("root")))
    of = lambda x: roots.select(F.col("name").alias(x), F.col("root").alias(f"root_{x}"))
    apart = checkpoint(pairs.where("NOT meet").join(of("a"), "a").join(of("b"), "b").where("root_a <> root_b").drop("meet"))
    if apart.isEmpty():
        return roots
    comp = components(_touching(apart, spots, eps).select(F.col("root_a").alias("source"), F.col("root_b").alias("target")))
    again = roots.join(comp.withColumnRenamed("record_id", "root"), "root", "left")
    return checkpoint(again.select("name", F.coalesce("component", "root").alias("root")))


def _touching(apart: DataFrame, spots: DataFrame, eps: float) -> DataFrame:
    """(root_a, root_b), distinct, of the pairs of boxes (a, b) that hold spots within ``eps`` of each other. Pairs of many spots are halved along
    every feature until the places of the parts tell, or few spots are left to compare."""
    roots = ["root_a", "root_b"]
    found = apart.select(*roots).limit(0)
    pairs = None
    for h in range(HALVINGS + 1):
        parts = spots.select("name", "p", "m", _boxes(eps, h).alias("part"), _boxes(eps, max(h - 1, 0)).alias("whole"))
        part = lambda x, *cols: parts.select(F.col("name").alias(x), F.col("part").alias(f"part_{x}"), *cols)  # noqa: E731, B023
        sizes = checkpoint(parts.groupBy("name", "whole", "part", "m").agg(F.count("*").alias("k")))
        size = lambda x: sizes.select(F.col("name").alias(x), F.col("whole").alias(f"whole_{x}"), F.col("part").alias(f"part_{x}"), F.col("k").alias(f"k_{x}"), *["m"] * (x == "a"))  # noqa: E731, B023
        if pairs is None:
            pairs = apart.join(size("a"), "a").join(size("b"), "b")
        else:
            pairs = pairs.join(size("a"), ["a", "whole_a"]).join(size("b"), ["b", "whole_b"])
        apart_by = lambda more: F.aggregate(F.zip_with("part_a", "part_b", lambda x, y: F.greatest(F.abs(x.cast("double") - y) + more, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x * x)
        wide = (F.col("m") * 2**h).cast("double")  # eps in sides of a part, nearly
        pairs = pairs.withColumns({"few": F.col("k_a") * F.col("k_b") <= FEW, "least": apart_by(-1.01), "most": apart_by(1.01)}).where(F.col("least") <= wide * wide)
        pairs = checkpoint(pairs.withColumn("sure", F.col("most") <= wide * wide * (1 - 4 * SLACK)).drop("whole_a", "whole_b", "k_a", "k_b", "least", "most", "m"))
        sure = pairs.where("sure").select(*roots)
        compared = pairs.where("NOT sure AND few" if h < HALVINGS else "NOT sure").join(part("a", F.col("p").alias("pa")), ["a", "part_a"]).join(part("b", F.col("p").alias("pb")), ["b", "part_b"])
        met = compared.where(_gap(F.col("pa"), F.col("pb")) <= eps * eps).select(*roots)
        found = checkpoint(found.union(sure).union(met).distinct())
        if h == HALVINGS:
            break
        pairs = pairs.where("NOT sure AND NOT few").join(found, roots, "left_anti")
        pairs = checkpoint(pairs.select("a", "b", *roots, F.col("part_a").alias("whole_a"), F.col("part_b").alias("whole_b")))
        if pairs.isEmpty():
            break
    return found


def ranked_by_range(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the 0-based place of every row in the order of a distinct column: places within range partitions plus the rows ahead of each."""
    parts = checkpoint(rows.repartitionByRange(column).withColumn("_part", F.spark_partition_id()))
    ahead, sizes = 0, []  # one entry per partition
    for part, n in sorted(tuple(r) for r in parts.groupBy("_part").count().collect()):
        sizes.append((part, ahead))
        ahead += n
    offsets = rows.sparkSession.createDataFrame(sizes, "_part int, _ahead bigint")
    place = F.row_number().over(W.partitionBy("_part").orderBy(column)) - 1 + F.col("_ahead")
    return parts.join(F.broadcast(offsets), "_part").withColumn(name, place.cast("int")).drop("_part", "_ahead")
