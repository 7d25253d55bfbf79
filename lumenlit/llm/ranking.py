"""One ranking from several differently-scaled scores, by median rank aggregation.

Every scorer's list becomes ranks (best = 1, ties share the smallest), so ranges and distributions do not matter.
A record a scorer does not list ranks behind that scorer's last. Records are ordered by weighted median rank, then
mean rank, then identifier.

Ranks are counted without gathering a list in one task: scores fall into monotone coarse buckets, counts per bucket
give each bucket's offset, and windows only run within a bucket over distinct scores. A query that holds a third of
all hits is therefore split over its buckets.

Defined results: NULL and NaN scores do not count, infinite ones do; of rows with one query, scorer, record and chunk
the latest ``scored_at`` holds (ties: the better score); a record's best chunk counts; a scorer missing from
``scorers`` counts as higher-is-better; NULL record ids and NULL query ids are left out; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenlit.session import broadcast_counted

#: Coarse buckets per doubling of a score, and width of a coarse bucket of ranks.
PER_OCTAVE, RANK_STEP = 1024, 4096


def coarse(score: Column) -> Column:
    """Non-decreasing bucket of a score."""
    size = F.floor(F.log2(F.least(F.greatest(F.abs(score), F.lit(1e-300)), F.lit(1e300))) * PER_OCTAVE).cast("long") + F.lit(1 << 21)
    return F.when(score > 0, size).when(score < 0, -size).otherwise(F.lit(0).cast("long"))


def best_scores(hits: DataFrame, scorers: DataFrame) -> DataFrame:
    """(query_id, scorer, record_id, s): one row per listed record, larger ``s`` is better."""
    side = broadcast_counted(scorers.groupBy("scorer").agg(F.max("higher_is_better").alias("up")))
    rows = hits.where(F.col("query_id").isNotNull() & F.col("record_id").isNotNull() & F.col("scorer").isNotNull())
    signed = rows.join(side, "scorer", "left").withColumn("s", F.when(F.coalesce("up", F.lit(True)), F.col("score")).otherwise(-F.col("score")))
    valid = F.when(F.col("s").isNotNull() & ~F.isnan("s"), F.col("s"))
    latest = signed.groupBy("query_id", "scorer", "record_id", "chunk_index").agg(F.max(F.struct("scored_at", valid.alias("s")))["s"].alias("s"))
    return latest.where(F.col("s").isNotNull()).groupBy("query_id", "scorer", "record_id").agg(F.max("s").alias("s"))


def scorer_ranks(best: DataFrame) -> DataFrame:
    """Adds ``rank`` within (query_id, scorer), 1 is best, and the list's length ``listed``."""
    keys = ["query_id", "scorer"]
    values = best.groupBy(*keys, "s").agg(F.count("*").alias("n")).withColumn("b", coarse(F.col("s")))
    buckets = values.groupBy(*keys, "b").agg(F.sum("n").alias("n"))
    ahead = F.sum("n").over(W.partitionBy(*keys).orderBy(F.desc("b"))) - F.col("n")
    offsets = buckets.select(*keys, "b", ahead.alias("ahead"), F.sum("n").over(W.partitionBy(*keys)).alias("listed"))
    within = F.sum("n").over(W.partitionBy(*keys, "b").orderBy(F.desc("s"))) - F.col("n")
    ranks = values.select(*keys, "b", "s", within.alias("within")).join(offsets, [*keys, "b"])
    return best.join(ranks.select(*keys, "s", (F.col("ahead") + F.col("within") + 1).alias("rank"), "listed"), [*keys, "s"])


def weighted_median(pairs: Column) -> Column:
    """Smallest rank whose cumulated weight reaches half. ``pairs``: array of (rank, weight); as many as a query has scorers."""
    ordered = F.array_sort(pairs)
    half = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["w"]) / 2
    start = F.struct(F.lit(0.0).alias("c"), F.lit(None).cast("double").alias("m"))
    step = lambda a, p: F.struct(
        (a["c"] + p["w"]).alias("c"), F.when(a["m"].isNull() & (a["c"] + p["w"] >= half - 1e-9), p["r"]).otherwise(a["m"]).alias("m")
    )
    return F.aggregate(ordered, start, step, lambda a: a["m"])


def aggregated(hits: DataFrame, scorers: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(query_id, record_id, median_rank, mean_rank, ranks by scorer, lists: length of every scorer's list)."""
    ranked = scorer_ranks(best_scores(hits, scorers))
    lists = ranked.groupBy("query_id", "scorer").agg(F.max("listed").alias("listed"))
    lists = lists.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("scorer", "listed"))).alias("lists"))
    own = ranked.groupBy("query_id", "record_id").agg(F.map_from_entries(F.collect_list(F.struct("scorer", F.col("rank")))).alias("ranks"))
    weight = F.create_map(*[F.lit(x) for kv in (weights or {"": 1.0}).items() for x in kv])
    pairs = F.transform(
        F.map_keys("lists"),
        lambda s: F.struct(
            F.coalesce(F.try_element_at("ranks", s), F.try_element_at("lists", s) + 1).cast("double").alias("r"),
            F.coalesce(F.try_element_at(weight, s), F.lit(1.0)).alias("w"),
        ),
    )
    mean = F.aggregate("pairs", F.lit(0.0), lambda a, p: a + p["r"] * p["w"]) / F.aggregate("pairs", F.lit(0.0), lambda a, p: a + p["w"])
    return own.join(lists, "query_id").withColumn("pairs", pairs).select(
        "query_id", "record_id", weighted_median(F.col("pairs")).alias("median_rank"), F.round(mean, 9).alias("mean_rank"), "ranks", "lists"
    )


def median_rank(hits: DataFrame, scorers: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(query_id, record_id, position, median_rank, mean_rank, scorers_listing)."""
    scored = aggregated(hits, scorers, weights).withColumn("scorers_listing", F.size("ranks")).drop("ranks", "lists")
    scored = scored.withColumns({"c1": F.floor(F.col("median_rank") / RANK_STEP), "c2": F.floor(F.col("mean_rank") / RANK_STEP)})
    buckets = scored.groupBy("query_id", "c1", "c2").agg(F.count("*").alias("n"))
    offsets = buckets.select("query_id", "c1", "c2", (F.sum("n").over(W.partitionBy("query_id").orderBy("c1", "c2")) - F.col("n")).alias("ahead"))
    within = F.row_number().over(W.partitionBy("query_id", "c1", "c2").orderBy("median_rank", "mean_rank", "record_id"))
    return scored.withColumn("within", within).join(offsets, ["query_id", "c1", "c2"]).select(
        "query_id", "record_id", (F.col("ahead") + F.col("within")).alias("position"), "median_rank", "mean_rank", "scorers_listing"
    )


def best_of_all(hits: DataFrame, scorers: DataFrame, top: int = 20) -> DataFrame:
    """(query_id, record_id) among the ``top`` best of every scorer of the query: the records whose median rank is that good, then the exact
    check of each of their ranks."""
    good = aggregated(hits, scorers).where(F.col("median_rank") <= top)
    every = (F.size("ranks") == F.size("lists")) & F.forall(F.map_values("ranks"), lambda r: r <= top)
    return good.where(every).select("query_id", "record_id")
