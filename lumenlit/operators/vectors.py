"""Cosine search over stored vectors and fusion of ranked lists.

A query vector is a literal in the plan, so a search is one scan with a bounded top-k; nothing is joined. Vectors that are NULL, of
another length, all zero or not finite have no similarity and are left out; ties go to record_id, then chunk_index.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenlit.errors import FusionError
from lumenlit.functions.text import let


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def cosine(v: Column, query: list[float]) -> Column:
    """Cosine of a vector column and a query vector in double precision; NULL where there is none."""
    norm = math.sqrt(sum(x * x for x in query))
    if not query or not math.isfinite(norm) or norm == 0:
        raise FusionError("a query vector is finite and not zero")
    q = F.array(*[F.lit(float(x) / norm) for x in query])
    d = F.transform(v, lambda x: x.cast("double"))
    size = F.sqrt(_sum(F.transform(d, lambda x: x * x)))
    value = _sum(F.zip_with(d, q, lambda x, y: x * y)) / F.nullif(size, F.lit(0.0))
    return F.when((F.size(v) == len(query)) & ~F.isnan(value) & (F.abs(value) < 2), value)


def unit(v: Column) -> Column:
    """A vector of length one; zero and non-finite vectors stay. Length is taken over the largest component first, so that no square overflows."""

    def scaled(big: Column) -> Column:
        return let(F.sqrt(_sum(F.transform(v, lambda x: (x / big) * (x / big)))) * big, shortened)

    def shortened(size: Column) -> Column:
        return F.when((size > 0) & (size < float("inf")), F.transform(v, lambda x: (x / size).cast("float"))).otherwise(v)

    return let(F.nullif(F.array_max(F.transform(v, lambda x: F.abs(x.cast("double")))), F.lit(0.0)), scaled)


def nearest_chunks(chunks: DataFrame, query: list[float], k: int = 10, least: float | None = None, exclude: str | None = None) -> DataFrame:
    """(record_id, chunk_index, score): the ``k`` most similar chunks; replays of a chunk count once."""
    rows = chunks if exclude is None else chunks.where(F.col("record_id") != exclude)
    scored = rows.select("record_id", "chunk_index", cosine(F.col("vector"), query).alias("score")).where(F.col("score").isNotNull())
    scored = scored.groupBy("record_id", "chunk_index").agg(F.max("score").alias("score"))
    if least is not None:
        scored = scored.where(F.col("score") >= least)
    return scored.orderBy(F.desc("score"), "record_id", "chunk_index").limit(max(k, 0))


def best_chunk(hits: DataFrame) -> DataFrame:
    """(record_id, chunk_index, score): every record's best chunk, of equal ones the first."""
    return hits.groupBy("record_id").agg(F.min_by(F.struct("chunk_index", "score"), F.struct(-F.col("score"), "chunk_index")).alias("b")).select("record_id", "b.chunk_index", "b.score")


def relevant(chunks: DataFrame, references: list[list[float]], least: float = 0.35) -> DataFrame:
    """Chunks whose largest cosine to the reference vectors (a handful, held in the plan) is at least ``least``."""
    best = F.greatest(*[cosine(F.col("vector"), r) for r in references]) if len(references) > 1 else cosine(F.col("vector"), references[0])
    return chunks.withColumn("relevance", best).where(F.col("relevance") >= least)


def ranked_list(hits: DataFrame, name: str) -> DataFrame:
    """(list, record_id, rank, score) of a bounded hit list; a record counts once, at its best place."""
    best = hits.groupBy("record_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(W.partitionBy("list").orderBy(F.desc("score"), "record_id"))
    return best.withColumn("list", F.lit(name)).select("list", "record_id", place.alias("rank"), "score")


def rrf(lists: DataFrame, weights: dict[str, float] | None = None, k: int = 60) -> DataFrame:
    """(record_id, fused): reciprocal rank fusion of (list, record_id, rank)."""
    if k < 1 or any(not math.isfinite(w) or w < 0 for w in (weights or {}).values()):
        raise FusionError("k is at least 1, weights are finite and not negative")
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("list") == name, F.lit(float(w))).otherwise(weight)
    return lists.groupBy("record_id").agg(F.sum(weight / (k + F.col("rank"))).alias("fused"))


def minmax(lists: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(record_id, fused): sum of the scores of (list, record_id, score), each list scaled to 0..1; equal scores count 1."""
    bad = F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))
    lists = lists.withColumn("score", F.when(bad, F.raise_error(F.lit("scores to be scaled are finite")).cast("double")).otherwise(F.col("score")))
    w = W.partitionBy("list")
    low, high = F.min("score").over(w), F.max("score").over(w)
    weight = F.lit(1.0)
    for name, x in (weights or {}).items():
        weight = F.when(F.col("list") == name, F.lit(float(x))).otherwise(weight)
    scaled = lists.withColumn("s", F.when(high == low, F.lit(1.0)).otherwise((F.col("score") - low) / F.nullif(high - low, F.lit(0.0))) * weight)
    return scaled.groupBy("record_id").agg(F.sum("s").alias("fused"))


def hybrid(lexical: DataFrame, semantic: DataFrame, top: int = 10, method: str | Callable[[DataFrame], DataFrame] = "rrf") -> DataFrame:
    """(record_id, fused, lexical_rank, semantic_rank): one list from two bounded ones; absent ranks are NULL. ``method``: rrf, minmax, or a function from
    (list, record_id, rank, score) to (record_id, fused)."""
    if not callable(method) and method not in ("rrf", "minmax"):
        raise FusionError("a method is rrf, minmax or a function")
    both = ranked_list(lexical, "lexical").unionByName(ranked_list(semantic, "semantic"))
    fused = (method if callable(method) else {"rrf": rrf, "minmax": minmax}[method])(both)
    ranks = both.groupBy("record_id").agg(*[F.max(F.when(F.col("list") == x, F.col("rank"))).alias(f"{x}_rank") for x in ("lexical", "semantic")])
    return fused.join(ranks, "record_id").orderBy(F.desc("fused"), "record_id").limit(top)


def embedding_edges(chunks: DataFrame, asked: DataFrame, limit: int = 10, pool: int = 5, block: int = 2048) -> DataFrame:
    """(source, target, weight, kind): for each asked record (record_id, vector) the ``limit`` records whose passages are most similar, out of its
    ``limit * pool`` nearest passages of other records with a cosine of at least 0. Asked vectors go through the passages in blocks of bounded size; a task keeps
    the best of each for its part, so what is merged is asked x tasks x pool rows."""
    import numpy as np
    import pyarrow as pa

    size = limit * pool
    spark = chunks.sparkSession
    usable = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = chunks.where(F.col("record_id").isNotNull() & usable).select("record_id", "chunk_index", "vector")
    wanted = asked.where(F.col("record_id").isNotNull() & usable).select("record_id", "vector", F.size("vector").alias("dim"))
    number = F.row_number().over(W.partitionBy("dim").orderBy("record_id")) - 1
    wanted = wanted.withColumn("block", F.floor(number / block))
    found = spark.createDataFrame([], "source string, target string, chunk_index int, score double")
    for dim, no in sorted(tuple(r) for r in wanted.select("dim", "block").distinct().collect()):
        part = wanted.where((F.col("dim") == dim) & (F.col("block") == no)).orderBy("record_id").collect()  # at most ``block`` rows
        names, q = np.array([r.record_id for r in part], object), np.array([r.vector for r in part], np.float64)
        q /= np.linalg.norm(q, axis=1, keepdims=True)

        def best(batches, names=names, q=q, dim=dim):
            keep_s, keep_r, keep_c = np.full((len(q), 0), -2.0), np.empty((len(q), 0), object), np.zeros((len(q), 0), np.int64)
            for b in batches:
                lists = b["vector"]
                fits = np.flatnonzero(np.diff(lists.offsets.to_numpy()) == dim)
                if not len(fits):
                    continue
                taken = b.take(pa.array(fits))
                x = taken["vector"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
                s = q @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
                r, c = np.array(taken["record_id"].to_pylist(), object), taken["chunk_index"].to_numpy(zero_copy_only=False)
                s[names[:, None] == r[None, :]] = -2.0
                s, r, c = np.concatenate([keep_s, s], 1), np.concatenate([keep_r, np.tile(r, (len(q), 1))], 1), np.concatenate([keep_c, np.tile(c, (len(q), 1))], 1)
                if s.shape[1] > size:
                    top = np.argsort(-s, axis=1, kind="stable")[:, :size]
                    s, r, c = np.take_along_axis(s, top, 1), np.take_along_axis(r, top, 1), np.take_along_axis(c, top, 1)
                keep_s, keep_r, keep_c = s, r, c
            a, b = np.nonzero(keep_s >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(names[a], pa.string()), pa.array(keep_r[a, b], pa.string()), pa.array(keep_c[a, b], pa.int32()), pa.array(keep_s[a, b])], ["source", "target", "chunk_index", "score"])

        found = found.unionByName(rows.dropDuplicates(["record_id", "chunk_index"]).mapInArrow(best, "source string, target string, chunk_index int, score double"))
    place = F.row_number().over(W.partitionBy("source").orderBy(F.desc("score"), "target", "chunk_index"))
    nearest = found.withColumn("_p", place).where(F.col("_p") <= size)
    each = nearest.groupBy("source", "target").agg(F.max("score").alias("weight"))
    order = F.row_number().over(W.partitionBy("source").orderBy(F.desc("weight"), "target"))
    return each.withColumn("_p", order).where(F.col("_p") <= limit).select("source", "target", "weight", F.lit("embedding").alias("kind"))


def embedded(rows: DataFrame, embedder: Callable[[], Callable[[list[str]], list[list[float]]]], column: str = "text", batch: int = 64) -> DataFrame:
    """Adds ``vector`` and ``error``. ``embedder`` makes, once per task, a function from texts to vectors, which is called with up to ``batch`` texts; a fault
    is the error of its batch. NULL and blank texts have no vector and no error."""
    import pandas as pd

    def run(batches):
        embed = embedder()
        for s in batches:
            vectors, errors = [None] * len(s), [None] * len(s)
            some = [i for i, t in enumerate(s) if t is not None and t.strip()]
            for at in range(0, len(some), batch):
                part = some[at : at + batch]
                try:
                    got = embed([s.iloc[i] for i in part])
                    if len(got) != len(part):
                        raise ValueError(f"{len(got)} vectors for {len(part)} texts")
                    for i, v in zip(part, got):
                        vectors[i] = [float(x) for x in v]
                except Exception as e:  # noqa: BLE001 - any fault of a batch is its rows' result
                    for i in part:
                        errors[i] = f"{type(e).__name__}: {e}"[:4096]
            yield pd.DataFrame({"vector": vectors, "error": errors})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return rows.withColumn("_e", F.pandas_udf(run, "vector array<float>, error string")(F.col(column))).select("*", "_e.vector", "_e.error").drop("_e")
