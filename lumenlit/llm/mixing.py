"""Mixing sources to target weights.

Each source's rows are spread by hash over blocks of about equal token counts. The total is the largest at which every source can give
its share with no row repeated more than allowed; each source's quota is whole passes over its rows plus the first blocks of one
more pass, the last block cut row by row. A splitting tree hands the block quotas out to the output shards: each node divides its
vector of blocks per source between its two halves by a multivariate-hypergeometric draw, so every split is exact and unbiased. Shards
draw disjoint runs of each source's permuted blocks and shuffle locally.

The driver only sees counts per source and block (bounded by ``MAX_BLOCKS`` per source) and the tree. Sums run over blocks,
then within one block, so a source that holds a third of all rows is never one task.

Defined results: rows with NULL source, or a source without a target, are not drawn; NULL and empty texts have no tokens and are not
drawn; a target without rows reaches share 0 and the others keep their proportions; a NULL or negative target counts as 0; repeated
rows are drawn as rows of their own.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenlit.llm.tokens import TOKENIZERS, count_corpus
from lumenlit.session import broadcast_counted, checkpoint

BLOCK_TOKENS, MAX_BLOCKS, SHARDS, SEED = 20_000, 4_096, 8, 11


def token_counts(documents: DataFrame, path: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    """(doc_id, source, tokens) of rows with a source and at least one token, counted by the operator that encodes the corpus."""
    rows = documents.where(F.col("source").isNotNull() & (F.length("text") > 0))
    return count_corpus(rows.select("doc_id", "source", "text"), ["doc_id", "source"], path=path)


def plan(available: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, int]:
    """Tokens to draw of each source. Without ``total``, the largest at which the shares hold within the repeats allowed."""
    open_ = {s: w for s, (w, r) in targets.items() if w and w > 0 and r and r > 0 and available.get(s, 0) > 0}
    weight = sum(open_.values())
    if not open_:
        return {}
    if total is None:
        total = min(int(available[s] * targets[s][1] * weight / w) for s, w in open_.items())
    return {s: min(int(total * w / weight), available[s] * targets[s][1]) for s, w in open_.items()}


def splitting_tree(blocks: dict[str, int], shards: int, seed: int = SEED) -> list[dict[str, int]]:
    """Blocks of each source that every shard draws; columns sum to ``blocks`` exactly."""
    names = sorted(blocks)
    rng = np.random.default_rng(seed)
    out: list[dict[str, int]] = []

    def divide(counts: np.ndarray, n: int) -> None:
        if n == 1:
            out.append(dict(zip(names, counts.tolist())))
            return
        total = int(counts.sum())
        half = n // 2
        take = total * half // n
        left = rng.multivariate_hypergeometric(counts, take, method="marginals") if total else counts
        divide(left, half)
        divide(counts - left, n - half)

    divide(np.array([blocks[s] for s in names], np.int64), shards)
    return out


def mix(documents: DataFrame, mix_targets: DataFrame, shards: int = SHARDS, seed: int = SEED, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(selection: shard, place, doc_id, source, pass_no, tokens; report: source, target_share, reached_share, tokens, rows, repeats, available)."""
    spark = documents.sparkSession
    # Targets are a table of sources, as many rows as sources.
    targets = {r.source: (r.target_share or 0.0, r.max_repeats or 0) for r in mix_targets.collect() if r.source is not None}
    sized = token_counts(documents)
    sized = checkpoint(sized.withColumn("u", F.xxhash64(F.lit(seed), "doc_id").bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)))
    available = {r[0]: r[1] for r in sized.groupBy("source").agg(F.sum("tokens")).collect() if r[0] in targets}
    quota = plan(available, targets, total)
    counts = {s: max(1, min(MAX_BLOCKS, math.ceil(available[s] / BLOCK_TOKENS))) for s in quota}
    per_source = spark.createDataFrame([(s, counts[s]) for s in quota], "source string, n int")
    placed = sized.join(broadcast_counted(per_source), "source").withColumn("block", F.floor(F.col("u") * F.col("n")).cast("int")).drop("n")
    sizes: dict[str, dict[int, int]] = {s: {} for s in quota}
    for s, b, n in placed.groupBy("source", "block").agg(F.sum("tokens")).collect():
        sizes[s][b] = n
    draws = []  # (source, pass, block, tokens allowed: -1 the whole block)
    for s, want in quota.items():
        passes, rest = divmod(want, available[s])
        draws += [(s, p, b, -1) for p in range(passes) for b in range(counts[s])]
        for b in range(counts[s]):
            n = sizes[s].get(b, 0)
            if rest <= 0:
                break
            draws.append((s, passes, b, -1 if n <= rest else rest))
            rest -= n
    # Blocks of a source are permuted, then dealt to the shards in runs of the tree's counts.
    rng = np.random.default_rng(seed + 1)
    deal = []
    by_source: dict[str, list[tuple]] = {}
    for d in draws:
        by_source.setdefault(d[0], []).append(d)
    for s in by_source:
        by_source[s] = [by_source[s][i] for i in rng.permutation(len(by_source[s]))]
    at = dict.fromkeys(by_source, 0)
    for shard, share in enumerate(splitting_tree({s: len(d) for s, d in by_source.items()}, shards, seed)):
        for s, n in share.items():
            deal += [(*d, shard) for d in by_source[s][at[s] : at[s] + n]]
            at[s] += n
    dealt = spark.createDataFrame(deal, "source string, pass_no int, block int, allowed bigint, shard int")
    drawn = placed.join(broadcast_counted(dealt), ["source", "block"])
    before = F.sum("tokens").over(W.partitionBy("source", "block", "pass_no").orderBy("u", "doc_id")) - F.col("tokens")
    # A cut block is one block of one pass; the row that crosses the quota is drawn when most of it is inside.
    cut = drawn.where(F.col("allowed") >= 0).withColumn("before", before).where(F.col("before") + F.col("tokens") / 2 <= F.col("allowed")).drop("before")
    chosen = drawn.where(F.col("allowed") < 0).unionByName(cut)
    # ``place`` orders the rows of a shard at random; reading a shard in that order is its local shuffle.
    place = F.xxhash64(F.lit(seed + 2), "doc_id", "pass_no")
    selection = chosen.select("shard", place.alias("place"), "doc_id", "source", "pass_no", "tokens")
    got = selection.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows"), F.max("pass_no").alias("last"))
    whole = spark.createDataFrame(
        [(s, float(w), available.get(s, 0)) for s, (w, _) in sorted(targets.items())], "source string, target_share double, available bigint"
    )
    joined = whole.join(got, "source", "left").select("source", "target_share", "available", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("rows", F.lit(0)).alias("rows"), (F.coalesce("last", F.lit(-1)) + 1).alias("repeats"))
    joined = joined.withColumn("every", F.sum("tokens").over(W.partitionBy()))  # one row per target
    report = joined.select("source", "target_share", (F.col("tokens") / F.greatest("every", F.lit(1))).alias("reached_share"), "tokens", "rows", "repeats", "available")
    return selection, report
