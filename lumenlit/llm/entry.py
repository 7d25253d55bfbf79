"""Queries of this subpackage over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlit.llm import blocks, linkage, lookalike, mixing, neighbours, ranking, splitting, tokens
from lumenlit.llm.sql import SQL
from lumenlit.session import load

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.boundaries(load(spark, sf_dir, "chunks"))


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_chunks(load(spark, sf_dir, "chunks"))


def p1_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, short, shared, whole): whether every piece of a chunk is within the limit, neighbours share no more than allowed, and the
    pieces without their overlaps give the text back."""
    chunks = load(spark, sf_dir, "chunks")
    pieces = splitting.split_chunks(chunks)
    own = F.substring("text", F.col("overlap") + 1, F.length("text"))
    ordered = F.array_sort(F.collect_list(F.struct("piece", own.alias("own"))))
    each = pieces.groupBy("chunk_id").agg(
        (F.max(F.length("text")) <= splitting.LIMIT).alias("short"), (F.max("overlap") <= splitting.OVERLAP).alias("shared"), F.array_join(F.transform(ordered, lambda p: p["own"]), "").alias("back")
    )
    texts = chunks.where(F.length("text") > 0).select("chunk_id", "text").distinct()
    return texts.join(each, "chunk_id", "left").select("chunk_id", "short", "shared", (F.col("back") == F.col("text")).alias("whole"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.same_paper(load(spark, sf_dir, "documents"))


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.link(load(spark, sf_dir, "documents")).where("confidence > 0").select("doc_id_a", "doc_id_b", "confidence")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.close_pairs(load(spark, sf_dir, "chunks"))


def p4_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.knn(load(spark, sf_dir, "chunks"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.best_of_all(load(spark, sf_dir, "search_hits"), load(spark, sf_dir, "scorers"))


def p5_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.median_rank(load(spark, sf_dir, "search_hits"), load(spark, sf_dir, "scorers"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.found_markup(load(spark, sf_dir, "documents"))


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.clean_fields(load(spark, sf_dir, "documents"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(load(spark, sf_dir, "documents"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"))[0]


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"))[1]


def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, known, repeats_kept, disjoint, share_kept) of every target: no row is drawn twice in one pass, none above the repeats allowed, and the
    reached share is within two of the largest rows of the target's part among the sources that have rows."""
    docs, targets = load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets")
    selection, report = mixing.mix(docs, targets)
    drawn = selection.groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.count_distinct("pass_no").alias("passes"))
    drawn = drawn.groupBy("source").agg(F.max("n").alias("most"), F.max((F.col("n") > F.col("passes")).cast("int")).alias("twice"))
    weight = report.select(F.sum(F.when(F.col("available") > 0, F.col("target_share"))).alias("every"))
    largest = selection.agg(F.coalesce(F.max("tokens"), F.lit(0)).alias("largest"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    rows = report.join(drawn, "source", "left").join(targets.select("source", "max_repeats"), "source").join(F.broadcast(weight)).join(F.broadcast(largest))
    want = F.when(F.col("available") > 0, F.col("target_share") / F.col("every")).otherwise(0.0)
    return rows.select(
        "source", (F.col("available") > 0).alias("known"), (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("repeats_kept"),
        (F.coalesce("twice", F.lit(0)) == 0).alias("disjoint"), (F.abs(F.col("reached_share") - want) * F.col("total") <= 2 * F.col("largest")).alias("share_kept"),
    )


def p10_looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.look_classes(load(spark, sf_dir, "documents"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.same_look(load(spark, sf_dir, "documents"))


def p10_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return docs.select("doc_id", lookalike.canonical_text(docs["text"]).alias("text"))


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit() and callable(v)}


def oracle_sql() -> dict[str, str]:
    return SQL
