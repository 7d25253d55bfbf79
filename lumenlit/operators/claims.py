"""Claims with evidence: identifiers, the change feed, rejections, stores as append-only tables.

A claim's identifier hashes what it says and where, not the model that read it. Stores are append-only logs; the state in force is the
last write per key, chosen by combining aggregates. NULL identifiers are left out; replays collapse; an empty log gives an empty state.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from lumenlit.errors import StoreError
from lumenlit.functions.text import PY_SPACE, content_hash

def _json(c: Column) -> Column:
    """A value as compact JSON."""
    return F.regexp_extract(F.to_json(F.array(c), {"ignoreNullFields": "false"}), r"(?s)^\[(.*)\]$", 1)


@F.pandas_udf(T.StringType())
def _hashed(s: pd.Series) -> pd.Series:
    """Hash of a JSON list, written anew where the two writers differ in how they escape control characters."""
    return s.map(lambda j: content_hash(json.loads(j)), na_action="ignore")


def claim_id(schema_hash: str = "") -> Column:
    """Identifier of a claim row: a hash of record, kind, subject, predicate, object, polarity, context, the quantity's text without white space,
    span and schema. Model and prompt do not count. Only rows with rare control characters leave the JVM."""
    entries = F.map_entries(F.coalesce("context", F.create_map().cast("map<string,string>")))
    pairs = F.array_sort(F.transform(entries, lambda e: F.array(e["key"], F.coalesce(e["value"], F.lit("None")))))
    verbatim = F.regexp_replace("quantity.verbatim", f"[{PY_SPACE}]+", "")
    plain = [_json(F.col(c)) for c in ("record_id", "kind", "subject", "predicate", "object", "polarity")]
    rest = [F.to_json(pairs), _json(verbatim), _json(F.col("span_start")), _json(F.col("span_end")), F.lit(json.dumps(schema_hash))]
    whole = F.concat(F.lit("["), F.concat_ws(",", *plain, *rest), F.lit("]"))
    rare = whole.rlike(r"\\\\u[0-9a-fA-F]{4}")
    return F.when(rare, _hashed(F.when(rare, whole))).otherwise(F.sha2(whole, 256))


def unique_claims(claims: DataFrame) -> DataFrame:
    """One row per claim_id, the first by (revision, position)."""
    n = F.row_number().over(W.partitionBy("claim_id").orderBy("revision", "position"))
    return claims.where(F.col("claim_id").isNotNull()).withColumn("_n", n).where("_n = 1").drop("_n")


def changes(claims: DataFrame) -> DataFrame:
    """(revision, record_id, op): one change per write; a record's claims are replaced as a whole."""
    return claims.groupBy("record_id", "revision").agg(F.lit("replace").alias("op")).select("revision", "record_id", "op")


def changes_since(feed: DataFrame, revision: int, limit: int) -> DataFrame:
    """The next ``limit`` changes behind a revision, in order; those of one revision by record."""
    if limit < 1:
        raise StoreError("a limit is at least 1")
    return feed.where(F.col("revision") > revision).orderBy("revision", "record_id").limit(limit)


def head(feed: DataFrame) -> DataFrame:
    """(revision,): the last one, 0 for an empty feed."""
    return feed.agg(F.coalesce(F.max("revision"), F.lit(0)).alias("revision"))


def in_force(log: DataFrame, key: str, order: str, deleted: Column | None = None) -> DataFrame:
    """Last write per key of an append-only log; keys whose last write is a deletion are gone."""
    keep = [c for c in log.columns if c != key]
    last = log.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*keep), F.col(order)).alias("r")).select(key, "r.*")
    return last.where(~deleted) if deleted is not None else last


def open_rejections(log: DataFrame, after: str = "", limit: int = 100) -> DataFrame:
    """Unresolved rejections in order of entry_id behind ``after``; the first put of an entry and its last resolution hold."""
    if limit < 1:
        raise StoreError("a limit is at least 1")
    first = log.groupBy("entry_id").agg(
        F.min_by(F.struct("record_id", "entity", "violations", "created_at"), F.col("created_at")).alias("r"), F.max("resolution").alias("resolution")
    )
    return first.where(F.col("resolution").isNull() & (F.col("entry_id") > after)).orderBy("entry_id").limit(limit).select("entry_id", "r.*")
