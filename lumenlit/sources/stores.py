"""Stores as append-only tables: vectors, claims with a change feed, rejections, model answers, and table sinks.

A write appends one numbered folder and then a small commit file; only committed writes are read. What is in force is the last write per
key, found by combining aggregates over keys and numbers; rows join back on (key, number). A write replaces all rows of its keys.

Defined results: rows without a key are left out; an empty write changes nothing; a store without writes is empty; of one key's rows in a write
all hold (a record's chunks or claims).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlit.errors import StoreError
from lumenlit.operators.claims import changes_since, open_rejections
from lumenlit.operators.vectors import unit
from lumenlit.sources.files import Files


class KeyedLog:
    """Rows of a schema under a key; ``replace`` and ``delete`` are its writes."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str):
        self.spark, self.path, self.key, self.schema = spark, path.rstrip("/"), key, schema
        self.files = Files(spark, path)

    def numbers(self) -> list[int]:
        return [int(n) for n in self.files.names("commits")]

    def _write(self, rows: DataFrame, op: str) -> int:
        no = max(self.numbers(), default=0) + 1
        named = rows.where(F.trim(F.coalesce(F.col(self.key).cast("string"), F.lit(""))) != "")
        named.withColumns({"_no": F.lit(no).cast("bigint"), "_op": F.lit(op)}).write.mode("overwrite").parquet(f"{self.path}/data/{no:09d}")
        self.files.write(f"commits/{no:09d}", {"op": op})
        return no

    def replace(self, rows: DataFrame) -> int:
        """All rows of the keys in ``rows`` become these; returns the revision."""
        columns = [f.name for f in self.spark.createDataFrame([], self.schema).schema.fields]
        missing = set(columns) - set(rows.columns)
        if missing:
            raise StoreError(f"the rows lack {sorted(missing)}")
        return self._write(rows.select(*columns), "replace")

    def delete(self, keys: DataFrame) -> int:
        """No rows of these keys are left."""
        columns = self.spark.createDataFrame([], self.schema).schema.fields
        return self._write(keys.select(self.key).distinct().select(*[F.col(f.name) if f.name == self.key else F.lit(None).cast(f.dataType).alias(f.name) for f in columns]), "delete")

    def log(self) -> DataFrame:
        """Every write's rows, with ``_no`` and ``_op``."""
        schema = f"{self.schema}, _no bigint, _op string"
        numbers = self.numbers()
        if not numbers:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{n:09d}" for n in numbers])

    def rows(self) -> DataFrame:
        """What is in force."""
        log = self.log()
        last = log.groupBy(self.key).agg(F.max("_no").alias("_no"))
        return log.join(last, [self.key, "_no"], "left_semi").where("_op = 'replace'").drop("_no", "_op")

    def count(self) -> int:
        return self.rows().count()

    def feed(self) -> DataFrame:
        """(revision, key, op): one change per key and write."""
        return self.log().groupBy(F.col("_no").alias("revision"), F.col(self.key)).agg(F.first("_op").alias("op")).select("revision", self.key, "op")

    def stream(self) -> DataFrame:
        """The log as a stream of the rows of every write, for a query that follows the changes. A folder counts once its rows are written."""
        return self.spark.readStream.schema(f"{self.schema}, _no bigint, _op string").option("recursiveFileLookup", True).parquet(f"{self.path}/data")


class VectorStore(KeyedLog):
    """Passages with vectors; a record's passages are replaced as a whole, vectors are stored at length one."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, "record_id", "record_id string, chunk_index int, text string, vector array<float>, metadata string")

    def put(self, chunks: DataFrame) -> int:
        return self.replace(chunks.withColumn("vector", unit(F.col("vector"))))

    def records(self) -> DataFrame:
        """(record_id, passages, metadata): every record's texts in order; no vector is read."""
        rows = self.rows().drop("vector")
        each = rows.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text", "metadata"))).alias("c"))
        return each.select("record_id", F.col("c.text").alias("passages"), F.get(F.col("c.metadata"), F.lit(0)).alias("metadata"))


class ClaimStore(KeyedLog):
    """Claims by record, with a change feed."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        super().__init__(spark, path, "record_id", schema)

    def changes_since(self, revision: int, limit: int = 100) -> DataFrame:
        return changes_since(self.feed(), revision, limit)


class RejectionStore(KeyedLog):
    """Rejected entities: the first put of an entry holds, a resolution closes it."""

    SCHEMA = "entry_id string, record_id string, entity string, violations string, quote string, created_at string, resolution string"

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, "entry_id", self.SCHEMA)

    def put(self, rows: DataFrame) -> int:
        return self.replace(rows.withColumn("resolution", F.lit(None).cast("string")))

    def resolve(self, rows: DataFrame) -> int:
        """``rows``: entry_id, resolution."""
        empty = [F.lit(None).cast("string").alias(c) for c in ("record_id", "entity", "violations", "quote", "created_at")]
        return self.replace(rows.select("entry_id", *empty, "resolution"))

    def unresolved(self, after: str = "", limit: int = 100) -> DataFrame:
        log = self.log().withColumn("created_at", F.coalesce("created_at", F.lit("9999")))
        return open_rejections(log, after, limit)

    def count_unresolved(self) -> int:
        return self.log().groupBy("entry_id").agg(F.max("resolution").alias("r")).where("r is null").count()


class AnswerCache(KeyedLog):
    """Model answers by request key. Answers are joined before the model is asked, so only misses are; a key's last answer holds."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, "key", "key string, answer string")

    def put(self, rows: DataFrame) -> int:
        return self.replace(rows.select("key", "answer").dropDuplicates(["key"]))

    def clear(self) -> int:
        return self.delete(self.rows())

    def answered(self, requests: DataFrame) -> DataFrame:
        """``requests`` (with ``key``) with ``answer``, NULL for a miss."""
        return requests.join(self.rows(), "key", "left")


def write_table(rows: DataFrame, url: str, table: str, mode: str = "append", properties: dict | None = None) -> None:
    """A table of a SQL database by JDBC (a driver must be on the class path), or of the catalogue where ``url`` is empty. ``mode``: append,
    overwrite, or error (the table must not exist)."""
    if mode not in ("append", "overwrite", "error"):
        raise StoreError("mode is append, overwrite or error")
    if url:
        rows.write.mode(mode).jdbc(url, table, properties=properties or {})
    else:
        rows.write.mode(mode).saveAsTable(table)


def scatter_spec(rows: DataFrame, x: str, y: str, z: str, label: str | None = None, colour: str | None = None, most: int = 100_000) -> dict | None:
    """A three-dimensional scatter plot as the JSON figure that plotting libraries read; rows without all three values are left out, none left
    gives None. A figure of more than ``most`` points is an error: it would be collected."""
    wanted = [c for c in (x, y, z, label, colour) if c]
    shown = rows.select(*dict.fromkeys(wanted)).dropna(subset=[x, y, z])
    shown = shown.where(~(F.isnan(F.col(x).cast("double")) | F.isnan(F.col(y).cast("double")) | F.isnan(F.col(z).cast("double")))).limit(most + 1).collect()
    if len(shown) > most:
        raise StoreError(f"a figure holds at most {most} points")
    if not shown:
        return None
    column = lambda c: [r[c] for r in shown]
    trace = {"type": "scatter3d", "mode": "markers", "x": column(x), "y": column(y), "z": column(z)}
    trace |= {"text": column(label)} if label else {}
    trace |= {"marker": {"color": column(colour)}} if colour else {}
    return {"data": [trace], "layout": {"scene": {"xaxis": {"title": x}, "yaxis": {"title": y}, "zaxis": {"title": z}}}}


def write_scatter(rows: DataFrame, path: str, x: str, y: str, z: str, **options: object) -> bool:
    """``scatter_spec`` as a file; False, and no file, when there is nothing to show."""
    spec = scatter_spec(rows, x, y, z, **options)
    if spec is None:
        return False
    folder, _, name = path.rpartition("/")
    files = Files(rows.sparkSession, folder or ".")
    files.write(name, spec)
    return json.dumps(spec) is not None
