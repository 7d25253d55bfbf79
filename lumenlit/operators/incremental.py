"""Processing only new or changed records: a Merkle tree over key ranges, compared with the tree of the last run.

Leaves are ranges of the sorted keys, about ``LEAF_ROWS`` records each, so records that arrive together (dates or numbers in their keys)
change few leaves. A leaf's digest sums the digests of its records, an inner node's those of its children, so trees build by map-side combining
aggregation and do not depend on row order. Two trees are compared from the root: only children of differing nodes are looked at, and only the
records of differing leaves are read and compared one by one. Ranges are kept with the tree, so both trees have the same leaves; they are
drawn anew at every publication, by which the depth follows the number of records.

``MerkleStore.publish`` writes output, records and tree into one new version folder and then moves the pointer file onto it:
a run that fails before the move leaves the last version in force, so its records come again; one that fails after
it has published all, so none is repeated.

Defined results: NULL, empty and blank keys are left out; NULL and empty texts are equal and white space at the ends
does not count; repeated rows and ties give one row; an empty current table gives no rows, an empty state makes all
records due.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlit.errors import StoreError
from lumenlit.session import checkpoint, shared_dir

FANOUT_BITS = 4
#: Records a leaf aims at; most leaves of a tree, which bounds the tree's rows and the ranges a plan carries; folders of a version's records.
LEAF_ROWS, MAX_LEAVES, FOLDERS = 256, 1 << 16, 256
#: Keys from which the ranges are drawn: this many for each leaf.
DRAWN = 8
#: Attempts from which a record is no longer due.
MAX_ATTEMPTS = 3
#: White space cut from the ends of keys and texts.
SPACE = r"^[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$"


def trimmed(c: Column) -> Column:
    """Text without white space at its ends; NULL becomes empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, "")


def digest_of(*content: str) -> Column:
    """Eight bytes for the trimmed content of a row."""
    return F.xxhash64(F.lit("d"), F.concat_ws("\x1f", *[trimmed(F.col(c)) for c in content]))


def digests(versions: DataFrame, key: str, *content: str) -> DataFrame:
    """(key, digest): one row per row of ``versions``."""
    return versions.select(F.col(key).alias("key"), digest_of(*content).alias("digest"))


def depth_of(leaves: int) -> int:
    """Levels below the root of a tree with so many leaves."""
    return max(1, -(-max(leaves - 1, 1).bit_length() // FANOUT_BITS))


def ranges(records: DataFrame, leaf_rows: int = LEAF_ROWS) -> list[str]:
    """Sorted keys at which the leaves after the first begin, drawn from a sample of ``DRAWN`` keys for each leaf."""
    rows = records.count()
    leaves = min(MAX_LEAVES, -(-rows // leaf_rows))
    if leaves < 2:
        return []
    share = min(1.0, DRAWN * leaves / rows)
    drawn = records.where(F.pmod(F.xxhash64(F.lit("range"), "key"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).select("key")
    keys = sorted(r[0] for r in drawn.collect())  # at most about DRAWN * MAX_LEAVES keys
    return sorted({keys[i * len(keys) // leaves] for i in range(1, leaves)}) if keys else []


def with_leaf(records: DataFrame, starts: list[str]) -> DataFrame:
    """Adds ``leaf``: how many of the sorted ``starts`` are not above the key, by bisection over one literal array."""
    if not starts:
        return records.withColumn("leaf", F.lit(0))
    steps = len(starts).bit_length()
    halves = F.array(*[F.lit(1 << i) for i in range(steps - 1, -1, -1)])
    # from_json keeps the plan small: one literal string, parsed once.
    table = F.from_json(F.lit(json.dumps(starts, ensure_ascii=False)), "array<string>")
    up = lambda t: lambda at, half: F.when((at + half <= len(starts)) & (F.get(t, at + half - 1) <= F.col("key")), at + half).otherwise(at)
    return records.withColumn("leaf", F.transform(F.array(table), lambda t: F.aggregate(halves, F.lit(0), up(t)))[0])


def tree(records: DataFrame, depth: int) -> DataFrame:
    """(level, node, digest): level ``depth`` are the leaves, level 0 the root. ``records``: key, digest, leaf."""
    mixed = F.xxhash64("key", "digest").bitwiseAND(F.lit((1 << 48) - 1)).cast("decimal(38,0)")
    leaves = records.groupBy("leaf").agg((F.sum(mixed) % F.lit(1 << 61)).cast("long").alias("digest"))
    levels = F.explode(F.array(*[F.struct(F.lit(d).alias("level"), F.shiftright("leaf", FANOUT_BITS * (depth - d)).alias("node")) for d in range(depth + 1)]))
    mixed_leaf = F.xxhash64("leaf", "digest").bitwiseAND(F.lit((1 << 48) - 1)).cast("decimal(38,0)")
    return (
        leaves.select(levels.alias("at"), mixed_leaf.alias("h"))
        .groupBy("at.level", "at.node")
        .agg((F.sum("h") % F.lit(1 << 61)).cast("long").alias("digest"))
    )


def differing_leaves(now: DataFrame, saved: DataFrame, depth: int) -> tuple[list[int], int]:
    """(leaves whose digests differ, nodes looked at), found by descending from the root through differing nodes only. A tree has at most
    MAX_LEAVES * 16 / 15 rows, so both are small enough for the driver."""
    a, b = ({(r.level, r.node): r.digest for r in t.collect()} for t in (now, saved))
    open_, seen = [0], 0
    for level in range(depth + 1):
        seen += len(open_)
        differ = [n for n in open_ if a.get((level, n)) != b.get((level, n))]
        if level == depth:
            return differ, seen
        open_ = [c for n in differ for c in range(n << FANOUT_BITS, (n + 1) << FANOUT_BITS) if (level + 1, c) in a or (level + 1, c) in b]
    return [], seen


def newest(rows: DataFrame, key: str = "key") -> DataFrame:
    """(key, digest): per key the digest of the latest ``listed_at``; ties go to the later fetch, then to the larger ``listing_no``. Only digests
    shuffle, and they combine map-side."""
    order = F.struct(F.col("listed_at"), F.col("fetched_at"), F.col("listing_no"))
    return rows.groupBy(key).agg(F.max_by("digest", order).alias("digest"))


def due_records(raw: DataFrame, processed: DataFrame, failures: DataFrame, max_attempts: int = MAX_ATTEMPTS, path: str | None = None) -> DataFrame:
    """Listed records the next run must process: (record_id,), trimmed, each once. What was processed is published to a ``MerkleStore`` under
    ``path`` (a folder of its own in the shared one if none is named), and the plan comes from its saved tree."""
    key = trimmed(F.col("record_id")).alias("key")
    listed = raw.select(key, digest_of("title", "abstract").alias("digest"), "listed_at", "fetched_at", "listing_no").where(F.col("key") != "")
    done = processed.select(key, "processed_at").where(F.col("key") != "").groupBy("key").agg(F.max("processed_at").alias("processed_at"))
    barred = failures.select(key, "attempts").groupBy("key").agg(F.max("attempts").alias("n")).where(F.col("n") >= max_attempts)
    # A record processed before any listing of it was fetched is known, but with no content to compare: it counts as changed.
    seen = done.join(listed, "key", "left").withColumn("known", F.col("fetched_at") <= F.col("processed_at"))
    order = F.struct(F.coalesce("known", F.lit(False)), F.col("listed_at"), F.col("fetched_at"), F.col("listing_no"))
    saved = seen.groupBy("key").agg(F.max_by(F.struct(F.coalesce("known", F.lit(False)).alias("known"), "digest"), order).alias("r"))
    saved = saved.select("key", F.when(F.col("r.known"), F.col("r.digest")).otherwise(F.xxhash64(F.lit("never listed"), "key")).alias("digest"))
    store = MerkleStore(raw.sparkSession, path or f"{shared_dir(raw.sparkSession)}/merkle-{uuid.uuid4().hex}")
    store.publish(saved)
    due = store.plan(newest(listed))
    return due.join(barred, "key", "left_anti").select(F.col("key").alias("record_id"))


class MerkleStore:
    """Versions of (output, tree, records) under one path of a file system that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def pointer(self) -> dict | None:
        """What the version in force says of itself, or None before the first publication."""
        fs, p = self._fs(f"{self.path}/CURRENT")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def current(self) -> str | None:
        found = self.pointer()
        return found and found["version"]

    def read(self, what: str) -> DataFrame | None:
        """``records``, ``tree`` or ``output`` of the version in force; None where there is none."""
        if what not in ("records", "tree", "output"):
            raise StoreError(f"no such part: {what}")
        found = self.pointer()
        return None if found is None or what not in found["parts"] else self.spark.read.parquet(f"{self.path}/{found['version']}/{what}")

    def plan(self, now: DataFrame) -> DataFrame:
        """(key,) to process: all of ``now`` (key, digest) before the first publication, else those new or changed since."""
        found = self.pointer()
        if found is None:
            return now.select("key")
        placed = checkpoint(with_leaf(now, found["starts"]))
        leaves, _ = differing_leaves(tree(placed, found["depth"]), self.read("tree"), found["depth"])
        if not leaves:
            return now.select("key").limit(0)
        # At most MAX_LEAVES numbers; folders of saved records that hold none of them are not read.
        names = self.spark.createDataFrame([(x,) for x in leaves], "leaf int")
        folders = sorted({x // found["per_folder"] for x in leaves})
        saved = self.read("records").where(F.col("folder").isin(folders)).join(F.broadcast(names), "leaf", "left_semi").select("key", "digest")
        return placed.join(F.broadcast(names), "leaf", "left_semi").join(saved, ["key", "digest"], "left_anti").select("key")

    def publish(self, now: DataFrame, output: DataFrame | None = None) -> str:
        """Write output, records and tree to a new folder, then move the pointer there; returns the version."""
        version = f"v-{uuid.uuid4().hex}"
        if output is not None:
            output.write.parquet(f"{self.path}/{version}/output")
        now = checkpoint(now.select("key", "digest"))
        starts = ranges(now)
        depth, per_folder = depth_of(len(starts) + 1), -(-(len(starts) + 1) // FOLDERS)
        placed = checkpoint(with_leaf(now, starts))
        records = placed.withColumn("folder", F.floor(F.col("leaf") / per_folder).cast("int"))
        records.repartition("folder").sortWithinPartitions("folder", "leaf").write.partitionBy("folder").parquet(f"{self.path}/{version}/records")
        if placed.isEmpty():
            records.drop("folder").withColumn("folder", F.lit(0)).write.mode("overwrite").parquet(f"{self.path}/{version}/records")
        tree(placed, depth).coalesce(1).write.parquet(f"{self.path}/{version}/tree")
        parts = ["records", "tree"] + (["output"] if output is not None else [])
        self._point({"version": version, "starts": starts, "depth": depth, "per_folder": per_folder, "parts": parts})
        return version

    def _point(self, value: dict) -> None:
        """Moves the pointer in one step."""
        fs, tmp = self._fs(f"{self.path}/.{value['version']}")
        stream = fs.create(tmp, True)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        _, target = self._fs(f"{self.path}/CURRENT")
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._jvm.java.lang.reflect.Array.newInstance(
            self.spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1
        )
        options[0] = getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        context.rename(tmp, target, options)
