"""A written full-text index: postings, documents with tags, and statistics, that queries read instead of the texts.

Postings are range-partitioned and sorted by (term, record_id), so a term or prefix reads the few files whose statistics cover it, and a term
that a third of all documents hold lies in many files. A write adds a segment; a record's last segment holds. ``optimize`` folds segments into
one. Every change publishes a new manifest by one rename: readers keep the version they began with, and a change that fails half-way leaves
the last version in force.

Defined results: records without an id or with only blank fields are not indexed (a blank version deletes the record); of one record's rows in
a write the last holds; an empty index matches nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlit.errors import StoreError
from lumenlit.functions.text import let, sanitize, tokens
from lumenlit.operators import search
from lumenlit.plans.query import FIELDS, Leaf, View, leaves, matches, matches_nothing, parse, parse_ranked
from lumenlit.plans.query import Near as NearNode
from lumenlit.session import checkpoint
from lumenlit.sources.files import Files

#: Words whose postings a file holds at most, and that make a file of its own worth while.
FILE_ROWS, SMALL_ROWS = 4_000_000, 100_000
POSTING = "term string, record_id string, field tinyint, positions array<int>, length int"


def words_with_places(tok: Column, field: int) -> Column:
    """Array of (term, field, positions) of a token array: sorted once by word and place, then cut where the word changes, within the row."""

    def cut(s: Column) -> Column:
        places = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda j: (j == 0) | (F.get(s, j)["term"] != F.get(s, j - 1)["term"]))

        def group(st: Column) -> Column:
            end = lambda k: F.coalesce(F.get(st, k + 1), F.size(s))
            of = lambda a, k: F.transform(F.slice(s, a + 1, end(k) - a), lambda x: x["pos"])
            return F.transform(st, lambda a, k: F.struct(F.get(s, a)["term"].alias("term"), F.lit(field).cast("tinyint").alias("field"), of(a, k).alias("positions")))

        return let(starts, group)

    return let(F.array_sort(F.transform(tok, lambda w, i: F.struct(w.alias("term"), i.cast("int").alias("pos")))), cut)


class PostingView(View):
    """Documents with the positions of the query's words: ``at_<slot>_<field>``, one slot for each distinct word or prefix."""

    def __init__(self, tree: object):
        parts = [p for n in leaves(tree) for p in (n.parts if isinstance(n, NearNode) else (n,))]
        self.slots = sorted({(w, p.prefix and i == len(p.words) - 1) for p in parts for i, w in enumerate(p.words)})

    def _at(self, word: str, prefix: bool, field: str) -> Column:
        return F.col(f"at_{self.slots.index((word, prefix))}_{FIELDS.index(field)}")

    def starts(self, leaf: Leaf, field: str) -> Column:
        *others, last = [self._at(w, leaf.prefix and i == len(leaf.words) - 1, field) for i, w in enumerate(leaf.words)]
        if not others:
            return F.array_sort(last)
        rest = [*others[1:], last]
        return F.array_sort(F.filter(others[0], lambda p: reduce(Column.__and__, [F.array_contains(o, p + (j + 1)) for j, o in enumerate(rest)])))

    def count(self, leaf: Leaf, field: str) -> Column:
        return F.size(self._at(leaf.words[0], leaf.prefix, field)) if len(leaf.words) == 1 else F.size(self.starts(leaf, field))

    def wanted(self) -> Column:
        """Condition on ``term`` that the scan can push down; a prefix is a range."""
        each = [(F.col("term") >= w) & (F.col("term") < w[:-1] + chr(ord(w[-1]) + 1)) if prefix else F.col("term") == w for w, prefix in self.slots]
        return reduce(Column.__or__, each)

    def gathered(self, postings: DataFrame) -> DataFrame:
        """record_id, length and the positions per slot and field, of every document with a word of the query."""
        cols = []
        for i, (w, prefix) in enumerate(self.slots):
            hit = F.col("term").startswith(w) if prefix else F.col("term") == w
            for j in range(len(FIELDS)):
                cols.append(F.flatten(F.collect_list(F.when(hit & (F.col("field") == j), F.col("positions")))).alias(f"at_{i}_{j}"))
        return postings.where(self.wanted()).groupBy("record_id").agg(F.max("length").alias("length"), *cols)


class TextIndex:
    """The index under one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)

    # --- versions

    def manifest(self) -> dict:
        names = self.files.names("versions")
        return self.files.read(f"versions/{names[-1]}") if names else {"no": 0, "segments": [], "keys": [], "n": 0, "total": 0, "live": None}

    def _publish(self, manifest: dict, segments: list[str], keys: list[str], live: DataFrame | None) -> None:
        """New version. ``live``: (record_id, segment, length) of the records in force; None when all of one segment are."""
        no, name = manifest["no"] + 1, None
        if live is not None:
            name = f"live/{uuid.uuid4().hex}"
            live.write.parquet(f"{self.path}/{name}")
        rows = self.spark.read.parquet(f"{self.path}/{name}") if name else self._docs(segments).select("record_id", "length") if segments else None
        n, total = rows.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first() if rows is not None else (0, 0)
        self.files.write(f"versions/{no:09d}", {"no": no, "segments": segments, "keys": keys, "n": n, "total": total, "live": name})
        if self.files.read(f"versions/{no:09d}")["segments"] != segments:
            raise StoreError("another writer published this version; write again")

    def _docs(self, segments: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/segments/{s}/docs" for s in segments])

    def _live(self, m: dict) -> DataFrame:
        if m["live"]:
            return self.spark.read.parquet(f"{self.path}/{m['live']}")
        return self._docs(m["segments"]).select("record_id", "segment", "length")

    def documents(self) -> DataFrame:
        """record_id, title, abstract, body, metadata, length and ``tag_`` columns of the records in force."""
        m = self.manifest()
        if not m["segments"]:
            return self.spark.createDataFrame([], "record_id string, title string, abstract string, body string, metadata string, length int, " + ", ".join(f"tag_{k} array<string>" for k in m["keys"]) if m["keys"] else "record_id string, title string, abstract string, body string, metadata string, length int")
        docs = self._docs(m["segments"])
        if m["live"]:
            docs = docs.join(self._live(m).select("record_id", "segment"), ["record_id", "segment"], "left_semi")
        return docs.drop("segment")

    def postings(self) -> DataFrame:
        m = self.manifest()
        if not m["segments"]:
            return self.spark.createDataFrame([], POSTING)
        parts = []
        for s in m["segments"]:
            part = self.spark.read.schema(POSTING).parquet(f"{self.path}/segments/{s}/postings")
            if m["live"]:
                part = part.join(self._live(m).where(F.col("segment") == s).select("record_id"), "record_id", "left_semi")
            parts.append(part)
        return reduce(DataFrame.unionByName, parts)

    # --- changes

    def _segment(self, docs: DataFrame, keys: list[str]) -> str:
        """Writes documents, tokenized once, and their postings."""
        name = uuid.uuid4().hex
        texts = [sanitize(F.coalesce(F.col(f), F.lit(""))).alias(f) for f in FIELDS]
        cores = self.spark.sparkContext.defaultParallelism
        # A small table comes as few splits; tokenizing is worth all cores.
        docs = docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs
        rows = search.with_tags(docs.select("record_id", *texts, "metadata"), tuple(keys))
        toks = rows.withColumns({f"tok_{f}": tokens(F.col(f)) for f in FIELDS})
        toks = checkpoint(toks.withColumns({"length": sum((F.size(f"tok_{f}") for f in FIELDS), F.lit(0)).cast("int"), "segment": F.lit(name)}))
        toks.drop(*[f"tok_{f}" for f in FIELDS]).write.parquet(f"{self.path}/segments/{name}/docs")

        each = F.explode(F.concat(*[words_with_places(F.col(f"tok_{f}"), i) for i, f in enumerate(FIELDS)])).alias("p")
        grouped = toks.select("record_id", "length", each).select("p.term", "record_id", "p.field", "p.positions", "length")
        total = toks.agg(F.sum("length")).first()[0] or 0
        # Enough files to keep the cores busy, unless they would be tiny; at most about FILE_ROWS postings each.
        parts = max(1, -(-total // FILE_ROWS), min(cores, total // SMALL_ROWS))
        grouped.repartitionByRange(parts, "term", "record_id").sortWithinPartitions("term", "record_id").write.option("parquet.block.size", 8 << 20).parquet(f"{self.path}/segments/{name}/postings")
        return name

    @staticmethod
    def _cleaned(documents: DataFrame, order: str | None) -> tuple[DataFrame, DataFrame]:
        """(documents to index, ids to delete): each record once, its last row."""
        have = documents.columns
        cols = [F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in (*FIELDS, "metadata")]
        rows = documents.where(F.trim(F.coalesce("record_id", F.lit(""))) != "").select("record_id", *cols, *([order] if order else []))
        if order:
            rows = rows.groupBy("record_id").agg(F.max_by(F.struct(*FIELDS, "metadata"), order).alias("d")).select("record_id", "d.*")
        filled = reduce(Column.__or__, [F.coalesce(F.col(f), F.lit("")).rlike(r"\S") for f in FIELDS])
        return rows.where(filled), rows.where(~filled).select("record_id")

    def upsert(self, documents: DataFrame, keys: tuple[str, ...] | None = None, order: str | None = None) -> None:
        """Adds or replaces records. ``order``: the column by which the last row of a record holds; without it records must come once.
        ``keys``: metadata keys whose tags are built, for the first write."""
        m = self.manifest()
        if m["segments"] and keys is not None and sorted(keys) != m["keys"]:
            raise StoreError("other facet keys need rebuild_tags")
        wanted = m["keys"] if m["segments"] else sorted(keys or ())
        new, gone = self._cleaned(documents, order)
        name = self._segment(new, wanted)
        fresh = self._docs([name]).select("record_id", "segment", "length")
        if not m["segments"]:
            self._publish(m, [name], wanted, None)
            return
        old = self._live(m).join(fresh.select("record_id").unionByName(gone), "record_id", "left_anti")
        self._publish(m, [*m["segments"], name], wanted, old.unionByName(fresh))

    def delete(self, ids: DataFrame) -> None:
        """Records, with their tags and postings, are gone from the next version on."""
        m = self.manifest()
        if m["segments"]:
            self._publish(m, m["segments"], m["keys"], self._live(m).join(ids.select("record_id"), "record_id", "left_anti"))

    def optimize(self, keys: tuple[str, ...] | None = None) -> None:
        """One segment from all that is in force, tokenized anew."""
        m = self.manifest()
        wanted = sorted(keys) if keys is not None else m["keys"]
        self._publish(m, [self._segment(self.documents(), wanted)], wanted, None)

    rebuild = optimize

    def rebuild_tags(self, keys: tuple[str, ...]) -> None:
        """Tags of other metadata keys for what is indexed."""
        self.optimize(keys)

    def integrity(self) -> DataFrame:
        """(check, bad): records whose postings do not add up to their length, postings without a record, and statistics that are off."""
        m, docs, posts = self.manifest(), self.documents().select("record_id", "length"), self.postings()
        counted = posts.groupBy("record_id").agg(F.sum(F.size("positions")).alias("n"), F.max("length").alias("noted"))
        both = docs.join(counted, "record_id", "full_outer")
        stats = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("total"))
        checks = both.agg(
            F.count_if(F.col("length").isNotNull() & (F.coalesce("n", F.lit(0)) != F.col("length"))).alias("lengths"),
            F.count_if(F.col("length").isNull()).alias("orphans"),
        )
        off = stats.select(((F.col("n") != m["n"]).cast("int") + (F.col("total") != m["total"]).cast("int")).cast("bigint").alias("bad"))
        named = checks.select(F.explode(F.array(F.struct(F.lit("lengths").alias("check"), F.col("lengths").alias("bad")), F.struct(F.lit("orphans").alias("check"), F.col("orphans").alias("bad")))).alias("c")).select("c.*")
        return named.unionByName(off.select(F.lit("statistics").alias("check"), "bad"))

    # --- queries

    def _passing(self, filters: list) -> DataFrame | None:
        """Ids that pass the filters; None without filters. Tags that are not built are an error."""
        if not filters:
            return None
        keys = self.manifest()["keys"]
        missing = {f.key for f in filters} - set(keys)
        if missing:
            raise StoreError(f"no tags are built for {sorted(missing)}")
        search.check_filters(filters, tuple(keys))
        return self.documents().where(search._filtered(None, list(filters))).select("record_id")

    def match(self, query: str | None, filters: list = ()) -> DataFrame:
        """(record_id,) of the matching documents; pure negations are allowed, None matches all."""
        allowed = self._passing(filters)
        if query is None:
            return allowed if allowed is not None else self.documents().select("record_id")
        tree = parse(query)
        view = PostingView(tree)
        seen = view.gathered(self.postings())
        if matches_nothing(tree):
            ids = self.documents().select("record_id").join(seen.where(~matches(tree, view)).select("record_id"), "record_id", "left_anti")
        else:
            ids = seen.where(matches(tree, view)).select("record_id")
        return ids if allowed is None else ids.join(allowed, "record_id", "left_semi")

    def rank(self, query: str, limit: int = 20, filters: list = (), exclude: str | None = None, weights: dict[str, float] | None = None) -> DataFrame:
        """(record_id, score): the best ``limit`` documents by BM25, ties by record_id, from the query's postings only."""
        weights, tree = search.checked_weights(weights), parse_ranked(query)
        allowed = self._passing(filters)
        if limit < 1:
            return self.spark.createDataFrame([], "record_id string, score double")
        m, view, scored = self.manifest(), PostingView(tree), search.scored_leaves(tree)
        seen = view.gathered(self.postings())
        held = [reduce(Column.__or__, [view.holds(x, f) for f in x.fields]) for x in scored]
        counts = seen.agg(*[F.count_if(h).alias(f"n{i}") for i, h in enumerate(held)]).first()  # one row
        idf = [search.inverse_frequency(m["n"], counts[i]) for i in range(len(scored))]
        rows = seen.where(matches(tree, view))
        if exclude is not None:
            rows = rows.where(F.col("record_id") != exclude)
        if allowed is not None:
            rows = rows.join(allowed, "record_id", "left_semi")
        average = max(m["total"], 1) / max(m["n"], 1)
        return search.bm25(rows, tree, idf, average, weights, view).orderBy(F.desc("score"), "record_id").limit(limit)

    def count_matches(self, query: str | None = None, cap: int | None = None, filters: list = ()) -> DataFrame:
        """(n,): matching documents, at most ``cap``."""
        if cap is not None and cap < 1:
            raise StoreError("a cap is at least 1")
        rows = self.match(query, filters)
        return (rows.limit(cap) if cap else rows).agg(F.count("*").alias("n"))


def backfill(index: TextIndex, passages: DataFrame, overlap: int = 50, build: Callable[[DataFrame, int], DataFrame] | None = None) -> dict[str, int]:
    """Documents rebuilt from stored passages (record_id, chunk_index, text, metadata) for records that are not indexed yet: passages in order
    without the words they repeat, the title from the metadata, or whatever ``build`` makes of passages and overlap. Returns how many were seen,
    indexed, present and empty."""
    known = index.documents().select("record_id")
    docs = checkpoint((build or stored_documents)(passages, overlap))
    new = checkpoint(docs.join(known, "record_id", "left_anti"))
    filled = F.col("body").rlike(r"\S") | F.coalesce("title", F.lit("")).rlike(r"\S")
    seen, fresh, good = docs.count(), new.count(), new.where(filled).count()
    if good:
        index.upsert(new.where(filled), keys=None)
    return {"seen": seen, "indexed": good, "present": seen - fresh, "empty": fresh - good}


def stored_documents(passages: DataFrame, overlap: int = 50) -> DataFrame:
    """(record_id, title, abstract, body, metadata) from passages. A record's passages merge in one row: a document, not the table."""
    from lumenlit.functions.text import merge_windows

    rows = passages.where(F.col("record_id").isNotNull()).groupBy("record_id", "chunk_index").agg(F.min(F.struct("text", "metadata")).alias("p"))
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", F.coalesce("p.text", F.lit("")).alias("text"))))
    first = F.min(F.struct("chunk_index", "p.metadata"))
    each = rows.groupBy("record_id").agg(ordered.alias("c"), first["metadata"].alias("metadata"))
    title = F.get_json_object("metadata", "$.title").alias("title")
    return each.select("record_id", title, F.lit("").alias("abstract"), merge_windows(F.col("c.text"), overlap).alias("body"), "metadata")
