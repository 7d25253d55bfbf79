"""The ingest pipeline: listing pages -> relevance -> full text -> entities -> sinks, with resumable, exactly accounted state.

One page is one micro-batch and settles under a key of its own. A page writes its results, then its outcomes, and last a commit: a small
file that appears at once or not at all. Only committed pages are ever read, and a page that is committed is not settled again, so a crash
between any two writes repeats the page with the same outcome and nothing is lost or doubled.

Records that fail, or that ``total_limit`` defers, go to the backlog with all their columns; the stream may then move on. The next run
settles the open backlog before it reads the listing. Attempts are counted only on pages that processed a record, or on stalled pages that a
later page of the run cleared; a record out of attempts is quarantined from the next run on.

Defined results: rows without an id are left out and counted as skipped; of one record's listings on a page the last holds; a NULL verdict
is a failure; empty pages settle to nothing; columns beside the record's travel along.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlit.errors import ConfigError, PipelineAborted, PipelineInterrupted
from lumenlit.session import checkpoint
from lumenlit.sources.files import Files

OUTCOME = "record_id string, outcome string, error string, page string"
#: Columns the pipeline adds to a page; a page must not bring them.
OWN = ("_place", "relevance", "entities", "error")


@dataclass
class Stages:
    """What a run does with a record; each is DataFrame -> DataFrame and keeps every column.

    ``relevant`` adds ``relevance`` (true, false, NULL: a fault), ``extract`` adds ``entities`` and ``error`` (NULL: none). ``memory`` sinks
    get the full text of the relevant records of a page; a fault of one is counted and does not lose the page's results.
    """

    relevant: Callable[[DataFrame], DataFrame]
    extract: Callable[[DataFrame], DataFrame]
    memory: list[Callable[[DataFrame, str], None]] = field(default_factory=list)


class State:
    """Outcomes, backlog and results of committed pages under one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)
        self._commits: dict[str, dict] = {}

    def committed(self) -> dict[str, dict]:
        """Commit of every page, by key; keys sort in the order of settlement. A commit never changes, so each is read once."""
        for k in self.files.names("commits"):
            if k not in self._commits:
                self._commits[k] = self.files.read(f"commits/{k}")
        return dict(sorted(self._commits.items()))

    def _read(self, what: str, schema: str) -> DataFrame:
        found = [f"{self.path}/{what}/{k}" for k, c in self.committed().items() if what in c["parts"]]
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def outcomes(self) -> DataFrame:
        """(record_id, outcome, error, page): exported, irrelevant, failed, deferred or forgotten, of every committed page."""
        return self._read("outcomes", OUTCOME)

    def last(self) -> DataFrame:
        """(record_id, outcome, page): a record's last outcome."""
        return self.outcomes().groupBy("record_id").agg(F.max_by("outcome", "page").alias("outcome"), F.max("page").alias("page"))

    def processed(self) -> DataFrame:
        """(record_id, outcome, page) of settled records; those forgotten afterwards are gone."""
        return self.last().where(F.col("outcome").isin("exported", "irrelevant"))

    def attempts(self) -> DataFrame:
        """(record_id, attempts, last_error): counted failures since the last success or forgetting."""
        counted = sorted({k for c in self.committed().values() for k in c["counted"]})
        rows = self.outcomes()
        cleared = rows.where(F.col("outcome").isin("exported", "irrelevant", "forgotten")).groupBy("record_id").agg(F.max("page").alias("cleared"))
        failed = rows.where((F.col("outcome") == "failed") & F.col("page").isin(counted)).join(cleared, "record_id", "left")
        open_ = failed.where(F.col("cleared").isNull() | (F.col("page") > F.col("cleared")))
        return open_.groupBy("record_id").agg(F.count("*").alias("attempts"), F.max_by("error", "page").alias("last_error"))

    def backlog(self, schema: str) -> DataFrame:
        """Records whose last outcome is a failure or a deferral, as they were listed last."""
        open_ = self.last().where(F.col("outcome").isin("failed", "deferred")).select("record_id", "page")
        rows = self._read("backlog", f"{schema}, _place bigint, page string")
        return rows.join(open_, ["record_id", "page"], "left_semi")

    def results(self, schema: str) -> DataFrame:
        """Exported rows, the last export of each record."""
        rows = self._read("results", f"{schema}, page string")
        keep = [c for c in rows.columns if c not in ("record_id", "page")]
        return rows.groupBy("record_id").agg(F.max_by(F.struct(*keep), "page").alias("r")).select("record_id", "r.*")

    def put(self, what: str, page: str, rows: DataFrame) -> None:
        rows.withColumn("page", F.lit(page)).write.mode("overwrite").parquet(f"{self.path}/{what}/{page}")

    def commit(self, page: str, counted: list[str], **facts: object) -> None:
        self.files.write(f"commits/{page}", {"parts": [w for w in ("results", "backlog", "outcomes") if self.files.exists(f"{w}/{page}")], "counted": counted, **facts})

    def forget(self, ids: DataFrame, page: str) -> None:
        """Records to be processed again: their successes and failures so far no longer count."""
        self.put("outcomes", page, ids.select("record_id", F.lit("forgotten").alias("outcome"), F.lit(None).cast("string").alias("error")).distinct())
        self.commit(page, [])


def listed_once(page: DataFrame) -> DataFrame:
    """A page's records with an id, each once, as listed last; ``_place`` is the place in the listing."""
    if set(OWN) & set(page.columns) - {"_place"}:
        raise ConfigError(f"a page must not have columns named {OWN}")
    placed = page if "_place" in page.columns else page.withColumn("_place", F.monotonically_increasing_id())
    named = placed.where(F.trim(F.coalesce("record_id", F.lit(""))) != "")
    keep = [c for c in placed.columns if c != "record_id"]
    return named.groupBy("record_id").agg(F.max_by(F.struct(*keep), "_place").alias("r")).select("record_id", "r.*")


def unsettled(page: DataFrame, state: State, max_attempts: int | None = 3) -> DataFrame:
    """Records of a page that are neither processed nor out of attempts."""
    rows = listed_once(page).join(state.processed().select("record_id"), "record_id", "left_anti")
    if max_attempts is None:
        return rows
    barred = state.attempts().where(F.col("attempts") >= max_attempts).select("record_id")
    return rows.join(barred, "record_id", "left_anti")


class Pipeline:
    """Settles pages; ``metrics`` counts outcomes of the run.

    ``stop`` is asked before every page and, when true, ends the run with ``PipelineInterrupted`` behind the page in work. ``on_event`` is told of
    the run's start, every settled page and the end.
    """

    STALLED = 2

    def __init__(self, spark: SparkSession, stages: Stages, path: str, max_attempts: int | None = 3, total_limit: int | None = None, stop: Callable[[], bool] = lambda: False,
                 on_event: Callable[[dict], None] = lambda event: None):
        if (max_attempts is not None and max_attempts < 1) or (total_limit is not None and total_limit < 1):
            raise ConfigError("max_attempts and total_limit are at least 1")
        self.spark, self.stages, self.path, self.stop = spark, stages, path.rstrip("/"), stop
        self.state = State(spark, f"{self.path}/state")
        self.max_attempts, self.limit, self.on_event = max_attempts, total_limit, on_event
        self.begin()

    def begin(self) -> None:
        """A new run: its own number, budget and metrics."""
        self.run_no = max((int(k[:6]) for k in self.state.files.names("commits")), default=-1) + 1
        self.left, self.stalled, self.held = self.limit, 0, []
        self.metrics: dict[str, int] = {}

    def key(self, batch: int) -> str:
        """Key of the page of a stream's batch; keys sort by run, then batch."""
        return f"{self.run_no:06d}-{batch:09d}"

    def settle(self, page: DataFrame, batch: int, stream: str = "") -> None:
        """The page of a micro-batch. A batch of one ``stream`` that an earlier run settled before it could be acknowledged is not settled again; a
        stream that starts anew numbers its batches from 0 under another name."""
        if self.stop():
            raise PipelineInterrupted("stopped before a page", self.metrics.get("exported", 0))
        name = f"{stream}:{batch}"
        if name in {c.get("batch") for c in self.state.committed().values()} or page.isEmpty():
            return
        self.settle_page(page, self.key(batch + 1), batch=name)

    def settle_backlog(self, schema: str) -> None:
        """The records that earlier runs left open, as the first page of this one."""
        page = self.state.backlog(schema)
        if not page.isEmpty():
            self.settle_page(page.drop("page"), self.key(0))

    def settle_page(self, page: DataFrame, key: str, **facts: object) -> None:
        """Judge, extract, write results and outcomes, commit."""
        placed = page if "_place" in page.columns else page.withColumn("_place", F.monotonically_increasing_id())
        blank = placed.where(F.trim(F.coalesce("record_id", F.lit(""))) == "").count()
        # Judged once and kept: verdicts may come from costly, not repeatable calls.
        judged = checkpoint(self.stages.relevant(unsettled(placed, self.state, self.max_attempts)))
        wanted = judged.where(F.col("relevance")).drop("relevance")
        good, bad, deferred = self._extracted(wanted)
        for sink in self.stages.memory:
            try:
                sink(good, key)
            except Exception as e:  # noqa: BLE001 - a fault of one sink must not lose the results
                self.metrics["memory_faults"] = self.metrics.get("memory_faults", 0) + 1
                print(f"memory sink failed on page {key}: {e}", file=sys.stderr)
        plain = [c for c in judged.columns if c not in ("relevance", "_place")]
        fault = judged.where(F.col("relevance").isNull()).drop("relevance").withColumn("error", F.lit("no verdict"))
        left_open = bad.drop("entities").unionByName(fault).withColumn("outcome", F.lit("failed"))
        left_open = checkpoint(left_open.unionByName(deferred.withColumns({"error": F.lit(None).cast("string"), "outcome": F.lit("deferred")})))
        none = F.lit(None).cast("string").alias("error")
        outcomes = good.select("record_id", F.lit("exported").alias("outcome"), none).unionByName(
            judged.where(~F.col("relevance")).select("record_id", F.lit("irrelevant").alias("outcome"), none)
        ).unionByName(left_open.select("record_id", "outcome", "error"))
        self.state.put("results", key, good.select(*plain, "entities"))
        self.state.put("backlog", key, left_open.select(*plain, "_place"))
        self.state.put("outcomes", key, outcomes)
        counts = dict(self.spark.read.parquet(f"{self.state.path}/outcomes/{key}").groupBy("outcome").count().collect())
        exported, failed = counts.get("exported", 0), counts.get("failed", 0)
        done = exported + counts.get("irrelevant", 0)
        self.held = [*self.held, key] if failed else self.held
        counted = self.held if exported else []
        self.state.commit(key, counted, **facts)
        self.held = [] if exported else self.held
        self.on_event({"event": "page", "page": key, "skipped": blank, **counts})
        for k, v in (counts | {"skipped": blank, "pages": 1}).items():
            self.metrics[k] = self.metrics.get(k, 0) + v
        if self.left is not None:
            self.left -= exported
        self.stalled = 0 if exported else self.stalled + bool(failed and not done)
        if self.stalled >= self.STALLED:
            raise PipelineAborted("pages fail without progress", self.metrics.get("exported", 0))

    def _extracted(self, wanted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(exported, failed, deferred). Under a limit, records are admitted in listing order; each failure gives its place to the next one."""
        if self.left is None:
            done = checkpoint(self.stages.extract(wanted))
            return done.where(F.col("error").isNull()).drop("error"), done.where(F.col("error").isNotNull()), wanted.limit(0)
        rounds, free, rest = [], max(self.left, 0), checkpoint(wanted)
        while free > 0:
            admitted = checkpoint(rest.orderBy("_place").limit(free))
            if admitted.isEmpty():
                break
            rounds.append(checkpoint(self.stages.extract(admitted)))
            rest = checkpoint(rest.join(admitted.select("record_id"), "record_id", "left_anti"))
            free -= rounds[-1].where(F.col("error").isNull()).count()
        done = rounds[0] if rounds else self.stages.extract(wanted.limit(0))
        for r in rounds[1:]:
            done = done.unionByName(r)
        return done.where(F.col("error").isNull()).drop("error"), done.where(F.col("error").isNotNull()), rest

    def run(self, stream: DataFrame) -> dict[str, int]:
        """The open backlog, then all pages the stream has now; a later run goes on behind the last settled page."""
        self.begin()
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
        fault: list[BaseException] = []
        log = Files(self.spark, f"{self.path}/stream")

        def each(page: DataFrame, batch: int) -> None:
            try:
                if self.left is not None and self.left <= 0:
                    raise LimitReached
                self.settle(page, batch, log.read("metadata")["id"])
            except BaseException as e:
                fault.append(e)
                raise

        self.on_event({"event": "started", "run": self.run_no})
        self.settle_backlog(schema)
        if self.left is not None and self.left <= 0:
            return self.metrics
        # One page is one micro-batch, and a page is all a paged source calls available: the run ends when the source has no further page.
        query = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{self.path}/stream").start()
        try:
            query.processAllAvailable()
        except Exception:
            if fault and not isinstance(fault[0], LimitReached):
                raise fault[0] from None
            if not fault:
                raise
        finally:
            query.stop()
        if self.stalled:  # a stalled page that ends the listing
            raise PipelineAborted("the listing ended on a page without progress", self.metrics.get("exported", 0))
        self.on_event({"event": "finished", "run": self.run_no, **self.metrics})
        return self.metrics


class LimitReached(Exception):
    """Ends a run's stream before a page that could export nothing; the page stays unread."""


def verdict(answer: str):
    """true, false or NULL of a model's JSON answer; only clear ones count."""
    word = F.lower(F.trim(F.get_json_object(F.col(answer), "$.relevant")))
    return F.when(word.isin("true", "yes", "1"), True).when(word.isin("false", "no", "0"), False)


def cascade(*filters: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Relevance filters in order of cost; a later one only sees what the earlier ones kept, as the rows are cut in between."""

    def run(df: DataFrame) -> DataFrame:
        out, rest = [], df
        for f in filters:
            judged = checkpoint(f(rest))
            out.append(judged.where(~F.col("relevance") | F.col("relevance").isNull()))
            rest = judged.where(F.col("relevance")).drop("relevance")
        kept = rest.withColumn("relevance", F.lit(True))
        for o in out:
            kept = kept.unionByName(o)
        return kept

    return run
