"""Run rules of the pipeline: nothing is lost or doubled by replays, crashes, failures and limits."""

import pytest
from pyspark.sql import functions as F

from lumenlit.errors import ConfigError, PipelineAborted, PipelineInterrupted, StaleCursor
from lumenlit.sources.paging import RECORD, Page, by_offset, paged_source, realigned
from lumenlit.streaming import pipeline as pl


def rec(i, kind="good"):
    return {"record_id": f"r{i}", "title": "t", "abstract": kind, "source_url": None, "metadata": None}


def page_of(spark, records):
    return spark.createDataFrame([tuple(r[c] for c in RECORD.names) for r in records], RECORD).coalesce(1)


def stages(bad=("bad",), memory=()):
    return pl.Stages(
        lambda df: df.withColumn("relevance", F.when(F.col("abstract") != "mute", F.col("abstract") != "off")),
        lambda df: df.withColumn("error", F.when(F.col("abstract").isin(*bad), "no text")).withColumn("entities", F.col("title")),
        list(memory),
    )


COLS = "record_id string, title string, abstract string, source_url string, metadata string, entities string"


def exported(p):
    return sorted(r.record_id for r in p.state.results(COLS).collect())


def test_replayed_page_keeps_its_results(spark, tmp_path):
    p = pl.Pipeline(spark, stages(), f"{tmp_path}/run")
    page = page_of(spark, [rec(0), rec(1), rec(2, "bad"), rec(3, "off"), rec(4), rec(4), {**rec(5), "record_id": "  "}, {**rec(5), "record_id": None}, rec(6, "mute")])
    p.settle(page, 0)
    assert p.metrics == {"exported": 3, "irrelevant": 1, "failed": 2, "skipped": 2, "pages": 1}
    p.settle(page, 0)
    again = pl.Pipeline(spark, stages(), f"{tmp_path}/run")
    again.settle(page, 0)
    assert exported(p) == ["r0", "r1", "r4"] and again.metrics == {}
    assert {r.record_id: (r.attempts, r.last_error) for r in p.state.attempts().collect()} == {"r2": (1, "no text"), "r6": (1, "no verdict")}
    p.state.forget(spark.createDataFrame([("r0",), ("r2",)], "record_id string"), p.key(99))
    assert sorted(r.record_id for r in pl.unsettled(page, p.state).collect()) == ["r0", "r2", "r6"]
    assert {r.record_id for r in p.state.attempts().collect()} == {"r6"}


@pytest.mark.parametrize("crash", ["results", "backlog", "outcomes", "commit"])
def test_a_crash_between_writes_loses_nothing(spark, tmp_path, monkeypatch, crash):
    page = page_of(spark, [rec(0), rec(1, "bad"), rec(2)])
    broken = pl.Pipeline(spark, stages(), f"{tmp_path}/run")
    put, commit = broken.state.put, broken.state.commit

    def failing_put(what, key, rows):
        put(what, key, rows)
        if what == crash:
            raise OSError("lost")

    def failing_commit(*a, **k):
        if crash == "commit":
            raise OSError("lost")
        commit(*a, **k)

    monkeypatch.setattr(broken.state, "put", failing_put)
    monkeypatch.setattr(broken.state, "commit", failing_commit)
    with pytest.raises(OSError):
        broken.settle(page, 0)
    p = pl.Pipeline(spark, stages(), f"{tmp_path}/run")
    assert exported(p) == [] and p.state.attempts().count() == 0
    p.settle(page, 0)
    assert exported(p) == ["r0", "r2"] and [r.attempts for r in p.state.attempts().collect()] == [1]


def run(spark, path, fetch, size=2, name="listing", number=0, newest=False, **kw):
    spark.dataSource.register(paged_source(name, fetch, size, number, newest))
    p = pl.Pipeline(spark, kw.pop("stages", stages()), path, **kw)
    try:
        p.run(spark.readStream.format(name).load())
    except PipelineAborted as e:
        return p, e
    return p, None


def test_streamed_run_reads_every_page_once(spark, tmp_path):
    records = [rec(i) for i in range(5)]
    fetch, events = by_offset(lambda at, n, records=records: records[at : at + n]), []
    p, fault = run(spark, f"{tmp_path}/run", fetch, on_event=events.append)
    assert [e["event"] for e in events] == ["started", "page", "page", "page", "finished"] and events[-1]["exported"] == 5
    assert fault is None and exported(p) == [f"r{i}" for i in range(5)] and p.metrics["exported"] == 5
    # Entries appended later are found by the next run, behind the last one.
    more = [*records, rec(5), rec(6)]
    p, _ = run(spark, f"{tmp_path}/run", by_offset(lambda at, n, more=more: more[at : at + n]), number=1)
    assert p.metrics["exported"] == 2 and len(exported(p)) == 7


def test_failures_are_retried_and_quarantined(spark, tmp_path):
    records = [rec(0), rec(1, "bad"), rec(2)]
    fetch = by_offset(lambda at, n, records=records: records[at : at + n])
    ok = lambda: run(spark, f"{tmp_path}/run", fetch, size=3, number=0)[0]
    p = ok()
    assert exported(p) == ["r0", "r2"] and p.state.attempts().first().attempts == 1
    # A run with nothing but the failure stalls; it is held, not counted.
    p, fault = run(spark, f"{tmp_path}/run", fetch, size=3, number=1)
    assert p.state.attempts().first().attempts == 1
    p, _ = run(spark, f"{tmp_path}/run", fetch, size=3, number=2, stages=stages(bad=()))
    assert exported(p) == ["r0", "r1", "r2"] and p.state.attempts().count() == 0 and p.state.backlog(COLS.rpartition(",")[0]).count() == 0


def test_out_of_attempts_is_skipped_from_the_next_run_on(spark, tmp_path):
    p = pl.Pipeline(spark, stages(), f"{tmp_path}/run", max_attempts=2)
    for n in range(3):
        p.begin()
        page = page_of(spark, [rec(1, "bad"), rec(10 + n)])
        p.settle(page, n)
    assert p.state.attempts().first().attempts == 2
    assert pl.unsettled(page_of(spark, [rec(1, "bad")]), p.state, 2).count() == 0


def test_limit_is_exact_and_loses_nothing(spark, tmp_path):
    records = [rec(0), rec(1, "bad"), rec(2), rec(3), rec(4), rec(5), rec(6)]
    fetch = by_offset(lambda at, n, records=records: records[at : at + n])
    p, _ = run(spark, f"{tmp_path}/run", fetch, size=5, total_limit=2)
    # The failure gives its place to the next record in listing order.
    assert exported(p) == ["r0", "r2"] and p.metrics["deferred"] == 2
    p, _ = run(spark, f"{tmp_path}/run", fetch, size=5, number=1, total_limit=3)
    assert p.metrics["exported"] == 3 and exported(p) == ["r0", "r2", "r3", "r4", "r5"]
    p, _ = run(spark, f"{tmp_path}/run", fetch, size=5, number=2)
    assert exported(p) == ["r0", "r2", "r3", "r4", "r5", "r6"]


def test_stalled_pages_abort(spark, tmp_path):
    records = [rec(i, "bad") for i in range(4)]
    p, fault = run(spark, f"{tmp_path}/run", by_offset(lambda at, n, records=records: records[at : at + n]))
    assert isinstance(fault, PipelineAborted) and fault.partial_count == 0 and p.state.attempts().count() == 0
    records = [rec(0, "bad"), rec(1, "bad"), rec(2), rec(3)]
    p, fault = run(spark, f"{tmp_path}/run2", by_offset(lambda at, n, records=records: records[at : at + n]))
    assert fault is None and exported(p) == ["r2", "r3"]
    assert sorted(r.record_id for r in p.state.attempts().collect()) == ["r0", "r1"]


def test_stop_ends_behind_a_page(spark, tmp_path):
    asked = iter([False, True, True])
    records = [rec(i) for i in range(6)]
    p, fault = run(spark, f"{tmp_path}/run", by_offset(lambda at, n, records=records: records[at : at + n]), stop=lambda: next(asked))
    assert isinstance(fault, PipelineInterrupted) and fault.partial_count == 2 and exported(p) == ["r0", "r1"]
    p, fault = run(spark, f"{tmp_path}/run", by_offset(lambda at, n, records=records: records[at : at + n]), number=1)
    assert fault is None and len(exported(p)) == 6


def test_memory_faults_do_not_lose_results(spark, tmp_path):
    def broken(df, key):
        raise ValueError("no memory")

    p = pl.Pipeline(spark, stages(memory=[broken]), f"{tmp_path}/run")
    p.settle(page_of(spark, [rec(0)]), 0)
    assert p.metrics["memory_faults"] == 1 and exported(p) == ["r0"]
    with pytest.raises(ConfigError):
        pl.Pipeline(spark, stages(), f"{tmp_path}/run", total_limit=0)
    with pytest.raises(ConfigError):
        p.settle_page(page_of(spark, [rec(1)]).withColumn("entities", F.lit(1)), "x")


def reads(fetch, runs=1, newest=False, size=2, start=None, steps=20):
    """Ids read, page by page, and the last offset of the reader over some runs."""
    out = []
    for n in range(runs):
        reader = paged_source("x", fetch, size, n, newest)({}).simpleStreamReader(RECORD)
        start = start or reader.initialOffset()
        for _ in range(steps):
            rows, end = reader.read(start)
            ids = [r[0] for r in rows]
            if ids:
                out.append(ids)
            if end == start or (end["done"] and end["run"] == n):
                start = end
                break
            start = end
    return out, start


def test_caps_and_stale_cursors():
    records = [rec(i) for i in range(9)]
    got, end = reads(by_offset(lambda at, n: records[at : at + n], cap=5), size=3)
    assert got == [["r0", "r1", "r2"], ["r3", "r4"]] and end["truncated"] and end["cursor"] is None
    calls = []

    def stale_once(cursor, size):
        calls.append(cursor)
        if cursor == "B" and calls.count("B") == 1:
            raise StaleCursor("gone")
        return {None: Page([rec(0)], "B"), "B": Page([rec(1)], None)}[cursor]

    assert reads(stale_once)[0] == [["r0"], ["r0"], ["r1"]]

    def stale(cursor, size):
        if cursor:
            raise StaleCursor("gone")
        return Page([rec(0)], "B")

    with pytest.raises(PipelineAborted):
        reads(stale)
    # A listing of opaque cursors starts anew in the next run.
    assert reads(lambda c, n: Page([rec(7)], None), runs=2)[0] == [["r7"], ["r7"]]


def test_newest_first_goes_on_where_the_backlog_moved():
    listing = [rec(i) for i in range(10, 0, -1)]
    fetch = by_offset(lambda at, n: listing[at : at + n])
    got, end = reads(fetch, newest=True, steps=2)
    assert got == [["r10", "r9"], ["r8", "r7"]] and end["head_offset"] == 4
    listing[:0] = [rec(13), rec(12), rec(11)]
    reader = paged_source("x", fetch, 2, 5, True)({}).simpleStreamReader(RECORD)
    seen, at = [], end
    for _ in range(6):
        rows, at = reader.read(at)
        seen.append([r[0] for r in rows])
    # Two new pages until a saved id shows up, then the backlog three places further down.
    assert seen[:4] == [["r13", "r12"], ["r11", "r10"], ["r6", "r5"], ["r4", "r3"]]
    assert realigned(["a", "b"], 4, ["x", "y", "a"], 0) == 6 and realigned(["a", "b"], 4, ["b"], 5) == 8 and realigned(["a"], 4, ["x"], 0) is None
