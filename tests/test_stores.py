"""Stores, extraction, fetching and settings."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from lumenlit.config import Secret, Settings, load_settings
from lumenlit.errors import ConfigError, StoreError
from lumenlit.operators import claims, extraction, vectors
from lumenlit.session import load
from lumenlit.sources import fetching, stores

SF = "/root/testdata/sf0.001"


def test_keyed_log(spark, tmp_path):
    log = stores.KeyedLog(spark, f"{tmp_path}/k", "k", "k string, v int")
    df = lambda rows: spark.createDataFrame(rows, "k string, v int")
    assert log.count() == 0 and log.feed().count() == 0
    log.replace(df([("a", 1), ("a", 2), ("b", 3), (None, 4), (" ", 5)]))
    log.replace(df([("a", 9)]))
    log.delete(df([("b", 0)]))
    assert [tuple(r) for r in log.rows().collect()] == [("a", 9)]
    assert {tuple(r) for r in log.feed().collect()} == {(1, "a", "replace"), (1, "b", "replace"), (2, "a", "replace"), (3, "b", "delete")}
    with pytest.raises(StoreError):
        log.replace(spark.createDataFrame([("a",)], "k string"))
    # Rows written without a commit do not count.
    df([("z", 1)]).withColumns({"_no": F.lit(9).cast("bigint"), "_op": F.lit("replace")}).write.parquet(f"{tmp_path}/k/data/000000009")
    assert log.rows().count() == 1
    query = log.stream().writeStream.format("memory").queryName("followed").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("followed").count() == 6  # a stream sees a folder once its rows are written


def test_vector_store(spark, tmp_path):
    store = stores.VectorStore(spark, f"{tmp_path}/v")
    rows = [("a", 1, "two", [0.0, 2.0], None), ("a", 0, "one", [3.0, 4.0], '{"m": 1}'), ("b", 0, "x", [0.0, 0.0], None), ("c", 0, "y", [float("nan"), 1.0], None), ("d", 0, "z", None, None)]
    store.put(spark.createDataFrame(rows, store.schema))
    got = {(r.record_id, r.chunk_index): r.vector for r in store.rows().collect()}
    assert got["a", 0] == pytest.approx([0.6, 0.8]) and got["b", 0] == [0.0, 0.0] and got["d", 0] is None
    assert {r.record_id: (r.passages, r.metadata) for r in store.records().collect()}["a"] == (["one", "two"], '{"m": 1}')
    store.put(spark.createDataFrame([("a", 0, "new", [1.0, 0.0], None)], store.schema))
    assert store.rows().where("record_id = 'a'").count() == 1 and store.count() == 4


def test_rejections_and_cache(spark, tmp_path):
    store = stores.RejectionStore(spark, f"{tmp_path}/r")
    row = lambda i, at: spark.createDataFrame([(i, "r", "{}", "[]", "q", at)], "entry_id string, record_id string, entity string, violations string, quote string, created_at string")
    store.put(row("a", "2024-01-01"))
    store.put(row("b", "2024-01-02"))
    assert store.count_unresolved() == 2 and [r.entry_id for r in store.unresolved(after="a").collect()] == ["b"]
    store.resolve(spark.createDataFrame([("a", "fixed")], "entry_id string, resolution string"))
    assert store.count_unresolved() == 1
    cache = stores.AnswerCache(spark, f"{tmp_path}/c")
    cache.put(spark.createDataFrame([("k", "1"), ("l", "2")], "key string, answer string"))
    cache.put(spark.createDataFrame([("k", "3")], "key string, answer string"))
    got = {r.key: r.answer for r in cache.answered(spark.createDataFrame([("k",), ("x",)], "key string")).collect()}
    assert got == {"k": "3", "x": None}
    cache.clear()
    assert cache.count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, "a"), (None, 1.0, 1.0, "b"), (float("nan"), 1.0, 1.0, "c")], "x double, y double, z double, n string")
    spec = stores.scatter_spec(df, "x", "y", "z", "n")
    assert spec["data"][0]["x"] == [1.0] and spec["data"][0]["text"] == ["a"]
    assert stores.scatter_spec(df.where("false"), "x", "y", "z") is None and not stores.write_scatter(df.where("false"), f"{tmp_path}/p.json", "x", "y", "z")
    assert stores.write_scatter(df, f"{tmp_path}/p.json", "x", "y", "z") and json.loads((tmp_path / "p.json").read_text())["data"][0]["type"] == "scatter3d"
    with pytest.raises(StoreError):
        stores.write_table(df, "", "t", mode="replace")


def test_entity_lists_and_schema(spark):
    lists = [extraction.entity_list_of(a, "entities") for a in ('{"entities": [{"a": 1}]}', '{"x": {"a": 1}}', '{"entities": null}', '{"a": 1, "b": 2}', "[1]", "{", None, '{"entities": [1]}')]
    assert [(len(e), bool(err)) for e, err in lists] == [(1, False), (1, False), (0, False), (0, True), (0, True), (0, True), (0, True), (0, True)]
    schema = {"type": "object", "required": ["n"], "properties": {"n": {"type": "string"}, "v": {"$ref": "#/$defs/V"}, "l": {"type": "array", "items": {"type": "integer"}}}, "additionalProperties": False, "$defs": {"V": {"type": ["number", "null"]}}}
    places = lambda e: [v["field"] for v in extraction.schema_violations(e, schema)]
    assert places({"n": "a", "v": None, "l": [1]}) == [] and places({"v": True, "l": [1, "x"], "z": 0}) == ["n", "v", "l.1", "z"]
    assert extraction.entity_list_schema(schema)["$defs"] == schema["$defs"] and "$defs" not in extraction.entity_list_schema(schema)["properties"]["entities"]["items"]
    rows = spark.createDataFrame([("r", '{"n": "a"}'), ("r", '{"n": 1}')], "record_id string, entity string")
    kept, bad = extraction.screened(rows, [extraction.schema_rule(F.col("entity"), schema)])
    assert kept.count() == 1 and bad.count() == 1
    one, two = extraction.rejections(bad).collect()[0], extraction.rejections(bad).collect()[0]
    assert one.entry_id == two.entry_id == extraction.rejection_id("r", {"n": 1}, [("schema", "n")])
    assert one.entry_id != extraction.rejection_id("r", {"n": 1}, [("schema", "n")], {"model": "m"})
    key = extraction.request_key
    assert len({key("m", "s", "p"), key("m", "s", "q"), key("m", "s", "p", temperature=0.0), key("m", "s", "p", schema={}), key("m", "s", "p", variant="2")}) == 5


def test_model_calls(spark):
    def client():
        def ask(prompt):
            if prompt == "bad":
                raise ValueError("no")
            return {"answer": prompt.upper(), "prompt_tokens": 3}

        return ask

    df = spark.createDataFrame([("a",), ("bad",), (None,)], "prompt string")
    got = {r.prompt: (r.answer, r.error) for r in extraction.asked(df, client).collect()}
    assert got["a"] == ("A", None) and got["bad"][1].startswith("ValueError") and got[None] == (None, "no text")
    assert tuple(extraction.usage_totals(extraction.asked(df, client)).first()) == (2, 3, 0)


def test_grounding_and_claim_rows(spark):
    docs = spark.createDataFrame([("r", "First one. The mass is 3 kg here. Last.")], "record_id string, text string")
    drafts = spark.createDataFrame([("1", "r", "mass is 3 kg"), ("2", "r", "the density of nothing"), ("3", "s", "mass")], "claim_id string, record_id string, quote string")
    kept, lost = extraction.grounded(drafts, docs)
    assert [(r.claim_id, r.span_start, r.span_end, r.match_ratio) for r in kept.collect()] == [("1", 11, 33, 1.0)]
    assert {r.claim_id: r.violations[0].code for r in lost.collect()} == {"2": "ungrounded", "3": "ungrounded"}
    table = load(spark, SF, "claims").dropDuplicates(["claim_id"])
    back = extraction.claims_of_rows(extraction.claim_rows(table)).select(table.columns)
    plain = lambda df: sorted(str((r.claim_id, r.quantity, sorted((r.context or {}).items()))) for r in df.collect())
    assert plain(back) == plain(table)


def test_claim_id_escapes(spark):
    rows = [("r\u0001", "k", "s\"\\/\n\t é", None, "o", 1, {"b": "2", "a": "1"}, (" 1 kg ",), 1, 2), ("r", "k", "s", "p", None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "record_id string, kind string, subject string, predicate string, object string, polarity int, context map<string,string>, quantity struct<verbatim: string>, span_start int, span_end int")
    from lumenlit.functions.text import content_hash

    want = [content_hash([r[0], r[1], r[2], r[3], r[4], r[5], sorted(map(list, (r[6] or {}).items())), r[7] and r[7][0].replace(" ", ""), r[8], r[9], "h"]) for r in rows]
    assert [r.i for r in df.select(claims.claim_id("h").alias("i")).collect()] == want


def test_embedding_edges(spark):
    rows = [("a", 0, [1.0, 0.0]), ("b", 0, [0.9, 0.1]), ("b", 1, [0.0, 1.0]), ("c", 0, [-1.0, 0.0]), ("d", 0, [0.5, 0.5]), ("d", 0, [0.5, 0.5]), ("e", 0, None), ("f", 0, [0.0, 0.0]), ("g", 0, [1.0])]
    df = spark.createDataFrame(rows, "record_id string, chunk_index int, vector array<float>")
    asked = df.where("record_id = 'a'")
    for block in (1, 100):
        got = [(r.source, r.target, round(r.weight, 3)) for r in vectors.embedding_edges(df, asked, 5, block=block).orderBy(F.desc("weight")).collect()]
        assert got == [("a", "b", 0.994), ("a", "d", 0.707)]
    assert vectors.embedding_edges(df, asked.where("false")).count() == 0


def test_fetching():
    waits, log = [], []
    answers = iter([fetching.Response(503, b"", {"Retry-After": "7"}), OSError("down"), fetching.Response(200, b"ok")])

    def open_(url):
        log.append(url)
        got = next(answers)
        if isinstance(got, Exception):
            raise got
        return got

    f = fetching.Fetcher(open_, sleep=waits.append)
    assert f.fetch("http://a.b/c") == b"ok" and waits == [7.0, 4.0] and len(log) == 3
    gone = fetching.Fetcher(lambda u: fetching.Response(404, b""), sleep=waits.append)
    assert gone.optional("http://a.b/c") is None
    with pytest.raises(fetching.FetchError):
        fetching.Fetcher(lambda u: fetching.Response(429, b""), attempts=2, sleep=waits.append).optional("http://x")
    now = datetime(2024, 1, 1, tzinfo=timezone.utc)
    assert fetching.retry_after("Mon, 01 Jan 2024 00:01:00 GMT", now) == 60 and fetching.retry_after("soon") is None and fetching.delay(2, 2, 500, 120) == 120
    limits = fetching.HostLimits({"example.org": "wide", "api.example.org": "narrow"}, "none")
    assert [limits.for_url(u) for u in ("http://v1.api.example.org/x", "http://example.org", "http://notexample.org")] == ["narrow", "wide", "none"]
    clock, slept = [0.0], []
    bucket = fetching.TokenBucket(2.0, 2, lambda: clock[0], slept.append)
    for _ in range(3):
        bucket.acquire()
    assert slept == [0.5]


def test_settings(tmp_path):
    got = load_settings({"path": "/x", "listing": {"page_size": 5}, "search": {"facet_keys": ["year"]}}, {"LUMENLIT_MODEL__API_KEY": "hush", "LUMENLIT_CHUNKING__WORDS": "100", "LUMENLIT_TOKENIZERS": "x"})
    assert got.listing.page_size == 5 and got.chunking.words == 100 and got.search.facet_keys == ("year",) and got.model.api_key.reveal() == "hush"
    assert "hush" not in repr(got) and "hush" not in str(got.model.api_key) and isinstance(got.model.api_key, Secret) and load_settings({}, {}) == Settings()
    for bad in ({"pth": 1}, {"listing": {"size": 1}}, {"listing": {"page_size": "x"}}, {"chunking": {"words": 5, "overlap": 5}}, {"listing": 3}):
        with pytest.raises(ConfigError):
            load_settings(bad, {})
    (tmp_path / "s.json").write_text('{"path": "/y"}')
    assert load_settings(str(tmp_path / "s.json"), {}).path == "/y"
