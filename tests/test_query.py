import pytest
from hypothesis import given
from hypothesis import strategies as st

from lumenlit.errors import FilterError, QueryError
from lumenlit.operators import search
from lumenlit.operators.search import Range, Tag
from lumenlit.plans import query as q

DOCS = "doc_id bigint, record_id string, title string, abstract string, body string, metadata string, indexed_at timestamp"


def docs(spark):
    rows = [
        (1, "a", "Dark halo survey", "a faint halo", "mass of the halo x x steady gas", '{"venue": "V", "year": 2010}', None),
        (2, "b", "Plasma", None, "the gas reservoir is steady", '{"venue": ["V", "W"], "year": 2015}', None),
        (3, "c", None, None, None, "{broken", None),
        (4, "d", "", "", "", None, None),
        (5, "e", "Müller HALOS", "gas", "reservoir gas reservoir", '{"year": "2015"}', None),
        (6, "a", "old title", "", "", None, None),
    ]
    from datetime import datetime

    rows = [(*r[:-1], datetime(2024, 1, 2 if i != 5 else 1)) for i, r in enumerate(rows)]
    return search.index(search.with_tags(search.newest_documents(spark.createDataFrame(rows, DOCS)), ("venue", "year")))


def ids(df):
    return sorted(r.record_id for r in df.collect())


@pytest.mark.parametrize(
    "text, want",
    [
        ("halo", ["a"]), ("halo*", ["a", "e"]), ('"gas reservoir"', ["b", "e"]), ("title:halo", ["a"]), ("abstract,body:halo AND survey", ["a"]),
        ("NOT gas", ["c", "d"]), ("gas -steady", ["e"]), ("plasma || survey", ["a", "b"]), ("NEAR(mass steady, 5)", ["a"]), ("NEAR(mass steady, 4)", []),
        ("muller", ["e"]), ("NOT (NOT plasma)", ["b"]),
    ],
)
def test_matches(spark, text, want):
    assert ids(search.match_ids(docs(spark), text)) == want


@pytest.mark.parametrize("text", ["", "(", ")", "a (b", '"open', "NEAR(a", "title:", "foo:bar", "AND", "a OR", "NEAR(a, x)", "!!"])
def test_errors_know_their_place(text):
    with pytest.raises(QueryError) as e:
        q.parse(text)
    assert e.value.position is not None


def test_tree_is_canonical():
    assert q.parse("a AND (b AND c)") == q.parse("a b c")
    assert q.parse("-a -b c") == q.parse("NOT (a OR b) c")
    assert q.parse("NOT NOT a") == q.parse("a")
    assert not q.rankable(q.parse("NOT a"))
    with pytest.raises(QueryError):
        q.parse_ranked("NOT a")
    assert q.semantic_text(q.parse("big -small (title:cat* OR dog)")) == "big dog"
    with pytest.raises(QueryError):
        q.parse_semantic("galax* -dwarf")
    assert q.parse_semantic("galax* dwarf")
    assert [c["negated"] for c in q.describe(q.parse("a -b"))] == [False, True]


@given(st.text(alphabet='ab()"-|&:*, NEAR', max_size=20))
def test_parser_never_crashes(text):
    try:
        q.parse(text)
    except QueryError:
        pass


def test_bm25_formula(spark):
    got = {r.record_id: r.score for r in search.rank(docs(spark), "reservoir", 5).collect()}
    lengths = {r.record_id: r.length for r in docs(spark).select("record_id", "length").collect()}
    import math

    n, df, avg = 5, 2, sum(lengths.values()) / 5
    idf = math.log((n - df + 0.5) / (df + 0.5))
    for rid, f in (("b", 1.0), ("e", 2.0)):
        assert got[rid] == pytest.approx(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * lengths[rid] / avg)))
    assert search.rank(docs(spark), "nothing", 5).count() == 0
    assert search.rank(docs(spark), "gas", 0).count() == 0
    assert ids(search.rank(docs(spark), "gas", 5, exclude="a")) == ["b", "e"]


def test_filters(spark):
    d = docs(spark)
    assert ids(search.match_ids(d, None, [Tag("venue", ("W",))])) == ["b"]
    assert ids(search.match_ids(d, None, [Tag("venue", ("V",), True)])) == ["c", "d", "e"]
    assert ids(search.match_ids(d, None, [Range("year", 2011, None)])) == ["b", "e"]
    assert ids(search.match_ids(d, None, [Range("year", "2010", "201")])) == ["a", "b", "e"]
    facets = {(r.key, r.value): r.n for r in search.facet_counts(d, ("venue", "year"), None, [Tag("venue", ("W",))]).collect()}
    assert facets == {("venue", "V"): 2, ("venue", "W"): 1, ("year", "2015"): 1}
    assert [r.n for r in search.range_counts(d, [Range("year", 2010, 2012), Range("year", 2010, 2012, True)]).orderBy("place").collect()] == [1, 4]
    assert search.count_matches(d, "gas", 2).first().n == 2
    for bad in (lambda: Tag("k", "text"), lambda: Range("k", 3, 1), lambda: Range("k"), lambda: search.check_filters([Tag("x", ("1",))], ("y",))):
        with pytest.raises(FilterError):
            bad()


def test_empty_index(spark):
    d = search.index(search.with_tags(search.newest_documents(spark.createDataFrame([], DOCS)), ("venue",)))
    assert search.rank(d, "gas").count() == 0 and search.count_matches(d, "gas").first().n == 0


def small_index(spark, path):
    from lumenlit.sources.textindex import TextIndex

    i = TextIndex(spark, path)
    i.upsert(docs(spark), ("venue", "year"))
    return i


QUERIES = ["halo", "halo*", '"gas reservoir"', "title:halo", "abstract,body:halo AND survey", "NOT gas", "gas -steady", "plasma || survey", "NEAR(mass steady, 5)", "NEAR(mass steady, 4)",
           "muller", "NOT (NOT plasma)", '"reservoir gas" OR title:plas*', "x", '"x x"', "NEAR(gas reservoir gas, 3)", "nothing", "NOT nothing"]


def test_written_index_equals_the_texts(spark, tmp_path):
    i, d = small_index(spark, f"{tmp_path}/i"), docs(spark).where("record_id in ('a', 'b', 'e')")
    for text in QUERIES:
        assert ids(i.match(text)) == ids(search.match_ids(d, text)), text
        if q.rankable(q.parse(text)):
            want = [(r.record_id, pytest.approx(r.score)) for r in search.rank(d, text, 3).collect()]
            assert [tuple(r) for r in i.rank(text, 3).collect()] == want, text
    assert ids(i.match("gas", [Tag("venue", ("V",))])) == ["a", "b"] and i.count_matches("gas", 2).first().n == 2
    assert {r.check: r.bad for r in i.integrity().collect()} == {"lengths": 0, "orphans": 0, "statistics": 0}


def test_written_index_changes(spark, tmp_path):
    from lumenlit.errors import StoreError
    from lumenlit.sources.textindex import TextIndex, backfill

    i = small_index(spark, f"{tmp_path}/i")
    new = spark.createDataFrame([("a", "old words", 1), ("a", "new words", 2), ("f", "more words", 1), ("b", "  ", 1), (" ", "no id", 1)], "record_id string, title string, n int")
    i.upsert(new, order="n")
    assert ids(i.match("words")) == ["a", "f"] and ids(i.match("halo")) == [] and ids(i.match("NOT nothing")) == ["a", "e", "f"]
    i.delete(spark.createDataFrame([("f",)], "record_id string"))
    assert ids(i.match("words")) == ["a"] and sum(r.bad for r in i.integrity().collect()) == 0
    before = [tuple(r) for r in i.rank("words OR gas", 5).collect()]
    i.optimize()
    assert [tuple(r) for r in i.rank("words OR gas", 5).collect()] == before and len(i.manifest()["segments"]) == 1
    with pytest.raises(StoreError):
        i.match("gas", [Tag("lang", ("x",))])
    i.rebuild_tags(("lang", "year"))
    assert ids(i.match("gas", [Tag("lang", ("x",))])) == [] and ids(i.match(None, [Tag("year", ("2015",))])) == ["e"]
    passages = spark.createDataFrame([("p", 1, "b c d e", None), ("p", 0, "a b c", '{"title": "T"}'), ("e", 0, "x", None), ("q", 0, " ", None)], "record_id string, chunk_index int, text string, metadata string")
    assert backfill(i, passages, 2) == {"seen": 3, "indexed": 1, "present": 1, "empty": 1}
    assert i.documents().where("record_id = 'p'").first().body == "a b c d e"
    empty = TextIndex(spark, f"{tmp_path}/none")
    assert empty.match("gas").count() == 0 and empty.rank("gas").count() == 0 and empty.match("NOT gas").count() == 0


def test_near_walk():
    from lumenlit.plans.evaluate import near_kept

    assert near_kept([[1, 9], [4, 30]], [1, 1], 2) == [[1], [4]]
    assert near_kept([[1], [9]], [1, 1], 2) == [[], []]
    assert near_kept([[0, 2], [1, 3]], [1, 1], 5) == [[0, 2], [1, 3]]
    assert near_kept([[], [1]], [1, 1], 5) == [[], []]
    # A start that no other part is near to is passed over.
    assert near_kept([[0, 50, 52], [51, 90]], [1, 1], 3) == [[50, 52], [51]]


def test_snippets(spark):
    from lumenlit.plans import evaluate as ev

    text = "one two gas four " + "x " * 40
    s = ev.passage_snippet(q.parse("gas NOT two"), text)
    assert s["text"].startswith("one two gas four") is False and s["text"].startswith("…gas") and s["text"][s["highlights"][0]["start"] : s["highlights"][0]["end"]] == "gas" and len(s["highlights"]) == 1
    assert ev.passage_snippet(q.parse("gas"), "") == {"field": "body", "text": "", "highlights": []}
    assert ev.passage_snippet(q.parse("title:gas"), "gas (all of it)")["text"] == "gas (all of it)"
    both = ev.document_snippets(q.parse("halo OR (gas AND missing)"), {"title": "Halo, halo", "abstract": "a halo of gas", "body": ""})
    assert both["best"]["field"] == "title" and [f["field"] for f in both["fields"]] == ["title", "abstract"]
    assert both["fields"][1]["highlights"] == [{"start": 2, "end": 6}]
    assert ev.split_markers("a\x02bc\x03 d\x02\x02e") == ("abc de", [(1, 3), (5, 6)]) and ev.split_markers("\x03\x02\x03x") == ("x", [])
    shown = search.with_snippets(docs(spark), "gas OR halo").where("record_id = 'b'").first().snippets
    assert shown.best.field == "body" and shown.best.text[shown.best.highlights[0].start : shown.best.highlights[0].end] == "gas"


def test_chains_of_negations():
    assert q.parse("NOT " * 5001 + "a") == q.parse("-a") and q.parse("-" * 4000 + "a") == q.parse("a")
    with pytest.raises(q.QueryError):
        q.parse("NOT " * 5000)


def test_filters_are_checked_first(spark):
    d = docs(spark)
    for bad in ([Tag("venue", ("V",)), Tag("venue", ("W",))], [Tag("lang", ("x",))]):
        for ask in (lambda f: search.match_ids(d, "gas", f), lambda f: search.rank(d, "gas", 5, f), lambda f: search.facet_counts(d, ("year",), None, f)):
            with pytest.raises(FilterError):
                ask(bad)
    assert [(r.key, r.value) for r in search.facet_counts(d, ("venue",)).collect()] == [("venue", "V"), ("venue", "W")]
