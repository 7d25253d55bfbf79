"""Core queries over the test tables, by name, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlit.functions import text as tx
from lumenlit.operators import claims as cl
from lumenlit.operators import extraction, graph, incremental, quantities, search, tables, vectors
from lumenlit.operators.search import Range, Tag
from lumenlit.session import checkpoint, load, shared_dir
from lumenlit.sources import listings, paging, parsers, stores, textindex
from lumenlit.sources.files import Files
from lumenlit.sql import SQL
from lumenlit.streaming import pipeline as pl

Query = Callable[[SparkSession, str], DataFrame]
KEYS = ("journal", "venue", "year", "published", "keywords")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return search.newest_documents(load(spark, d, "documents"))


def _tokenized(spark: SparkSession, d: str) -> DataFrame:
    return search.index(search.with_tags(_docs(spark, d), KEYS))


def written_index(spark: SparkSession, d: str) -> textindex.TextIndex:
    """The text index over the documents of a table directory. It is written once into the shared folder, under a name that changes with the
    table's files, and read by every query from then on."""
    files = Files(spark, d)
    fs, p = files._at("documents.parquet")
    seen = fs.getContentSummary(p)
    name = sha256(f"{d} {seen.getLength()} {seen.getFileCount()} {fs.getFileStatus(p).getModificationTime()} {KEYS}".encode()).hexdigest()[:24]
    index = textindex.TextIndex(spark, f"{shared_dir(spark)}/index-{name}")
    if not index.manifest()["segments"]:
        index.upsert(_docs(spark, d), KEYS)
    return index


def _index(spark: SparkSession, d: str) -> DataFrame:
    return written_index(spark, d).documents()


def _match(query: str | None, *filters: Tag | Range) -> Query:
    return lambda s, d: written_index(s, d).match(query, list(filters))


def _rank(query: str, limit: int = 20) -> Query:
    return lambda s, d: written_index(s, d).rank(query, limit).withColumn("score", F.round("score", 9))


def _edges(s: SparkSession, d: str) -> DataFrame:
    return graph.jaccard_edges(graph.record_tags(_index(s, d), ("journal", "keywords")), _docs(s, d).where(F.col("doc_id") % 100 == 0), 10)


def _all_edges(s: SparkSession, d: str) -> DataFrame:
    return graph.all_jaccard_edges(graph.record_tags(_index(s, d), ("journal", "keywords")), 10)


def _query_vector(s: SparkSession, d: str) -> list[float]:
    """Vector of the usable chunk with the smallest id and 64 components."""
    rows = load(s, d, "chunks").where((F.size("vector") == 64) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists("vector", lambda x: x != 0))
    return list(rows.orderBy("chunk_id").select("vector").first()[0])


def _lists(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lexical = written_index(s, d).rank("mass OR density OR spectroscopy", 200)
    semantic = vectors.best_chunk(vectors.nearest_chunks(load(s, d, "chunks"), _query_vector(s, d), 1000))
    return checkpoint(lexical), checkpoint(semantic)  # bounded lists that fusion reads more than once


def _fused(method: Callable[[DataFrame], DataFrame]) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        lexical, semantic = _lists(s, d)
        return _scored(method(vectors.ranked_list(lexical, "lexical").unionByName(vectors.ranked_list(semantic, "semantic"))), "fused")

    return run


def _scored(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _html(s: SparkSession, d: str) -> DataFrame:
    docs = load(s, d, "documents")
    return docs.select("doc_id", parsers.parsed(F.encode("body", "UTF-8"), "html").alias("r")).select("doc_id", "r.text", "r.error")


def _inverted(s: SparkSession, d: str) -> DataFrame:
    words = tx.split_words(F.col("abstract"))
    places = lambda ws: lambda w: F.struct(w.alias("key"), F.filter(F.sequence(F.lit(0), F.size(ws)), lambda i: F.get(ws, i) == w).alias("value"))
    entries = tx.let(words, lambda ws: F.transform(F.array_distinct(ws), places(ws)))
    docs = load(s, d, "documents").where(F.size(words) > 0)
    return docs.select("doc_id", tx.abstract_from_positions(F.map_from_entries(entries)).alias("abstract"))


def _components(s: SparkSession, d: str) -> DataFrame:
    return graph.components(graph.choose_edges(_all_edges(s, d)))


def _communities(s: SparkSession, d: str) -> DataFrame:
    """Communities of all records' lists; each component is a graph, named by its smallest id, as no label leaves it."""
    edges = checkpoint(graph.choose_edges(_all_edges(s, d)))
    nodes = checkpoint(graph.components(edges).withColumnRenamed("component", "graph"))
    return graph.communities(edges.join(nodes.withColumnRenamed("record_id", "source"), "source"), nodes)


def _dedup(s: SparkSession, d: str) -> DataFrame:
    part = load(s, d, "part").select(tx.key_of(F.col("p_brand")).alias("_norm_key"), F.col("p_partkey").alias("_ord"), "p_type", F.when(F.col("p_size") > 10, F.col("p_size")).alias("p_size"))
    return tables.deduplicated(source="p_type")(part)


def _complete(s: SparkSession, d: str) -> DataFrame:
    rows = load(s, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_acctbal") > 5000, F.col("c_acctbal")).alias("big"), "c_nationkey")
    steps = tables.chain(tables.completeness(["c_name", "big", "c_nationkey", "absent"], "filled"), tables.quality_flag(50, "filled"))
    return steps(rows).select("c_custkey", "filled", "quality_flag")


def _dbscan(s: SparkSession, d: str) -> DataFrame:
    points = load(s, d, "customer").select(F.col("c_custkey").alias("id"), F.array(F.col("c_acctbal").cast("double") / 100, F.col("c_nationkey").cast("double")).alias("features"))
    return tables.dbscan(points, eps=0.5, min_samples=4)


def _validated(s: SparkSession, d: str) -> DataFrame:
    rows = tables.validated([tables.range_rule("p_size", 1, 40)])(load(s, d, "part"))
    return rows.select("p_partkey", F.to_json("violations").alias("violations"), "valid")


def _keywords(s: SparkSession, d: str) -> DataFrame:
    rows = tables.validated([tables.keyword_rule("title", ["plasma", "gas reservoir", "erratum"])])(load(s, d, "documents"))
    return rows.select("doc_id", F.to_json("violations").alias("violations"), "valid")


def _windows(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("record_id", F.posexplode(tx.windows(F.col("body"), 60, 10)).alias("chunk_index", "text"))


def _located(s: SparkSession, d: str) -> DataFrame:
    claims = cl.unique_claims(load(s, d, "claims")).select("claim_id", "record_id", "quote")
    docs = _docs(s, d).select("record_id", "text")
    return claims.join(docs, "record_id").select("claim_id", tx.located(F.col("text"), F.col("quote")).alias("at")).select("claim_id", "at.*")


def _stored(s: SparkSession, d: str) -> DataFrame:
    chunks = load(s, d, "chunks").where(F.col("record_id").isNotNull()).select("record_id", "chunk_index", "text").distinct()
    return chunks.groupBy("record_id").agg(F.count("*").alias("passages"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))


def _processed_anti(s: SparkSession, d: str) -> DataFrame:
    key = incremental.trimmed(F.col("record_id")).alias("record_id")
    barred = load(s, d, "record_failures").groupBy("record_id").agg(F.max("attempts").alias("n")).where("n >= 3")
    listed = load(s, d, "raw_records").select(key).where("record_id <> ''").distinct()
    return listed.join(load(s, d, "processed_ids"), "record_id", "left_anti").join(barred, "record_id", "left_anti")


def _stages(bad: Column) -> pl.Stages:
    """Irrelevant: titles whose length divides by five; a NULL title is a fault; ``bad`` records fail."""
    return pl.Stages(
        lambda df: df.withColumn("relevance", F.length("title") % 5 != 0),
        lambda df: df.withColumn("error", F.when(bad, "no text")).withColumn("entities", F.col("title")),
    )


def _listing(s: SparkSession, d: str) -> DataFrame:
    """Listing entries in the order of ``listing_no``, as one page."""
    rows = load(s, d, "raw_records").withColumn("record_id", incremental.trimmed(F.col("record_id")))
    return rows.select("record_id", "title", "abstract", F.col("listing_no").alias("_place"))


def _folder(s: SparkSession) -> str:
    return f"{shared_dir(s)}/run-{uuid.uuid4().hex}"


def _lacking() -> Column:
    return F.length(F.coalesce("abstract", F.lit(""))) % 3 == 0


def _settle_replay(s: SparkSession, d: str) -> DataFrame:
    """Last outcome of every record after a page that is settled, replayed, and listed once more on the next page."""
    page, path = _listing(s, d), _folder(s)
    for batch in (0, 0, 1):
        p = pl.Pipeline(s, _stages(_lacking()), path)
        try:
            p.settle(page, batch)
        except pl.PipelineAborted:
            pass
    return p.state.last().join(p.state.attempts().select("record_id", "attempts"), "record_id", "left").select("record_id", "outcome", F.coalesce("attempts", F.lit(0)).alias("attempts"))


def _settle_retry(s: SparkSession, d: str) -> DataFrame:
    """Last outcome of every record after a run in which some fail and a second one, over the backlog, in which they do not."""
    path = _folder(s)
    pl.Pipeline(s, _stages(_lacking()), path).settle(_listing(s, d), 0)
    again = pl.Pipeline(s, _stages(F.lit(False)), path)
    again.settle_backlog("record_id string, title string, abstract string")
    return again.state.last().select("record_id", "outcome")


def _settle_limit(s: SparkSession, d: str) -> DataFrame:
    """(record_id, run): when a record was exported by runs that may export 30, 50 and then any number; failures give their place to others."""
    path = _folder(s)
    for limit in (30, 50, None):
        p = pl.Pipeline(s, _stages(_lacking()), path, total_limit=limit, max_attempts=None)
        if limit == 30:
            p.settle(_listing(s, d), 0)
        else:
            p.settle_backlog("record_id string, title string, abstract string")
    return p.state.outcomes().where("outcome = 'exported'").select("record_id", F.substring("page", 1, 6).cast("int").alias("run"))


def _vector_edges(s: SparkSession, d: str) -> DataFrame:
    """Embedding edges of every record with a first passage whose ``chunk_id`` divides by 100."""
    chunks = load(s, d, "chunks")
    asked = chunks.where((F.col("chunk_id") % 100 == 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists("vector", lambda x: x != 0))
    asked = asked.where("record_id is not null").groupBy("record_id").agg(F.min_by("vector", "chunk_id").alias("vector"))
    return _scored(vectors.embedding_edges(chunks, asked), "weight")


def _vector_store(s: SparkSession, d: str) -> DataFrame:
    """(record_id, passages): a store after two writes and a deletion: records whose id ends in a digit are written twice, those ending in 7 deleted."""
    store = stores.VectorStore(s, _folder(s))
    chunks = load(s, d, "chunks").where("record_id is not null").dropDuplicates(["record_id", "chunk_index"])
    store.put(chunks)
    store.put(chunks.where(F.col("record_id").rlike("[0-9]$") & (F.col("chunk_index") < 2)))
    store.delete(chunks.where(F.col("record_id").endswith("7")))
    return store.rows().groupBy("record_id").agg(F.count("*").alias("passages"))


def _backfilled(s: SparkSession, d: str) -> DataFrame:
    """(record_id, body) of documents rebuilt from stored passages without overlap, for records that an index of every second document lacks."""
    rows = textindex.stored_documents(load(s, d, "chunks"), 0)
    return rows.join(_docs(s, d).where("doc_id % 2 = 0").select("record_id"), "record_id", "left_anti").where(F.col("body") != "").select("record_id", "body")


def _grounded(s: SparkSession, d: str) -> DataFrame:
    """(claim_id, grounded): whether the record's text holds the claim's quote."""
    drafts = cl.unique_claims(load(s, d, "claims")).select("claim_id", "record_id", "quote")
    kept, lost = extraction.grounded(drafts, _docs(s, d).select("record_id", "text"))
    return kept.select("claim_id", F.lit(True).alias("grounded")).unionByName(lost.select("claim_id", F.lit(False).alias("grounded")))


ENTITY = {"type": "object", "required": ["name", "value"], "properties": {"name": {"type": "string"}, "value": {"type": ["number", "null"]}, "polarity": {"enum": [0, 1]}}, "additionalProperties": False}


def _entities(s: SparkSession, d: str) -> DataFrame:
    return cl.unique_claims(load(s, d, "claims")).select("claim_id", "record_id", F.to_json(F.struct(F.col("subject").alias("name"), F.col("quantity.value").alias("value"), "polarity"), {"ignoreNullFields": "false"}).alias("entity"))


def _screened(s: SparkSession, d: str) -> DataFrame:
    """(claim_id, fields): places at which a claim, taken as an entity, breaks the schema; accepted ones have none."""
    kept, bad = extraction.screened(_entities(s, d), [extraction.schema_rule(F.col("entity"), ENTITY)])
    return kept.select("claim_id", F.lit("").alias("fields")).unionByName(bad.select("claim_id", F.array_join(F.array_sort(F.transform("violations", lambda v: v["field"])), ",").alias("fields")))


def _rejected(s: SparkSession, d: str) -> DataFrame:
    """(record_id, entries): open rejections per record after those of every second record are resolved; putting them twice changes nothing."""
    store = stores.RejectionStore(s, _folder(s))
    _, bad = extraction.screened(_entities(s, d), [extraction.schema_rule(F.col("entity"), ENTITY)])
    rows = checkpoint(extraction.rejections(bad).withColumns({"quote": F.lit(""), "created_at": F.lit("2024-01-01T00:00:00+00:00")}).dropDuplicates(["entry_id"]))
    store.put(rows)
    store.put(rows)
    store.resolve(rows.where(F.length("record_id") % 2 == 0).select("entry_id", F.lit("fixed").alias("resolution")))
    return store.unresolved(limit=1 << 30).groupBy("record_id").agg(F.count("*").alias("entries"))


def _double() -> Callable[[str], dict]:
    """A model of fixed answers, for queries that show the stages around one."""
    return lambda prompt: {"answer": '{"entities": [{"words": %d}]}' % len(prompt.split(" ")), "prompt_tokens": len(prompt), "completion_tokens": 1}


def _cached(s: SparkSession, d: str) -> DataFrame:
    """(requests, prompt_tokens, completion_tokens) of the requests that a cache filled with every second document's answer leaves to the model."""
    cache = stores.AnswerCache(s, _folder(s))
    wanted = checkpoint(extraction.requests(_docs(s, d).where("title is not null and title <> ''").select("doc_id", F.col("title").alias("text")), "model", "system").dropDuplicates(["key"]))
    half = wanted.where(F.length("text") % 2 == 0)
    cache.put(extraction.asked(half, _double))
    misses = cache.answered(wanted).where("answer is null").drop("answer")
    return extraction.usage_totals(extraction.asked(misses, _double))


def _xml_text(c: str) -> Column:
    """A column as the text of an XML element."""
    clean = F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[^\t\n\r\x20-\x{d7ff}\x{e000}-\x{fffd}\x{10000}-\x{10ffff}]", " ")
    return F.replace(F.replace(F.replace(clean, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _atom(s: SparkSession, d: str) -> DataFrame:
    """Documents written as Atom pages and read again; every entry comes twice, in two versions."""
    entry = lambda v: F.concat(F.lit("<entry><id>http://x.org/abs/d"), F.col("doc_id"), F.lit(f"v{v}</id><title>"), _xml_text("title"), F.lit("</title></entry>"))
    page = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), entry(2), entry(1), F.lit("</feed>"))
    return listings.atom_records(load(s, d, "documents").select(page.alias("value"))).select("record_id", "title")


def _pubmed(s: SparkSession, d: str) -> DataFrame:
    part = lambda label, c: F.concat(F.lit(f'<AbstractText Label="{label}">'), _xml_text(c), F.lit("</AbstractText>"))
    page = F.concat(F.lit("<A><PubmedArticle><PMID>"), F.col("doc_id"), F.lit("</PMID><ArticleTitle>"), _xml_text("title"), F.lit("</ArticleTitle><Abstract>"), part("ONE", "title"), part("TWO", "abstract"), F.lit("</Abstract></PubmedArticle></A>"))
    return listings.pubmed_records(load(s, d, "documents").select(page.alias("value"))).select("record_id", "title", "abstract")


def _scholar(s: SparkSession, d: str) -> DataFrame:
    paper = F.struct(F.concat(F.lit("p"), "doc_id").alias("paperId"), "title", "abstract", F.array("lang").alias("fieldsOfStudy"))
    rows = listings.semantic_scholar_records(load(s, d, "documents").select(F.to_json(F.struct(F.array(paper).alias("data"))).alias("value")))
    return rows.select("record_id", "title", "abstract")


def _openalex(s: SparkSession, d: str) -> DataFrame:
    work = F.struct(F.concat(F.lit("https://o.org/W"), "doc_id").alias("id"), F.col("title").alias("display_name"), F.create_map(F.lit("b"), F.array(F.lit(1)), F.lit("a"), F.array(F.lit(0), F.lit(2))).alias("abstract_inverted_index"))
    rows = listings.openalex_records(load(s, d, "documents").select(F.to_json(F.struct(F.array(work).alias("results"))).alias("value")))
    return rows.select("record_id", "title", "abstract")


def _csv_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """Titles and sources written as a table for spreadsheets and read again."""
    path = _folder(s)
    rows = load(s, d, "documents").select(F.col("doc_id").cast("string").alias("record_id"), F.regexp_replace("title", r"\r", " ").alias("title"), "source")
    listings.write_csv(rows, path, ["title", "source"])
    return listings.read_csv(s, path, ["title", "source"]).select("record_id", "title", "source")


def _jsonl_roundtrip(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s)
    docs = _docs(s, d).select("record_id", "title", F.lit("u").alias("source_url"), F.array(F.create_map(F.lit("lang"), F.coalesce("lang", F.lit("?")))).alias("entities"))
    listings.write_jsonl(docs, path)
    return listings.read_jsonl(s, path).select("record_id", "title", F.col("entities")[0]["lang"].alias("lang"))


def _parsed(kind: str, data: Callable[[], Column]) -> Query:
    return lambda s, d: load(s, d, "documents").select("doc_id", parsers.parsed(F.encode(data(), "UTF-8"), kind).alias("r")).select("doc_id", "r.text", "r.error")


def _page_html() -> Column:
    return F.concat(F.lit("<html><head><style>p {x: y}</style></head><body><p>"), _xml_text("title"), F.lit("</p><script>let a = 1</script><!-- c --><b>end</b></body></html>"))


def _page_jats() -> Column:
    front = F.concat(F.lit("<article><front><article-meta><title-group><article-title>"), _xml_text("title"), F.lit("</article-title></title-group><abstract><p>"), _xml_text("abstract"))
    return F.concat(front, F.lit("</p></abstract></article-meta></front><body><sec><title>S</title><p>P</p></sec><table><tr><th>a</th><td>b</td></tr></table></body></article>"))


def _page_latex() -> Column:
    return F.concat(F.lit("\\documentclass{a}%x\n"), F.regexp_replace(F.coalesce("title", F.lit("")), r"[%\\]", ""), F.lit(" % gone\nend"))


def _verdicts(s: SparkSession, d: str) -> DataFrame:
    answer = F.concat(F.lit('{"relevant": '), F.element_at(F.array(*map(F.lit, ("true", "false", '"YES"', '" no "', "1", "0", '"maybe"', "null"))), F.pmod("doc_id", F.lit(8)).cast("int") + 1), F.lit("}"))
    return load(s, d, "documents").select("doc_id", answer.alias("answer")).select("doc_id", pl.verdict("answer").alias("relevant"))


def _cascaded(s: SparkSession, d: str) -> DataFrame:
    by = lambda c: lambda df: df.withColumn("relevance", c)
    steps = pl.cascade(by(F.length("title") > 40), by(F.when(F.col("lang").isNotNull(), F.col("lang") == "en")))
    return steps(load(s, d, "documents").select("doc_id", "title", "lang")).select("doc_id", "relevance")


def _filtered_graph(s: SparkSession, d: str) -> DataFrame:
    """(record_id, degree) of the tag graph when only records whose id has an even length stay, and the smallest id as the seed."""
    edges = checkpoint(graph.choose_edges(_all_edges(s, d)))
    nodes = checkpoint(graph.degrees(edges))
    seed = nodes.agg(F.min("record_id")).first()[0]
    kept = nodes.where(F.length("record_id") % 2 == 0)
    return graph.filter_graph(nodes, edges, kept, seed or "")[0].select("record_id", F.col("degree").cast("bigint").alias("degree"))


def _grown(s: SparkSession, d: str) -> DataFrame:
    """Nodes of a graph grown one level from the smallest tagged record."""
    tags = checkpoint(graph.record_tags(_index(s, d), ("journal", "keywords")))
    seed = tags.agg(F.min("record_id")).first()[0]
    near = lambda ids: graph.jaccard_edges(tags, s.createDataFrame([(i,) for i in ids], "record_id string"), 10)
    nodes, _ = graph.grow(near, seed, depth=1, fanout=10) if seed else ([], [])
    return s.createDataFrame([(n,) for n in nodes], "record_id string")


def _metrics(s: SparkSession, d: str) -> DataFrame:
    p = pl.Pipeline(s, _stages(_lacking()), _folder(s))
    p.settle(_listing(s, d), 0)
    return s.createDataFrame([(k, p.metrics.get(k, 0)) for k in ("exported", "irrelevant", "failed", "skipped")], "outcome string, n bigint")


def _streamed(s: SparkSession, d: str) -> DataFrame:
    """A listing of 57 records, cut by its source at 35, read as a stream in pages of ten."""
    rows = [{"record_id": f"r{i}", "title": "t", "abstract": None, "source_url": None, "metadata": None} for i in range(57)]
    name, path = f"listing{uuid.uuid4().hex[:8]}", _folder(s)
    s.dataSource.register(paging.paged_source(name, paging.by_offset(lambda at, n: rows[at : at + n], cap=35), 10))
    query = s.readStream.format(name).load().writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").start()
    query.processAllAvailable()
    query.stop()
    return s.read.parquet(f"{path}/out").select("record_id", "title")


def _feed(s: SparkSession, d: str) -> DataFrame:
    """(revision, record_id, op) of a claim store: all records, then those with an id of even length again, then those ending in 3 deleted."""
    claims = cl.unique_claims(load(s, d, "claims")).where("trim(record_id) <> ''").select("record_id", "claim_id", "predicate")
    store = stores.ClaimStore(s, _folder(s), "record_id string, claim_id string, predicate string")
    store.replace(claims)
    store.replace(claims.where(F.length("record_id") % 2 == 0))
    store.delete(claims.where(F.col("record_id").endswith("3")))
    return store.feed()


def _changed_index(s: SparkSession, d: str) -> DataFrame:
    """(record_id, length) of an index after every second document's title changed, every third was deleted, and all was folded into one segment."""
    docs = checkpoint(_docs(s, d).select("doc_id", "record_id", "title", "abstract", "body", "metadata"))
    index = textindex.TextIndex(s, _folder(s))
    index.upsert(docs)
    index.upsert(docs.where("doc_id % 2 = 0").withColumn("title", F.lit("changed title")))
    index.delete(docs.where("doc_id % 3 = 0"))
    index.optimize()
    return index.documents().select("record_id", "length")


def _dates(s: SparkSession, d: str) -> DataFrame:
    at = F.get_json_object("metadata", "$.pub_date")
    part = lambda n: F.regexp_extract(at, r"^(\d{4})(?:[ -](\w+))?(?:[ -](\d+))?$", n)
    return load(s, d, "documents").where(at.isNotNull()).select("doc_id", tx.partial_date(part(1), part(2), part(3)).alias("date"))


def _composite(s: SparkSession, d: str) -> DataFrame:
    rules = [tables.range_rule("p_size", 1, 40), tables.range_rule("p_retailprice", 900, 1500), tables.keyword_rule("p_name", ["metallic"])]
    rows = tables.validated(rules)(load(s, d, "part"))
    return rows.select("p_partkey", F.array_join(F.transform("violations", lambda v: F.concat(v["field"], F.lit(":"), v["code"])), ",").alias("violations"), "valid")


def _sentences(s: SparkSession, d: str) -> DataFrame:
    each = load(s, d, "documents").select("doc_id", "abstract", F.posexplode(tx.sentences(F.col("abstract"))).alias("n", "at"))
    return each.select("doc_id", "n", F.substring("abstract", F.col("at.start") + 1, F.col("at.end") - F.col("at.start")).alias("sentence"))


def _shown(s: SparkSession, d: str, query: str, limit: int) -> DataFrame:
    index = written_index(s, d)
    return search.hydrate(index.rank(query, limit), index.documents(), "title", "abstract", "body")


def _canonical(s: SparkSession, d: str) -> DataFrame:
    return quantities.canonicalize(load(s, d, "claims"), load(s, d, "measures"))


def _published() -> Column:
    return F.coalesce(F.get_json_object("metadata", "$.published"), F.get_json_object("metadata", "$.pub_date"))


YEARS = [Range("year", 2000, 2009), Range("year", 2005, 2020), Range("year", 2020, None, True)]
JOURNALS = ("Annals of Layered Matter", "Quarterly of Field Methods")


def queries() -> dict[str, Query]:
    """Every core query: (spark, table directory) -> DataFrame."""
    return {
        "p3_found": lambda s, d: quantities.wrong_or_missing(_canonical(s, d)),
        "p3_canonical": _canonical,
        "p3_inferred": lambda s, d: quantities.inferred(_canonical(s, d)),
        "p6_found": lambda s, d: incremental.due_records(load(s, d, "raw_records"), load(s, d, "processed_ids"), load(s, d, "record_failures")),
        "tokens": lambda s, d: _tokenized(s, d).select("record_id", *[F.array_join(f"tok_{f}", " ").alias(f) for f in search.FIELDS]),
        "tok_counts": lambda s, d: _tokenized(s, d).select("record_id", *[F.size(f"tok_{f}").alias(f"n_{f}") for f in search.FIELDS]),
        "term_doc_freq": lambda s, d: written_index(s, d).postings().groupBy("term").agg(F.count_distinct("record_id").alias("df")),
        "postings_freq": lambda s, d: written_index(s, d).postings().groupBy("term", F.element_at(F.array(*map(F.lit, search.FIELDS)), F.col("field").cast("int") + 1).alias("field")).agg(F.count("*").alias("docs"), F.sum(F.size("positions")).alias("positions")),
        "index_integrity": lambda s, d: written_index(s, d).integrity(),
        "match_term": _match("spectroscopy"),
        "match_prefix": _match("spectro*"),
        "match_phrase": _match('"gas reservoir"'),
        "match_fieldscope": _match("title,abstract:faint"),
        "match_and_or_not": _match("survey AND (faint OR compact) -isotope"),
        "match_pure_negation": _match("NOT the"),
        "match_near": _match("NEAR(mass steady, 5)"),
        "bm25_near": _rank("NEAR(mass steady, 5) OR halo", 50),
        "bm25_topk": _rank("survey AND (faint OR compact) -isotope"),
        "bm25_fields": _rank("title:mass OR abstract:faint", 50),
        "bm25_or": _rank("halo || plasma", 50),
        "rank_hydrate": lambda s, d: search.hydrate(written_index(s, d).rank("halo OR plasma", 20), _docs(s, d), "title", "source").withColumn("score", F.round("score", 9)),
        "search_snippets": lambda s, d: search.with_snippets(_shown(s, d, "halo OR plasma", 20), "halo OR plasma").select("record_id", "snippets.best.field", "snippets.best.text", F.to_json("snippets.best.highlights").alias("highlights"), F.size("snippets.fields").alias("fields")),
        "passage_snippets": lambda s, d: search.with_passage_snippet(_shown(s, d, "halo OR plasma", 20), "mass halo -plasma", "body").select("record_id", "snippet.text", F.to_json("snippet.highlights").alias("highlights")),
        "filter_candidates": lambda s, d: search.filter_candidates(_docs(s, d).where(F.col("doc_id") % 100 == 0).select("record_id"), _index(s, d), [Range("year", 2005, 2020)]),
        "filter_meta": _match(None, Tag("journal", JOURNALS)),
        "filter_negated": _match(None, Tag("journal", JOURNALS[:1], True)),
        "filter_range_int": _match(None, Range("year", 2010, 2015)),
        "filter_range_text": _match(None, Range("published", "2015-03", "2018")),
        "facet_counts": lambda s, d: search.facet_counts(_index(s, d), ("venue", "year"), None, [Tag("venue", JOURNALS), Range("year", 2000, 2020)]),
        "range_counts": lambda s, d: search.range_counts(_index(s, d), YEARS),
        "capped_count": lambda s, d: written_index(s, d).count_matches("the", 50),
        "chunk_windows": _windows,
        "merge_passages": lambda s, d: _docs(s, d).select("record_id", tx.merge_windows(tx.windows(F.col("body"), 60, 10), 10).alias("text")),
        "stored_records": _stored,
        "vec_topk": lambda s, d: _scored(vectors.nearest_chunks(load(s, d, "chunks"), _query_vector(s, d), 25), "score"),
        "best_chunk": lambda s, d: _scored(vectors.best_chunk(vectors.nearest_chunks(load(s, d, "chunks"), _query_vector(s, d), 200)), "score"),
        "emb_relevance": lambda s, d: _scored(vectors.relevant(load(s, d, "chunks").select("chunk_id", "vector"), [_query_vector(s, d)], 0.35), "relevance").select("chunk_id", "relevance").distinct(),
        "rrf": _fused(vectors.rrf),
        "minmax": _fused(vectors.minmax),
        "hybrid_topk": lambda s, d: _scored(vectors.hybrid(*_lists(s, d), top=20), "fused"),
        "jaccard_edges": lambda s, d: _edges(s, d).withColumn("weight", F.round("weight", 9)),
        "knn_edges": _vector_edges,
        "mutual_edges": lambda s, d: graph.choose_edges(_all_edges(s, d), mutual=True),
        "degrees": lambda s, d: graph.degrees(_all_edges(s, d)),
        "components": _components,
        "communities": _communities,
        "dbscan": _dbscan,
        "norm_key": lambda s, d: load(s, d, "part").select("p_partkey", tx.key_of(F.col("p_name")).alias("_norm_key")),
        "dedup_first": _dedup,
        "completeness": _complete,
        "clip": lambda s, d: tables.clipped({"price": (1000, 1500)})(load(s, d, "part").select("p_partkey", F.col("p_retailprice").alias("price"))),
        "layout": lambda s, d: tables.laid_out([("c_nationkey", True), ("big", False)], ["c_name"], order="c_custkey")(load(s, d, "customer").select("c_custkey", "c_nationkey", "c_name", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("big"), F.lit(1).alias("_hidden"))),
        "validate_range": _validated,
        "validate_keyword": _keywords,
        "csv_escape": lambda s, d: load(s, d, "documents").select("doc_id", tx.escape_cell(F.col("title")).alias("cell")),
        "ref_year": lambda s, d: load(s, d, "documents").select("doc_id", tx.year_prefix(_published()).alias("year")),
        "trim_refs": lambda s, d: load(s, d, "documents").select("doc_id", tx.trim_references(F.col("body")).alias("kept")),
        "html_text": _html,
        "sentences": _sentences,
        "locate_quote": _located,
        "abstract_inverted": _inverted,
        "claim_ids": lambda s, d: cl.unique_claims(load(s, d, "claims")).select("claim_id", cl.claim_id().alias("content_id")),
        "unique_claims": lambda s, d: cl.unique_claims(load(s, d, "claims")).select("claim_id", "record_id", "position", "revision"),
        "claim_changes": lambda s, d: cl.changes(load(s, d, "claims")),
        "change_head": lambda s, d: cl.head(cl.changes(load(s, d, "claims"))),
        "claim_grounding": _grounded,
        "quotes_exact": lambda s, d: _located(s, d).select("claim_id", F.coalesce(F.col("ratio") == 1.0, F.lit(False)).alias("exact")),
        "claim_rows": lambda s, d: extraction.claim_rows(cl.unique_claims(load(s, d, "claims"))).select("claim_id", "context", "quantity_value", "quantity_unit_text", "has_quantity"),
        "entity_screen": _screened,
        "rejections_open": _rejected,
        "cache_misses": _cached,
        "vector_store": _vector_store,
        "backfill_documents": _backfilled,
        "document_text": lambda s, d: load(s, d, "documents").select("doc_id", tx.document_text(F.col("title"), F.col("abstract")).alias("text")),
        "bounded_errors": lambda s, d: load(s, d, "documents").select("doc_id", tx.bounded_error(F.col("text"), 200).alias("error")),
        "markup_start": lambda s, d: load(s, d, "documents").select("doc_id", extraction.is_markup(F.col("body")).alias("markup")),
        "atom_listing": _atom,
        "pubmed_listing": _pubmed,
        "scholar_listing": _scholar,
        "openalex_listing": _openalex,
        "csv_roundtrip": _csv_roundtrip,
        "jsonl_roundtrip": _jsonl_roundtrip,
        "headers": lambda s, d: search.headers(_docs(s, d), _docs(s, d).where("doc_id % 100 = 0")),
        "full_text": lambda s, d: load(s, d, "documents").select("doc_id", listings.full_text(F.col("body"), F.col("text"), F.col("abstract")).alias("text")),
        "vec_unit": lambda s, d: load(s, d, "chunks").select("chunk_id", "chunk_index", F.round(F.aggregate(vectors.unit(F.col("vector")), F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm")).where("norm is not null and not isnan(norm)").distinct(),
        "html_roundtrip": _parsed("html", _page_html),
        "jats_roundtrip": _parsed("jats", _page_jats),
        "latex_roundtrip": _parsed("latex", _page_latex),
        "llm_verdict": _verdicts,
        "relevance_cascade": _cascaded,
        "filter_graph": _filtered_graph,
        "grow_graph": _grown,
        "run_metrics": _metrics,
        "listing_stream": _streamed,
        "claim_store_feed": _feed,
        "changes_page": lambda s, d: cl.changes_since(cl.changes(load(s, d, "claims")), 3, 50),
        "index_changes": _changed_index,
        "partial_dates": _dates,
        "paper_ids": lambda s, d: load(s, d, "documents").select("doc_id", *[f(F.concat(F.lit("http://x.org/abs/2401."), "doc_id", F.lit("v12.pdf"))).alias(n) for n, f in (("paper_id", tx.paper_id), ("base_id", lambda c: tx.without_version(tx.paper_id(c))))]),
        "validate_composite": _composite,
        "rank_exclude": lambda s, d: written_index(s, d).rank("halo OR plasma", 10, exclude=written_index(s, d).rank("halo OR plasma", 1).first()[0]).withColumn("score", F.round("score", 9)),
        "settle_replay": _settle_replay,
        "settle_retry": _settle_retry,
        "settle_limit": _settle_limit,
        "processed_anti": _processed_anti,
        "failure_counts": lambda s, d: load(s, d, "record_failures").groupBy("record_id").agg(F.max("attempts").alias("attempts"), F.max_by("last_error", "attempts").alias("last_error")),
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL with the same result; absent where SQL cannot express the operator."""
    return SQL
