"""DuckDB SQL equal to the core queries, where SQL can express them."""

from __future__ import annotations

# Folding is stated here by itself, in DuckDB's functions: lower case, combining marks dropped, and a letter without its accent where that leaves
# a letter from a to z.
FOLD = r"array_to_string(list_transform(string_split(regexp_replace(lower({0}), '[\x{{300}}-\x{{36f}}]', '', 'g'), ''), lambda c: CASE WHEN regexp_matches(strip_accents(c), '^[a-z]$') THEN strip_accents(c) ELSE c END), '')"


def tok(c: str) -> str:
    """Words of a text column."""
    clean = rf"regexp_replace(coalesce({c}, ''), '[\x00-\x08\x0b\x0c\x0e-\x1f]', ' ', 'g')"
    return rf"regexp_extract_all({FOLD.format(clean)}, '[\p{{L}}\p{{N}}\p{{Co}}]+')"


DOCS = f"""
docs AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY indexed_at DESC, doc_id DESC) AS newest FROM documents WHERE record_id IS NOT NULL)
  WHERE newest = 1),
toks AS (SELECT *, {tok("title")} AS t, {tok("abstract")} AS a, {tok("body")} AS b FROM docs),
idx AS (SELECT *, len(t) + len(a) + len(b) AS length FROM toks)"""

MANY = r"""
CASE WHEN json_valid(metadata) THEN
  CASE json_type(metadata, '$.{key}')
    WHEN 'VARCHAR' THEN [metadata ->> '$.{key}']
    WHEN 'UBIGINT' THEN [metadata ->> '$.{key}']
    WHEN 'BIGINT' THEN [metadata ->> '$.{key}']
    WHEN 'ARRAY' THEN (metadata ->> '$.{key}[*]')
  END
END"""


def tags(key: str) -> str:
    """Distinct sorted tags of a JSON key."""
    return f"list_sort(list_distinct(list_filter(coalesce({MANY.format(key=key)}, []), lambda x: x IS NOT NULL AND x <> '')))"


def has(word: str, fields: str = "tab") -> str:
    return "(" + " OR ".join(f"list_contains({f}, '{word}')" for f in fields) + ")"


def count_of(word: str, field: str) -> str:
    return f"len(list_filter({field}, lambda x: x = '{word}'))"


def bm25(leaves: list[tuple[str, str, dict[str, float], str]], where: str, limit: int, columns: str = "") -> str:
    """Ranking SQL; leaves: (name, match condition, frequency terms by field -> weight, condition under which the leaf counts)."""
    stats = ", ".join(f"count_if({cond}) AS n_{name}" for name, cond, _, _ in leaves)

    def idf(name: str) -> str:
        x = f"ln((n - n_{name} + 0.5) / (n_{name} + 0.5))"
        return f"CASE WHEN {x} > 0 THEN {x} ELSE 1e-6 END"

    parts = []
    for name, cond, freq, counts in leaves:
        f = "(" + " + ".join(f"{w} * {x}" for x, w in freq.items()) + ")"
        parts.append(f"CASE WHEN {counts} THEN ({idf(name)}) * {f} * 2.2 / ({f} + 1.2 * (0.25 + 0.75 * length / avg_length)) ELSE 0 END")
    return f"""
WITH {DOCS},
stats AS (SELECT count(*)::DOUBLE AS n, greatest(sum(length), 1) / count(*)::DOUBLE AS avg_length, {stats} FROM idx)
SELECT record_id, {columns}round({" + ".join(parts)}, 9) AS score FROM idx, stats WHERE {where}
ORDER BY {" + ".join(parts)} DESC, record_id LIMIT {limit}"""


def freq(word: str) -> dict[str, float]:
    return {count_of(word, "t"): 10.0, count_of(word, "a"): 4.0, count_of(word, "b"): 1.0}


def phrase(a: str, b: str, f: str) -> str:
    return f"len(list_filter(generate_series(1, len({f}) - 1), lambda i: {f}[i] = '{a}' AND {f}[i + 1] = '{b}'))"


NEAR = """EXISTS (SELECT 1 FROM (SELECT unnest(list_filter(generate_series(1, len({f})), lambda i: {f}[i] = '{x}')) AS p) x,
  (SELECT unnest(list_filter(generate_series(1, len({f})), lambda i: {f}[i] = '{y}')) AS p) y
  WHERE abs(x.p - y.p) <= 1 + {n})"""

PY_SPACES = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WINDOW = r"""list_filter(regexp_split_to_array(coalesce(body, ''), '[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: x <> '')"""

SQL = {
    "tok_counts": f"WITH {DOCS} SELECT record_id, len(t)::INT AS n_title, len(a)::INT AS n_abstract, len(b)::INT AS n_body FROM idx",
    "term_doc_freq": f"""WITH {DOCS}, w AS (SELECT record_id, unnest(list_distinct(list_concat(t, a, b))) AS term FROM idx)
SELECT term, count(*) AS df FROM w GROUP BY term """,
    "postings_freq": f"""WITH {DOCS}, w AS (SELECT record_id, 'title' AS field, unnest(t) AS term FROM idx UNION ALL SELECT record_id, 'abstract', unnest(a) FROM idx
UNION ALL SELECT record_id, 'body', unnest(b) FROM idx) SELECT term, field, count(DISTINCT record_id) AS docs, count(*) AS positions FROM w GROUP BY term, field""",
    "match_term": f"WITH {DOCS} SELECT record_id FROM idx WHERE {has('spectroscopy')}",
    "match_prefix": f"WITH {DOCS} SELECT record_id FROM idx WHERE len(list_filter(list_concat(t, a, b), lambda x: starts_with(x, 'spectro'))) > 0",
    "match_phrase": f"WITH {DOCS} SELECT record_id FROM idx WHERE {phrase('gas', 'reservoir', 't')} + {phrase('gas', 'reservoir', 'a')} + {phrase('gas', 'reservoir', 'b')} > 0",
    "match_fieldscope": f"WITH {DOCS} SELECT record_id FROM idx WHERE {has('faint', 'ta')}",
    "match_and_or_not": f"WITH {DOCS} SELECT record_id FROM idx WHERE {has('survey')} AND ({has('faint')} OR {has('compact')}) AND NOT {has('isotope')}",
    "match_pure_negation": f"WITH {DOCS} SELECT record_id FROM idx WHERE NOT {has('the')}",
    "match_near": f"WITH {DOCS} SELECT record_id FROM idx WHERE " + " OR ".join(NEAR.format(f=f, x="mass", y="steady", n=5) for f in "tab"),
    "bm25_topk": bm25(
        [("survey", has("survey"), freq("survey"), has("survey")), ("faint", has("faint"), freq("faint"), has("faint")), ("compact", has("compact"), freq("compact"), has("compact"))],
        f"{has('survey')} AND ({has('faint')} OR {has('compact')}) AND NOT {has('isotope')}", 20,
    ),
    "bm25_fields": bm25([("x", has("mass", "t"), {count_of("mass", "t"): 10.0}, has("mass", "t")), ("y", has("faint", "a"), {count_of("faint", "a"): 4.0}, has("faint", "a"))],
                        f"{has('mass', 't')} OR {has('faint', 'a')}", 50),
    "bm25_or": bm25([("x", has("halo"), freq("halo"), has("halo")), ("y", has("plasma"), freq("plasma"), has("plasma"))], f"{has('halo')} OR {has('plasma')}", 50),
    "rank_hydrate": bm25([("x", has("halo"), freq("halo"), has("halo")), ("y", has("plasma"), freq("plasma"), has("plasma"))], f"{has('halo')} OR {has('plasma')}", 20, "title, source, "),
    "filter_meta": f"WITH {DOCS} SELECT record_id FROM docs WHERE len(list_intersect({tags('journal')}, ['Annals of Layered Matter', 'Quarterly of Field Methods'])) > 0",
    "filter_negated": f"WITH {DOCS} SELECT record_id FROM docs WHERE len(list_intersect({tags('journal')}, ['Annals of Layered Matter'])) = 0",
    "filter_range_int": f"WITH {DOCS} SELECT record_id FROM docs WHERE len(list_filter({tags('year')}, lambda x: regexp_matches(x, '^(0|-?[1-9][0-9]{{0,18}})$') AND try_cast(x AS BIGINT) BETWEEN 2010 AND 2015)) > 0",
    "filter_range_text": f"WITH {DOCS} SELECT record_id FROM docs WHERE len(list_filter({tags('published')}, lambda x: x >= '2015-03' AND left(x, 4) <= '2018')) > 0",
    "facet_counts": f"""WITH {DOCS}, g AS (SELECT {tags('venue')} AS v, {tags('year')} AS y FROM docs),
ok AS (SELECT *, len(list_intersect(v, ['Annals of Layered Matter', 'Quarterly of Field Methods'])) > 0 AS fv, len(list_filter(y, lambda x: try_cast(x AS BIGINT) BETWEEN 2000 AND 2020)) > 0 AS fy FROM g),
r AS (SELECT 'venue' AS key, unnest(v) AS value FROM ok WHERE fy UNION ALL SELECT 'year', unnest(y) FROM ok WHERE fv)
SELECT key, value, count(*) AS n FROM r GROUP BY key, value""",
    "range_counts": f"""WITH {DOCS}, g AS (SELECT list_filter({tags('year')}, lambda x: regexp_matches(x, '^(0|-?[1-9][0-9]{{0,18}})$')) AS y FROM docs)
SELECT 0 AS place, count_if(len(list_filter(y, lambda x: x::BIGINT BETWEEN 2000 AND 2009)) > 0) AS n FROM g UNION ALL
SELECT 1, count_if(len(list_filter(y, lambda x: x::BIGINT BETWEEN 2005 AND 2020)) > 0) FROM g UNION ALL
SELECT 2, count_if(len(list_filter(y, lambda x: x::BIGINT >= 2020)) = 0) FROM g""",
    "capped_count": f"WITH {DOCS} SELECT least(count(*), 50) AS n FROM idx WHERE {has('the')}",
    "chunk_windows": f"""WITH {DOCS}, w AS (SELECT record_id, {WINDOW} AS words FROM docs),
s AS (SELECT record_id, words, unnest(generate_series(0, (ceil(greatest(len(words) - 60, 0) / 50.0))::INT)) AS i FROM w WHERE len(words) > 0)
SELECT record_id, i::INT AS chunk_index, array_to_string(words[i * 50 + 1 : i * 50 + 60], ' ') AS text FROM s""",
    "merge_passages": f"WITH {DOCS} SELECT record_id, array_to_string({WINDOW}, ' ') AS text FROM docs",
    "processed_anti": r"""WITH l AS (SELECT DISTINCT regexp_replace(record_id, '^\s+|\s+$', '', 'g') AS record_id FROM raw_records WHERE record_id IS NOT NULL)
SELECT record_id FROM l WHERE record_id <> '' AND record_id NOT IN (SELECT record_id FROM processed_ids) AND record_id NOT IN (SELECT record_id FROM record_failures GROUP BY 1 HAVING max(attempts) >= 3)""",
    "failure_counts": "SELECT record_id, max(attempts) AS attempts, arg_max(last_error, attempts) AS last_error FROM record_failures GROUP BY record_id",
    "unique_claims": "SELECT claim_id, record_id, position, revision FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY revision, position) AS n FROM claims WHERE claim_id IS NOT NULL) WHERE n = 1",
    "claim_changes": "SELECT DISTINCT revision, record_id, 'replace' AS op FROM claims",
    "change_head": "SELECT coalesce(max(revision), 0) AS revision FROM claims",
    "norm_key": "SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS _norm_key FROM part",
    "dedup_first": """SELECT regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS _norm_key, min(p_partkey) AS _ord, arg_min(p_type, p_partkey) AS p_type,
arg_min(p_size, p_partkey) FILTER (p_size > 10) AS p_size, string_agg(DISTINCT p_type, '; ' ORDER BY p_type) AS sources FROM part GROUP BY 1""",
    "completeness": """SELECT c_custkey, filled, CASE WHEN filled = 100 THEN 'Confirmed' WHEN filled >= 50 THEN 'Needs Review' ELSE 'Low Confidence' END AS quality_flag FROM (
SELECT c_custkey, round_even(((c_name IS NOT NULL)::INT + (big IS NOT NULL)::INT + (c_nationkey IS NOT NULL)::INT) / 3.0 * 1000, 0) / 10 AS filled
FROM (SELECT *, CASE WHEN c_acctbal > 5000 THEN c_acctbal END AS big FROM customer))""",
    "clip": "SELECT p_partkey, least(greatest(p_retailprice::DOUBLE, 1000.0), 1500.0) AS price FROM part",
    "validate_range": """SELECT p_partkey, p_size BETWEEN 1 AND 40 AS valid, CASE WHEN p_size BETWEEN 1 AND 40 THEN '[]' ELSE
'[{"code":"out-of-range","field":"p_size","severity":"error","message":"' || p_size || ' is outside 1..40"}]' END AS violations FROM part""",
    "csv_escape": r"""SELECT doc_id, CASE WHEN starts_with(title, '''') OR (regexp_matches(title, '^[=+\-@\t\r]') AND NOT regexp_matches(title, '^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$'))
THEN '''' || title ELSE title END AS cell FROM documents""",
    "ref_year": "SELECT doc_id, nullif(regexp_extract(CASE WHEN json_valid(metadata) THEN coalesce(metadata ->> '$.published', metadata ->> '$.pub_date') END, '^([0-9]{4})(?:[^0-9]|$)', 1), '') AS year FROM documents",
    "p6_found": r"""WITH l AS (SELECT regexp_replace(coalesce(record_id, ''), '^\s+|\s+$', '', 'g') AS record_id, regexp_replace(coalesce(title, ''), '^\s+|\s+$', '', 'g') AS title,
  regexp_replace(coalesce(abstract, ''), '^\s+|\s+$', '', 'g') AS abstract, listed_at, fetched_at, listing_no FROM raw_records),
p AS (SELECT record_id, max(processed_at) AS processed_at FROM processed_ids GROUP BY 1),
n AS (SELECT record_id, arg_max((title, abstract), (listed_at, fetched_at, listing_no)) AS v FROM l WHERE record_id <> '' GROUP BY 1),
o AS (SELECT l.record_id, arg_max((title, abstract), (listed_at, fetched_at, listing_no)) AS v FROM l JOIN p ON p.record_id = l.record_id AND l.fetched_at <= p.processed_at GROUP BY 1)
SELECT n.record_id FROM n LEFT JOIN o ON o.record_id = n.record_id WHERE (o.record_id IS NULL OR o.v IS DISTINCT FROM n.v)
AND n.record_id NOT IN (SELECT record_id FROM record_failures GROUP BY 1 HAVING max(attempts) >= 3)""",
    "abstract_inverted": f"SELECT doc_id, array_to_string(w, ' ') AS abstract FROM (SELECT doc_id, {WINDOW.replace('body', 'abstract')} AS w FROM documents) WHERE len(w) > 0",
    "stored_records": """WITH c AS (SELECT DISTINCT record_id, chunk_index, text FROM chunks WHERE record_id IS NOT NULL)
SELECT record_id, count(*) AS passages, sum(length(coalesce(text, ''))) AS chars FROM c GROUP BY record_id""",
    "jaccard_edges": f"""WITH {DOCS}, g AS (SELECT DISTINCT record_id, 'journal' AS key, unnest({tags('journal')}) AS value FROM docs UNION SELECT record_id, 'keywords', unnest({tags('keywords')}) FROM docs),
s AS (SELECT record_id, count(*) AS n FROM g GROUP BY 1),
asked AS (SELECT record_id FROM docs WHERE doc_id % 100 = 0),
e AS (SELECT a.record_id AS source, b.record_id AS target, count(*) AS n_both FROM g a JOIN g b USING (key, value) WHERE a.record_id <> b.record_id AND a.record_id IN (FROM asked) GROUP BY ALL),
w AS (SELECT source, target, n_both / (x.n + y.n - n_both)::DOUBLE AS weight FROM e JOIN s x ON x.record_id = source JOIN s y ON y.record_id = target)
SELECT source, target, round(weight, 9) AS weight, 'tags' AS kind FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY weight DESC, target) AS r FROM w) WHERE r <= 10""",
}

USABLE = "len(list_filter({v}, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter({v}, lambda x: x <> 0)) > 0"
SCORES = f"""
q AS (SELECT list_transform(vector, lambda x: x::DOUBLE) AS q FROM chunks WHERE len(vector) = 64 AND {USABLE.format(v='vector')} ORDER BY chunk_id LIMIT 1),
v AS (SELECT chunk_id, record_id, chunk_index, list_transform(vector, lambda x: x::DOUBLE) AS v FROM chunks WHERE len(vector) = 64 AND {USABLE.format(v='vector')}),
s AS (SELECT record_id, chunk_index, max(list_cosine_similarity(v.v, q.q)) AS score FROM v, q GROUP BY ALL)"""


def _best(n: int) -> str:
    return f"""
n AS (SELECT * FROM s ORDER BY score DESC, record_id, chunk_index LIMIT {n}),
best AS (SELECT record_id, chunk_index, score FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY score DESC, chunk_index) AS r FROM n) WHERE r = 1)"""


def _lists() -> str:
    words = ("mass", "density", "spectroscopy")
    lexical = bm25([(w, has(w), freq(w), has(w)) for w in words], " OR ".join(map(has, words)), 200)
    lexical = lexical.replace("round(", "(", 1).replace(", 9) AS score", ") AS score").strip()
    return f"""WITH {SCORES.lstrip()}, {_best(1000).lstrip()},
lex AS ({lexical}),
lists AS (SELECT 'lexical' AS list, record_id, score FROM lex UNION ALL SELECT 'semantic', record_id, score FROM best),
ranked AS (SELECT *, row_number() OVER (PARTITION BY list ORDER BY score DESC, record_id) AS rank FROM lists)"""


GROUPS = f"""g AS (SELECT DISTINCT record_id, 'journal' AS key, unnest({tags('journal')}) AS value FROM docs UNION SELECT record_id, 'keywords', unnest({tags('keywords')}) FROM docs),
sz AS (SELECT record_id, count(*) AS n FROM g GROUP BY 1),
e AS (SELECT a.record_id AS source, b.record_id AS target, count(*) AS n_both FROM g a JOIN g b USING (key, value) WHERE a.record_id <> b.record_id GROUP BY ALL),
w AS (SELECT source, target, n_both / (x.n + y.n - n_both)::DOUBLE AS weight FROM e JOIN sz x ON x.record_id = source JOIN sz y ON y.record_id = target),
l AS (SELECT source, target, weight FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY weight DESC, target) AS r FROM w) WHERE r <= 10),
u AS (SELECT source AS x, target AS y FROM l UNION SELECT target, source FROM l)"""

LISTED = r"""t AS (SELECT regexp_replace(coalesce(record_id, ''), '^\s+|\s+$', '', 'g') AS record_id, title, abstract, listing_no FROM raw_records),
p AS (SELECT record_id, arg_max((title, abstract), listing_no) AS v, max(listing_no) AS place FROM t WHERE record_id <> '' GROUP BY 1),
j AS (SELECT record_id, place, length(v[1]) % 5 <> 0 AS relevant, length(coalesce(v[2], '')) % 3 = 0 AS lacking FROM p)"""

UNIQUE = "uc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY revision, position) AS n FROM claims WHERE claim_id IS NOT NULL) WHERE n = 1)"
BROKEN = """array_to_string(list_sort(list_filter([CASE WHEN subject IS NULL THEN 'name' END, CASE WHEN isnan(quantity.value) THEN 'value' END,
CASE WHEN polarity IS NULL OR polarity NOT IN (0, 1) THEN 'polarity' END], lambda x: x IS NOT NULL)), ',')"""
KEYWORDS = r"regexp_extract_all(lower(translate(coalesce(title, ''), 'WIDE', 'NARROW')), '[\p{L}\p{M}]+|\p{N}+')".replace("WIDE", "".join(map(chr, range(0xFF01, 0xFF5F))).replace("＇", "")).replace("NARROW", "".join(map(chr, range(0x21, 0x7F))).replace("'", ""))
HEADS = r"(?:\\begin\{thebibliography\}|\\bibliography\{|\\printbibliography|\n\s*references\s*\n|\n\s*bibliography\s*\n|\n\s*acknowledgments?\s*\n|\n\s*literature cited\s*\n)"

SQL |= {
    "tokens": f"WITH {DOCS} SELECT record_id, array_to_string(t, ' ') AS title, array_to_string(a, ' ') AS abstract, array_to_string(b, ' ') AS body FROM idx",
    "index_integrity": "SELECT unnest(['lengths', 'orphans', 'statistics']) AS check, 0::BIGINT AS bad",
    "filter_candidates": f"WITH {DOCS} SELECT record_id FROM docs WHERE doc_id % 100 = 0 AND len(list_filter({tags('year')}, lambda x: regexp_matches(x, '^(0|-?[1-9][0-9]{{0,18}})$') AND try_cast(x AS BIGINT) BETWEEN 2005 AND 2020)) > 0",
    "vec_topk": f"WITH {SCORES} SELECT record_id, chunk_index, round(score, 6) AS score FROM s ORDER BY s.score DESC, record_id, chunk_index LIMIT 25",
    "best_chunk": f"WITH {SCORES}, {_best(200)} SELECT record_id, chunk_index, round(score, 6) AS score FROM best",
    "emb_relevance": f"WITH {SCORES} SELECT DISTINCT chunk_id, round(list_cosine_similarity(v, q), 6) AS relevance FROM v, q WHERE list_cosine_similarity(v, q) >= 0.35",
    "rrf": f"{_lists()} SELECT record_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS fused FROM ranked GROUP BY record_id",
    "minmax": f"""{_lists()}, m AS (SELECT *, min(score) OVER (PARTITION BY list) AS lo, max(score) OVER (PARTITION BY list) AS hi FROM ranked)
SELECT record_id, round(sum(CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END), 6) AS fused FROM m GROUP BY record_id""",
    "hybrid_topk": f"""{_lists()}, f AS (SELECT record_id, sum(1.0::DOUBLE / (60 + rank)) AS fused, max(rank) FILTER (list = 'lexical')::INT AS lexical_rank, max(rank) FILTER (list = 'semantic')::INT AS semantic_rank FROM ranked GROUP BY record_id)
SELECT record_id, round(fused, 6) AS fused, lexical_rank, semantic_rank FROM f ORDER BY f.fused DESC, record_id LIMIT 20""",
    "knn_edges": f"""WITH a AS (SELECT record_id, arg_min(vector, chunk_id) AS q FROM chunks WHERE chunk_id % 100 = 0 AND record_id IS NOT NULL AND {USABLE.format(v='vector').replace(' OR isinf(x)', '')} GROUP BY 1),
k AS (SELECT DISTINCT ON (record_id, chunk_index) record_id, chunk_index, vector FROM chunks WHERE record_id IS NOT NULL AND {USABLE.format(v='vector')}),
s AS (SELECT a.record_id AS source, k.record_id AS target, chunk_index, list_cosine_similarity(list_transform(q, lambda x: x::DOUBLE), list_transform(vector, lambda x: x::DOUBLE)) AS score
  FROM a JOIN k ON len(q) = len(vector) AND a.record_id <> k.record_id),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, target, chunk_index) AS r FROM s WHERE score >= 0) WHERE r <= 50),
w AS (SELECT source, target, max(score) AS weight FROM n GROUP BY ALL)
SELECT source, target, round(weight, 6) AS weight, 'embedding' AS kind FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY weight DESC, target) AS r FROM w) WHERE r <= 10""",
    "mutual_edges": f"WITH {DOCS}, {GROUPS} SELECT a.source, a.target, a.weight, 'tags' AS kind FROM l a JOIN l b ON a.source = b.target AND a.target = b.source WHERE a.source < a.target",
    "degrees": f"WITH {DOCS}, {GROUPS} SELECT x AS record_id, count(*) AS degree FROM u GROUP BY x",
    "components": f"""WITH RECURSIVE {DOCS.lstrip()}, {GROUPS}, reach(x, y) AS (SELECT x, x FROM u UNION SELECT reach.x, u.y FROM reach JOIN u ON u.x = reach.y)
SELECT x AS record_id, min(y) AS component FROM reach GROUP BY x""",
    "layout": "SELECT c_name, c_custkey, c_nationkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS big FROM customer",
    "validate_keyword": f"""WITH k AS (SELECT doc_id, title, {KEYWORDS} AS w FROM documents),
h AS (SELECT doc_id, lower(trim(coalesce(title, ''))) IN ('', 'null', 'none', 'unknown', 'n/a', 'nan') AS missing,
  coalesce(list_filter(w, lambda x: x IN ('plasma', 'erratum'))[1], CASE WHEN contains(' ' || array_to_string(w, ' ') || ' ', ' gas reservoir ') THEN 'gas reservoir' END) AS hit FROM k)
SELECT doc_id, NOT missing AND hit IS NULL AS valid, CASE WHEN missing THEN '[{{"code":"null-key","field":"title","severity":"error","message":"the key is missing"}}]'
WHEN hit IS NOT NULL THEN '[{{"code":"forbidden-keyword","field":"title","severity":"error","message":"holds ' || hit || '"}}]' ELSE '[]' END AS violations FROM h""",
    "trim_refs": f"SELECT doc_id, CASE WHEN regexp_matches(body, '(?i){HEADS}') THEN regexp_replace(regexp_replace(body, '(?is){HEADS}.*$', ''), '\\s+$', '') ELSE body END AS kept FROM documents",
    "document_text": "SELECT doc_id, concat_ws(chr(10) || chr(10), CASE WHEN trim(title) <> '' THEN title END, CASE WHEN trim(abstract) <> '' THEN abstract END) AS text FROM documents",
    "bounded_errors": "SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 185) || '... [truncated]' ELSE text END AS error FROM documents",
    "markup_start": r"SELECT doc_id, coalesce(starts_with(regexp_replace(left(body, 200), '^\s+', ''), '<'), false) AS markup FROM documents",
    "claim_rows": f"""WITH {UNIQUE} SELECT claim_id, to_json(list_transform(list_sort(map_entries(coalesce(context, MAP {{}}))), lambda e: [e.key, e.value]))::VARCHAR AS context,
quantity.value AS quantity_value, quantity.unit_text AS quantity_unit_text, quantity IS NOT NULL AS has_quantity FROM uc""",
    "entity_screen": f"WITH {UNIQUE} SELECT claim_id, {BROKEN} AS fields FROM uc",
    "rejections_open": f"""WITH {UNIQUE}, r AS (SELECT DISTINCT record_id, subject, quantity.value AS value, polarity FROM uc WHERE {BROKEN} <> '')
SELECT record_id, count(*) AS entries FROM r WHERE record_id IS NULL OR length(record_id) % 2 <> 0 GROUP BY 1""",
    "cache_misses": f"WITH {DOCS}, r AS (SELECT DISTINCT title FROM docs WHERE title <> '') SELECT count(*) AS requests, sum(length(title))::BIGINT AS prompt_tokens, count(*) AS completion_tokens FROM r WHERE length(title) % 2 <> 0",
    "vector_store": """WITH c AS (SELECT DISTINCT record_id, chunk_index, regexp_matches(record_id, '[0-9]$') AS again FROM chunks WHERE trim(record_id) <> '')
SELECT record_id, CASE WHEN count_if(again AND chunk_index < 2) > 0 THEN count_if(chunk_index < 2) ELSE count(*) END::BIGINT AS passages FROM c WHERE NOT ends_with(record_id, '7') GROUP BY record_id""",
    "backfill_documents": f"""WITH {DOCS}, c AS (SELECT record_id, chunk_index, array_to_string({WINDOW.replace('body', 'min(text)')}, ' ') AS words FROM chunks WHERE record_id IS NOT NULL GROUP BY 1, 2)
SELECT record_id, string_agg(words, ' ' ORDER BY chunk_index) AS body FROM c WHERE words <> '' AND record_id NOT IN (SELECT record_id FROM docs WHERE doc_id % 2 = 0) GROUP BY record_id""",
    "settle_replay": f"""WITH {LISTED} SELECT record_id, CASE WHEN relevant IS NULL OR relevant AND lacking THEN 'failed' WHEN relevant THEN 'exported' ELSE 'irrelevant' END AS outcome,
CASE WHEN relevant IS NULL OR relevant AND lacking THEN 1 ELSE 0 END::BIGINT AS attempts FROM j""",
    "settle_retry": f"WITH {LISTED} SELECT record_id, CASE WHEN relevant IS NULL THEN 'failed' WHEN relevant THEN 'exported' ELSE 'irrelevant' END AS outcome FROM j",
    "settle_limit": f"""WITH {LISTED}, r AS (SELECT record_id, row_number() OVER (ORDER BY place) AS n FROM j WHERE relevant AND NOT lacking)
SELECT record_id, CASE WHEN n <= 30 THEN 0 WHEN n <= 80 THEN 1 ELSE 2 END::INT AS run FROM r""",
}

_J = "coalesce(to_json({0})::VARCHAR, 'null')"
SQL["claim_ids"] = f"""WITH {UNIQUE} SELECT claim_id, sha256('[' || concat_ws(',', {", ".join(_J.format(c) for c in ("record_id", "kind", "subject", "predicate", "object", "polarity"))},
to_json(list_transform(list_sort(map_entries(coalesce(context, MAP {{}}))), lambda e: [e.key, e.value]))::VARCHAR, {_J.format("regexp_replace(quantity.verbatim, '[" + PY_SPACES + "]+', '', 'g')")},
{_J.format("span_start")}, {_J.format("span_end")}, '""') || ']') AS content_id FROM uc"""
_WORDS = lambda c: f"array_to_string({WINDOW.replace('body', c)}, ' ')"
SQL |= {
    "atom_listing": f"SELECT 'd' || doc_id || 'v2' AS record_id, {_WORDS('title')} AS title FROM documents",
    "pubmed_listing": f"SELECT doc_id::VARCHAR AS record_id, {_WORDS('title')} AS title, 'ONE: ' || {_WORDS('title')} || chr(10) || 'TWO: ' || {_WORDS('abstract')} AS abstract FROM documents",
    "scholar_listing": "SELECT 'p' || doc_id AS record_id, title, abstract FROM documents",
    "openalex_listing": "SELECT 'W' || doc_id AS record_id, title, 'a b a' AS abstract FROM documents",
    "csv_roundtrip": r"SELECT doc_id::VARCHAR AS record_id, coalesce(regexp_replace(title, '\r', ' ', 'g'), '') AS title, coalesce(source, '') AS source FROM documents",
    "jsonl_roundtrip": f"WITH {DOCS} SELECT record_id, title, coalesce(lang, '?') AS lang FROM docs",
    "headers": f"WITH {DOCS} SELECT record_id, title, metadata FROM docs WHERE doc_id % 100 = 0",
    "full_text": f"""WITH x AS (SELECT doc_id, body, text, abstract FROM documents),
y AS (SELECT doc_id, abstract, CASE WHEN trim(body) <> '' THEN body WHEN trim(text) <> '' THEN text END AS best FROM x)
SELECT doc_id, coalesce(CASE WHEN regexp_matches(best, '(?i){HEADS}') THEN regexp_replace(regexp_replace(best, '(?is){HEADS}.*$', ''), '[[:space:]]+$', '') ELSE best END, abstract) AS text FROM y""",
    "vec_unit": f"""SELECT DISTINCT chunk_id, chunk_index, CASE WHEN len(list_filter(vector, lambda x: x <> 0)) = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS norm FROM chunks
WHERE vector IS NOT NULL AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0""",
}
SQL["dbscan"] = """WITH RECURSIVE p AS (SELECT c_custkey AS id, c_acctbal::DOUBLE / 100 AS x, c_nationkey::DOUBLE AS y FROM customer),
n AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.y = b.y AND (a.x - b.x) * (a.x - b.x) <= 0.25),
core AS (SELECT a AS id FROM n GROUP BY a HAVING count(*) >= 4),
link AS (SELECT a, b FROM n WHERE a IN (FROM core) AND b IN (FROM core)),
reach(x, y) AS (SELECT id, id FROM core UNION SELECT reach.x, link.b FROM reach JOIN link ON link.a = reach.y),
root AS (SELECT x AS id, min(y) AS root FROM reach GROUP BY x),
num AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster FROM (SELECT DISTINCT root FROM root)),
edge AS (SELECT n.a AS id, min(root.root) AS root FROM n JOIN root ON root.id = n.b GROUP BY 1)
SELECT p.id, coalesce(num.cluster, -1)::INT AS cluster FROM p LEFT JOIN root USING (id) LEFT JOIN edge USING (id) LEFT JOIN num ON num.root = coalesce(root.root, edge.root)"""
_PLAIN = lambda c: _WORDS(c)
_LATEX = r"regexp_replace(coalesce(title, ''), '[%\\]', '', 'g')"
SQL |= {
    "html_roundtrip": f"SELECT doc_id, trim({_PLAIN('title')} || ' end') AS text, NULL::VARCHAR AS error FROM documents",
    "jats_roundtrip": f"SELECT doc_id, concat_ws(chr(10) || chr(10), nullif({_PLAIN('title')}, ''), nullif({_PLAIN('abstract')}, ''), 'S', 'P', 'a' || chr(9) || 'b') AS text, NULL::VARCHAR AS error FROM documents",
    "latex_roundtrip": f"SELECT doc_id, '\\documentclass{{a}}' || chr(10) || {_LATEX} || ' ' || chr(10) || 'end' AS text, NULL::VARCHAR AS error FROM documents",
    "llm_verdict": "SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN true WHEN 5 THEN false END AS relevant FROM documents",
    "relevance_cascade": "SELECT doc_id, CASE WHEN title IS NULL THEN NULL WHEN length(title) <= 40 THEN false WHEN lang IS NULL THEN NULL ELSE lang = 'en' END AS relevance FROM documents",
    "filter_graph": f"""WITH {DOCS}, {GROUPS}, keep AS (SELECT DISTINCT x FROM u WHERE length(x) % 2 = 0 OR x = (SELECT min(x) FROM u))
SELECT keep.x AS record_id, count(y) AS degree FROM keep LEFT JOIN (SELECT * FROM u WHERE y IN (FROM keep)) e ON e.x = keep.x GROUP BY keep.x""",
    "grow_graph": f"WITH {DOCS}, {GROUPS}, seed AS (SELECT min(record_id) AS x FROM g) SELECT target AS record_id FROM l WHERE source = (SELECT x FROM seed) UNION SELECT x FROM seed WHERE x IS NOT NULL",
    "run_metrics": f"""WITH {LISTED}, b AS (SELECT count(*) AS n FROM t WHERE record_id = '')
SELECT 'exported' AS outcome, count_if(relevant AND NOT lacking)::BIGINT AS n FROM j UNION ALL SELECT 'irrelevant', count_if(NOT relevant)::BIGINT FROM j
UNION ALL SELECT 'failed', count_if(relevant IS NULL OR relevant AND lacking)::BIGINT FROM j UNION ALL SELECT 'skipped', n::BIGINT FROM b""",
    "listing_stream": "SELECT 'r' || i AS record_id, 't' AS title FROM generate_series(0, 34) t(i)",
    "claim_store_feed": f"""WITH {UNIQUE}, r AS (SELECT DISTINCT record_id FROM uc WHERE trim(record_id) <> '')
SELECT 1::BIGINT AS revision, record_id, 'replace' AS op FROM r UNION ALL SELECT 2, record_id, 'replace' FROM r WHERE length(record_id) % 2 = 0 UNION ALL SELECT 3, record_id, 'delete' FROM r WHERE ends_with(record_id, '3')""",
    "changes_page": "SELECT DISTINCT revision, record_id, 'replace' AS op FROM claims WHERE revision > 3 ORDER BY revision, record_id NULLS FIRST LIMIT 50",
    "index_changes": rf"""WITH {DOCS} SELECT record_id, (CASE WHEN doc_id % 2 = 0 THEN 2 ELSE len(t) END + len(a) + len(b))::INT AS length FROM idx
WHERE doc_id % 3 <> 0 AND trim(record_id) <> '' AND (doc_id % 2 = 0 OR regexp_matches(concat_ws(' ', title, abstract, body), '\S'))""",
    "partial_dates": r"""WITH m AS (SELECT doc_id, metadata ->> '$.pub_date' AS pub FROM documents WHERE json_valid(metadata) AND (metadata ->> '$.pub_date') IS NOT NULL),
p AS (SELECT doc_id, regexp_extract(pub, '^(\d{4})(?:[ -](\w+))?(?:[ -](\d+))?$', 1) AS y, lower(regexp_extract(pub, '^(\d{4})(?:[ -](\w+))?(?:[ -](\d+))?$', 2)) AS mo, regexp_extract(pub, '^(\d{4})(?:[ -](\w+))?(?:[ -](\d+))?$', 3) AS d FROM m),
n AS (SELECT *, CASE WHEN regexp_matches(mo, '^\d{1,2}$') THEN mo::INT WHEN mo <> '' THEN list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], left(mo, 3)) END AS m FROM p)
SELECT doc_id, CASE WHEN y = '' THEN NULL WHEN m BETWEEN 1 AND 12 AND d <> '' AND try_cast(y || '-' || m || '-' || d AS DATE) IS NOT NULL THEN printf('%s-%02d-%02d', y, m, d::INT)
WHEN m BETWEEN 1 AND 12 THEN printf('%s-%02d', y, m) ELSE y END AS date FROM n""",
    "paper_ids": "SELECT doc_id, '2401.' || doc_id || 'v12' AS paper_id, '2401.' || doc_id AS base_id FROM documents",
    "validate_composite": r"""SELECT p_partkey, array_to_string(list_filter([CASE WHEN NOT p_size BETWEEN 1 AND 40 THEN 'p_size:out-of-range' END, CASE WHEN NOT p_retailprice BETWEEN 900 AND 1500 THEN 'p_retailprice:out-of-range' END,
CASE WHEN list_contains(regexp_extract_all(lower(p_name), '[a-z]+|[0-9]+'), 'metallic') THEN 'p_name:forbidden-keyword' END], lambda x: x IS NOT NULL), ',') AS violations,
p_size BETWEEN 1 AND 40 AND p_retailprice BETWEEN 900 AND 1500 AND NOT list_contains(regexp_extract_all(lower(p_name), '[a-z]+|[0-9]+'), 'metallic') AS valid FROM part""",
    "rank_exclude": SQL["bm25_or"].replace("LIMIT 50", "LIMIT 10 OFFSET 1"),
}
SQL["quotes_exact"] = f"""WITH {UNIQUE}, {DOCS}
SELECT claim_id, coalesce(quote <> '' AND contains({_WORDS('d.text')}, {_WORDS('uc.quote')}) AND {_WORDS('uc.quote')} <> '', false) AS exact FROM uc JOIN docs d ON d.record_id = uc.record_id"""
