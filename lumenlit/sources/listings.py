"""Response parsers of four catalogues, and table exports and imports. ``paging`` turns a catalogue's pages into a stream."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlit.errors import StoreError
from lumenlit.functions.text import abstract_from_positions, escape_cell, trim_references, unescape_cell
from lumenlit.sources.paging import RECORD



def openalex_records(pages: DataFrame, column: str = "value") -> DataFrame:
    """Records of a works response (JSON text): the abstract comes from its inverted index."""
    schema = "struct<results: array<struct<id: string, display_name: string, publication_date: string, publication_year: int, abstract_inverted_index: map<string, array<int>>, authorships: array<struct<author: struct<display_name: string>>>>>>"
    rows = pages.select(F.explode(F.from_json(column, schema)["results"]).alias("w"))
    metadata = F.to_json(F.struct(F.transform("w.authorships", lambda a: a["author"]["display_name"]).alias("authors"), F.col("w.publication_date").alias("published"), F.col("w.publication_year").alias("year")))
    return rows.select(F.substring_index("w.id", "/", -1).alias("record_id"), F.col("w.display_name").alias("title"), abstract_from_positions(F.col("w.abstract_inverted_index")).alias("abstract"), F.col("w.id").alias("source_url"), metadata.alias("metadata"))


def semantic_scholar_records(pages: DataFrame, column: str = "value") -> DataFrame:
    """Records of a paper search response (JSON text); the categories are the distinct union of both field lists."""
    schema = "struct<data: array<struct<paperId: string, title: string, abstract: string, year: int, url: string, publicationDate: string, authors: array<struct<name: string>>, fieldsOfStudy: array<string>, s2FieldsOfStudy: array<struct<category: string>>>>>"
    rows = pages.select(F.explode(F.from_json(column, schema)["data"]).alias("p"))
    none = F.array().cast("array<string>")
    categories = F.array_distinct(F.concat(F.coalesce("p.fieldsOfStudy", none), F.coalesce(F.transform("p.s2FieldsOfStudy", lambda x: x["category"]), none)))
    metadata = F.to_json(F.struct(F.transform("p.authors", lambda a: a["name"]).alias("authors"), categories.alias("categories"), F.col("p.publicationDate").alias("published"), F.col("p.year").alias("year")))
    return rows.select(F.col("p.paperId").alias("record_id"), F.col("p.title").alias("title"), F.col("p.abstract").alias("abstract"), F.col("p.url").alias("source_url"), metadata.alias("metadata"))


def _xml_records(pages: DataFrame, column: str, read: Callable[[bytes], list[dict]]) -> DataFrame:
    def run(batches):
        import pandas as pd

        for b in batches:
            rows = [r for text in b[column] if text for r in read(text.encode())]
            yield pd.DataFrame(rows, columns=RECORD.names)

    return pages.select(column).mapInPandas(run, RECORD)


def _atom(data: bytes) -> list[dict]:
    from lumenlit.sources.parsers import safe_xml

    a = "{http://www.w3.org/2005/Atom}"
    out, seen = [], set()
    for e in safe_xml(data).iter(f"{a}entry"):
        url = (e.findtext(f"{a}id") or "").strip()
        for part in ("/abs/", "/pdf/"):
            url_id = url.split(part, 1)[1] if part in url else None
            if url_id:
                break
        base = re.sub(r"v\d+$", "", (url_id or url).removesuffix(".pdf"))
        if base in seen:
            continue
        seen.add(base)
        published = (e.findtext(f"{a}published") or "").strip()
        meta = {
            "categories": [c.get("term") for c in e.iter(f"{a}category")], "authors": [(n.text or "").strip() for n in e.iter(f"{a}name")],
            "published": published, "year": published[:4] if published[:4].isdigit() else None,
        }
        out.append({"record_id": (url_id or url).removesuffix(".pdf"), "title": " ".join((e.findtext(f"{a}title") or "").split()),
                    "abstract": " ".join((e.findtext(f"{a}summary") or "").split()), "source_url": url, "metadata": json.dumps(meta, ensure_ascii=False)})
    return out


def atom_records(pages: DataFrame, column: str = "value") -> DataFrame:
    """Records of an Atom feed page; of one paper's versions on a page the first stays."""
    return _xml_records(pages, column, _atom)


def _pubmed(data: bytes) -> list[dict]:
    from lumenlit.sources.parsers import safe_xml

    plain = lambda n: " ".join("".join(n.itertext()).split()) if n is not None else ""
    out = []
    for a in safe_xml(data).iter("PubmedArticle"):
        pid = a.findtext(".//PMID") or ""
        parts = [(p.get("Label"), plain(p)) for p in a.iter("AbstractText")]
        date = next((x for x in (a.findtext(".//PubDate/Year"), (a.findtext(".//PubDate/MedlineDate") or "")[:4]) if x), None)
        authors = [" ".join(x for x in (n.findtext("ForeName"), n.findtext("LastName")) if x) for n in a.iter("Author")]
        out.append({"record_id": pid, "title": plain(a.find(".//ArticleTitle")), "abstract": "\n".join(f"{label}: {t}" if label else t for label, t in parts),
                    "source_url": f"https://pubmed.ncbi.nlm.nih.gov/{pid}/", "metadata": json.dumps({"authors": authors, "year": date}, ensure_ascii=False)})
    return out


def pubmed_records(pages: DataFrame, column: str = "value") -> DataFrame:
    """Records of an efetch response; labelled parts of an abstract stand on lines of their own."""
    return _xml_records(pages, column, _pubmed)


def full_text(latex: Column, pdf: Column, abstract: Column) -> Column:
    """The best text there is of a record, without its references: LaTeX, then PDF, then the abstract; blank ones do not count. A source that failed
    for now must not look like one without text: ``transient_fault`` keeps such records for a later run."""
    some = lambda c: F.when(F.trim(c) != "", trim_references(c))
    return F.coalesce(some(latex), some(pdf), abstract)


def transient_fault(latex_status: Column, pdf_status: Column) -> Column:
    """Error of a record whose text may come later: a status (0 for a transport fault) that passes when asked again; NULL when there is none."""
    again = lambda c: (c == 0) | (c >= 500) | c.isin(408, 429)
    first = F.when(again(latex_status), latex_status).when(again(pdf_status), pdf_status)
    return F.when(first.isNotNull(), F.concat(F.lit("the text may come later: status "), first.cast("string")))


def sorted_keys(c: Column, kind: str) -> Column:
    """A map column in the order of its keys; other values as they are (the fields of a struct have an order of their own)."""
    return F.map_from_entries(F.array_sort(F.map_entries(c))) if kind.startswith("map") else c


def write_csv(entities: DataFrame, path: str, columns: list[str]) -> None:
    """record_id, the named columns and ``extra``: the other columns as JSON; cells are escaped against formulas."""
    rest = [c for c in entities.columns if c not in ("record_id", *columns)]
    kinds = dict(entities.dtypes)
    # Nested values as JSON with sorted keys; what has none is its own text.
    plain = lambda c: F.to_json(sorted_keys(F.col(c), kinds[c])) if kinds[c].startswith(("array", "struct", "map")) else F.col(c).cast("string")
    cell = lambda c: escape_cell(F.coalesce(plain(c), F.lit("")))
    extra = F.to_json(F.struct(*[F.col(c) for c in sorted(rest)])) if rest else F.lit("")
    entities.select(cell("record_id").alias("record_id"), *[cell(c).alias(c) for c in columns], escape_cell(F.when(extra == "{}", "").otherwise(extra)).alias("extra")).write.csv(path, header=True, quoteAll=False, escape='"')


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A table written by ``write_csv``; another header is an error, cells are unescaped."""
    names = ["record_id", *columns, "extra"]
    found = spark.read.option("header", True).option("escape", '"').option("multiLine", True).option("mode", "FAILFAST").csv(path)
    if found.columns != names:
        raise StoreError(f"the header is {found.columns}, not {names}")
    return found.select(*[unescape_cell(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in names])


def write_jsonl(records: DataFrame, path: str) -> None:
    """One line per record: record_id, title, source_url, entities."""
    records.select("record_id", "title", "source_url", "entities").write.json(path)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """The last line of every record, in the order of their first lines; a malformed line is an error."""
    schema = "record_id string, title string, source_url string, entities array<map<string,string>>"
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path).withColumn("_line", F.struct(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("n")))
    last = rows.groupBy("record_id").agg(F.max_by(F.struct("title", "source_url", "entities"), F.col("_line")).alias("r"), F.min("_line").alias("first"))
    return last.orderBy("first").select("record_id", "r.*")
