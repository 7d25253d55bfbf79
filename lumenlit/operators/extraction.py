"""Extraction of entities and claims with a language model: prompts, cached answers, entity lists, screening, grounding, usage.

The model is a factory of clients that runs on the executors; nothing here reaches a network by itself. Requests are columns, answers are
joined from a cache first, and only what the cache lacks is asked. What is not kept is a rejection with its reasons.

Defined results: NULL texts give NULL prompts and no request; an answer that holds no list of entities is an error, not an empty list; ``null`` is an
empty list; an entity may break several rules at once; empty tables pass through.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlit.errors import ConfigError
from lumenlit.functions.text import content_hash, located
from lumenlit.operators.tables import NONE

#: Characters of a document that a prompt holds.
MOST_CHARS = 120_000
VIOLATIONS = NONE
USAGE = "struct<requests:int,prompt_tokens:int,completion_tokens:int>"


def prepared(text: Column, most: int = MOST_CHARS) -> Column:
    """The part of a text that a prompt holds."""
    return F.substring(text, 1, most)


def is_markup(text: Column) -> Column:
    """Whether a text begins with a tag within its first 200 characters, white space aside."""
    return F.coalesce(F.ltrim(F.regexp_replace(F.substring(text, 1, 200), r"^\s+", "")).startswith("<"), F.lit(False))


def entity_list_schema(entity: dict, key: str = "entities") -> dict:
    """JSON Schema of an answer that holds a list of entities under ``key``; definitions move to the root, where references find them."""
    item = {k: v for k, v in entity.items() if k != "$defs"}
    answer = {"type": "object", "properties": {key: {"type": "array", "items": item}}, "required": [key], "additionalProperties": False}
    return answer | ({"$defs": entity["$defs"]} if entity.get("$defs") else {})


def request_key(model: str, system: str, prompt: str, base_url: str | None = None, temperature: float | None = None, response_format: dict | None = None, schema: dict | None = None, variant: str = "") -> str:
    """Key of a request: what could change its answer, and nothing else. Schema and variant only count where they are given."""
    parts: list = [model, base_url, None if temperature is None else float(temperature), response_format, system, prompt]
    if schema is not None or variant:
        parts.append({"schema": schema, "variant": variant})
    return content_hash(parts)


def requests(texts: DataFrame, model: str, system: str, column: str = "text", **options: object) -> DataFrame:
    """Adds ``prompt`` and ``key`` to rows with a text."""

    def keys(s: pd.Series) -> pd.Series:
        return s.map(lambda p: request_key(model, system, p, **options), na_action="ignore")

    keys.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return texts.withColumn("prompt", prepared(F.col(column))).withColumn("key", F.pandas_udf(keys, T.StringType())(F.col("prompt")))


def asked(misses: DataFrame, client: Callable[[], Callable[[str], dict]]) -> DataFrame:
    """Adds ``answer``, ``error`` and ``usage`` to rows with ``prompt``. ``client`` makes, once per task, a function from a prompt to a dict of
    ``answer`` and, if known, ``prompt_tokens`` and ``completion_tokens``. A fault is that row's error."""
    schema = f"answer string, error string, usage {USAGE}"

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ask = client()
        for s in batches:
            rows = []
            for prompt in s:
                if prompt is None:
                    rows.append((None, "no text", (0, 0, 0)))
                    continue
                try:
                    got = ask(prompt)
                    rows.append((got["answer"], None, (1, got.get("prompt_tokens", 0), got.get("completion_tokens", 0))))
                except Exception as e:  # noqa: BLE001 - any fault of a request is that request's result
                    rows.append((None, f"{type(e).__name__}: {e}"[:4096], (1, 0, 0)))
            yield pd.DataFrame(rows, columns=["answer", "error", "usage"])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return misses.withColumn("_r", F.pandas_udf(run, schema)(F.col("prompt"))).select("*", "_r.answer", "_r.error", "_r.usage").drop("_r")


def usage_totals(answers: DataFrame) -> DataFrame:
    """(requests, prompt_tokens, completion_tokens): sums over all rows; cached ones cost nothing."""
    return answers.agg(*[F.coalesce(F.sum(f"usage.{c}"), F.lit(0)).cast("bigint").alias(c) for c in ("requests", "prompt_tokens", "completion_tokens")])


ENTITY_LIST = "entities array<string>, error string"


def entity_list_of(answer: str | None, key: str) -> tuple[list[str], str | None]:
    """(entities as JSON, error) of one answer: the list under ``key``, or under the only key there is; one entity stands for a list of it."""
    try:
        found = json.loads(answer) if answer else None
    except ValueError as e:
        return [], f"no JSON: {e}"
    if not isinstance(found, dict):
        return [], f"the answer is {type(found).__name__}, not an object"
    if key not in found and len(found) != 1:
        return [], f"the answer has no {key!r} and {len(found)} keys"
    value = found[key] if key in found else next(iter(found.values()))
    if value is None:
        return [], None
    items = [value] if isinstance(value, dict) else value
    if not isinstance(items, list) or not all(isinstance(x, dict) for x in items):
        return [], f"{type(value).__name__} where a list of entities belongs"
    return [json.dumps(x, ensure_ascii=False, sort_keys=True) for x in items], None


def entity_lists(answer: Column, key: str = "entities") -> Column:
    """``struct<entities, error>`` of an answer column."""

    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([entity_list_of(a, key) for a in s], columns=["entities", "error"])

    run.__annotations__ = {"s": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, ENTITY_LIST)(answer)


_KINDS = {"string": str, "number": (int, float), "integer": int, "boolean": bool, "array": list, "object": dict}


def schema_violations(entity: dict, schema: dict) -> list[dict]:
    """Violations of a JSON Schema's types, required properties, enumerations and ``additionalProperties``; the field is the dotted place."""
    out: list[dict] = []

    def report(where: tuple, message: str) -> None:
        at = ".".join(map(str, where))
        out.append({"code": "schema", "field": at, "severity": "error", "message": f"{at or 'entity'}: {message}"})

    def check(value: object, rule: dict, where: tuple) -> None:
        if "$ref" in rule:
            rule = schema.get("$defs", {}).get(rule["$ref"].rpartition("/")[2], {})
        kinds = rule.get("type", [])
        kinds = [kinds] if isinstance(kinds, str) else kinds
        if value is None and "null" in kinds:
            return
        fits = [isinstance(value, _KINDS[k]) and not (isinstance(value, bool) and k in ("number", "integer")) for k in kinds if k in _KINDS]
        if kinds and not any(fits):
            return report(where, f"should be {' or '.join(kinds)}")
        if "enum" in rule and value not in rule["enum"]:
            report(where, f"should be one of {rule['enum']}")
        if isinstance(value, dict):
            known = rule.get("properties", {})
            for name in rule.get("required", []):
                if name not in value:
                    report((*where, name), "is missing")
            for name, inner in value.items():
                if name in known:
                    check(inner, known[name], (*where, name))
                elif rule.get("additionalProperties") is False:
                    report((*where, name), "is not expected")
        if isinstance(value, list) and "items" in rule:
            for i, inner in enumerate(value):
                check(inner, rule["items"], (*where, i))

    check(entity, schema, ())
    return out


def schema_rule(entity: Column, schema: dict) -> Column:
    """Violations of a column of JSON entities."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda e: schema_violations(json.loads(e), schema) if e is not None else [])

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, VIOLATIONS)(entity)


def screened(entities: DataFrame, rules: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): entities without and with a violation that is an error; rejected ones keep ``violations``."""
    judged = entities.withColumn("violations", F.concat(*rules) if rules else F.array().cast(VIOLATIONS))
    bad = F.exists("violations", lambda v: v["severity"] == "error")
    return judged.where(~bad).drop("violations"), judged.where(bad)


def rejection_id(record_id: str, entity: dict, violations: list[tuple[str, str | None]], stamp: dict | None = None) -> str:
    """Identifier of a rejection: record, entity, codes and fields of its violations, and what extracted it."""
    return content_hash([record_id, json.loads(json.dumps(entity, ensure_ascii=False, default=str)), [list(v) for v in violations], stamp])


def rejections(rejected: DataFrame, stamp: dict | None = None, entity: str = "entity") -> DataFrame:
    """(entry_id, record_id, entity, violations): rejected entities for a review; the same rejection again has the same id."""

    def ids(record: pd.Series, what: pd.Series, violations: pd.Series) -> pd.Series:
        return pd.Series([rejection_id(r, json.loads(e), [(v["code"], v["field"]) for v in vs], stamp) for r, e, vs in zip(record, what, violations)])

    ids.__annotations__ = {"record": pd.Series, "what": pd.Series, "violations": pd.Series, "return": pd.Series}
    entry = F.pandas_udf(ids, T.StringType())(F.col("record_id"), F.col(entity), F.col("violations"))
    return rejected.select(entry.alias("entry_id"), "record_id", F.col(entity).alias("entity"), F.to_json("violations").alias("violations"))


def grounded(drafts: DataFrame, documents: DataFrame, least: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(claims, ungrounded): drafts (record_id, quote, ...) with ``span_start``, ``span_end`` and ``match_ratio`` of the sentences that hold the quote, and
    those whose quote, or whose document, is not there, with a violation."""
    if least != 0.9:
        raise ConfigError("quotes are located at a ratio of 0.9")
    found = drafts.join(documents.select("record_id", F.col("text").alias("_text")), "record_id", "left").withColumn("_at", located(F.col("_text"), F.col("quote")))
    placed = found.withColumns({"span_start": F.col("_at.start"), "span_end": F.col("_at.end"), "match_ratio": F.col("_at.ratio")}).drop("_text", "_at")
    violation = F.struct(F.lit("ungrounded").alias("code"), F.lit("quote").alias("field"), F.lit("error").alias("severity"), F.lit("the quote is not in the text").alias("message"))
    lost = placed.where(F.col("match_ratio").isNull()).drop("span_start", "span_end", "match_ratio").withColumn("violations", F.array(violation))
    return placed.where(F.col("match_ratio").isNotNull()), lost


FLAT = ("verbatim", "value", "unit_text", "qualifier", "uncertainty", "uncertainty_kind", "scale_note")


def claim_rows(claims: DataFrame) -> DataFrame:
    """Nested claims as flat rows: ``quantity_<field>`` columns and the context as sorted pairs in JSON."""
    pairs = F.array_sort(F.map_entries(F.coalesce("context", F.create_map().cast("map<string,string>"))))
    flat = claims.withColumns({f"quantity_{f}": F.col(f"quantity.{f}") for f in FLAT} | {"has_quantity": F.col("quantity").isNotNull()})
    return flat.withColumn("context", F.to_json(F.transform(pairs, lambda p: F.array(p["key"], p["value"])))).drop("quantity")


def claims_of_rows(rows: DataFrame) -> DataFrame:
    """What ``claim_rows`` was given."""
    quantity = F.when(F.col("has_quantity"), F.struct(*[F.col(f"quantity_{f}").alias(f) for f in FLAT]))
    pairs = F.from_json("context", "array<array<string>>")
    context = F.map_from_entries(F.transform(pairs, lambda p: F.struct(p[0].alias("key"), p[1].alias("value"))))
    return rows.withColumn("quantity", quantity).withColumn("context", context).drop("has_quantity", *[f"quantity_{f}" for f in FLAT])
