"""Visually identical text with different characters, brought to one form.

A transducer runs over grapheme clusters in one pass, always taking the longest match: a base with its combining marks, the jamo of a
Hangul syllable, an emoji sequence, a letter with a joiner it needs, or a single character. Its table is compiled once from Unicode
properties (widths, spaces, ligatures, canonical forms) of every assigned character and a fixed list of look-alike letters of a dozen scripts:
single characters, and every base with marks that has a canonical composition, from whichever look-alike of the base. It is
checked for conflicts: no output may itself be mapped. A cluster outside the table (a base with marks that compose to nothing) follows the same
rule, worked out once. Case, accents, digits, raised signs, font variants and line ends stay.

Defined results: NULL stays NULL, empty stays empty; blank texts keep their length in spaces; texts of any length pass
through in linear time. Two texts look the same when their forms are equal and hold a letter.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlit.session import checkpoint

# Letters of two scripts that share one shape, as (look-alikes, Latin letters).
CONFUSABLE = {
    "Cyrillic": ("АВЕЅІӀЈКМНОРԚСТѴԜХУҮаеорсухѕіјһԁԛԝѵӏ", "ABESIIJKMHOPQCTVWXYYaeopcyxsijhdqwvl"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿονϲϳ", "ABEZHIKMNOPTYXCJovcj"),
    "Armenian": ("ՕՍՏԼօհոսզցյ", "OUSLohnuqgj"),
    "Coptic": ("ⲎⲔⲘⲚⲞⲢⲤⲦⲬⲟⲥ", "HKMNOPCTXoc"),
    "Cherokee": ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏀᏃᏙᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHYGZVSLCPKB"),
    "Lisu": ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
    "Latin": ("ɡⅠⅤⅩⅬⅭⅮⅯⅰⅴⅹⅼⅽⅾⅿ", "gIVXLCDMivxlcdm"),
    "Deseret": ("\U00010404\U0001042c", "Oo"),
    "Osage": ("\U000104c2\U000104ea", "Oo"),
    "Lycian": ("\U00010282\U00010297", "BT"),
    "Carian": ("\U000102a0", "A"),
}
HYPHENS = "‐‑"
#: Format characters without a shape: soft hyphen, zero-width space and joiners, marks of direction, word joiner, byte-order mark.
SHAPELESS = "­؜​‌‍‎‏⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿"
#: Compatibility forms that keep their look: the tag of the decomposition.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>")


@cache
def assigned() -> list[str]:
    """Every assigned character outside ASCII and the private planes."""
    return [c for i in range(0x80, 0xF0000) if not 0xD800 <= i < 0xE000 and unicodedata.category(c := chr(i)) not in ("Cn", "Co")]


@cache
def mapping() -> dict[str, str]:
    """Code point -> text of the one form, over canonically decomposed text."""
    out = {a: b for some, latin in CONFUSABLE.values() for a, b in zip(some, latin, strict=True)} | dict.fromkeys(HYPHENS, "-") | dict.fromkeys(SHAPELESS, "")
    for c in assigned():
        if c in out:
            continue
        if unicodedata.category(c) == "Zs":
            out[c] = " "
            continue
        tag, _, rest = unicodedata.decomposition(c).partition(" ")
        if not tag.startswith("<"):
            continue
        plain = "".join(chr(int(x, 16)) for x in rest.split())
        ligature = tag == "<compat>" and "LIGATURE" in unicodedata.name(c, "") and len(plain) <= 3
        if tag in SAME_LOOK or ligature or c in "µ…":
            out[c] = plain
    # Outputs that are sources themselves are resolved now, so that one pass suffices.
    resolved = {k: "".join(out.get(x, x) for x in unicodedata.normalize("NFD", v)) for k, v in out.items()}
    conflicts = [k for k, v in resolved.items() if any(x in resolved for x in v)]
    if conflicts:
        raise ValueError(f"the mapping is no fixed point for {conflicts}")
    return resolved


def by_rule(cluster: str) -> str:
    """The one form of one cluster, by the mapping alone."""
    table = mapping()
    plain = unicodedata.normalize("NFD", "".join(c for c in cluster if table.get(c) != ""))
    return unicodedata.normalize("NFC", "".join(table.get(c, c) for c in plain))


@cache
def compiled() -> dict[str, str]:
    """The transducer's table: cluster -> one form, for single characters and for bases with marks."""
    table, out = mapping(), {}
    alike: dict[str, list[str]] = {}
    for c, v in table.items():
        if len(v) == 1:
            alike.setdefault(v, []).append(c)
    for c in assigned():
        plain = unicodedata.normalize("NFD", c)
        form = by_rule(c)
        if form != c:
            out[c] = form
        if len(plain) > 1 and all(map(unicodedata.combining, plain[1:])):
            for base in (plain[0], *alike.get(plain[0], ())):
                out[base + plain[1:]] = form
    bad = [k for k, v in out.items() if any(x in table for x in v)]
    if bad:
        raise ValueError(f"the table is no fixed point for {bad}")
    return out


def _class(points: list[int]) -> str:
    """Inside of a character class."""
    out, i = [], 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        out.append(f"\\U{points[i]:08x}" + (f"-\\U{points[j]:08x}" if j > i else ""))
        i = j + 1
    return "".join(out)


@cache
def classes() -> tuple[str, str, str]:
    """(single characters that may change, combining marks, shapeless characters), as insides of character classes."""
    singles = [ord(c) for c in compiled() if len(c) == 1]
    marks = [ord(c) for c in assigned() if unicodedata.combining(c)]
    return _class(sorted({*singles, *map(ord, mapping())})), _class(marks), _class(sorted(map(ord, SHAPELESS)))


@cache
def transducer() -> re.Pattern:
    """Matches, longest first, every cluster that may change or must be kept whole, and runs of single characters at once."""
    special, marks, none = classes()
    pictograph = r"[\u2190-\u2bff\U0001f000-\U0001faff]"
    joining = r"[\u0600-\u08ff\u0900-\u0dff]"
    return re.compile(
        rf"(?P<keep>{pictograph}(?:\ufe0f?\u200d{pictograph}\ufe0f?)+|{joining}[\u200c\u200d]+(?={joining}))"
        rf"|[\u1100-\u115f][\u1160-\u11a7][\u11a8-\u11ff]?|[\uac00-\ud7a3][\u11a8-\u11ff]"
        rf"|[^\r\n{none}{marks}](?=[{none}{marks}])(?:[{none}]*[{marks}])+|(?P<run>(?:[{special}](?![{none}{marks}]))+)|[{special}{marks}]"
    )


@cache
def _any() -> frozenset[str]:
    inside = re.compile("[" + "".join(classes()) + r"\u1100-\u11ff]")
    return frozenset(c for c in assigned() if inside.match(c))


@cache
def _singles() -> dict[int, str]:
    return {ord(c): v for c, v in compiled().items() if len(c) == 1}


@cache
def _short(cluster: str) -> str:
    return by_rule(cluster)


def _cluster(text: str) -> str:
    form = compiled().get(text)
    return form if form is not None else _short(text) if len(text) < 8 else by_rule(text)


def one_form(text: str) -> str:
    """The one form of a text."""
    if text.isascii():
        return text
    if _any().isdisjoint(text):
        return text
    singles = _singles()

    def replaced(m: re.Match) -> str:
        if m.lastgroup == "run":
            return m[0].translate(singles)
        if m.lastgroup == "keep":
            return m[0]
        return _cluster(m[0])

    return transducer().sub(replaced, text)


@F.pandas_udf(T.StringType())
def _one_form_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(one_form, na_action="ignore")


def canonical_text(text: Column) -> Column:
    """The one form; plain ASCII never leaves the JVM."""
    return F.coalesce(_one_form_udf(F.when(text.rlike(r"[^\x00-\x7f]"), text)), text)


def looks(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, look, own): digests of the one form and of the text itself, of every document whose form holds a letter."""
    rows = documents.where(F.col(text).isNotNull()).select(F.col(key), F.col(text).alias("_t"), canonical_text(F.col(text)).alias("_f"))
    return rows.where(F.col("_f").rlike(r"\p{L}")).select(key, F.unhex(F.md5("_f")).alias("look"), F.unhex(F.md5("_t")).alias("own"))


def look_classes(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id, spelling_id, spellings): every document with its look and its own spelling of it, both named by their smallest key, and
    the number of different spellings of the look. One row per document, whatever the number of copies."""
    rows = checkpoint(looks(documents, key, text))
    spelled = rows.groupBy("look", "own").agg(F.min(key).alias("spelling_id"))
    look = spelled.groupBy("look").agg(F.min("spelling_id").alias("class_id"), F.count("*").alias("spellings"))
    return rows.join(spelled, ["look", "own"]).join(look, "look").select(key, "class_id", "spelling_id", "spellings")


def same_look(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id_a, doc_id_b): pairs of documents that look the same, hold a letter and are different strings.

    Only looks with two or more different strings reach the join, so a mass of exact copies costs one aggregate.
    """
    rows = checkpoint(looks(documents, key, text).withColumnRenamed(key, "id"))  # digests only; three passes read them
    mixed = rows.groupBy("look").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).where(F.col("lo") != F.col("hi")).select("look")
    some = rows.join(mixed, "look", "left_semi")
    a, b = (some.select("look", F.col("id").alias(f"{key}_{x}"), F.col("own").alias(f"own_{x}")) for x in "ab")
    return a.join(b, "look").where((F.col(f"{key}_a") < F.col(f"{key}_b")) & (F.col("own_a") != F.col("own_b"))).select(f"{key}_a", f"{key}_b")
