"""Encoding of a corpus with a public byte-level BPE vocabulary, in Spark's own expressions.

Texts split into words by the vocabulary's pattern. Only the distinct words of the corpus are encoded: higher-order
functions turn a word into byte ids and fold the merges over them, always the lowest-ranked pair first. The rank map is
a literal of three arrays (a perfect hash of the mergeable pairs), so a lookup is three array reads. The most frequent
words, up to ``DICTIONARY_BYTES``, are encoded once and broadcast; a word outside them is encoded where it stands, by the same fold. So
the broadcast is bounded, no join shuffles on a hot word, and every corpus takes the same plan. Texts are partitioned by
document once, so putting the ids together needs no further shuffle. Decoding concatenates the binary pieces of the ids.

Defined results: NULL and empty texts give an empty list; white space is text; text that spells a special token is
ordinary text; repeated documents each give a row (their key must be unique); extra columns are ignored; a word's cost
grows with the square of its length, a text's with its length.
"""

from __future__ import annotations

import json
import os
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlit.session import checkpoint

#: Folder of the public vocabularies; a parameter of every function here.
TOKENIZERS = os.environ.get("LUMENLIT_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pattern that splits a text into words, published with the vocabulary.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of the most frequent words and their ids that are broadcast.
DICTIONARY_BYTES = 32 * 1024 * 1024
NO_MERGE = 1 << 30


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


@cache
def vocabulary(path: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> tuple[list[int], list[tuple[int, int, int]], list[bytes]]:
    """(id of every byte, merges as (left id, right id, new id) in rank order, bytes of every id)."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    ids, letters = model["vocab"], _byte_letters()
    back = {c: b for b, c in enumerate(letters)}
    merges = []
    for m in model["merges"]:
        left, right = m if isinstance(m, list) else m.split(" ")
        merges.append((ids[left], ids[right], ids[left + right]))
    pieces = [b""] * (max(ids.values()) + 1)
    for piece, i in ids.items():
        pieces[i] = bytes(back[c] for c in piece) if all(c in back for c in piece) else piece.encode()
    return [ids[c] for c in letters], merges, pieces


#: Bits of the rank map's buckets and slots, and the odd factors of its two hashes; products stay below 2 ** 63.
BUCKET_BITS, SLOT_BITS, MIX_1, MIX_2 = 15, 17, 668_265_263, 374_761_393


@cache
def rank_map(path: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> tuple[list[int], list[int], list[int]]:
    """(shift, owner, value): a perfect hash of the pairs. With key = l * 65536 + r, the pair's only place is
    ``at = (hash2(key) + shift[hash1(key)]) mod 2 ** SLOT_BITS``; it merges to ``value[at]`` if ``owner[at] == key``.
    A pair's rank must grow with its new id, so the new id serves as rank."""
    _, merges, _ = vocabulary(path)
    if any(a[2] >= b[2] for a, b in zip(merges, merges[1:])):
        raise ValueError("the ids of this vocabulary are not in rank order")
    size = 1 << SLOT_BITS
    buckets: dict[int, list[tuple[int, int, int]]] = {}
    for left, right, new in merges:
        key = left * 65536 + right
        buckets.setdefault((key * MIX_1 >> 20) % (1 << BUCKET_BITS), []).append(((key * MIX_2 >> 12) % size, key, new))
    shift, owner, value = [0] * (1 << BUCKET_BITS), [-1] * size, [0] * size
    for at, entries in sorted(buckets.items(), key=lambda x: (-len(x[1]), x[0])):
        places = {p for p, _, _ in entries}
        if len(places) < len(entries):
            raise ValueError("two pairs of a bucket collide; choose other factors")
        d = next(d for d in range(size) if all(owner[(p + d) % size] < 0 for p in places))
        shift[at] = d
        for p, key, new in entries:
            owner[(p + d) % size], value[(p + d) % size] = key, new
    return shift, owner, value


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def word_ids(word: Column, tables: Column) -> Column:
    """Ids of one non-empty word. ``tables``: struct of bytes, shift, owner, value."""
    t = tables

    def pair(left: Column, right: Column) -> Column:
        def at_key(key: Column) -> Column:
            bucket = F.shiftright(key * MIX_1, 20).bitwiseAND(F.lit((1 << BUCKET_BITS) - 1)).cast("int")
            slot = (F.shiftright(key * MIX_2, 12) + F.get(t["shift"], bucket)).bitwiseAND(F.lit((1 << SLOT_BITS) - 1)).cast("int")
            return _let(slot, lambda at: F.when(F.get(t["owner"], at) == key, F.get(t["value"], at)).otherwise(F.lit(NO_MERGE)))

        return _let(left.cast("long") * 65536 + right, at_key)

    byte = lambda x: F.get(t["bytes"], x.cast("int"))
    tail = lambda c, shift: (F.shiftright(c, shift).bitwiseAND(F.lit(63))) + 128
    utf8 = lambda c: (
        F.when(c < 0x80, F.array(byte(c)))
        .when(c < 0x800, F.array(byte(F.shiftright(c, 6) + 0xC0), byte(tail(c, 0))))
        .when(c < 0x10000, F.array(byte(F.shiftright(c, 12) + 0xE0), byte(tail(c, 6)), byte(tail(c, 0))))
        .otherwise(F.array(byte(F.shiftright(c, 18) + 0xF0), byte(tail(c, 12)), byte(tail(c, 6)), byte(tail(c, 0))))
    )
    start = F.flatten(F.transform(F.split(word, ""), lambda c: F.when(c == "", F.array().cast("array<int>")).otherwise(_let(F.ascii(c), utf8))))

    def step(a: Column, _: Column) -> Column:
        ids, ranks, m = a["ids"], a["ranks"], a["m"]

        def merged(p: Column) -> Column:
            new_ids = F.concat(F.slice(ids, F.lit(1), p - 1), F.array(m), F.slice(ids, p + 2, F.size(ids)))
            left = F.when(p > 1, F.array(pair(F.get(ids, p - 2), m))).otherwise(F.array().cast("array<int>"))
            right = F.when(p + 1 < F.size(ids), F.array(pair(m, F.get(ids, p + 1)))).otherwise(F.array().cast("array<int>"))
            new_ranks = F.concat(F.slice(ranks, F.lit(1), F.greatest(p - 2, F.lit(0))), left, right, F.slice(ranks, p + 2, F.size(ids)))
            return _let(new_ranks, lambda r: F.struct(new_ids.alias("ids"), r.alias("ranks"), F.coalesce(F.array_min(r), F.lit(NO_MERGE)).alias("m")))

        return F.when(m >= NO_MERGE, a).otherwise(_let(F.array_position(ranks, m).cast("int"), merged))

    def fold(ids: Column) -> Column:
        n = F.size(ids)
        ranks = F.zip_with(F.slice(ids, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(ids, F.lit(2), n), lambda l, r: pair(l, r))
        first = _let(ranks, lambda r: F.struct(ids.alias("ids"), r.alias("ranks"), F.coalesce(F.array_min(r), F.lit(NO_MERGE)).alias("m")))
        return F.when(n < 2, ids).otherwise(F.aggregate(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), first, step, lambda a: a["ids"]))

    return _let(start, fold)


def tables(spark: SparkSession, path: str) -> Column:
    """The rank map and the byte ids as one literal struct, held once per executor."""
    shift, owner, value = rank_map(path)
    schema = "bytes array<int>, shift array<int>, owner array<bigint>, value array<int>"
    row = spark.createDataFrame([(vocabulary(path)[0], shift, owner, value)], schema)
    return row.select(F.struct(*row.columns).alias("t")).scalar()


def with_ids(rows: DataFrame, known: str | None, path: str) -> DataFrame:
    """Adds ``own``: the ids of ``word``, those of the column ``known`` where it has any. The rank map is one value bound per row, not a copy."""
    word = F.transform(F.array("_t"), lambda t: word_ids(F.col("word"), t))[0]
    if known:
        word = F.coalesce(F.col(known), F.when(F.col("word").isNull(), F.array().cast("array<int>")).otherwise(word))
    return rows.withColumn("_t", tables(rows.sparkSession, path)).withColumn("own", word).drop("_t")


def dictionary(words: DataFrame, path: str) -> DataFrame:
    """(word, ids) of the most frequent distinct words, at most ``DICTIONARY_BYTES`` in all: whole octaves of frequency, the highest first."""
    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    counted = checkpoint(counted.select("word", F.floor(F.log2("n")).cast("int").alias("octave")))
    sizes = counted.groupBy("octave").agg(F.sum(F.octet_length("word") * 5 + 48).alias("bytes")).collect()  # at most 64 rows
    room, least = DICTIONARY_BYTES, 64
    for octave, size in sorted(map(tuple, sizes), reverse=True):
        room -= size
        if room < 0:
            break
        least = octave
    return with_ids(counted.where(F.col("octave") >= least), None, path).select("word", F.col("own").alias("ids"))


def split_words(text: Column) -> Column:
    """Words of a text by the vocabulary's pattern."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    """(key, ids): the token ids of every document, without special tokens."""
    words = split_words(F.col(text))
    known = dictionary(documents.select(F.explode(words).alias("word")), path)
    placed = documents.select(key, text).repartition(key).select(key, F.posexplode_outer(words).alias("pos", "word"))
    joined = with_ids(placed.join(F.broadcast(known), "word", "left"), "ids", path).select(key, "pos", F.col("own").alias("ids"))
    parts = F.sort_array(F.collect_list(F.struct("pos", "ids")))
    return joined.groupBy(key).agg(parts.alias("parts")).select(key, F.flatten(F.col("parts.ids")).alias("ids"))


def count_corpus(documents: DataFrame, keys: list[str], text: str = "text", path: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    """(keys, tokens): how many ids ``encode_corpus`` gives each row of the keys; rows without a token are left out. Counts combine before
    the only shuffle, which carries keys and numbers."""
    words = split_words(F.col(text))
    known = dictionary(documents.select(F.explode(words).alias("word")), path)
    each = with_ids(documents.select(*keys, F.explode(words).alias("word")).join(F.broadcast(known), "word", "left"), "ids", path)
    return each.groupBy(*keys).agg(F.sum(F.size("own")).cast("bigint").alias("tokens"))


def decode(ids: Column, path: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> Column:
    """The text of a list of ids; bytes that are no UTF-8 become replacement characters."""
    pieces = F.from_json(F.lit(json.dumps([p.hex() for p in vocabulary(path)[2]])), "array<string>")
    whole = F.transform(F.array(pieces), lambda t: F.array_join(F.transform(ids, lambda i: F.get(t, i)), ""))[0]
    return F.decode(F.unhex(whole), "UTF-8")
