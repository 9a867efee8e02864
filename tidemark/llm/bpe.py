"""Byte-level BPE by ranked merges, and its inverse, as Spark expressions.

A text is cut into pre-tokens by the tokenizer's pattern. A distinct word is encoded by a fold over its array of bytes:
each step merges the leftmost adjacent pair of lowest rank and asks the ranks of the two new pairs only. A piece is held
as its id, which is its rank, so the map gives for two ids the rank of their joined bytes. The rank map is one constant of
the plan, an array of small maps addressed by a hash, so a look-up does not search all pairs.

Words that are frequent in a bounded sample of documents are folded once and their pieces become a second constant; the
other words are folded where they stand. Which words are frequent changes the time only: the pieces are the same.
Nothing is shuffled but the sampled word counts; a lost executor repeats its own rows.

Nulls and empty texts give no ids. Invalid UTF-8 cannot occur in a string column. Ties of rank go to the leftmost pair.
Repeated rows give repeated results. Other columns pass through `encode` untouched; one named `pieces` is replaced.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents

# The pattern of the tokenizer, in Java's notation (its \s and \S are ASCII there, so the Unicode property
# is named). The alternatives and their order are those of public_tokenizers.PATTERN.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+"
           r"|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+")
#: An entry of the fold: 17 bits of rank, 29 of place and 17 of id. The largest rank stands for "no such pair".
ID_BITS, START_BITS = 17, 29
NONE = (1 << ID_BITS) - 1
CLOSED = NONE << (START_BITS + ID_BITS)
REST = (1 << (START_BITS + ID_BITS)) - 1
RANK_SLOTS = 1 << 16
PAIR_SLOTS = 1 << 18
WORD_SLOTS = 1 << 17
#: Documents that choose the frequent words, and most frequent words kept: bounds on the second constant.
SAMPLE_DOCS = 24_000
MOST_WORDS = 120_000


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` with `value` computed once: a fold over nothing. Unlike an element of a one-element array it asks for no
    types while rows are computed, and it copies nothing."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, body)


def slots(df: DataFrame, key: str, value: Column, n: int, at: Column | None = None) -> Column:
    """A constant array of n small maps that holds (key, value) at the slot of the key's hash, or at the slot given."""
    small = df.groupBy((F.pmod(F.xxhash64(key), F.lit(n)) if at is None else at).alias("slot")).agg(
        F.collect_list(F.struct(F.col(key).alias("k"), value.alias("v"))).alias("m"))
    every = df.sparkSession.range(n).select(F.col("id").alias("slot")).join(small, "slot", "left")
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "m"))), lambda s: F.map_from_entries(s["m"])).alias("slots")).scalar()


def look_up(table: Column, n: int, key: Column) -> Column:
    return F.try_element_at(F.get(table, F.pmod(F.xxhash64(key), F.lit(n))), key)


def with_constants(df: DataFrame, to: str, constants: dict[str, Column], body: Callable[[Column], Column]) -> DataFrame:
    """`df` with column `to` = body(constants). The constants are sub-query results: the body gets them through one
    reference, which the optimizer puts in place, so they are never copied into rows."""
    held = df.withColumns({f"_const_{k}": v for k, v in constants.items()})
    bound = F.struct(*[F.col(f"_const_{k}").alias(k) for k in constants])
    return held.select(*[c for c in df.columns if c != to], bind(bound, body).alias(to))


class Bpe:
    """A rank file as constants of a plan: `ranks` (piece to id) and `pieces` (id to piece, in hex)."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), encoding="ascii") as f:
            lines = f.read()
        one = spark.createDataFrame([(lines,)], "lines string")
        cut_line = F.split("line", " ")
        self.vocab = cut(one.select(F.explode(F.split("lines", "\n")).alias("line")).where("line <> ''").select(
            F.unbase64(cut_line[0]).alias("piece"), cut_line[1].cast("long").alias("id")))
        last, least = self.vocab.agg(F.max("id"), F.count(F.when(F.length("piece") == 1, 1))).first()
        if last >= NONE or least != 256:
            raise ValueError(f"a rank file needs every single byte and ids below {NONE}")
        # Ids may have gaps: the piece of id i stands at place i.
        by_id = spark.range(last + 1).join(self.vocab, "id", "left")
        pieces = by_id.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", F.hex("piece").alias("h")))), lambda s: s["h"])
                           .alias("pieces")).scalar()
        codes = by_id.agg(F.transform(F.sort_array(F.collect_list("id")), id_hex).alias("codes")).scalar()
        halves = self.vocab.where(F.length("piece") > 1).select("piece", "id", F.explode(F.sequence(F.lit(1), F.length("piece") - 1)).alias("k")).select(
            F.substring("piece", F.lit(1), F.col("k")).alias("l"), F.substring("piece", F.col("k") + 1, F.length("piece")).alias("r"), "id")
        part = lambda side: self.vocab.select(F.col("piece").alias(side), F.col("id").alias(f"{side}_id"))
        pairs = cut(halves.join(part("l"), "l").join(part("r"), "r").select(
            pair_key(F.col("l_id"), F.col("r_id")).alias("pair"), pair_slot(F.col("l_id"), F.col("r_id")).alias("at"), "id"))
        every = spark.range(256).select(F.unhex(F.lpad(F.hex("id"), 2, "0")).alias("piece"), F.col("id").alias("b"))
        single = every.join(self.vocab, "piece", "left").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("b", "id"))), lambda x: x["id"]).alias("bytes")).scalar()
        self.constants = {"ranks": slots(self.vocab, "piece", F.col("id"), RANK_SLOTS), "pairs": slots(pairs, "pair", F.col("id"), PAIR_SLOTS, F.col("at")),
                          "bytes": single, "pieces": pieces, "codes": codes}


def id_hex(i: Column) -> Column:
    """An id as eight hex digits of a little-endian unsigned 32-bit integer."""
    h = F.lpad(F.hex(i), 8, "0")
    return F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))


def pair_key(a: Column, b: Column) -> Column:
    return F.shiftleft(a, ID_BITS).bitwiseOR(b)


def pair_slot(a: Column, b: Column) -> Column:
    return (a * long(40503) + b).bitwiseAND(long(PAIR_SLOTS - 1))


def long(i: int) -> Column:
    return F.lit(i).cast("long")


def rank(c: Column, a: Column, b: Column) -> Column:
    """Rank of two joined pieces, or NONE, also where one of them is null."""
    return F.coalesce(F.try_element_at(F.get(c["pairs"], pair_slot(a, b)), pair_key(a, b)), long(NONE))


def fold(c: Column, word: Column) -> Column:
    """Ids of one word (binary): itself if it is a piece, else ranked merges folded over its bytes."""
    return bind(look_up(c["ranks"], RANK_SLOTS, word), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(merged(c, word)))


def entry(opens: Column, rest: Column) -> Column:
    """A piece in the fold, as one long: rank of the pair that it opens, its first byte's place, its id. The least entry
    is therefore the leftmost pair of lowest rank."""
    return F.shiftleft(opens, START_BITS + ID_BITS).bitwiseOR(rest)


def entry_id(e: Column) -> Column:
    return e.bitwiseAND(long(NONE))


def merged(c: Column, word: Column) -> Column:
    def step(acc: Column, _: Column) -> Column:
        return bind(F.array_min(acc), lambda low: F.when(low >= CLOSED, acc).otherwise(
            bind(F.array_position(acc, low).cast("int"), lambda i: joined(acc, low, i))))

    def joined(acc: Column, low: Column, i: Column) -> Column:
        # Places in an entry are unique, so an entry is known by its value: the right half goes, the left half becomes
        # the joined piece, and the entry before it opens another pair. There is none before the first one: null.
        return bind(F.shiftright(low, START_BITS + ID_BITS), lambda new: bind(entry_id(F.get(acc, i + 1)), lambda right: bind(
            entry(rank(c, new, right), start_of(low).bitwiseOR(new)), lambda here: bind(F.get(acc, i - 2), lambda before: bind(
                bind(entry_id(before), lambda left: entry(rank(c, left, new), before.bitwiseAND(long(REST)))),
                lambda opener: F.transform(F.array_remove(acc, F.get(acc, i)), lambda e: F.when(e == low, here).when(e == before, opener).otherwise(e)))))))

    # Bytes as the characters of a one-byte character set, for their numbers.
    singles = F.transform(F.split(F.decode(word, "ISO-8859-1"), ""), lambda x: F.get(c["bytes"], F.ascii(x)))
    entries = bind(singles, lambda ids: F.transform(ids, lambda a, i: bind(
        F.get(ids, i + 1), lambda b: entry(rank(c, a, b), F.shiftleft(i.cast("long"), ID_BITS).bitwiseOR(a)))))
    return bind(entries, lambda e: F.aggregate(e, e, step, lambda acc: F.transform(acc, entry_id)))


def start_of(e: Column) -> Column:
    """The place in an entry, where it stands."""
    return e.bitwiseAND(F.lit(((1 << START_BITS) - 1) << ID_BITS))


def words(text: Column) -> Column:
    """Pre-tokens of a text in order; null reads as empty."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERN), F.lit(0))


def coded(c: Column, word: Column) -> Column:
    """struct(ids, raw) of a word: its ids as a hex string, and what decoding these ids gives. A word is whole characters,
    so its decoded bytes are a string, half as long as their hex digits."""
    return bind(fold(c, word.cast("binary")), lambda ids: F.struct(
        F.array_join(F.transform(ids, lambda i: F.get(c["codes"], i)), "").alias("ids"), F.unhex(decode_hex(c, ids)).cast("string").alias("raw")))


def decode_hex(c: Column, ids: Column) -> Column:
    """Binary pieces of the ids, concatenated, as a hex string. An id outside the vocabulary adds nothing."""
    return F.array_join(F.transform(ids, lambda i: F.get(c["pieces"], i)), "")


def decode(df: DataFrame, bpe: Bpe, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds the binary text of an array of ids; null ids give null."""
    return with_constants(df, to, bpe.constants, lambda c: F.unhex(decode_hex(c, F.col(ids))))


def frequent(docs: DataFrame, bpe: Bpe, sample_docs: int, most_words: int) -> Column:
    """Constant map from frequent words to their coded form, chosen on a bounded sample of documents."""
    share = min(1.0, sample_docs / max(1, docs.count()))
    step = 1 << 20
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) < max(1, int(share * step)))
    seen = cut(sample.select(F.explode(words(F.col("text"))).alias("word")).groupBy("word").count())
    # The lowest count that leaves at most `most_words` words; counts from `top` on are taken together.
    top = 1_000
    sizes = {r["c"]: r["n"] for r in seen.groupBy(F.least("count", F.lit(top)).alias("c")).agg(F.count("*").alias("n")).collect()}
    low, kept = top + 1, 0
    while low > 1 and kept + sizes.get(low - 1, 0) <= most_words:
        low -= 1
        kept += sizes.get(low, 0)
    common = with_constants(seen.where(F.col("count") >= low).select("word"), "code", bpe.constants, lambda c: coded(c, F.col("word")))
    return slots(common, "word", F.col("code"), WORD_SLOTS)


def encode(docs: DataFrame, bpe: Bpe, sample_docs: int = SAMPLE_DOCS, most_words: int = MOST_WORDS) -> DataFrame:
    """`docs` with `pieces`: per pre-token its ids (hex string) and decoded text, in text order. `sample_docs` and
    `most_words` bound the constant of frequent words, which trades driver memory for time."""
    constants = bpe.constants | {"known": frequent(documents(docs), bpe, sample_docs, most_words)}
    return with_constants(docs, "pieces", constants, lambda c: F.transform(words(F.col("text")), lambda w: F.coalesce(
        look_up(c["known"], WORD_SLOTS, w), coded(c, w))))


def ids_of(pieces: Column) -> Column:
    """The ids of encoded pieces as an array of integers."""
    h = F.array_join(pieces["ids"], "")
    return bind(h, lambda s: F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(0), (F.length(s) / 8 - 1).cast("int")), lambda i: F.conv(
        F.concat(*[F.substring(s, i * 8 + at, F.lit(2)) for at in (7, 5, 3, 1)]), 16, 10).cast("int"))).otherwise(
        F.array().cast("array<int>")))


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of encoded documents."""
    ids = F.unhex(F.array_join("pieces.ids", ""))
    raw = F.array_join("pieces.raw", "").cast("binary")
    return encoded.select("doc_id", ids.alias("_ids"), raw.alias("_raw")).select(
        "doc_id", (F.length("_ids") / 4).cast("long").alias("n_tokens"), F.sha2("_ids", 256).alias("ids_sha256"),
        F.sha2("_raw", 256).alias("decoded_sha256"))
