"""Token counts by a two-tier look-up on the map side.

The model's pieces never hold a space mark after another character, so a text's tokens are the tokens of its pre-tokens:
the runs of spaces with the word that follows. Tier one is a hash table of the lengths of pre-tokens that are frequent
in a bounded sample, broadcast once; its size has a fixed bound. Tier two encodes what the table misses and keeps the
lengths in a cache of bounded size in each worker. Pre-tokens of the corpus are never shuffled, only those of the sample.

Which pre-tokens are in either tier changes the time only. Nulls read as empty texts: no bytes, no tokens. Rows are
handled one by one; the model is opened once per worker from `model`, a path that every executor has.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, documents

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIMIT = 4096
#: Documents that choose the frequent pre-tokens, entries of the broadcast table, entries of a worker's cache.
SAMPLE_DOCS = 4_000
TABLE = 1 << 16
CACHE = 1 << 19
MARK = "▁"
RUN = re.compile(" +[^ ]+| +")


def pre_tokens(text: str) -> list[str]:
    """Runs of spaces with the word that follows, after the leading space that the model adds."""
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, " ")
    return RUN.findall(" " + text)


class Lengths(dict):
    """Tokens per pre-token: the broadcast table, then a bounded cache filled by the model."""

    def __init__(self, table: dict[str, int], model: str):
        import sentencepiece

        super().__init__(table)
        self.table, self.coder = table, sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = (self.coder.id_to_piece(i) for i in range(self.coder.vocab_size()))
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("the model joins words across spaces; its texts cannot be cut at spaces")
        self[" "] = 1

    def __missing__(self, key: str) -> int:
        if len(self) > len(self.table) + CACHE:
            self.clear()
            self.update(self.table)
            self[" "] = 1
            if key == " ":
                return 1
        # The model puts one space before what it encodes.
        n = self[key] = len(self.coder.encode(key[1:], num_threads=1))
        return n


def frequent_lengths(docs: DataFrame, model: str) -> dict[str, int]:
    """Lengths of the pre-tokens most frequent in a bounded sample; at most TABLE entries."""
    step = 1 << 20
    share = max(1, min(step, int(step * SAMPLE_DOCS / max(1, docs.count()))))
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) < share)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        for batch in batches:
            seen = Counter()
            for text in batch.column(1).to_pylist():
                seen.update(pre_tokens(text or ""))
            yield pa.RecordBatch.from_pydict({"word": list(seen), "n": list(seen.values())}, schema=pa.schema([("word", pa.string()), ("n", pa.int64())]))

    top = sample.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(
        F.desc("n"), "word").limit(TABLE).select("word").collect()
    lengths = Lengths({}, model)
    return {r["word"]: lengths[r["word"]] for r in top}


def token_counts(docs: DataFrame, model: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document."""
    rows = documents(docs)
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(rows, model))
    held: list[Lengths] = []

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(Lengths(table.value, model))
        length = held[0].__getitem__
        texts = [x or "" for x in batch.column(1).to_pylist()]
        n = [sum(map(length, pre_tokens(x))) for x in texts]
        return pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_bytes": pa.array([len(x.encode()) for x in texts], pa.int64()),
                                           "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n], pa.bool_())})

    return arrow_pass(rows, one, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
