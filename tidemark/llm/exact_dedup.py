"""Exact duplicates through an extendible-hash index on shared files.

Texts are normalised (A-Z to lower case) and hashed. A histogram of the leading hash bits, counted in the tasks, gives
the directory: a bucket that would hold more texts than its capacity is split by one more bit and the directory doubles
where the bucket was as deep as the directory. Tasks combine the copies they meet, then every combined text goes to the
owner of its bucket, a range of keys. The owner reads its keys in order, chains the texts that share a key, compares
their bytes and writes one entry per different text to the index: the row that stays, the count, the digest. Bucket
files and directory are Parquet under the shared checkpoint folder, so a lost executor costs no more than its own tasks.

A bucket whose keys are all equal cannot be split; it is small all the same, for copies are combined before they travel.
Every row finds its entry by key and digest; the few entries that a thousandth of all rows share are broadcast (there
are at most a thousand), the others are joined. Null texts count as empty and equal to each other. Of rows that repeat
an id and a text all are kept by `decisions`; `survivors` returns one of them. A null id is smaller than any other.
Columns with clashing names are left out of the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, documents, lower_ascii, shared_folder, small_batches, text_bytes

#: Leading hash bits of the histogram: the directory's greatest depth.
DEEPEST = 16
#: Buckets aimed at for each shuffle partition.
BUCKETS_PER_OWNER = 8
#: Bytes of texts that a task combines before it hands them on.
COMBINE_BYTES = 32 << 20
#: A group of at least this share of all rows is looked up in a broadcast table.
HOT_SHARE = 1_000


def key_of(raw: bytes) -> int:
    """64-bit key of a normalised text, as a signed integer."""
    h = xxhash.xxh3_64_intdigest(raw)
    return h - (1 << 64) if h >= 1 << 63 else h


def prefix_of(keys: np.ndarray) -> np.ndarray:
    return (keys.view(np.uint64) >> np.uint64(64 - DEEPEST)).astype(np.int64)


def histogram(docs: DataFrame) -> dict[int, int]:
    """Different keys per leading bits, each task counting its own: 2^DEEPEST numbers at most."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << DEEPEST, np.int64)
        for batch in batches:
            keys = np.unique(np.array([key_of(lower_ascii(x)) for x in text_bytes(batch.column(0))], np.int64))
            seen += np.bincount(prefix_of(keys), minlength=1 << DEEPEST)
        at = np.nonzero(seen)[0]
        yield pa.RecordBatch.from_pydict({"p": at.astype(np.int64), "n": seen[at]})

    small_batches(docs.sparkSession)
    return {r["p"]: r["n"] for r in docs.select("text").mapInArrow(count, "p long, n long").groupBy("p").agg(F.sum("n").alias("n")).collect()}


def directory(counts: dict[int, int], capacity: int, deepest: int = DEEPEST) -> np.ndarray:
    """Bucket of every leading-bits value. Buckets start as one; an overfull one is split by its next bit."""
    total = np.zeros((1 << deepest) + 1, np.int64)
    for p, n in counts.items():
        total[p + 1] = n
    total = total.cumsum()
    depth, slots = 0, np.zeros(1, np.int64)  # global depth; bucket of each directory slot
    local, start = [0], [0]  # per bucket: its depth and its first leading-bits value
    todo = [0]
    while todo:
        b = todo.pop()
        width = 1 << (deepest - local[b])
        if local[b] == deepest or total[start[b] + width] - total[start[b]] <= capacity:
            continue
        if local[b] == depth:
            depth, slots = depth + 1, np.repeat(slots, 2)
        new = len(local)
        local[b] += 1
        local.append(local[b])
        start.append(start[b] + width // 2)
        first = start[new] >> (deepest - depth)
        slots[first:first + ((width // 2) >> (deepest - depth))] = new
        todo += [b, new]
    # Buckets are renumbered along the keys, so that neighbours in key order are neighbours in number.
    order = np.empty(len(start), np.int64)
    order[np.argsort(start)] = np.arange(len(start))
    return np.repeat(order[slots], 1 << (deepest - depth))


def combined(docs: DataFrame, slots: np.ndarray) -> DataFrame:
    """Different texts per task with bucket, key, newest id, rows, rows of that id and digest."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(slots)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size = 0

        def out() -> pa.RecordBatch:
            keys = np.array([key_of(x) for x in held], np.int64)
            v = list(held.values())
            return pa.RecordBatch.from_pydict({
                "bucket": sent.value[prefix_of(keys)], "key": keys, "keep_id": pa.array([x[0] for x in v], pa.int64()),
                "rows": pa.array([x[1] for x in v], pa.int64()), "last_rows": pa.array([x[2] for x in v], pa.int64()),
                "digest": pa.array([hashlib.sha256(x).digest() for x in held], pa.binary()), "raw": pa.array(list(held), pa.binary())})

        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                x = lower_ascii(x)
                got = held.get(x)
                if got is None:
                    held[x] = [i, 1, 1]
                    size += len(x) + 200
                else:
                    add(got, i, 1, 1)
            if size > COMBINE_BYTES:
                yield out()
                held, size = {}, 0
        if held:
            yield out()

    return documents(docs).mapInArrow(combine, "bucket long, key long, keep_id long, rows long, last_rows long, digest binary, raw binary")


def add(entry: list, keep_id: int | None, rows: int, last_rows: int) -> None:
    """Merge a count of copies into an entry [newest id, rows, rows of that id]."""
    entry[1] += rows
    if keep_id == entry[0]:
        entry[2] += last_rows
    elif entry[0] is None or keep_id is not None and keep_id > entry[0]:
        entry[0], entry[2] = keep_id, last_rows


def build_index(docs: DataFrame, path: str | None = None) -> str:
    """Writes directory and bucket files for all texts of `docs`; returns the folder."""
    spark = docs.sparkSession
    path = path or shared_folder(spark, "hash-index")
    counts = histogram(documents(docs))
    owners = int(spark.conf.get("spark.sql.shuffle.partitions"))
    capacity = max(1, -(-sum(counts.values()) // (owners * BUCKETS_PER_OWNER)))
    slots = directory(counts, capacity)
    spark.range(len(slots)).select(F.col("id").alias("prefix"), F.get(F.split(F.lit(",".join(map(str, slots))), ","), F.col("id").cast("int")).cast("long")
                                   .alias("bucket")).coalesce(1).write.parquet(f"{path}/directory")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, chain = None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "bucket": [x[4] for x in chain], "key": [key] * len(chain), "link": list(range(len(chain))), "keep_id": pa.array([x[0] for x in chain], pa.int64()),
                "rows": [x[1] for x in chain], "last_rows": [x[2] for x in chain], "digest": [x[5] for x in chain]}, schema=entry)

        for batch in batches:
            b = batch.to_pydict()
            for bucket, k, i, n, m, digest, raw in zip(*b.values(), strict=True):
                if k != key and chain:
                    yield out()
                    chain = []
                key = k
                for x in chain:
                    if x[3] == raw:
                        add(x, i, n, m)
                        break
                else:
                    chain.append([i, n, m, raw, bucket, digest])
        if chain:
            yield out()

    entry = pa.schema([("bucket", pa.int64()), ("key", pa.int64()), ("link", pa.int64()), ("keep_id", pa.int64()), ("rows", pa.int64()), ("last_rows", pa.int64()), ("digest", pa.binary())])
    dealt = combined(docs, slots).repartition("bucket").sortWithinPartitions("bucket", "key")
    dealt.mapInArrow(merged_batches(own), "bucket long, key long, link long, keep_id long, rows long, last_rows long, digest binary").write.parquet(f"{path}/buckets")
    return path


def merged_batches(fn, rows: int = 10_000):
    """Gathers the small batches that `fn` yields."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in fn(batches):
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return run


def told(docs: DataFrame, index: str, carry: bool) -> DataFrame:
    """Every row with its digest and entry `e`; with `carry` its text too, and the other columns of `docs` in `rest`."""
    entries = docs.sparkSession.read.parquet(f"{index}/buckets").select("digest", F.struct("keep_id", "rows", "last_rows").alias("e"))
    total = entries.agg(F.sum("e.rows")).first()[0] or 0
    hot_from = max(2, -(-total // HOT_SHARE))
    rest = F.struct(F.lit(0).alias("_"), *[F.col(c) for c in docs.columns if c not in ("doc_id", "text")])
    rows = documents(docs, rest.alias("rest")) if carry else documents(docs)
    signed = arrow_pass(rows, with_digest if carry else digest_only, columns_of(rows if carry else rows.select("doc_id")) + ", digest binary")
    hot = F.broadcast(entries.where(F.col("e.rows") >= hot_from).select(  # at most HOT_SHARE rows: each holds a thousandth
        "digest", F.col("e").alias("hot")))
    # Rows that found a hot entry join on a key of their own, which is spread and meets nothing.
    keyed = signed.join(hot, "digest", "left").withColumn("key", F.when(F.col("hot").isNull(), F.col("digest")).otherwise(
        F.concat(F.lit(b"row"), F.unhex(F.hex(F.coalesce(F.col("doc_id"), F.lit(0)))))))
    cold = entries.where(F.col("e.rows") < hot_from).select(F.col("digest").alias("key"), F.col("e").alias("cold"))
    return keyed.join(cold, "key", "left").select(*signed.columns, F.coalesce("hot", "cold").alias("e"))


def decisions(docs: DataFrame, index: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and last_rows (rows that repeat the id that stays) of every row."""
    found = told(docs, index or build_index(docs), False)
    return found.select("doc_id", F.col("e.keep_id").alias("keep_id"), F.col("e.rows").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("e.keep_id")).alias("kept"),
                        F.lower(F.hex("digest")).alias("text_sha256"), F.col("e.last_rows").alias("last_rows"))


def columns_of(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def with_digest(batch: pa.RecordBatch) -> pa.RecordBatch:
    digests = pa.array([hashlib.sha256(lower_ascii(x)).digest() for x in text_bytes(batch.column(1))], pa.binary())
    return pa.RecordBatch.from_arrays([*batch.columns, digests], names=[*batch.schema.names, "digest"])


def digest_only(batch: pa.RecordBatch) -> pa.RecordBatch:
    out = with_digest(batch)
    return pa.RecordBatch.from_arrays([out.column(0), out.columns[-1]], names=["doc_id", "digest"])


def survivors(docs: DataFrame, index: str | None = None) -> DataFrame:
    """Rows of `docs` that stay: of equal texts the row with the largest id, one of them where it is repeated."""
    index = index or build_index(docs)
    kept = told(docs, index, True).where(F.col("doc_id").eqNullSafe(F.col("e.keep_id")))
    if not docs.sparkSession.read.parquet(f"{index}/buckets").where("last_rows > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "digest"])
    return kept.select(*[F.col(c) if c in ("doc_id", "text") else F.col("rest")[c].alias(c) for c in docs.columns])
