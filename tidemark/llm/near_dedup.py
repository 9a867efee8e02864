"""Near duplicates by MinHash bands and odd sketches, confirmed on whole shingle sets.

1. A task lower-cases a text, takes its distinct word shingles as 64-bit hashes, and gives the set's digest, its MinHash
   samples folded into band keys, and an odd sketch: a bitmap whose bits are flipped by each (place, sample) pair. The
   population count of the XOR of two sketches estimates how many samples differ, most precisely where few do.
2. Equal sets are one class. Classes that share a band key meet in that band's bucket. A bucket is dealt into blocks of
   BLOCK classes, and blocks are compared two by two, in the first band that a pair shares. Pairs whose sketches rule the
   similarity out are passed over. Only the classes that have a pair left go on; pairs are never written.
3. The texts of these classes join their blocks, and every pair of a block is decided on the whole sets, by one matrix
   product. A block gives the links of a spanning forest, so its rows stay below its classes while no connection is lost.
4. Connected components over the links, by the smallest document id.

The number of bands is the least that misses a pair at the threshold with a probability of at most 1e-6. A sketch passes
over a pair at the threshold only when its estimate is more than five standard deviations off.

Nulls and texts without words have empty sets, linked with nothing. With fewer words than a shingle takes, the whole
sequence is the one shingle. Rows that repeat an id stay rows; equal texts are one class. Null ids count as larger than
any other. A component without any id has a null component_id. Long texts are shingled whole.

A class and a component are stood for by a spot, the digest of a row's id and text, of their smallest id; texts and
survivors are fetched by it, never by the id alone, and one row of equal spots is taken.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kit.graph import components
from .common import LOWER_SPACED, arrow_pass, cut, documents, mix64, set_apart, text_bytes

ROWS = 5
SKETCH_BITS = 512
#: Classes of a bucket that are compared in one task-side matrix.
BLOCK = 256
MISS = 1e-6
#: An odd multiplier for the polynomial hash, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


@dataclass(frozen=True)
class Plan:
    """Words per shingle, the similarity num/den at which documents are linked, and what follows from them."""

    words: int = 5
    num: int = 80
    den: int = 100

    @property
    def bands(self) -> int:
        return math.ceil(math.log(MISS) / math.log(1 - (self.num / self.den) ** ROWS))

    @property
    def most_bits(self) -> int:
        """Differing sketch bits beyond which a pair is passed over."""
        k, j = self.bands * ROWS, self.num / self.den
        low = max(0.0, j - 5 * math.sqrt(j * (1 - j) / k))
        odd = SKETCH_BITS * (1 - math.exp(-4 * k * (1 - low) / SKETCH_BITS)) / 2
        return math.ceil(odd + 3 * math.sqrt(odd / 2))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        size = 1 << max(16, n.bit_length())
        for k, b in enumerate((BASE, INVERSE)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def shingles(raw: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    text = b" ".join(raw.translate(LOWER_SPACED).split())
    if not text:
        return np.zeros(0, np.uint64)
    b = np.frombuffer(text, np.uint8)
    up, down = powers(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:len(b)], out=sums[1:])
    gaps = np.flatnonzero(b == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(b)]])
    k = min(words, len(starts))
    starts, ends = starts[:len(starts) - k + 1], ends[k - 1:]
    return np.unique(mix64((sums[ends] - sums[starts]) * down[starts]))


def sample_keys(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 32, n, dtype=np.uint32), rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def samples(hashes: np.ndarray, keys: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """MinHash samples: per function the smallest scrambled shingle."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(keys[0]), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 4096):
        x = low[at:at + 4096]
        for i, (a, m) in enumerate(zip(*keys, strict=True)):
            least = ((x ^ a) * m).min()
            if least < out[i]:
                out[i] = least
    return out


def odd_sketch(sample: np.ndarray) -> np.ndarray:
    """Bitmap (bytes) in which every (place, sample) pair flips one bit."""
    place = np.arange(len(sample), dtype=np.uint64) << np.uint64(32)
    bit = (mix64(place | sample.astype(np.uint64)) % np.uint64(SKETCH_BITS)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=SKETCH_BITS) & 1).astype(np.uint8))


def band_keys(sample: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, the band's number included."""
    m = sample.reshape(-1, ROWS).astype(np.uint64)
    h = np.arange(1, len(m) + 1, dtype=np.uint64)
    for k in range(ROWS):
        h = mix64(h * np.uint64(BASE) + m[:, k])
    return h.view(np.int64)


def class_of(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def spot() -> Column:
    """Digest of a row's id and text."""
    text = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    return F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), text).cast("binary")))


def signatures(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, spot, n_shingles, class (digest of the set), band keys and sketch; the last three null for empty sets."""
    keys = sample_keys(plan.bands * ROWS)
    words = plan.words

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, classes, bands, sketches = [], [], [], []
        for raw in text_bytes(batch.column(1)):
            s = shingles(raw, words)
            n.append(len(s))
            if len(s):
                m = samples(s, keys)
                classes.append(class_of(s))
                bands.append(band_keys(m))
                sketches.append(odd_sketch(m).tobytes())
            else:
                classes.append(None)
                bands.append(None)
                sketches.append(None)
        return pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "spot": batch.column(2), "n_shingles": pa.array(n, pa.int64()), "class": pa.array(classes, pa.binary()),
                                           "bands": pa.array(bands, pa.list_(pa.int64())), "sketch": pa.array(sketches, pa.binary())})

    return arrow_pass(documents(docs, spot().alias("spot")), sign, "doc_id long, spot binary, n_shingles long, class binary, bands array<long>, sketch binary")


def blocked(members: DataFrame) -> DataFrame:
    """(bucket, p, q, class, left, right): the pairs of blocks that a class takes part in; left: of block p, right: of q."""
    keyed = members.select("class", F.explode("bands").alias("bucket"))
    sizes = cut(keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    held = keyed.join(sizes, "bucket").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn(
        "mine", F.pmod(F.xxhash64("class", F.lit(1)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return held.select("bucket", "class", "mine", other.alias("other")).select(
        "bucket", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "class",
        (F.col("mine") <= F.col("other")).alias("left"), (F.col("mine") >= F.col("other")).alias("right"))


def gathered(rows: DataFrame, *columns: str) -> DataFrame:
    """One row per pair of blocks with its members: at most about twice BLOCK of them."""
    return rows.groupBy("bucket", "p", "q").agg(F.collect_list(F.struct("class", "left", "right", *columns)).alias("members"))


def live_members(blocks: DataFrame, plan: Plan) -> DataFrame:
    """(bucket, p, q, class, left, right) of the members that have a pair their sketches do not rule out."""
    most = plan.most_bits

    def look(batch: pa.RecordBatch) -> pa.RecordBatch:
        members = batch.column(3)
        flat, size = members.flatten(), np.diff(members.offsets.to_numpy())
        left, right = (flat.field(f).to_numpy(zero_copy_only=False).astype(bool) for f in ("left", "right"))
        sketch = np.frombuffer(b"".join(flat.field("sketch").to_pylist()), np.uint64).reshape(-1, SKETCH_BITS // 64)
        bands = flat.field("bands").flatten().to_numpy().reshape(len(flat), -1)
        live = np.zeros(len(flat), bool)
        start = np.concatenate([[0], np.cumsum(size)])
        bucket, p, q = (batch.column(k).to_numpy() for k in range(3))
        small: list[np.ndarray] = []
        pairs = 0

        def settle(a: np.ndarray, b: np.ndarray, of: np.ndarray) -> None:
            for at in range(0, len(a), 1 << 16):
                x, y, key = a[at:at + (1 << 16)], b[at:at + (1 << 16)], of[at:at + (1 << 16)]
                same = bands[x] == bands[y]
                mine = bands[x, same.argmax(1)] == key
                x, y = x[mine], y[mine]
                near = np.bitwise_count(sketch[x] ^ sketch[y]).sum(1, dtype=np.int64) <= most
                live[x[near]] = True
                live[y[near]] = True

        for k in range(len(size)):
            mine = np.arange(start[k], start[k + 1])
            if p[k] == q[k]:
                i, j = np.triu_indices(len(mine), 1)
                small.append(np.stack([mine[i], mine[j], np.full(len(i), k)]))
            else:
                i, j = np.meshgrid(mine[left[mine]], mine[right[mine]], indexing="ij")
                small.append(np.stack([i.ravel(), j.ravel(), np.full(i.size, k)]))
            pairs += small[-1].shape[1]
            if pairs > 1 << 16:
                a, b, of = np.concatenate(small, 1)
                settle(a, b, bucket[of])
                small.clear()
                pairs = 0
        if small:
            a, b, of = np.concatenate(small, 1)
            settle(a, b, bucket[of])
        at = np.flatnonzero(live)
        row = np.repeat(np.arange(len(size)), size)[at]
        return pa.RecordBatch.from_pydict({"bucket": bucket[row], "p": p[row], "q": q[row], "class": flat.field("class").take(pa.array(at)),
                                           "left": left[at], "right": right[at]})

    return arrow_pass(blocks, look, "bucket long, p int, q int, class binary, left boolean, right boolean")


def confirmed(blocks: DataFrame, plan: Plan) -> DataFrame:
    """(u, v): a spanning forest of the confirmed links of every pair of blocks."""
    words, num, den = plan.words, plan.num, plan.den

    def decide(batch: pa.RecordBatch) -> pa.RecordBatch:
        us, vs = [], []
        for members in batch.column(3):
            sets = {}
            for m in members.as_py():
                s = shingles((m["text"] or "").encode(), words)
                if class_of(s) == m["class"]:
                    sets[m["class"]] = s
            names = sorted(sets)
            u, v = forest(names, [sets[c] for c in names], num, den)
            us += u
            vs += v
        return pa.RecordBatch.from_pydict({"u": pa.array(us, pa.binary()), "v": pa.array(vs, pa.binary())})

    return arrow_pass(blocks, decide, "u binary, v binary")


def forest(names: list[bytes], sets: list[np.ndarray], num: int, den: int) -> tuple[list[bytes], list[bytes]]:
    """Links that connect what den x intersection >= num x union connects, each from the first name of its component: blocks
    of different bands then tend to give the same links."""
    n = len(sets)
    linked = similar(sets, num, den)
    us, vs, seen = [], [], np.zeros(n, bool)
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = True
        front = linked[root] & ~seen
        while front.any():
            seen |= front
            at = np.flatnonzero(front)
            us += [names[root]] * len(at)
            vs += [names[i] for i in at]
            front = linked[front].any(0) & ~seen
    return us, vs


def similar(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Whether each pair of sets reaches the similarity, from all intersections at once."""
    n, size = len(sets), np.array([len(s) for s in sets], np.int64)
    every, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    both = np.zeros((n, n), np.float32)
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    step = max(1, (1 << 22) // n)
    for at in range(0, len(every), step):
        a, b = np.searchsorted(place, [at, at + step])
        part = np.zeros((n, min(step, len(every) - at)), np.float32)
        part[owner[a:b], place[a:b] - at] = 1
        both += part @ part.T
    inter = np.rint(both).astype(np.int64)
    return den * inter >= num * (size[:, None] + size[None, :] - inter)


def links(docs: DataFrame, members: DataFrame, plan: Plan) -> DataFrame:
    """(u, v): links between classes that connect all similar ones."""
    placed = blocked(members.select("class", "bands")).join(members.select("class", "bands", "sketch"), "class")
    live = cut(live_members(gathered(placed, "bands", "sketch"), plan))
    # A class takes one text, from the row of its spot; rows that repeat id and text are folded before they are collected.
    wanted = live.select("class").distinct().join(members.select("class", "head.spot"), "class")
    rows = documents(docs, spot().alias("spot"))
    texts = rows.join(wanted, "spot").groupBy("class").agg(F.first("text").alias("text"))
    return cut(confirmed(gathered(live.join(texts, "class"), "text"), plan).distinct())


def classes(docs: DataFrame, signed: DataFrame, plan: Plan) -> DataFrame:
    """(class, component_id, spot): every class with the id and spot that stand for its component."""
    filled = signed.where(F.col("class").isNotNull())
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "spot")).alias("head")
    members = cut(filled.groupBy("class").agg(head, F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    found = links(docs, members, plan)
    labels = components(found.select(F.col("u").alias("node")).limit(0), found, src="u", dst="v").select(F.col("node").alias("class"), "component")
    named = members.select("class", "head").join(labels, "class", "left").select("class", "head", F.coalesce("component", "class").alias("component"))
    least = named.groupBy("component").agg(F.min("head").alias("best"))
    return cut(named.join(least, "component").select("class", F.col("best.doc_id").alias("component_id"), F.col("best.spot").alias("spot")))


def near_duplicates(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:  # noqa: B008
    """doc_id, n_shingles, component_id and kept (the row's id is the component's, null ids included) of every row."""
    signed = cut(signatures(docs, plan))
    of_class = classes(docs, signed, plan).drop("spot")
    told = signed.where(F.col("class").isNotNull()).select("doc_id", "n_shingles", "class").join(of_class, "class").select(
        "doc_id", "n_shingles", "component_id")
    alone = signed.where(F.col("class").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return told.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def survivors(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:  # noqa: B008
    """One row of `docs` for each component, that of its spot, and every row without words."""
    signed = cut(signatures(docs, plan))
    chosen = classes(docs, signed, plan).select(F.col("spot").alias("_spot")).distinct()
    held, own = set_apart(docs, _spot=spot())
    standing = held.join(chosen, "_spot", "left_semi").dropDuplicates(["_spot"]).select(*own)
    return standing.union(docs.where(~F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")))
