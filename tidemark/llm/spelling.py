"""Spelling variants: words one edit apart, found by dynamic programming down sorted word lists.

Words are the runs of letters of all texts; each task counts those it meets and the counts are summed. Two words that differ by
one inserted, deleted or replaced code point agree before and after the place of the edit. So every word of length l is dealt,
once for pairs whose longer word has l code points and once for l + 1, to a list per window of places: the words that agree
on all before and all after the window. Windows start as the two halves. A list of more than `LIST_ROWS` words, or of too many
code points, is dealt again by the halves of its window, down to a window of one place, where a list holds no more words than
there are letters. The split needs the logarithm of a word's length in rounds, and no list grows with the table.

A list is sorted and scanned once for each of its words: the three cells of the edit matrix next to its diagonal are
kept per prefix length, the next word takes up the rows of the prefix it shares with the one before (their LCP), and once
all three cells exceed one edit every following word that shares that prefix is jumped over. Each pair is told
by one list: that of its longer length and of the window that holds its first differing place.

Null texts have no words; a null id is written as an empty string in the hash. Repeated rows count again. Words of any length
are taken whole. Columns other than doc_id and text are left out. No texts give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby, product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, documents, lower_ascii, small_batches, text_bytes

#: Shortest word in code points, fewest occurrences of a word, how much more frequent its form must be.
SHORTEST, RAREST, RATIO = 6, 5, 5
#: Of this many (document, run) pairs about one has a letter taken out.
TYPO_ONE_IN = 199
#: Words and code points of a list that is scanned as it is.
LIST_ROWS, LIST_CHARS = 512, 4_000_000
#: Different words a task counts before it hands them on.
HELD_WORDS = 200_000
#: Rows of one list meet the note that it is too long under so many salts.
SALTS = 16

RUN = re.compile(rf"[A-Za-zÀ-ÿ]{{{SHORTEST},}}")
#: Cells of the matrix are 0, 1 or 2 (two and more); a row is three of them: before, on and behind the diagonal.
DEAD = 2


def next_rows() -> list[list[int]]:
    """Row (as base-3 number) and which of three query letters equal the next letter (as bits) to the next row."""
    out = []
    for before, on, behind in product(range(3), repeat=3):
        row = []
        for bits in range(8):
            a = min(before + (not bits & 1), on + 1, DEAD)
            b = min(on + (not bits & 2), behind + 1, a + 1, DEAD)
            c = min(behind + (not bits & 4), b + 1, DEAD)
            row.append(9 * a + 3 * b + c)
        out.append(row)
    return out


STEPS = next_rows()
ALL_DEAD = 26
FIRST_ROW, OWN_ROW = 9 * 2 + 1, 9 * 1 + 1  # rows of a word against the empty prefix and against its own prefix
CELL = [(x // 9, x // 3 % 3, x % 3) for x in range(27)]


def counted_words(docs: DataFrame) -> DataFrame:
    """(word, n) of the distinct words that are long and frequent enough."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                start = zlib.crc32(f"{'' if i is None else i}:".encode())
                for word, n in Counter(RUN.findall(lower_ascii(raw).decode())).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % TYPO_ONE_IN == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < SHORTEST:
                            continue
                    held[word] += n
                if len(held) > HELD_WORDS:
                    yield pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())})
                    held.clear()
        if held:
            yield pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())})

    parts = documents(docs).mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= RAREST)


def list_key() -> Column:
    """The list of a row: longer length, window, and all code points before and after the window."""
    tail = F.col("longer") - F.col("hi")
    return F.xxhash64("longer", "lo", "hi", F.expr("left(word, lo)"), F.when(tail > 0, F.expr("right(word, longer - hi)")).otherwise(F.lit("")))


def halves() -> Column:
    """The two halves of the window of a row."""
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    return F.explode(F.array(F.struct("lo", middle.alias("hi")), F.struct(middle.alias("lo"), "hi")))


def halved(rows: DataFrame) -> DataFrame:
    return rows.select("word", "n", "longer", halves().alias("w")).select("word", "n", "longer", "w.lo", "w.hi").withColumn("list", list_key())


def lists(words: DataFrame, list_rows: int = LIST_ROWS, list_chars: int = LIST_CHARS) -> list[DataFrame]:
    """Rows (word, n, longer, lo, hi, list) of the lists to scan; a union of them holds every list once."""
    size = F.char_length("word")
    rows = cut(halved(words.select("word", "n", F.explode(F.array(size, size + 1)).alias("longer")).select(
        "word", "n", "longer", F.lit(0).alias("lo"), F.col("longer").alias("hi"))))
    done = []
    while True:
        sizes = rows.groupBy("list").agg(F.count(F.lit(1)).alias("k"), F.sum("longer").alias("chars"), F.max(F.col("hi") - F.col("lo")).alias("width"))
        long = cut(sizes.where(((F.col("k") > list_rows) | (F.col("chars") > list_chars)) & (F.col("width") > 1)).select(
            "list", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
        if long.isEmpty():
            return [*done, rows]
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int"))
        done.append(salted.join(long, ["list", "salt"], "left_anti").drop("salt"))
        rows = cut(halved(salted.join(long, ["list", "salt"], "left_semi")))


def scan(words: list[str]) -> Iterator[tuple[int, int]]:
    """Places (i, k), i < k, of the sorted different `words` that are one edit apart."""
    count = len(words)
    lcp = [0] * count
    for k in range(1, count):
        a, b, d = words[k - 1], words[k], 0
        for x, y in zip(a, b, strict=False):
            if x != y:
                break
            d += 1
        lcp[k] = d
    # The next place that shares less with its predecessor: the end of a range with a common prefix.
    past, stack = [count] * count, []
    for k in range(count - 1, -1, -1):
        while stack and lcp[stack[-1]] >= lcp[k]:
            stack.pop()
        past[k] = stack[-1] if stack else count
        stack.append(k)
    rows = [FIRST_ROW] + [OWN_ROW] * (max(map(len, words), default=0) + 1)
    for i, q in enumerate(words):
        have = len(q)
        padded = f"\0{q}\0\0\0"  # place j of the query stands at j + 1
        k = i + 1
        if k == count:
            continue
        for d in range(1, min(lcp[k], len(rows) - 1) + 1):
            rows[d] = OWN_ROW
        while k < count:
            v = words[k]
            size = len(v)
            d = lcp[k]
            row = rows[d]
            while d < size and row != ALL_DEAD and d <= have:
                c = v[d]
                row = STEPS[row][(c == padded[d]) + 2 * (c == padded[d + 1]) + 4 * (c == padded[d + 2])]
                d += 1
                rows[d] = row
            if row != ALL_DEAD and d == size:
                if -1 <= have - size <= 1 and CELL[row][have - size + 1] == 1:
                    yield i, k
                k += 1
            else:
                # Every word that shares these d code points is farther than one edit.
                k += 1
                while k < count and lcp[k] >= d:
                    k = past[k]


def near_counts(rows: DataFrame) -> DataFrame:
    """Per word and list: number of near words and the most frequent of them, of equal ones the first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {"word": [], "n_near": [], "form_n": [], "form": []}

        def told(group: list[tuple]) -> None:
            _, longer, lo, hi, _, _ = group[0]
            tail = longer - hi
            members = sorted({(w[lo:len(w) - tail], w, n) for *_, w, n in group})
            found: dict[int, list] = {}
            for i, k in scan([m[0] for m in members]):
                a, b = members[i], members[k]
                if max(len(a[1]), len(b[1])) != longer or not proper(a[1], b[1], lo, hi, tail):
                    continue
                for x, y in ((i, b), (k, a)):
                    best = found.setdefault(x, [0, (0, "")])
                    best[0] += 1
                    best[1] = min(best[1], (-y[2], y[1]))
            for x, (k, (n, form)) in found.items():
                for name, v in zip(out, (members[x][1], k, -n, form), strict=True):
                    out[name].append(v)

        group: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and row[:4] != group[0][:4]:
                    told(group)
                    group = []
                    if len(out["word"]) > 10_000:
                        yield pa.RecordBatch.from_pydict(out)
                        for v in out.values():
                            v.clear()
                group.append(row)
        if group:
            told(group)
        if out["word"]:
            yield pa.RecordBatch.from_pydict(out)

    sorted_rows = rows.select("list", "longer", "lo", "hi", "word", "n").repartition("list").sortWithinPartitions("list", "longer", "lo", "hi")
    return sorted_rows.mapInArrow(run, "word string, n_near long, form_n long, form string")


def proper(a: str, b: str, lo: int, hi: int, tail: int) -> bool:
    """Whether this window tells the pair: its first differing place lies in it, all outside agrees."""
    if a[:lo] != b[:lo] or (tail and a[-tail:] != b[-tail:]):
        return False  # two lists whose keys collide
    at = lo
    for x, y in zip(a[lo:], b[lo:], strict=False):
        if x != y:
            break
        at += 1
    return at < hi


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last. A form is at least five times as frequent, so paths are short and end."""
    up = forms.select(F.col("word").alias("root"), F.col("form").alias("_next"))
    cur, done = forms.select("word", F.col("form").alias("root")), None
    while True:
        step = cut(cur.join(up, "root", "left"))
        ended = step.where("_next is null").select("word", "root")
        done = ended if done is None else done.unionByName(ended)
        cur = step.where("_next is not null").select("word", F.col("_next").alias("root"))
        if cur.isEmpty():
            return done


def variants(docs: DataFrame, list_rows: int = LIST_ROWS, list_chars: int = LIST_CHARS) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word."""
    words = cut(counted_words(docs))
    parts = lists(words, list_rows, list_chars)
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    best = near_counts(rows).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("k"), "form")).alias("b"))
    told = cut(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(
        -F.col("b.k") >= RATIO * F.col("n"), F.struct(F.col("b.form").alias("form"), (-F.col("b.k")).alias("n"))).alias("f")))
    forms = told.where("f is not null").select("word", F.col("f.form").alias("form"))
    return told.join(roots(forms), "word", "left").select(
        "word", F.col("f.form").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", F.col("f.n").alias("form_n"))
