"""WARC archives, spelling variants and vector codes against brute-force versions and exact round trips."""

import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import spelling, vector_codes, warc

PAGES = "page_id long, url string, html string, payload string, digest string, first long"


@pytest.fixture(scope="module")
def pages(spark):
    long = "<p>" + "wörd " * 400_000 + "</p>"
    copy = "<html>" + "copy " * 40 + "</html>"
    rows = [(5, "http://a.example/x y?q=é\r\nX: 1", copy), (3, "http://b.example/%20", copy), (9, None, copy), (None, "http://c.example", copy), (3, "http://b.example/again", copy),
            (1, "http://d.example", None), (2, "http://d.example", ""), (4, "u", "short"), (6, "u", "short"), (7, "http://e.example", long), (8, "http://f.example", long),
            (None, None, "z" * 200), (None, "v", "z" * 200), (10, "http://g.example", "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" + "b" * 100), (-4, "n", copy + "!")]
    return rows, spark.createDataFrame([(*r, "clash", "clash", 77) for r in rows], PAGES).repartition(3)


def expected_records(rows):
    least = {}
    for i, _, html in rows:
        if i is not None:
            least[html or ""] = min(i, least.get(html or "", i))
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        first = least.get(html or "")
        again = len(raw) >= 100 and first is not None and i != first
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def told(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=repr)


def test_archives_round_trip(spark, pages, tmp_path):
    rows, df = pages
    streams = warc.write_archives(df, str(tmp_path), archive_bytes=50_000)
    archives = [r.archive for r in streams.collect()]
    assert len(archives) > 3
    for path in archives:  # one gzip stream a file
        unpack = zlib.decompressobj(31)
        unpack.decompress(open(path, "rb").read())
        assert unpack.eof and not unpack.unused_data
    done = warc.normalise(streams, str(tmp_path))
    assert told(warc.read_records(done)) == expected_records(rows)
    bodies = [(r.page_id, r.payload) for r in warc.read_records(done, payload=True).collect()]
    want = {e[:3]: e[3] for e in expected_records(rows)}
    for i, body in bodies:
        if body is not None:
            assert want[(i, len(body), hashlib.sha256(body).hexdigest())] == "response"


def test_sidecar_points_at_single_members(pages, tmp_path):
    _, df = pages
    done = warc.normalise(warc.write_archives(df, str(tmp_path)), str(tmp_path))
    lines = warc.read_index(done).collect()
    assert {x.record_type for x in lines} == {"warcinfo", "response", "revisit"} and len(lines) == done.agg({"records": "sum"}).first()[0]
    for x in lines:
        raw = open(x.archive, "rb").read()[x.offset:x.offset + x.length]
        record = gzip.decompress(raw)
        assert record.startswith(b"WARC/1.1\r\nWARC-Type: " + x.record_type.encode()) and record.endswith(b"\r\n\r\n")
        unpack = zlib.decompressobj(31)
        unpack.decompress(raw)
        assert unpack.eof and not unpack.unused_data


def test_copies_met_by_digest_are_the_same(spark, pages, tmp_path, monkeypatch):
    rows, df = pages
    streams = warc.planned_records(df, told_rows=0)
    got = sorted(((r.page_id, r.payload_bytes, r.digest, "response" if r.refers_to is None else "revisit", r.refers_to) for r in streams.collect()), key=repr)
    assert got == expected_records(rows)
    monkeypatch.setattr(warc, "HOT_SHARE", 1)  # no payload is hot: all meet by digest
    again = warc.planned_records(df, told_rows=0)
    assert sorted(((r.page_id, r.payload_bytes, r.digest, "response" if r.refers_to is None else "revisit", r.refers_to) for r in again.collect()), key=repr) == got


def test_foreign_archives(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\nContent-Length: 4\r\n\r\nabcd"
    digest = hashlib.sha256(b"abcd").hexdigest()
    record = warc.record_bytes([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:page:12>"), ("WARC-Payload-Digest", f"sha256:{digest}")], body)
    other = warc.record_bytes([("WARC-Type", "request"), ("WARC-Record-ID", "<urn:uuid:x y>")], b"GET / HTTP/1.1\r\n\r\n")
    (tmp_path / "members.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(other) + gzip.compress(record) + b"\0" * 8)
    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(record * 50)[:-30])
    (tmp_path / "text.warc.gz").write_bytes(gzip.compress(b"no archive\r\n\r\n"))
    (tmp_path / "none.warc.gz").write_bytes(gzip.compress(b""))

    def archives(*names):
        return spark.createDataFrame([(str(tmp_path / n),) for n in names], "archive string")

    done = warc.normalise(archives("members.warc.gz", "none.warc.gz"), str(tmp_path / "out"))
    assert sorted(r.records for r in done.collect()) == [0, 3]
    assert told(warc.read_records(done)) == [(12, 4, digest, "response", None)] * 2
    for name in ("cut.warc.gz", "text.warc.gz"):
        with pytest.raises(Exception, match="ends early|no WARC record"):
            warc.normalise(archives(name), str(tmp_path / f"bad-{name}"))


def test_no_pages(spark, tmp_path):
    done = warc.normalise(warc.write_archives(spark.createDataFrame([], PAGES), str(tmp_path)), str(tmp_path))
    assert done.count() == 0 and warc.read_records(done).count() == 0 and warc.read_index(done).count() == 0


# Spelling variants

def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    return any(a == b[:i] + b[i + 1:] if len(a) < len(b) else a[:i] + a[i + 1:] == b[:i] + b[i + 1:] for i in range(len(b)))


def brute_variants(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    out, form = {}, {}
    for w in n:
        close = sorted((-n[x], x) for x in n if near(w, x))
        if close and -close[0][0] >= 5 * n[w]:
            form[w] = close[0][1]
        out[w] = len(close)
    result = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        result.add((w, form.get(w), root, n[w], out[w], n[form[w]] if w in form else None))
    return result


def words_table(spark):
    rng = random.Random(11)
    heads = ["kestrel", "aaaaaaaa", "Müllerei", "abababab", "ÿÀÖòrendé", "straßen"]
    rows = []
    for i in range(400):
        text = []
        for _ in range(40):
            w = rng.choice(heads)
            for _ in range(rng.choice((0, 0, 0, 1, 1, 2))):
                at = rng.randrange(len(w) + 1)
                w = rng.choice((w[:at] + rng.choice("abÀz") + w[at:], w[:at] + w[at + 1:], w[:at] + rng.choice("Bbé") + w[at + 1:]))
            text.append(w)
        rows.append((None if i % 50 == 7 else i % 90, rng.choice(" ,\n1×").join(text).replace("×", " × " if i % 3 else "×")))
    long = "q" * 30_000
    rows += [(500, f"{long} {long}x " * 5), (501, f"{long} " * 30), (502, None), (503, ""), (504, "12 --"), (1, rows[1][1]), (1, rows[1][1])]
    return rows, spark.createDataFrame([(*r, "clash", 3) for r in rows], "doc_id long, text string, word string, n int").repartition(4)


@pytest.mark.parametrize("list_rows", [512, 3])
def test_variants_equal_all_pairs(spark, list_rows):
    rows, df = words_table(spark)
    want = brute_variants(rows)
    assert len(want) > 150 and any(r[2] != (r[1] or r[0]) for r in want)
    got = spelling.variants(df, list_rows=list_rows)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in got.collect()} == want


def test_scan_equals_all_pairs():
    rng = random.Random(3)
    for _ in range(300):
        words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(0, 7))) for _ in range(rng.randrange(0, 40))})
        want = {(i, k) for i in range(len(words)) for k in range(i + 1, len(words)) if near(words[i], words[k])}
        got = list(spelling.scan(words))
        assert set(got) == want and len(got) == len(want)


def test_lists_stay_short_however_many_words_agree(spark):
    rows = [("common" + a + b + c + "ending", 9) for a in "abcdefghij" for b in "abcdefghij" for c in "abcdefghij"]
    words = spark.createDataFrame(rows, "word string, n long")
    parts = spelling.lists(words, list_rows=50)
    assert max(p.groupBy("list").count().agg({"count": "max"}).first()[0] or 0 for p in parts) <= 50
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    got = spelling.near_counts(union).groupBy("word").sum("n_near").collect()
    assert len(got) == 1000 and {r[1] for r in got} == {27}


def test_no_words(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, "few short words")], "doc_id long, text string")).count() == 0


# Vector codes

def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = sorted(((math.inf if i is None else i, v, i, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: r[:2])
    width = next((len(r[1]) for r in kept if r[1] and len(r[1]) % parts == 0), 0)
    d = width // parts

    def cutting(v):
        ints = [math.floor(256 * x) for x in v]
        return [tuple(ints[p * d:(p + 1) * d]) for p in range(parts)]

    mine = [cutting(r[1]) for r in kept if len(r[1]) == width and width]
    books = [[m[p] for m in mine[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        members = [defaultdict(list) for _ in range(parts)]
        for m in mine:
            for p in range(parts):
                members[p][nearest(p, m[p])[1]].append(m[p])
        books = [[tuple(sum(c) // len(got) for c in zip(*got, strict=True)) if (got := members[p].get(e)) else old for e, old in enumerate(books[p])] for p in range(parts)]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out, sums = [], defaultdict(lambda: None)
    for _, v, i, label in kept:
        code = error = None
        if width and len(v) == width:
            found = [nearest(p, x) for p, x in enumerate(cutting(v))]
            code, error = "".join(f"{e:02x}" for _, e in found), sum(f[0] for f in found)
            sums[label] = (sums[label] or 0) + error
        out.append((i, code, error, label))
    return sorted(((i, c, e, sums[label], sha) for i, c, e, label in out), key=repr)


def vectors(n, scale=1.0, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (7, 32))
    rows = [(int(i), [float(np.float32(x)) for x in (centres[i % 7] + rng.normal(0, 0.1, 32)) * scale], None if i % 11 == 0 else int(i % 3)) for i in rng.permutation(n)]
    return rows


ODD = [(None, [0.5] * 32, 1), (900, None, 1), (901, [0.1] * 31 + [None], 2), (902, [0.1] * 31 + [math.inf], 2), (903, [math.nan] * 32, 2),
       (904, [0.25] * 16, 2), (905, [], None), (906, [0.1] * 33, 8), (7, [0.0] * 32, 1), (7, [0.0] * 32, 1), (907, [-0.001] * 32, None)]
VECTOR = "vec_id long, embedding array<float>, label int, code string, part long"


def codes(df, **more):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.compressed(df, **more).collect()), key=repr)


@pytest.mark.parametrize("rows", [vectors(300) + ODD, vectors(40), vectors(90) * 2, vectors(100, 3000.0), vectors(100, 3e5), [(1, [0.5] * 16, 4)] * 70])
def test_codes_equal_full_search(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], VECTOR).repartition(3)
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    assert codes(df) == brute_codes(single)


def test_label_sums_by_salt_are_the_same(spark):
    df = vector_codes.assigned(rows := vector_codes.kept(spark.createDataFrame([(*r, "c", 1) for r in vectors(80) + ODD], VECTOR)), vector_codes.trained(rows, vector_codes.Plan()))
    told_ = sorted(map(repr, vector_codes.with_label_error(df).collect()))
    assert told_ == sorted(map(repr, vector_codes.with_label_error(df, told_rows=0).collect()))


def test_orchard_is_exact_on_ties_and_copies():
    rng = np.random.default_rng(1)
    for count in (1, 2, 9, 64):
        book = vector_codes.Book(rng.integers(-3, 4, (count, 2)))
        points = rng.integers(-4, 5, (500, 2))
        d = ((points[:, None, :] - book.entries[None]) ** 2).sum(2)
        code, dist = vector_codes.orchard(points, book)
        assert (code == d.argmin(1)).all() and (dist == d.min(1)).all()


def test_no_vectors_and_too_large_ones(spark):
    assert codes(spark.createDataFrame([], VECTOR)) == []
    assert codes(spark.createDataFrame([(1, [0.5], 1, "c", 1)], VECTOR)) == brute_codes([(1, [0.5], 1)])
    with pytest.raises(Exception, match="do not fit|fits a long"):
        codes(spark.createDataFrame([(1, [1e30] * 16, 1, "c", 1)], VECTOR))
