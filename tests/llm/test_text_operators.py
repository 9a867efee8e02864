"""Text operators against brute-force versions, on a table with nulls, empty and long texts, ties and clashing columns."""

import base64
import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest

from tidemark.llm import bpe, exact_dedup, html_text, language, licenses, mixing, near_dedup, quality, sharding, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, slot string, digest string"
WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "Tö", "su") for b in ("ran", "bel", "dit") for c in ("", "o", "ens", "!")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    base = [prose(rng, n) for n in (60, 80, 120, 300, 64, 70)]
    out = [(i, t, "en" if i % 2 else "de", f"src{i % 3}") for i, t in enumerate(base)]
    out += [(10, base[0].upper(), "en", "src0"), (11, base[0], None, None), (12, base[3] + " extra", "en", "src0"), (13, base[3].replace("ran", "ren", 1), "en", "src9")]
    out += [(20, None, None, "src0"), (21, "", "en", None), (22, " \t\n ", "en", "src1"), (None, "one two", "en", "src1"), (23, "one two", "en", "src1"),
            (24, prose(rng, 9000), "en", "src0"), (25, "It's  naïve — 日本語 'll\r\n\x0b x y ①  ", "fr", "src2"), (26, "word " * 200, "en", "src2")]
    out += [(1, base[1], "en", "src1"), (30, "Licensed under the Apache License, Version 2.0.\nAll rights reserved. CC BY cc-by x", "en", "src0")]
    return [(*r, len(r[1] or ""), "clash", "clash", "clash") for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def folded(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def measured(t):
    t = t or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = list(zip(ws, ws[1:], ws[2:], strict=False))
    rep = {k + d for k, g in enumerate(tri) if tri.count(g) > 1 for d in range(3)} if len(ws) < 2000 else None
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), None if rep is None else len(rep)


def test_quality_measures_and_order(docs, rows, nothing):
    got = quality.measured_verdicts(docs).collect()
    assert len(got) == len(rows)
    want = sorted((r[0] is None, r[0] or 0, *measured(r[1])[:4]) for r in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) for r in got) == want
    rep = {r[0]: measured(r[1])[4] for r in rows}
    assert all(rep[r.doc_id] is None or rep[r.doc_id] == r.n_repeat_words for r in got)
    kept = {(r.doc_id, r.kept) for r in got}
    # Any order of the rules gives the same verdicts.
    for order in (quality.RULES, quality.RULES[::-1]):
        lazy = quality.cascade(docs, order, quality.from_text(docs["text"])).collect()
        assert {(r.doc_id, r.kept) for r in lazy} == kept
    assert quality.verdicts(nothing).count() == 0 and quality.measured_verdicts(nothing).count() == 0


def test_quality_order_prefers_cheap_rejections(spark):
    df = spark.createDataFrame([(i, "a b c") for i in range(50)] + [(99, prose(random.Random(1), 80))], "doc_id long, text string")
    assert quality.cascade_order(df)[0].name == "few_words"


def test_quality_plan_is_native(docs):
    plan = quality.measured_verdicts(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_license_scan(docs, rows, nothing):
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    x = got[30]
    assert (x.n_base, x.base_labels, x.labels, x.score) == (3, "cc-by,reserved", "apache-2.0,cc-by,reserved", 1.0)
    assert got[20].n_words == 0 and got[20].first_word is None and got[20].labels == ""
    for r in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded(r[1]))
        places = [i for p in licenses.BASE for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
        g = got[r[0]]
        assert (g.n_words, g.n_base, g.first_word, g.last_word) == (len(words), len(places), min(places, default=None), max(places, default=None))
    assert licenses.scan(nothing).count() == 0


def test_license_templates():
    a = licenses.compiled({"t": "grant of <<beginOptional>>the free <<beginOptional>>full<<endOptional>> <<endOptional>>use <<var;max=2>> to all"})
    label = lambda s: [m for m in a.matches(licenses.tokens(s.encode())) if m[2] == "t"]
    assert label("grant of use to all") == [(0, 5, "t")]
    assert label("x grant of the free use of it to all") == [(1, 9, "t")] and label("Grant of the free full use to all")
    assert not label("grant of the use to all") and not label("grant of use of it now to all") and not label("grant use to all")
    with pytest.raises(ValueError):
        licenses.compiled({"bad": "<<var;max=2>> opens"})


MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
       "“Software”), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
       "distribute, sublicense, and/or sell copies of the Software")
BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
       "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
       " * Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
       "documentation and/or other materials provided with the distribution.\n")
NAMES = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
         "software without specific prior written permission.\n")
FSF = ("you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the "
       "License, or (at your option) any later version.")
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"


@pytest.mark.parametrize(("text", "labels"), [
    (MIT, "mit"), (MIT.replace("“Software”", "Program").replace("software", "program"), "mit"), (MIT.replace("merge, ", ""), ""),
    (BSD + "THIS SOFTWARE IS PROVIDED BY THE AUTHORS", "bsd-2-clause"), (BSD + NAMES + "THIS SOFTWARE IS PROVIDED BY", "bsd-3-clause"),
    (BSD + "3. The name of the author may not be used" + NAMES.partition("be used")[2], "bsd-3-clause"), (BSD.replace("retain", "keep") + "THIS SOFTWARE IS PROVIDED BY", ""),
    (FSF.format("General Public License", 2), "gpl,gpl-2.0"), (FSF.format("General Public License", 3), "gpl,gpl-3.0"),
    (FSF.format("Lesser General Public License", "2.1"), "gpl,lgpl-2.1"), (FSF.format("Lesser General Public License", 3), "gpl,lgpl-3.0"),
    (FSF.format("Affero General Public License", 3), "agpl-3.0,gpl"), (FSF.format("General Public License", 7), "gpl"),
    ("licensed under the GNU Lesser General Public License version 3", "gpl,lgpl-3.0"), ("licensed under the GNU Affero General Public License version 3", "agpl-3.0,gpl"),
    ("Licensed under the GNU GPL General Public License, version 3", "gpl,gpl-3.0"), ("Licensed under the GNU General Public License v2.0", "gpl,gpl-2.0"),
    ("Licensed under GPLv3", "gpl-3.0"), ("GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991", "gpl,gpl-2.0"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2.0"), ("Licensed under the Mozilla Public License 1.1", "mpl-1.1"),
    ("Creative Commons Attribution-NonCommercial 4.0 International", "cc-by-nc"), ("a Creative Commons Attribution-NonCommercial-ShareAlike License", "cc-by-nc-sa"),
    ("Creative Commons Attribution 4.0", "cc-by"), ("creative commons attribution non-commercial no derivatives", "cc-by-nc-nd"), ("a creative and common attribution", ""),
    ("Licensed under CC BY-NC 4.0", "cc-by,cc-by-nc"), ("Licensed under CC BY-NC-SA 4.0", "cc-by,cc-by-nc-sa"),
    ("licenses this file to you under the Apache License, Version 2.0", "apache-2.0"), ("a copy of the License at http://www.apache.org/", ""),
    ("You may obtain a copy of the License at\n\n https://www.apache.org/licenses/LICENSE-2.0", "apache-2.0"),
    (ISC + ", provided that the above copyright notice and this permission notice appear in all copies.", "isc"), (ISC + ".\n\nTHE SOFTWARE IS PROVIDED", "0bsd"),
    ("Distributed under the Boost Software License, Version 1.0.", "bsl-1.0"), ("This is free and unencumbered software released into the public domain.", "unlicense"),
])
def test_licenses_in_their_own_words(text, labels):
    a = licenses.compiled()
    found = licenses.longest(a.matches(licenses.tokens(f"Some words. {text} and more".encode())))
    assert ",".join(sorted({label.removeprefix("base:") for _, _, label in found})) == labels


def tiktoken_ids():
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(spark, docs, rows, nothing):
    from pyspark.sql import functions as F

    coder, model = tiktoken_ids(), bpe.Bpe(spark)
    encoded = bpe.encode(docs, model)
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(encoded).collect())
    want = []
    for r in rows:
        ids = coder.encode_ordinary(r[1] or "")
        want.append((r[0] or -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert got == sorted(want)
    # The general interface: ids as an array, and back to the text.
    back = bpe.decode(encoded.select("text", bpe.ids_of(F.col("pieces")).alias("ids")), model).collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") and list(r.ids) == coder.encode_ordinary(r.text or "") for r in back)
    assert bpe.digests(bpe.encode(nothing, model)).count() == 0


def test_token_counts(docs, rows, nothing):
    import sentencepiece

    coder = sentencepiece.SentencePieceProcessor(model_file=token_counts.MODEL)
    want = sorted((r[0] or -1, len((r[1] or "").encode()), len(coder.encode(r[1] or "")), len(coder.encode(r[1] or "")) > 4096) for r in rows)
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs).collect()) == want
    lengths = token_counts.Lengths({}, token_counts.MODEL)
    for x in ["a  b\n c\t ﬁ①  ", " a", "", " ", "<s> x</s><unk>", "▁a ▁", "a ", "  ", "   a    b ", "a▁▁b", "\n\n  \n"]:
        assert sum(lengths[k] for k in token_counts.pre_tokens(x)) == len(coder.encode(x)), x
    assert token_counts.token_counts(nothing).count() == 0


def test_token_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE", 3)
    lengths = token_counts.Lengths({" a": 1}, token_counts.MODEL)
    assert [lengths[f" w{k}"] for k in range(20)] and len(lengths) <= 6 and lengths[" "] == 1


def test_language_held_out_accuracy(spark, nothing):
    rng, tables = random.Random(3), {"aa": ["lok", "mir", "tan"], "bb": ["ües", "grö", "tän"], "cc": ["qui", "oux", "eau"]}
    data = [(i, " ".join("".join(rng.choices(tables[k], k=3)) for _ in range(40)), k) for i, k in zip(range(400), itertools.cycle(tables), strict=False)]
    data += [(900, None, "aa"), (901, "12 -- 34", "bb"), (902, "quieau", None)]
    df = spark.createDataFrame([(*r, "clash") for r in data], "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in language.predict(df, language.fit(df)).collect()}
    truth = {r[0]: r[2] for r in data[:400]}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in truth)
    held = [i for i in truth if got[i].held_out]
    assert sum(got[i].lang_pred == truth[i] for i in held) >= 0.97 * len(held)
    assert (got[900].lang_pred, got[901].lang_pred, got[900].score) == ("und", "und", 0.0) and 0 <= got[902].score <= 1
    empty = nothing.select("doc_id", "text", "lang")
    assert language.fit(empty) is None and language.predict(empty, None).count() == 0


def test_folded_tables_equal_the_network():
    net = language.ByteNet(["x", "y"], seed=1)
    x = np.random.default_rng(0).integers(0, 256, (5, language.WINDOW)).astype(np.uint8)
    h, _ = net.pooled(x)
    z = h @ net.dense + net.bias
    assert np.allclose(net.log_probabilities(x, net.folded()), z - np.log(np.exp(z).sum(1, keepdims=True)), atol=1e-4)


def test_mixing(docs, rows, nothing):
    weights = {"src0": 3.0, "src1": 1.0, "*": 1.0}
    got = mixing.mixed(docs, weights, 5).collect()
    group = lambda s: s if s in ("src0", "src1") else "*"
    size = {g: sum(len(r[1] or "") for r in rows if group(r[3]) == g) for g in weights}
    want = []
    for r in rows:
        rate = weights[group(r[3])] / 5 * sum(size.values()) / size[group(r[3])]
        u = (int(hashlib.md5(f"mix5|{'' if r[0] is None else r[0]}".encode()).hexdigest()[:15], 16) + 0.5) / 16**15
        k, term = 0, np.exp(-rate)
        total = term
        while total < u:
            k += 1
            term *= rate / k
            total += term
        want += [(r[0] or -1, c) for c in range(1, k + 1)]
    assert sorted((r.doc_id or -1, r["copy"]) for r in got) == sorted(want)
    assert mixing.mixed(nothing, weights).count() == 0
    with pytest.raises(ValueError):
        mixing.rates(docs, {"a": 0.0})


def test_mixing_reaches_its_weights(spark):
    df = spark.range(6000).selectExpr("id AS doc_id", "repeat('x', 100) AS text", "if(id % 3 = 0, 'big', 'small') AS source")
    got = {r["source"]: r["count"] for r in mixing.mixed(df, {"big": 3.0, "small": 1.0}, 1).groupBy("source").count().collect()}
    assert abs(got["big"] / sum(got.values()) - 0.75) < 0.02 and abs(sum(got.values()) - 6000) < 250


@pytest.mark.parametrize("rate", [650, 750, 1000, 5000])
def test_mixing_at_large_means(spark, rate):
    """A rare source's documents: counts of the Poisson mean and variance, not all the largest."""
    df = spark.range(300).selectExpr("id AS doc_id", "'xxxxxxxxxx' AS text", "'rare' AS source")
    got = [r["count"] for r in mixing.mixed(df, {"rare": 1.0, "*": 19.0}, 3, total=300 * 10 * 20 * rate).groupBy("doc_id").count().collect()]
    assert len(got) == 300 and abs(np.mean(got) - rate) < 5 * (rate / 300) ** 0.5 and 0.65 * rate < np.var(got) < 1.4 * rate


def test_exact_dedup(docs, rows, nothing):
    got = exact_dedup.decisions(docs).collect()
    groups = {}
    for r in rows:
        groups.setdefault(folded(r[1]), []).append(r[0])
    order = lambda i: -1 if i is None else i
    want = sorted((order(r[0]), order(max(groups[folded(r[1])], key=order)), len(groups[folded(r[1])]), r[0] == max(groups[folded(r[1])], key=order),
                   hashlib.sha256(folded(r[1]).encode()).hexdigest()) for r in rows)
    assert sorted((order(r.doc_id), order(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got) == want
    left = exact_dedup.survivors(docs)
    assert left.columns == docs.columns and sorted(folded(r.text) for r in left.collect()) == sorted(groups)
    assert exact_dedup.decisions(nothing).count() == 0 and exact_dedup.survivors(nothing).count() == 0


def test_key_collisions_are_chained(docs, rows, monkeypatch):
    import pyarrow as pa

    dealt = exact_dedup.merged_batches(lambda batches: (b for b in batches))
    batch = pa.RecordBatch.from_pydict({"x": [1, 2]})
    assert [b.num_rows for b in dealt(iter([batch, batch]))] == [4]


def test_directory_doubles_where_buckets_are_full():
    slots = exact_dedup.directory({0: 5, 1: 5, 9: 1}, 5, deepest=4)
    assert slots[0] != slots[1] and len(set(slots[8:])) == 1 and list(slots) == sorted(slots)
    assert set(exact_dedup.directory({3: 99}, 5, deepest=4)) >= {0} and len(set(exact_dedup.directory({}, 1, deepest=4))) == 1


def brute_components(rows, words, num, den):
    def shingles(t):
        ws = folded(t).translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")
        ws = [w for w in ws if w]
        return {tuple(ws[i:i + words]) for i in range(max(1, len(ws) - words + 1))} if ws else set()

    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        inter = len(sets[i] & sets[j])
        if sets[i] and sets[j] and den * inter >= num * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((-1 if r[0] is None else r[0], len(sets[i]), min(ids, default=None)))
    return sorted(out, key=str)


@pytest.mark.parametrize("plan", [near_dedup.Plan(3, 85, 100), near_dedup.Plan(5, 80, 100)])
def test_near_duplicates(docs, rows, nothing, plan):
    got = near_dedup.near_duplicates(docs, plan).collect()
    assert sorted(((-1 if r.doc_id is None else r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows, plan.words, plan.num, plan.den)
    assert near_dedup.near_duplicates(nothing, plan).count() == 0 and near_dedup.survivors(nothing, plan).count() == 0


def test_near_duplicates_with_null_and_repeated_ids(spark, monkeypatch):
    rng = random.Random(11)
    rows = []
    for g in range(12):
        base = prose(rng, 90)
        ids = [None] * 5 if g < 6 else [7] * 5 if g < 9 else [100 + 5 * g + k for k in range(5)]
        rows += [(i, base + f" end{k}" * (k > 1), f"{g}") for k, i in enumerate(ids)]
    rows += [(None, None, "empty"), (None, " \n", "empty"), (7, "", "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    plan, collected = near_dedup.Plan(3, 85, 100), []
    gathered = near_dedup.gathered
    monkeypatch.setattr(near_dedup, "gathered", lambda r, *c: collected.append((c, gathered(r, *c))) or collected[-1][1])
    left = near_dedup.survivors(docs, plan).collect()
    assert sorted(r.source for r in left) == sorted([*map(str, range(12)), "empty", "empty", "empty"])
    # A class has one text in each block that it takes part in.
    blocks = [b.members for c, frame in collected if c == ("text",) for b in frame.collect()]
    assert blocks and all(len(b) == len({bytes(m["class"]) for m in b}) for b in blocks)
    got = near_dedup.near_duplicates(docs, plan).collect()
    assert sorted(((-1 if r.doc_id is None else r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows, 3, 85, 100)


def test_near_duplicates_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rng = random.Random(8)
    base = prose(rng, 120).split()
    rows = []
    for i in range(60):
        ws = list(base)
        for _ in range(rng.randrange(6)):
            ws[rng.randrange(len(ws))] = f"x{rng.randrange(50)}"
        rows.append((i, " ".join(ws)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), near_dedup.Plan(3, 85, 100)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows, 3, 85, 100)


def test_sketch_tells_similar_from_distant():
    plan, rng = near_dedup.Plan(3, 85, 100), np.random.default_rng(1)
    keys = near_dedup.sample_keys(plan.bands * near_dedup.ROWS)
    a = np.unique(rng.integers(0, 1 << 63, 1000).astype(np.uint64))
    bits = lambda x, y: int(np.bitwise_count(near_dedup.odd_sketch(near_dedup.samples(x, keys)) ^ near_dedup.odd_sketch(near_dedup.samples(y, keys))).sum())
    near = np.concatenate([a[:920], rng.integers(0, 1 << 63, 80).astype(np.uint64)])
    far = np.concatenate([a[:300], rng.integers(0, 1 << 63, 700).astype(np.uint64)])
    assert bits(a, a) == 0 and bits(a, near) <= plan.most_bits < bits(a, far)
    assert (1 - (1 - 0.85**near_dedup.ROWS) ** plan.bands) >= 1 - near_dedup.MISS


def test_sharding(docs, rows, nothing, tmp_path, spark):
    names = ["a", "b", "c"]
    owner = sharding.claims(names, 101)
    assert -1 not in owner and max(owner.count(k) for k in range(3)) - min(owner.count(k) for k in range(3)) <= 1
    fewer = sharding.claims(["a", "b"], 101)
    assert sum(x != y for x, y in zip(owner, fewer, strict=True) if x != 2) <= 30
    got = {r.doc_id: (r.slot, r.shard) for r in sharding.placed(docs, names).collect()}
    for r in rows:
        slot = int(hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert got[r[0]] == (slot, names[sharding.claims(names)[slot]])
    assert sharding.placed(nothing, names).count() == 0
    sharding.write_shards(docs.select("doc_id", "text"), names, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(rows)
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.claims(bad, 101)
    with pytest.raises(ValueError):
        sharding.claims(names, 100)


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("just text &amp; more", "just text & more"), ("<html><body></body></html>", ""),
    ("<body><nav><a href=x>Home</a></nav><article><h1>Ti tle</h1><p>One<b> two<br>three<p>Four &lt;5&gt;  six</article><footer>f</footer>", "Ti tle One two three Four <5> six"),
    ("<body><div class='sidebar'><p>side side side</p></div><div id=content><p>Body text of the page, long enough to win.</p><p>Second.</p></div>"
     "<section class='comments'><p>first!</p></section><form><p>mail</p></form>", "Body text of the page, long enough to win. Second."),
    ("<body><article><p>a</p><aside>no</aside><script>var t='</p>';</script><p>b &copy", "a b ©"),
    ("<body><header><p>site</p></header><div class=cookie-notice>We use</div><main><section><p>x y</p></section><section><p>z</p></section></main>", "x y z"),
])
def test_main_text(page, text):
    assert html_text.main_text(page or "") == text


ARTICLE = "<p>Body text of the page, long enough to win.</p><p>Second part.</p>"
BODY = "Body text of the page, long enough to win. Second part."


@pytest.mark.parametrize("attributes", [
    'style="overflow:hidden"', 'title="hidden costs"', 'data-id="comments"', 'data-role="menu"', "title='role=menu class=ad'", 'data-hidden hidden="until-found"',
    'class="has-sidebar"', 'class="content no-sidebar"', 'class="td-post-content no-comments"', 'class="layout_with_left_sidebar"', 'class="social-science"',
    'id="ad-hoc-methods"', 'class="sidebar-layout"', 'role="form"', 'aria-hidden="true"', 'class="post comments-open"'])
def test_wrappers_keep_their_article(attributes):
    page = f"<body><nav><a href=/>Home</a></nav><div {attributes}>{ARTICLE}<div class=sidebar><p>aside</p></div></div><footer>f</footer>"
    assert html_text.main_text(page) == BODY


@pytest.mark.parametrize(("page", "text"), [
    ('<body><p>See the <a href="/hidden/gems">finest places</a> of the long and quiet coast.</p>', "See the finest places of the long and quiet coast."),
    # Hints that stand: nothing of the article is in them.
    (f"<body><div id=post>{ARTICLE}</div><div class=related><article>Other page</article></div>", BODY),
    (f"<body><div id=post>{ARTICLE}</div><section id=comments>" + "<div class=comment><article class=comment-body>A reader says it.</article></div>" * 9 + "</section>", BODY),
    (f"<body><div hidden><p>{'secret ' * 40}</p></div><div HIDDEN='false'>x</div>{ARTICLE}", BODY),
    # Hints that the page overrules.
    (f"<body><div class='promo-page'><main><p>x y</p></main></div><div class=widget><p>{'w ' * 20}</p></div>", "x y"),
    ("<body><div class='widget-area'><article>The whole article</article></div><div class=sidebar>" + "<p class=ad>buy this thing</p>" * 9 + "</div>", "The whole article"),
    # An unclosed named element does not take the rest of the page.
    (f"<body><ul><li class=menu-item>a<li class=menu-item>b</ul>{ARTICLE}", BODY),
])
def test_hints_stand_or_are_overruled(page, text):
    assert html_text.main_text(page) == text


def test_attributes_are_names_and_values():
    got = html_text.attributes_of(""" CLASS = 'a b' data-x=1 hidden id="c&amp;d" class=late href=/x?id=ads "stray" / """)
    assert got == {"class": "a b", "data-x": "1", "hidden": "", "id": "c&d", "href": "/x?id=ads"}


def test_html_frame(spark):
    df = spark.createDataFrame([(1, "u", "<p>a</p>", "c"), (1, "u", "<p>a</p>", "c"), (None, None, None, "c"), (2, "v", "<div>" * 5000 + "deep", "c")], "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in html_text.extract(df).collect())
    assert got == [(0, "", 0), (1, "a", 1), (1, "a", 1), (2, "deep", 4)]
    assert html_text.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("page", [
    "<form id=aspnetForm><nav><a href=/>Home</a></nav><div>{}</div><input><select><option>x</option></select></form>",
    "<form><div class=menu>Menu</div><article>{}</article><form class=login><label>User name</label></form></form>",
    "<fieldset><div>{}</div></fieldset>", "<form action=/s><input name=q><div>{}</div>",
    "<div>{}</div><form><label>Your e-mail</label><button>Go</button></form>"])
def test_a_form_around_the_page_holds_its_article(page):
    text = "The river rose over its banks in the night and the town woke to water. " * 6
    assert html_text.main_text("<body>" + page.format(f"<p>{text}</p><p>{text}</p>") + "</body>") == (text + text).strip()


@pytest.mark.parametrize("page", ["<b>" * 30_000 + "<p>x y z" * 3_000, "<div>" * 20_000 + "</span>" * 20_000,
                                  "<nav>" + "<div>" * 20_000 + "</span>" * 20_000, "<b><p>word" * 20_000])
def test_deep_markup_takes_linear_time(page):
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 5
