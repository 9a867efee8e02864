"""The operators bound to the given tables, with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, html_text, language, licenses, mixing, near_dedup, quality, sharding, spelling, token_counts, vector_codes, warc

#: Target weights of the sources; "*" is every other source.
WEIGHTS = {"src0": 2.0, "src1": 1.0, "src2": 1.0, "src3": 0.5, "*": 15.5}
SEED = 17
SHARDS = [f"shard-{k:02d}" for k in range(16)]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.measured_verdicts(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents")).drop("spans")


def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode(docs, bpe.Bpe(spark), sample_docs=48_000, most_words=480_000))


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"))


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language.predict(docs, language.fit(docs))


def op6_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return mixing.mixed(docs, WEIGHTS, SEED).select("doc_id", "source", F.round("rate", 9).alias("rate"), F.col("copy").cast("long").alias("copy"),
                                                    "place", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.decisions(table(spark, folder, "documents")).drop("last_rows")


def op8_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"), near_dedup.Plan(3, 85, 100))


def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.placed(table(spark, folder, "documents"), SHARDS).select("doc_id", "slot", "shard")


def op10_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


def op11_warc(spark: SparkSession, folder: str) -> DataFrame:
    streams = warc.write_archives(table(spark, folder, "pages"))
    return warc.read_records(warc.normalise(streams)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.compressed(table(spark, folder, "embeddings")).drop("label")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_quality_rules, op2_license_scan, op3_byte_bpe, op4_token_counts, op5_language_id, op6_source_mixing, op7_exact_dedup,
    op8_near_dedup, op9_sharding, op10_html_text, op11_warc, op12_spelling, op13_vector_codes)}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NORMAL = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
GAP = r"[\x20\x09-\x0D]+"


def quality_measures(docs: str) -> str:
    """SQL of the measures of op1 over a relation with rid, doc_id and text."""
    return rf"""
    d AS (SELECT rid, doc_id, coalesce(text, '') AS t FROM {docs}),
    w AS (SELECT *, list_filter(regexp_split_to_array(t, '{GAP}'), lambda x: x <> '') AS ws,
            list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
    tri AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w),
    win AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS n FROM tri),
    rep AS (SELECT rid, count(DISTINCT pos) AS r FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS pos FROM win WHERE n > 1) GROUP BY rid),
    m AS (SELECT w.rid, doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{GAP}', '', 'g')) AS BIGINT) AS word_chars,
            CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
            CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words,
            length(t) - length(regexp_replace(t, '!+', '', 'g')) AS n_bangs, length(t) - length(regexp_replace(t, '[A-Z]+', '', 'g')) AS n_capitals,
            len(ls) AS n_lines
          FROM w LEFT JOIN rep USING (rid))"""


CLEAN = ("NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 4 * n_symbols > n_words OR 2 * n_bangs > n_words "
         "OR 10 * n_capitals > 6 * word_chars OR 2 * word_chars < 5 * n_words OR word_chars > 12 * n_words OR 2 * n_dup_lines > n_lines)")

OP1_SQL = f"""WITH src AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents), {quality_measures("src")}
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, {CLEAN} AS kept FROM m"""

LICENSE_PATTERNS = {
    "apache-2.0": r" licensed under (the )?apache license (version )?2 0 ",
    "mit": r" (released )?under the mit license ",
    "gpl-3.0": r" licensed under (the )?gnu ([^ ]+ )?general public license (version )?3 ",
    "cc-by-nc": r" licensed under (a creative commons )?cc by nc ",
    "copyright-reserved": r" copyright ([^ ]+ ){0,6}all rights reserved ",
}
OP2_SQL = rf"""WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({NORMAL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
    places AS (SELECT rid, unnest(range(1, len(ws) + 1)) AS i, ws FROM w),
    hit AS (SELECT rid, i - 1 AS i, 'cc-by' AS label FROM places WHERE ws[i] = 'cc' AND ws[i + 1] = 'by'
      UNION ALL SELECT rid, i - 1, 'gpl' FROM places WHERE ws[i] = 'general' AND ws[i + 1] = 'public' AND ws[i + 2] = 'license'
      UNION ALL SELECT rid, i - 1, 'reserved' FROM places WHERE ws[i] = 'all' AND ws[i + 1] = 'rights' AND ws[i + 2] = 'reserved'),
    base AS (SELECT rid, count(*) AS n, min(i) AS lo, max(i) AS hi, list_sort(list_distinct(list(label))) AS ls FROM hit GROUP BY rid),
    own AS (SELECT rid, list_filter([{", ".join(f"CASE WHEN regexp_matches(' ' || array_to_string(ws, ' ') || ' ', '{p}') THEN '{k}' END" for k, p in LICENSE_PATTERNS.items())}],
            lambda x: x IS NOT NULL) AS os FROM w)
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
           coalesce(array_to_string(ls, ','), '') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(ls, []), os))), ',') AS labels,
           CAST(CASE WHEN len(os) > 0 THEN 1.0 WHEN n > 0 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS score
    FROM w LEFT JOIN base USING (rid) JOIN own USING (rid)"""


def hash15(*parts: str) -> str:
    """SQL of common.md5_long."""
    text = " || '|' || ".join(f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts)
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


def mixing_sql(docs: str, weights: dict[str, float], seed: int) -> str:
    """SQL of mixing.mixed over a relation: its rows with rate, copy and place."""
    whole = sum(weights.values())
    named = ", ".join(f"'{w}'" for w in weights if w != mixing.OTHER)
    case = " ".join(f"WHEN '{k}' THEN {w / whole!r}" for k, w in weights.items())
    u = f"(CAST({hash15(repr(f'mix{seed}'), 'doc_id')} AS DOUBLE) + 0.5) / {16**15}.0"
    return f"""SELECT q.* EXCLUDE (_g, _u), copy, {hash15(repr(f"order{seed}"), "doc_id", "copy")} AS place FROM (
        SELECT s.*, rate, _u FROM (SELECT *, CASE WHEN source IN ({named}) THEN source ELSE '*' END AS _g, {u} AS _u FROM {docs}) s
        JOIN (SELECT _g, CASE WHEN c > 0 THEN coalesce(CASE _g {case} END, 0) * (sum(c) OVER ()) / c ELSE 1 END AS rate FROM (
            SELECT CASE WHEN source IN ({named}) THEN source ELSE '*' END AS _g, CAST(coalesce(sum(length(text)), 0) AS DOUBLE) AS c FROM {docs} GROUP BY 1)) r USING (_g)) q,
        LATERAL (SELECT unnest(range(1, 1 + (
            SELECT count(*) FROM range(0, 200) k(k) WHERE _u > (SELECT sum(exp(-rate + j * ln(greatest(rate, 1e-300)) - lgamma(j + 1.0))) FROM range(0, 200) jj(j) WHERE j <= k)))) AS copy)"""


SLOT_ROWS = ", ".join(map(str, sharding.claims(SHARDS)))
OP9_SQL = f"""WITH owners AS (SELECT [{SLOT_ROWS}] AS o),
    d AS (SELECT doc_id, {hash15("doc_id")} % {sharding.SLOTS} AS slot FROM documents)
    SELECT doc_id, slot, 'shard-' || lpad(CAST(o[slot + 1] AS VARCHAR), 2, '0') AS shard FROM d, owners"""

OP7_SQL = f"""SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept,
    sha256({NORMAL}) AS text_sha256 FROM documents WINDOW g AS (PARTITION BY {NORMAL})"""

#: Document pairs by shared shingles, then components by repeated minima; for tables of test size.
OP8_SQL = rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({NORMAL}, '{GAP}'), lambda x: x <> '') AS ws FROM documents),
    s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
            ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w),
    x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
    e AS (SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
    r(u, v) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
    SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, c AS component_id, s.doc_id = c AS kept
    FROM s JOIN (SELECT u, min(v) AS c FROM r GROUP BY u) m ON m.u = s.doc_id"""

OP6_SQL = f"""SELECT doc_id, source, round(rate, 9) AS rate, copy, place, md5(coalesce(text, '')) AS text_md5 FROM ({mixing_sql("documents", WEIGHTS, SEED)})"""

OP11_SQL = f"""SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN again THEN least_id END AS refers_to
    FROM (SELECT *, payload_bytes >= {warc.SMALLEST_REVISIT} AND least_id IS NOT NULL AND page_id IS DISTINCT FROM least_id AS again
      FROM (SELECT page_id, strlen(t) AS payload_bytes, sha256(t) AS payload_digest, min(page_id) OVER (PARTITION BY t) AS least_id
        FROM (SELECT page_id, coalesce(html, '') AS t FROM pages)))"""


def crc_table() -> list[int]:
    """The 256 remainders of the reflected CRC-32 polynomial."""
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return out


#: Words of whole texts, then pairs by what is left when one place is taken out, then forms followed to their roots.
OP12_SQL = rf"""WITH RECURSIVE
    crc AS (SELECT {crc_table()}::BIGINT[] AS t),
    occ AS (SELECT doc_id, translate(r, '{UPPER}', '{LOWER}') AS r FROM (
      SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS r FROM documents) WHERE length(r) >= 6),
    dist AS (SELECT doc_id, r, count(*) AS n FROM occ GROUP BY ALL),
    hexed AS (SELECT r, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r)) AS x FROM dist),
    hashed AS (SELECT r, n, xor(list_reduce([4294967295::BIGINT] || list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)),
        lambda a, b: xor(a >> 8, t[1 + xor(a & 255, b)])), 4294967295::BIGINT) AS h FROM hexed, crc),
    typed AS (SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, n FROM hashed),
    w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM typed WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
    gone AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
    pair AS (SELECT a.word, b.word AS near, b.n FROM gone a JOIN gone b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
      UNION SELECT g.word, w.word, w.n FROM gone g JOIN w ON w.word = g.rest
      UNION SELECT w.word, g.word, g.n FROM gone g JOIN w ON w.word = g.rest),
    best AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS near, max(n) AS near_n FROM pair GROUP BY word),
    f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
      FROM w LEFT JOIN best USING (word)),
    path(word, top, d) AS (SELECT word, word, 0 FROM f UNION ALL SELECT p.word, f.form, d + 1 FROM path p JOIN f ON f.word = p.top WHERE f.form IS NOT NULL)
    SELECT f.word, f.form, root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
    FROM f JOIN (SELECT word, arg_max(top, d) AS root FROM path GROUP BY word) USING (word)"""


def codes_sql() -> str:
    """Product codes with two rounds, each part against every entry."""
    assign = """SELECT row_id, part, e, d FROM (SELECT x.row_id, x.part, c.e, list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i]))) AS d,
        FROM x JOIN {book} c ON c.part = x.part) QUALIFY row_number() OVER (PARTITION BY row_id, part ORDER BY d, e) = 1"""
    improve = """SELECT c.part, c.e, coalesce(m.v, c.v) AS v FROM {book} c LEFT JOIN (SELECT part, e, list(s ORDER BY i) AS v FROM (
        SELECT a.part, a.e, i, CAST(floor(sum(x.v[i]) / count(*)) AS BIGINT) AS s FROM {at} a JOIN x ON x.row_id = a.row_id AND x.part = a.part,
        (SELECT unnest(range(1, (SELECT max(len(v)) FROM x) + 1)) AS i) GROUP BY a.part, a.e, i) GROUP BY part, e) m ON m.part = c.part AND m.e = c.e"""
    return f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row_id, vec_id, label, embedding FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      x AS MATERIALIZED (SELECT row_id, part, list_transform(embedding[part * (len(embedding) // 16) + 1:(part + 1) * (len(embedding) // 16)],
        lambda z: CAST(floor(256 * CAST(z AS DOUBLE)) AS BIGINT)) AS v FROM kept, (SELECT unnest(range(0, 16)) AS part)),
      b0 AS MATERIALIZED (SELECT part, row_id - 1 AS e, v FROM x WHERE row_id <= 64),
      a0 AS MATERIALIZED ({assign.format(book="b0")}), b1 AS MATERIALIZED ({improve.format(book="b0", at="a0")}),
      a1 AS MATERIALIZED ({assign.format(book="b1")}), b2 AS MATERIALIZED ({improve.format(book="b1", at="a1")}),
      a2 AS MATERIALIZED ({assign.format(book="b2")}),
      coded AS (SELECT row_id, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY row_id)
      SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
        (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) FROM b2) AS codebooks_sha256
      FROM kept JOIN coded USING (row_id)"""


OP13_SQL = codes_sql()

SQL: dict[str, str] = {"op1_quality_rules": OP1_SQL, "op2_license_scan": OP2_SQL, "op6_source_mixing": OP6_SQL, "op7_exact_dedup": OP7_SQL,
                       "op8_near_dedup": OP8_SQL, "op9_sharding": OP9_SQL, "op11_warc": OP11_SQL, "op12_spelling": OP12_SQL, "op13_vector_codes": OP13_SQL}
