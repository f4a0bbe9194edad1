"""The registered queries of the ``llm`` operators: thin digests of what the operators
return, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caliper.llm import bpe_codec, decontaminate, divergence_audit, language_id, minmax_dedup, quality_rules, secret_grammar, store, token_counts, token_store, url_filter, vector_codes, window_packing, zip_warc

TOKEN_LIMIT = 2048
END_ID = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents from their prefix tables."""
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    counted = token_counts.prefix_token_counts(table(spark, sf_dir, "documents"), vocabulary)
    n = token_counts.total_tokens(F.col("prefix_counts"))
    return counted.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > TOKEN_LIMIT).alias("over_limit"))


def op2_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written to coded shards and read back."""
    folder, shards = token_store.store_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    back = token_store.read(spark, shards, folder)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


# fixed values: (verdict, host, path)
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all page URLs."""
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of all documents, the base rules, and the learned list's verdict."""
    judged, _ = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_secret_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: counts and a digest of the base spans, and all spans."""
    documents = table(spark, sf_dir, "documents")
    scanned = store.written(secret_grammar.scan(documents), "secrets")
    found = secret_grammar.find(documents, secret_grammar.learn(scanned, documents))

    def joined(spans: F.Column) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"] != "format")
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in secret_grammar.KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted languages of all documents, learned from four of five folds."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", language_id.fold().alias("fold"))
    model = language_id.fit(documents.where("fold != 0").select("text", "lang"))
    told = language_id.identify(documents.select("doc_id", "text", F.coalesce(F.col("fold") == 0, F.lit(False)).alias("held_out")), model)
    return told.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op7_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that overlap benchmark items, one row for each document and item."""
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents by four-word shingles."""
    return minmax_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=4)


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents and what they decode to, as digests."""
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    coded = bpe_codec.round_trip(table(spark, sf_dir, "documents"), vocabulary)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to packages of WARC records and read back by range."""
    folder = store.new_folder(spark, "warc")
    packages = zip_warc.write(table(spark, sf_dir, "pages"), folder)
    return zip_warc.read(packages, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all pairs of sources of a language and the terms that set each off."""
    return divergence_audit.audit(table(spark, sf_dir, "documents"))


def op12_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of at most 1,024 tokens, a row for each piece."""
    windows = window_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0)
    return window_packing.pieces(windows).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings in eight parts of sixteen entries after six rounds."""
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    hexed = F.lower(F.hex("code")).alias("code")
    return vector_codes.label_errors(coded).select("vec_id", hexed, "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_counts, op2_huffman_ids, op3_url_filter, op4_quality_rules, op5_secret_grammar, op6_language_id, op7_spaced_seeds, op8_minmax_dedup, op9_bpe_codec, op10_zip_warc,
                                op11_divergence_audit, op12_window_packing, op13_vector_codes)
}
#: Base32 of a SHA-1 in hex, column h: twenty bits at a time.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, {5 * g + 1}, 5) AS BIGINT) >> {shift}) & 31 AS BIGINT), 1)"
    for g in range(8) for shift in (15, 10, 5, 0))


def _vector_codes_sql(rounds: int = 6) -> str:
    """The rounds one after the other: a<r> assigns to the codebook b<r>, whose next one is
    the floored mean, by the remainder that is never negative."""
    assign = """
a{r} AS MATERIALIZED (SELECT x.r, x.p, any_value(x.s) AS s, arg_min(e, 16 * d + e) AS e, min(d) AS d FROM (
    SELECT x.r, x.p, x.s, b.e, list_sum(list_transform(list_zip(x.s, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x JOIN b{r} b ON x.p = b.p) x GROUP BY x.r, x.p),"""
    move = """
b{n} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN (
    SELECT p, e, list((t - ((t % n) + n) % n) // n ORDER BY i) AS c FROM (
        SELECT p, e, i, CAST(sum(s[i]) AS BIGINT) AS t, count(*) AS n FROM (SELECT p, e, s, unnest(range(1, len(s) + 1)) AS i FROM a{r}) GROUP BY p, e, i)
    GROUP BY p, e) m ON b.p = m.p AND b.e = m.e),"""
    steps = "".join(assign.format(r=r) + move.format(r=r, n=r + 1) for r in range(rounds)) + assign.format(r=rounds)
    return f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda c: CAST(floor(4096 * CAST(c AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS MATERIALIZED (SELECT r, p, list_slice(v, p * len(v) // 8 + 1, (p + 1) * len(v) // 8) AS s FROM k CROSS JOIN range(8) t(p)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, s AS c FROM x WHERE r <= 16),{steps}
h AS (SELECT sha256(string_agg(t, ',' ORDER BY p, e)) AS codebooks_sha256 FROM (SELECT p, e, array_to_string(c, ',') AS t FROM b{rounds})),
c AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN c USING (r) CROSS JOIN h"""


ORACLE: dict[str, str] = {
    "op13_vector_codes": _vector_codes_sql(),
    "op10_zip_warc": f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, min(page_id) OVER (PARTITION BY h, n) AS lead FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> lead THEN lead END AS refers_to FROM d""",
    "op8_minmax_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
g AS MATERIALIZED (SELECT doc_id, r, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))) END AS s FROM d),
e AS MATERIALIZED (SELECT r, unnest(s) AS x FROM g),
l AS MATERIALIZED (SELECT a, b FROM (SELECT p.r AS a, q.r AS b, count(*) AS c FROM e p JOIN e q ON p.x = q.x AND p.r <> q.r GROUP BY ALL) t
    JOIN g m ON m.r = a JOIN g n ON n.r = b WHERE 100 * c >= 80 * (len(m.s) + len(n.s) - c)),
t AS (SELECT r AS a, r AS b FROM g UNION SELECT t.a, l.b FROM t JOIN l ON t.b = l.a),
k AS (SELECT a AS r, min(doc_id) AS component_id FROM t JOIN g ON g.r = t.b GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM g JOIN k USING (r)""",
    "op11_divergence_audit": r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT lang, source, r, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS total FROM c GROUP BY ALL HAVING sum(docs) >= 10),
l AS (SELECT lang, count(*) AS v, sum(total) + 2 * count(*) AS m FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
own AS (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS n FROM c JOIN k USING (lang, term) GROUP BY ALL),
m AS (SELECT g.lang, g.source, coalesce(own.n, 0) + 2 * l.v AS m FROM g JOIN l USING (lang) LEFT JOIN own USING (lang, source)),
p AS (SELECT m.lang, m.source, k.term, coalesce(c.n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2)) // m.m AS p,
      1 + (CAST(1000000000 AS HUGEINT) * (k.total + 2)) // l.m AS q
      FROM m JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = m.lang AND c.source = m.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
ranked AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
         UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM ranked)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 10""",
}
