"""Registered queries of this package: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bloomgrid.llm import (
    alignment,
    bpe,
    compression,
    decontaminate,
    html_blocks,
    language,
    license_scan,
    neardup,
    packing,
    quality_rules,
    resampling,
    token_counts,
    url_rules,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


@query
def op2_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"), width=4, percent=80)


SQL["op2_minhash_near_dedup"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), spans AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM words WHERE len(w) > 0
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS gram FROM spans
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
  FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * shared >= 80 * (p.n + q.n - shared)
), edges AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT reach.x, edges.y FROM reach JOIN edges ON reach.y = edges.x
), least AS (
  SELECT x, min(y) AS component_id FROM reach GROUP BY x
)
SELECT words.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id,
       words.doc_id = component_id AS kept
FROM words LEFT JOIN sizes USING (doc_id) JOIN least ON least.x = words.doc_id
"""


@query
def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"))


@query
def op4_bpe_encode_decode(spark: SparkSession, folder: str) -> DataFrame:
    return digests(bpe.encode_decode(table(spark, folder, "documents")))


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op5_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return html_blocks.extracted(pages, html_blocks.labeller(pages))


@query
def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judged(table(spark, folder, "documents"))


@query
def op7_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    ).drop("key")


SQL["op7_benchmark_decontamination"] = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), item_starts AS (
  SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS phrase, least(len(w), 10) AS size
  FROM item_starts
), doc_words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), doc_starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i, size
  FROM doc_words CROSS JOIN (SELECT DISTINCT size FROM windows)
), phrases AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM doc_starts WHERE i + size - 1 <= len(w)
), hits AS (
  SELECT doc_id, i, size, item_id FROM phrases JOIN windows USING (phrase, size)
), hit_words AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS at FROM hits
), hit_counts AS (
  SELECT doc_id, count(*) AS n_hit FROM hit_words GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
    sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS digest
  FROM hits GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, coalesce(digest, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit_counts USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


@query
def op7_proximity_matches(spark: SparkSession, folder: str) -> DataFrame:
    """As op7_benchmark_decontamination, with the items whose words stand within one word of their place."""
    return decontaminate.contaminated(
        table(spark, folder, "documents"), table(spark, folder, "benchmark"), slack=1
    ).drop("key")


@query
def op8_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judged(table(spark, folder, "pages"))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SQL["op8_url_filters"] = """
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS tail
  FROM pages
), parts AS (
  SELECT page_id,
    translate(regexp_extract(tail, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(verdict, rule_host, rule_path) AS (VALUES %s
), fits AS (
  SELECT DISTINCT host, path, verdict, rule_host || rule_path AS rule, rule_host
  FROM (SELECT DISTINCT host, path FROM parts) p JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
), best AS (
  SELECT * FROM fits
  QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(rule) DESC, length(rule_host) DESC) = 1
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN %s THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN best USING (host, path)
""" % (
    ", ".join(
        f"({_sql_text(r.verdict)}, {_sql_text(r.host)}, {_sql_text(r.path)})" for r in url_rules.HOST_RULES
    ),
    " OR ".join(
        f"regexp_matches(host || chr(10) || path, {_sql_text(r.pattern)})" for r in url_rules.PATTERN_RULES
    ),
)


@query
def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.licensed(table(spark, folder, "documents")).drop("passages")


SQL["op9_license_scan"] = r"""
WITH templates(id, name, body, is_text) AS (VALUES %s
), template_words AS (
  SELECT *, regexp_extract_all(lower(body), '[a-z0-9]+') AS w FROM templates
), template_sets AS (
  SELECT id, name, is_text, len(w) - 1 AS span,
    list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS grams
  FROM template_words
), texts AS (
  SELECT doc_id, string_split(text, chr(10)) AS parts, text FROM documents
), units AS (
  SELECT doc_id, unnest(range(1, len(parts) + 1)) AS place, parts[place] AS body FROM texts
  UNION ALL SELECT doc_id, 0, text FROM texts
), unit_words AS (
  SELECT doc_id, place, regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS w
  FROM units
), unit_pairs AS (
  SELECT doc_id, place, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS pairs
  FROM unit_words WHERE len(w) > 1
), unit_sets AS (
  SELECT doc_id, place, pairs, list_distinct(pairs) AS grams FROM unit_pairs
), hits AS (
  SELECT doc_id, place, name,
    2.0::DOUBLE * len(list_intersect(u.grams, t.grams)) / (len(u.grams) + len(t.grams)) AS dice
  FROM unit_sets u JOIN template_sets t ON list_has_any(u.grams, t.grams) AND NOT is_text
), best AS (
  SELECT doc_id, arg_min(name, (-dice, name)) AS license, max(dice) AS dice,
    count(DISTINCT place) FILTER (WHERE place > 0) AS n
  FROM hits WHERE dice >= 0.7 GROUP BY doc_id
), able AS (
  SELECT doc_id, pairs, id, name, is_text, span, t.grams
  FROM unit_sets u JOIN template_sets t
    ON place = 0 AND len(list_intersect(u.grams, t.grams)) >= len(t.grams) * 0.7 / 1.3
), starts AS (
  SELECT *, unnest(range(1, len(pairs) + 1)) AS p FROM able
), slid AS (
  SELECT doc_id, name, is_text, grams, list_distinct(pairs[p:p + span - 1]) AS own
  FROM starts WHERE list_contains(grams, pairs[p])
), windows AS (
  SELECT doc_id, name, is_text,
    2.0::DOUBLE * len(list_intersect(own, grams)) / (len(own) + len(grams)) AS dice
  FROM slid
), found AS (
  SELECT doc_id, is_text, arg_min(name, (-dice, name)) AS name, max(dice) AS dice
  FROM windows WHERE dice >= 0.7 GROUP BY ALL
)
SELECT d.doc_id, coalesce(t.name, license, f.name) AS license,
  coalesce(t.dice, best.dice, f.dice) AS dice, coalesce(n, 0)::BIGINT AS n_notices
FROM documents d LEFT JOIN best USING (doc_id)
LEFT JOIN (SELECT * FROM found WHERE is_text) t ON t.doc_id = d.doc_id
LEFT JOIN (SELECT * FROM found WHERE NOT is_text) f ON f.doc_id = d.doc_id
""" % ", ".join(
    f"({i}, {_sql_text(name)}, {_sql_text(text)}, {is_text})"
    for i, (name, text, is_text) in enumerate(license_scan.known_templates())
)


@query
def op10_compression_quality(spark: SparkSession, folder: str) -> DataFrame:
    return compression.classified(
        table(spark, folder, "documents"), table(spark, folder, "labels")
    )


@query
def op11_sequence_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces with the checksum of their ids in place of the ids."""
    pieces = packing.pack(table(spark, folder, "documents"), size=2048)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query
def op12_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Figures and scores of each document, its groups as a digest."""

    def digest(groups):
        return F.when(groups == "", "").otherwise(F.sha2(groups, 256))

    scored = alignment.scored(table(spark, folder, "documents"), stored=digest)
    return scored.withColumnRenamed("groups", "groups_sha256")


@query
def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    drawn = resampling.resampled(
        table(spark, folder, "documents"), table(spark, folder, "benchmark"),
        percent=5, least_words=20, seed=42,
    )
    return drawn.drop("n_words")


SQL["op13_importance_resampling"] = r"""
WITH RECURSIVE crc_steps(i, c, k) AS (
  SELECT unnest(range(0, 256)), unnest(range(0, 256)), 0
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_steps WHERE k < 8
), crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM crc_steps WHERE k = 8
), texts AS (
  SELECT doc_id, text, true AS ours FROM documents UNION ALL SELECT item_id, text, false FROM benchmark
), words AS (
  SELECT doc_id, ours, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts
), features AS (
  SELECT doc_id, ours, unnest(list_concat(w,
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f
  FROM words
), counted AS (
  SELECT doc_id, ours, f, count(*) AS n FROM features GROUP BY ALL
), spelled AS (
  SELECT f, hex(f) AS h FROM (SELECT DISTINCT f FROM counted)
), crcs AS (
  SELECT f, (xor(list_reduce(
    list_transform(range(0, len(h) // 2), lambda k: CAST('0x' || substr(h, 2 * k + 1, 2) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)) % 10000 AS bucket
  FROM spelled CROSS JOIN crc_table
), placed AS (
  SELECT doc_id, ours, bucket, sum(n)::BIGINT AS n FROM counted JOIN crcs USING (f) GROUP BY ALL
), sums AS (
  SELECT bucket, coalesce(sum(n) FILTER (ours), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (NOT ours), 0)::DOUBLE AS t
  FROM placed GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM sums) + 10000)
    / ((s + 1) * ((SELECT sum(t) FROM sums) + 10000))))::BIGINT AS gain FROM sums
), weights AS (
  SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight
  FROM placed JOIN gains USING (bucket) WHERE ours GROUP BY doc_id
), scored AS (
  SELECT words.doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((
      CAST('0x' || substr(sha256('42:' || words.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (doc_id) WHERE ours
), drawn AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_words >= 20
  QUALIFY rank <= (SELECT count(*) FROM scored WHERE n_words >= 20) * 5 // 100
)
SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN drawn USING (doc_id)
"""
