"""Queries over the driver's tables, one for each operator, and SQL where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, filter_audit, html_extract, mixing, ngram_join, pii, quality_rules, sharding, suffix_dedup, token_alignment, token_output, url_filter
from .store import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    model = url_filter.train(url_filter.topic_labels(pages), more=url_filter.seeds())
    return url_filter.judge(pages, model).select("page_id", "host", "path", "rule", "verdict")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/token-store-{uuid.uuid4().hex}"
    token_output.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_output.read(spark, path, with_ids=False)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).drop("text")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents")).drop("tid")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.detect(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op6_extendible_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: A conversation of control strings beside those of the table.
CONTROLS = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(CONTROLS, "conv_id long, turn long, role string, text string"))
    path = public_tokenizers.path("byte_bpe_50k.json")
    return chat.read_back(chat.format_turns(rows, path), path, in_order=True)


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_token_store, op3_quality_rules, op4_ngram_join, op5_personal_data, op6_extendible_hash_shards, op7_suffix_dedup, op8_html_extract, op9_source_mixing, op10_decontamination, op11_token_alignment, op12_filter_audit, op13_chat_formatting)}

OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), d AS (SELECT doc_id, words, array_to_string(words, ' ') AS tid FROM w),
t AS (SELECT tid, any_value(words) AS words, min(doc_id) AS first_id, count(*) AS n_copies FROM d WHERE len(words) > 0 GROUP BY tid),
g AS (
  SELECT DISTINCT first_id, array_to_string(words[i:i + 4], ' ') AS gram
  FROM t, LATERAL (SELECT unnest(generate_series(1, greatest(len(words) - 4, 1))) AS i)
), n AS (SELECT first_id, count(*) AS n FROM g GROUP BY first_id),
common AS (SELECT a.first_id AS a, b.first_id AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.first_id <> b.first_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n na ON na.first_id = a JOIN n nb ON nb.first_id = b WHERE c >= 0.8 * (na.n + nb.n - c) - 1e-9),
reach AS (SELECT a AS node, a AS hit FROM (SELECT DISTINCT a FROM links) UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.hit),
class AS (SELECT node, min(hit) AS class_id FROM reach GROUP BY node),
k AS (SELECT tid, first_id, n_copies, coalesce(class_id, first_id) AS class_id, coalesce(l.n_links, 0) AS n_links
      FROM t LEFT JOIN class ON class.node = first_id LEFT JOIN (SELECT a, count(*) AS n_links FROM links GROUP BY a) l ON l.a = first_id)
SELECT d.doc_id, coalesce(k.class_id, d.doc_id) AS class_id, CAST(coalesce(k.n_links, 0) AS BIGINT) AS n_links, CAST(coalesce(k.n_copies, 1) AS BIGINT) AS n_copies
FROM d LEFT JOIN k ON k.tid = d.tid AND len(d.words) > 0
"""

OP6_SQL = f"""
WITH d AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents
), r AS (
  SELECT d.*, l.depth, sum(n_bytes) OVER (PARTITION BY l.depth, h >> (60 - l.depth)) AS held
  FROM d, (SELECT CAST(range AS INTEGER) AS depth FROM range(61)) l
), s AS (SELECT doc_id, n_bytes, h, min(depth) AS depth, max(held) FILTER (WHERE held <= {sharding.LIMIT_BYTES}) AS held FROM r WHERE held <= {sharding.LIMIT_BYTES} GROUP BY ALL)
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(h >> (60 - depth)), depth, '0') END AS shard_id,
       depth AS shard_depth, CAST(held AS BIGINT) AS shard_bytes, CAST(n_bytes AS BIGINT) AS n_bytes
FROM s
"""

#: Bytes as hex digits, two each: a window of 100 bytes is 200 digits.
OP7_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, p, md5(substr(x, 2 * p + 1, 200)) AS h FROM d, LATERAL (SELECT unnest(generate_series(0, n - 100)) AS p)),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS k FROM w),
s AS (SELECT doc_id, p, max(p) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM r WHERE k > 1),
g AS (SELECT doc_id, p, sum(CASE WHEN prev IS NULL OR p > prev + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM s),
spans AS (SELECT doc_id, span, min(p) AS a, max(p) + 100 AS b FROM g GROUP BY doc_id, span),
ends AS (SELECT doc_id, a, b, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS next FROM spans),
kept AS (
  SELECT d.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
         any_value(substr(x, 1, 2 * (SELECT min(a) FROM spans s WHERE s.doc_id = d.doc_id)))
           || string_agg(substr(x, 2 * b + 1, 2 * (coalesce(next, n) - b)), '' ORDER BY a) AS x
  FROM d JOIN ends ON ends.doc_id = d.doc_id GROUP BY d.doc_id
)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(k.n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k.x, d.x))) AS kept_sha256
FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         length(coalesce(text, '')) AS n, length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS symbols,
         (('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT)::DOUBLE AS v
  FROM documents
), k AS (
  SELECT doc_id, source, size, -ln((v + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE greatest(0.1::DOUBLE, 1.0::DOUBLE - 5.0::DOUBLE * symbols / n) END AS key
  FROM d
), s AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS ss, CAST([3, 1, 2][((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1] AS DOUBLE) AS w
  FROM d GROUP BY source
), b AS (
  SELECT *, 2.0::DOUBLE * ss AS cap,
    (1.5::DOUBLE * sum(ss) OVER () - coalesce(sum(2.0::DOUBLE * ss) OVER p, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER p, 0)) AS level
  FROM s WINDOW p AS (ORDER BY 2.0::DOUBLE * ss / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, ss, least(cap, coalesce((max(CASE WHEN cap > level * w THEN level END) OVER ()) * w, cap)) AS target FROM b
), e AS (SELECT *, CASE WHEN ss > 0 THEN floor(target / ss) ELSE 0 END AS epochs FROM t),
f AS (
  SELECT k.doc_id, k.size, e.ss, e.target, e.epochs, e.target - e.epochs * e.ss AS rest,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, CAST(ss AS BIGINT) AS source_size, target,
       CAST(size * (epochs + CASE WHEN rest > 0 AND before + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM f
"""

#: Every document with every order and step, without cells.
OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
  FROM documents
), l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails
  FROM d LEFT JOIN l USING (doc_id)
), x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, CAST(k AS INTEGER) AS step, substr(filter_order, k, 1) AS letter, substr(filter_order, 1, k - 1) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
c AS (
  SELECT part, filter_order, step, letter, contains(fails, letter) AS hit, length(translate(before, fails, '')) < step - 1 AS gone, length(fails) = 1 AS alone, good, toxic
  FROM f, s
), r AS (
  SELECT part, filter_order, step, letter, count(*) FILTER (WHERE NOT hit AND NOT gone) AS kept, count(*) FILTER (WHERE hit AND NOT gone) AS removed, count(*) FILTER (WHERE hit AND gone) AS redundant,
         count(*) FILTER (WHERE hit AND alone) AS unique_fails, count(*) FILTER (WHERE hit AND NOT gone AND good) AS good_lost, count(*) FILTER (WHERE hit AND NOT gone AND toxic) AS toxic_lost
  FROM c GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r
"""

ORACLE = {"op4_ngram_join": OP4_SQL, "op6_extendible_hash_shards": OP6_SQL, "op7_suffix_dedup": OP7_SQL, "op9_source_mixing": OP9_SQL, "op12_filter_audit": OP12_SQL}
