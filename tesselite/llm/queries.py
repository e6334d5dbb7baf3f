"""Queries of this subpackage over the synthetic tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselite.llm import dart, mixing, ogg, packing, secrets, separators, subword, topk, toxicity, warc
from tesselite.llm._util import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(listed("base_spans").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """A crawl's log from the table of pages: each page is a full response, and a later conditional request for the
    same page gives a revisit.  Tags of some revisits are weak, some have changed, and some have a date or a digest alone."""
    digest = F.md5(F.coalesce(F.col("html"), F.lit("")))
    tag = F.concat(F.lit('"'), digest, F.lit('"'))
    at = F.col("page_id") * 10
    text = lambda c: c.cast("string")
    response = pages.select(
        (F.col("page_id") * 2).alias("record_id"), "url", at.alias("at"), F.lit("response").alias("kind"), tag.alias("etag"),
        F.concat(F.lit("day "), text(F.col("page_id") % 365)).alias("last_modified"), digest.alias("digest"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), text(F.length(F.coalesce(F.col("html"), F.lit("")))), F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("Date"), text(at)).alias("headers"),
    )
    later = at + 10 * (1 + F.col("page_id") % 97) + 5
    kind = F.col("page_id") % 7
    revisit = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), "url", later.alias("at"), F.lit("revisit").alias("kind"),
        F.when(kind == 0, F.lit('"changed"')).when(kind == 1, F.concat(F.lit("W/"), tag)).when(kind < 4, tag).alias("etag"),
        F.when(kind == 4, F.concat(F.lit("day "), text(F.col("page_id") % 365))).alias("last_modified"), F.when(kind == 5, digest).alias("digest"),
        F.create_map(F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=3600"), F.lit("date"), text(later), F.lit("expires"), text(later + 3600)).alias("headers"),
    )
    return response.unionByName(revisit)


def op2_not_modified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each revisit: what it resolves to, and the merged headers as sorted text."""
    found = warc.resolve(captures(table(spark, sf_dir, "pages")))
    listed = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws(": ", e["key"], e["value"]))), "; ")
    return found.select("record_id", "base_id", "outcome", listed.alias("headers"))


OP2_SQL = """
WITH named AS (
  SELECT page_id, url, coalesce(html, '') AS html,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest
  FROM pages
), parts AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*', 0)), '^www[0-9]*\\.', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(rest, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^(utm_[^=]*|ref|gclid|fbclid|sessionid)(=|$)'))) AS asked
  FROM named
), keyed AS (
  SELECT *, host || path || CASE WHEN len(asked) > 0 THEN '?' || array_to_string(asked, '&') ELSE '' END AS key, md5(html) AS digest FROM parts
), responses AS (
  SELECT key, page_id * 10 AS tm, page_id * 2 AS record_id, digest, 'day ' || (page_id % 365) AS last_modified, length(html) AS n FROM keyed
), revisits AS (
  SELECT key, page_id * 10 + 10 * (1 + page_id % 97) + 5 AS tm, page_id * 2 + 1 AS record_id,
    CASE WHEN page_id % 7 = 0 THEN '"changed"' WHEN page_id % 7 < 4 THEN '"' || digest || '"' END AS etag,
    CASE WHEN page_id % 7 = 4 THEN 'day ' || (page_id % 365) END AS last_modified, CASE WHEN page_id % 7 = 5 THEN digest END AS digest
  FROM keyed
), met AS (
  SELECT v.*, r.record_id AS base_id, r.digest AS base_digest, r.last_modified AS base_modified, r.n,
    row_number() OVER (PARTITION BY v.record_id ORDER BY r.tm DESC, r.record_id DESC) AS k
  FROM revisits v LEFT JOIN responses r ON v.key = r.key AND r.tm < v.tm
), judged AS (
  SELECT *, CASE WHEN base_id IS NULL THEN 'no_base'
    WHEN etag IS NOT NULL THEN CASE WHEN etag = '"' || base_digest || '"' THEN 'match' ELSE 'mismatch' END
    WHEN last_modified IS NOT NULL THEN CASE WHEN last_modified = base_modified THEN 'match' ELSE 'mismatch' END
    WHEN digest IS NOT NULL THEN CASE WHEN digest = base_digest THEN 'match' ELSE 'mismatch' END
    ELSE 'no_validator' END AS outcome
  FROM met WHERE k = 1
)
SELECT record_id, base_id, outcome, CASE WHEN outcome = 'match' THEN
  'cache-control: max-age=3600; content-length: ' || n || '; content-type: text/html; date: ' || tm || '; expires: ' || (tm + 3600) END AS headers
FROM judged
"""


def op3_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.read_texts(ogg.store_texts(table(spark, sf_dir, "documents")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = subword.fit(documents, table(spark, sf_dir, "labels"))
    scored = subword.score(documents, model)
    return scored.select("doc_id", subword.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""


def op6_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as flat token files; each document's tokens as the separators bound them."""
    blocks, who = separators.write_flat(table(spark, sf_dir, "documents"))
    return separators.count_tokens(blocks).filter("closed").join(who, ["file", "ordinal"]).select("doc_id", "tokens")


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS h
  FROM documents
), hashed AS (
  SELECT doc_id, source, size, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2 FROM sized
), sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM hashed GROUP BY source),
weighed AS (
  SELECT source, source_size, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS w, 3 * source_size AS most FROM sizes
), leveled AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(most) OVER before, 0) AS DOUBLE) / CAST(sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS DOUBLE) AS level
  FROM weighed WINDOW before AS (ORDER BY CAST(most AS DOUBLE) / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), first AS (
  SELECT level AS share FROM leveled WHERE level * w <= most ORDER BY CAST(most AS DOUBLE) / w, source IS NULL, source LIMIT 1
), aimed AS (
  SELECT source, source_size, least(coalesce((SELECT share FROM first) * w, CAST(most AS DOUBLE)), CAST(most AS DOUBLE)) AS target FROM weighed
), rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM aimed),
met AS (SELECT h.*, r.source_size, r.target, r.rate, floor(r.rate) AS whole FROM hashed h JOIN rated r ON h.source IS NOT DISTINCT FROM r.source),
tried AS (
  SELECT source, k, sum(whole * size) + sum(CASE WHEN ((h1 + k * h2) % 4294967296) / CAST(4294967296 AS DOUBLE) < rate - whole THEN size ELSE 0 END) - any_value(target) AS off
  FROM met, range(16) AS t(k) GROUP BY source, k
), best AS (SELECT source, k FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY abs(off), k) AS n FROM tried) WHERE n = 1)
SELECT m.doc_id, m.size, m.source_size, m.target,
  CAST(m.size * (m.whole + CASE WHEN ((m.h1 + b.k * m.h2) % 4294967296) / CAST(4294967296 AS DOUBLE) < m.rate - m.whole THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM met m JOIN best b ON m.source IS NOT DISTINCT FROM b.source
"""


def op8_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart.near_copies(table(spark, sf_dir, "documents"))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"))
    scored = toxicity.score(documents, model)
    return scored.select("doc_id", subword.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_secret_scan, op2_not_modified, op3_ogg, op4_quality, op5_segment_topk, op6_separator_scan, op7_mix, op8_near_copies, op9_pack, op10_toxicity)
}
ORACLE_SQL: dict[str, str] = {"op2_not_modified": OP2_SQL, "op5_segment_topk": OP5_SQL, "op7_mix": OP7_SQL}
