"""The operators' queries over the synthetic tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunklake.llm import chat, decontamination, exact_dedup, langid, licenses, mixing, quality, sharding, simhash, suffix_dedup
from chunklake.llm.common import scratch_path

SHARDS = 24
SOURCE_WEIGHTS = (5, 2, 1)
EXTRA_CHAT = r"\### Assistant: </turn> ok"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out() -> Column:
    """Rows that nothing is learned from; a null doc_id counts as held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op1_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = mixing.mix(table(spark, sf_dir, "documents"), weights=SOURCE_WEIGHTS)
    return x.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_hierarchical_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out()))
    return langid.predict(docs, model).withColumn("held_out", held_out())


def op3_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.element_at(F.array(F.lit("user"), F.lit("assistant")), (F.col("id") + 1).cast("int")).alias("role"), F.lit(EXTRA_CHAT).alias("text"))
    return chat.read_back(chat.format_windows(turns.unionByName(extra)))


def op4_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark, scratch_path(spark, "digest-index"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = exact_dedup.decisions(table(spark, sf_dir, "documents"), index)
    index.close()
    return out


def op5_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs.where(~held_out()), labels.where(~held_out()))
    return quality.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_simhash_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.clustered(table(spark, sf_dir, "documents"), words_in_shingle=3, most=3)


def op7_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_manifest(table(spark, sf_dir, "documents"), SHARDS)


def op8_bm25_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_suffix_radix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removals(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pareto_mixing": op1_pareto_mixing,
    "op2_hierarchical_langid": op2_hierarchical_langid,
    "op3_chat_windows": op3_chat_windows,
    "op4_digest_index": op4_digest_index,
    "op5_pu_quality": op5_pu_quality,
    "op6_simhash_multi_index": op6_simhash_multi_index,
    "op7_bounded_ring": op7_bounded_ring,
    "op8_bm25_wand": op8_bm25_wand,
    "op9_license_join": op9_license_join,
    "op10_suffix_radix": op10_suffix_radix,
}

ORACLES: dict[str, str] = {
    # A system turn of more than 160 tokens is repeated up to its 156th word.
    "op3_chat_windows": r"""
        WITH t0 AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        t1 AS (
          SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4 AS tokens,
            length('<turn:' || replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '>' || replace(replace(text, '&', '&amp;'), '<', '&lt;') || '</turn>') + 1 AS size,
            length('<turn:system></turn>') + 1 + length(replace(replace(regexp_extract(text, '^[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){0,155}[^\x20\x09-\x0D]*'), '&', '&amp;'), '<', '&lt;')) AS shown
          FROM t0),
        t2 AS (
          SELECT *, first_value(role) OVER w AS role1, first_value(text) OVER w AS text1, first_value(shown) OVER w AS size1,
            row_number() OVER w AS place, coalesce(sum(tokens) OVER b, 0) // 192 AS cell, count(*) FILTER (WHERE tokens > 192) OVER w AS alone, tokens > 192 AS own
          FROM t1 WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING),
            b AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t3 AS (
          SELECT *, place = 1 OR (lag(cell) OVER w, lag(alone) OVER w, lag(own) OVER w) <> (cell, alone, own) AS opens,
            lag(tokens) OVER w AS n1, lag(tokens, 2) OVER w AS n2, lag(size) OVER w AS s1, lag(size, 2) OVER w AS s2,
            place = 2 AND role1 = 'system' AS f1, place = 3 AND role1 = 'system' AS f2
          FROM t2 WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
        t4 AS (SELECT *, opens AND place > 1 AND NOT f1 AND n1 <= 96 AS b1 FROM t3),
        t5 AS (SELECT *, b1 AND place > 2 AND NOT f2 AND n1 + n2 <= 96 AS b2 FROM t4)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
          CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
          sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
          CAST(sum(size + CASE WHEN opens AND place > 1 AND role1 = 'system' THEN size1 ELSE 0 END + CASE WHEN b1 THEN s1 ELSE 0 END + CASE WHEN b2 THEN s2 ELSE 0 END) AS BIGINT) AS formatted_chars,
          count(*) FILTER (WHERE opens) AS n_windows
        FROM t5 GROUP BY conv_id""",
    "op10_suffix_radix": r"""
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
        p AS (SELECT doc_id, b, unnest(range(1, octet_length(b) - 48)) AS i FROM d),
        w AS (SELECT doc_id, i, array_slice(b, i, i + 49) AS x FROM p),
        r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY x) AS low FROM w) WHERE low < doc_id),
        o AS (SELECT *, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 OR lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL THEN 1 ELSE 0 END AS opens FROM r),
        g AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o),
        s AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM g GROUP BY doc_id, run),
        k AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 1) AS low FROM s),
        h AS (SELECT doc_id, sum(z - a) AS gone, count(*) AS n, max(z) AS tail, list(struct_pack(low := low, a := a) ORDER BY a) AS pieces FROM k GROUP BY doc_id)
        SELECT d.doc_id, octet_length(b) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
          sha256(CASE WHEN n IS NULL THEN b ELSE list_reduce(list_transform(pieces, lambda q: CASE WHEN q.a > q.low THEN array_slice(b, q.low, q.a - 1) ELSE ''::BLOB END), lambda u, v: u || v)
            || CASE WHEN tail <= octet_length(b) THEN array_slice(b, tail, octet_length(b)) ELSE ''::BLOB END END) AS kept_sha256
        FROM d LEFT JOIN h USING (doc_id)""",
    "op4_digest_index": r"""
        WITH d AS (
          SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
          doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
}
