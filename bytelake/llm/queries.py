"""Queries op1 to op10 and the pipeline, with production parameters, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelake.llm.common import crc32_mod, load, written


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bytelake.llm.packing import pack

    pieces = pack(load(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "window", "step_group")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bytelake.llm.token_counts import token_counts

    return token_counts(load(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bytelake.llm.line_dedup import dedup_lines

    kept = dedup_lines(load(spark, sf_dir, "documents").select("doc_id", "text"), counts=("n_lines", "n_dropped"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bytelake.llm.near_dedup import near_duplicates

    return near_duplicates(load(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bytelake.llm.decontam import leaks

    return leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op6_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bytelake.llm.ctw import score_texts

    return score_texts(load(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bytelake.llm.html_text import extract

    return extract(load(spark, sf_dir, "pages"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bytelake.llm.warc import archives, records

    stored = written(archives(load(spark, sf_dir, "pages")), "warc")
    return records(stored, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


OP8_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS x FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, max(page_id) OVER (PARTITION BY payload) AS last,
             array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 1 + (((('0x' || substr(x, 5 * (i // 4)::INT + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31)), 1)), '') AS digest FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to, NULL::VARCHAR AS error
FROM d
"""


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bytelake.llm.toxicity import score, train, training_rows

    docs = load(spark, sf_dir, "documents")
    scored = score(docs, train(training_rows(docs), load(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc32_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted", F.size("spans").cast("long").alias("n_spans"), F.get("spans", F.lit(0))["start"].alias("first_offset"))


def op10_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bytelake.llm.flac import describe, store

    return describe(store(load(spark, sf_dir, "documents")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


#: The masks of decontam, as offsets of the compared tokens.
OP5_SQL = r"""
WITH doc AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
item AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
mask(m, span, o) AS (VALUES (0, 8, [1, 2, 4, 5, 7, 8]), (1, 7, [1, 2, 3, 5, 6, 7]), (2, 7, [1, 2, 3, 4, 6, 7])),
doc_seed AS (SELECT doc_id, m, p, array_to_string(list_transform(o, lambda k: w[p + k]), ' ') AS seed
             FROM (SELECT *, unnest(range(greatest(len(w) - span + 1, 0))) AS p FROM doc, mask)),
item_seed AS (SELECT item_id, m, p, array_to_string(list_transform(o, lambda k: w[p + k]), ' ') AS seed
              FROM (SELECT *, unnest(range(greatest(len(w) - span + 1, 0))) AS p FROM item, mask)),
place AS (SELECT DISTINCT doc_id, item_id, d.p - i.p AS start FROM doc_seed d JOIN item_seed i USING (m, seed)),
counted AS (SELECT doc_id, item_id, start, len(item.w) AS n,
                   list_sum(list_transform(range(1, len(item.w) + 1), lambda k: CASE WHEN start + k >= 1 AND doc.w[start + k] = item.w[k] THEN 1 ELSE 0 END)) AS m
            FROM place JOIN doc USING (doc_id) JOIN item USING (item_id))
SELECT doc_id, item_id, max(m)::BIGINT AS n_matched, first(n ORDER BY m DESC, start)::BIGINT AS item_tokens, first(start ORDER BY m DESC, start)::BIGINT AS start
FROM counted WHERE m >= ceil(0.6 * n) OR m >= 20 GROUP BY doc_id, item_id
"""


OP3_SQL = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents),
keyed AS (
    SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM lines),
shared AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT doc_id, pos, line, keeper IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def queries() -> dict:
    return {"op1_packing": op1_packing, "op2_token_counts": op2_token_counts, "op3_line_dedup": op3_line_dedup, "op4_near_dedup": op4_near_dedup, "op5_decontamination": op5_decontamination, "op6_ctw": op6_ctw, "op7_html_text": op7_html_text, "op8_warc": op8_warc, "op9_toxicity": op9_toxicity, "op10_flac": op10_flac, "pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": OP3_SQL, "op5_decontamination": OP5_SQL, "op8_warc": OP8_SQL}
