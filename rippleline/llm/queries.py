"""The registered queries of these operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rippleline.llm import ann, bpe, changepoints, chat, langid, mixing, ngram_join, quality, runs, simhash, token_shards, toxicity, warc
from rippleline.llm.common import materialize, n_words, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("n"), mixing.text_tie(F.col("text")).alias("tie"))
    mixed = mixing.mix(materialize(sized, "sized"), size=F.col("n"), tie=F.col("tie"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.digest(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.with_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derivatives(table(spark, sf_dir, "pages"))
    return made.withColumn("record_sha256", F.sha2("record", 256)).drop("record")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.with_control_case(spark, table(spark, sf_dir, "conversations")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.assess(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(table(spark, sf_dir, "documents"))


def op12_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changepoints.of_vendors(table(spark, sf_dir, "sale_lines"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.with_components(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mixing, op2_token_shards, op3_simhash, op4_language_id, op5_warc, op6_chat, op7_toxicity, op8_neighbours, op9_bpe, op10_quality,
        op11_word_runs, op12_change_points, op13_ngram_join, pipeline,
    )
}

_OP1 = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS skey,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || left(md5(coalesce(text, '')), 15))::BIGINT AS tie, greatest(64, (count(*) OVER () + 1048575) // 1048576) AS salts
  FROM documents
), b AS (
  SELECT *, floor(4 * log2(size + 1.0))::INTEGER AS class,
         (('0x' || left(md5(coalesce(doc_id::VARCHAR, '') || ':' || tie), 8))::BIGINT % salts)::INTEGER AS salt
  FROM d
), s AS (
  SELECT skey, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM b GROUP BY skey
), w AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3)::INTEGER + 1]::BIGINT AS weight,
         3 * source_size AS cap
  FROM s
), r AS (
  SELECT *, sum(source_size) OVER ()::BIGINT
            - coalesce(sum(cap) OVER (ORDER BY source_size / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rest,
         (sum(weight) OVER (ORDER BY source_size / weight, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS open
  FROM w
), l AS (
  SELECT rest, open FROM r WHERE rest * weight <= cap * open ORDER BY source_size / weight, skey LIMIT 1
), t AS (
  SELECT skey, source_size,
         CASE WHEN r.rest * weight <= cap * r.open THEN l.rest * weight / l.open ELSE cap::DOUBLE END AS target,
         ('0x' || left(md5('42:' || skey), 12))::BIGINT / 281474976710656.0::DOUBLE AS u
  FROM r, l
), k AS (
  SELECT *, row_number() OVER (PARTITION BY skey ORDER BY class, salt, size, doc_id NULLS FIRST, tie) AS k FROM b
), c AS (
  SELECT doc_id, size, source_size, target, k, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate
  FROM k JOIN t USING (skey)
)
SELECT doc_id, size, source_size, target, (size * least(floor(k * rate + u) - floor((k - 1) * rate + u), 3))::BIGINT AS taken FROM c
"""

_OP6 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), made AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*)((\|[A-Za-z0-9_]+\|>|/?s>|/?INST\]|/?SYS>>))', '\1\\\2\3', 'g')) AS escaped,
         length(replace(replace(regexp_replace(role, '([<\[])(\\*)((\|[A-Za-z0-9_]+\|>|/?s>|/?INST\]|/?SYS>>))', '\1\\\2\3', 'g'), '\', '\-'), chr(10), '\n')) AS named
  FROM rows
), flat AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
         sum(12 + named + 1 + escaped + 11)::BIGINT AS formatted_chars
  FROM made GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM flat
"""

_OP12 = r"""
WITH RECURSIVE d AS (
  SELECT vendor_id, (shipped_at::DATE - DATE '1970-01-01')::BIGINT AS day, sum(quantity)::BIGINT AS total FROM sale_lines
  WHERE flag IN ('kept', 'swapped') AND quantity IS NOT NULL AND shipped_at IS NOT NULL GROUP BY ALL
), v AS (
  SELECT vendor_id, min(day) AS first, max(day) - min(day) + 1 AS n FROM d GROUP BY vendor_id
), g AS (
  SELECT vendor_id, first, n, unnest(range(n)) AS pos FROM v
), t AS (
  SELECT g.vendor_id, first, n, pos, coalesce(total, 0)::HUGEINT AS x FROM g LEFT JOIN d ON d.vendor_id IS NOT DISTINCT FROM g.vendor_id AND d.day = first + pos
), p AS (
  SELECT *, (sum(x) OVER w)::HUGEINT AS s, (sum(x * x) OVER w)::HUGEINT AS q FROM t WINDOW w AS (PARTITION BY vendor_id ORDER BY pos)
), a AS (
  SELECT vendor_id, first, n, [0::HUGEINT] || list(s ORDER BY pos) AS s, [0::HUGEINT] || list(q ORDER BY pos) AS q FROM p GROUP BY vendor_id, first, n
), r AS (
  SELECT vendor_id, first, n, s, q, 0::BIGINT AS j, [{'cost': 0::BIGINT, 'k': 0::BIGINT, 'i': 0::BIGINT}] AS b FROM a
  UNION ALL
  SELECT vendor_id, first, n, s, q, j + 1, list_append(b, list_min(list_transform(
    list_filter(range(j + 1), lambda i: (j + 1 - i >= 5 AND (i = 0 OR i >= 5)) OR (i = 0 AND j + 1 = n)),
    lambda i: {'cost': b[i + 1].cost + CASE WHEN i > 0 THEN 10000 ELSE 0 END + (j + 1 - i) * floor(1000 * ln((1 + ((j + 1 - i) * (q[j + 2] - q[i + 1]) - (s[j + 2] - s[i + 1]) * (s[j + 2] - s[i + 1])) // ((j + 1 - i) * (j + 1 - i)))::DOUBLE))::BIGINT, 'k': b[i + 1].k + 1, 'i': i})))
  FROM r WHERE j < n
), z AS (
  SELECT vendor_id, first, s, q, b, n AS e, b[n + 1].i AS st, b[n + 1].k AS no, b[n + 1].k AS n_segments, b[n + 1].cost AS best_cost FROM r WHERE j = n
  UNION ALL
  SELECT vendor_id, first, s, q, b, st, b[st + 1].i, no - 1, n_segments, best_cost FROM z WHERE st > 0
), y AS (
  SELECT *, e - st AS m, 1 + ((e - st) * (q[e + 1] - q[st + 1]) - (s[e + 1] - s[st + 1]) * (s[e + 1] - s[st + 1])) // ((e - st) * (e - st)) AS spread FROM z
)
SELECT vendor_id, no::INTEGER AS segment_no, first + st AS first_day, m AS n_days, (s[e + 1] - s[st + 1])::BIGINT AS total, spread::BIGINT AS spread,
       m * floor(1000 * ln(spread::DOUBLE))::BIGINT AS cost, n_segments, best_cost FROM y
"""

ORACLE_SQL: dict[str, str] = {"op1_mixing": _OP1, "op6_chat": _OP6, "op12_change_points": _OP12}
