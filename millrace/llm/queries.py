"""The registered queries of this subpackage: one opN_ query for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import collocations, decontamination, html_text, jaccard, langid, packing, periods, ppm, quality, redirects, repeats, sharding, warc


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.summary(_docs(spark, sf_dir).select("doc_id", "text"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_docs(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.contained_items(_docs(spark, sf_dir).select("doc_id", "text"), benchmark.select("item_id", "text"), short=True)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    held_out = langid.remainder(F.col("doc_id"), 5) == 0
    machines = langid.fit(docs.where(~held_out).select("doc_id", "text", "lang"))
    return langid.predict(docs, machines).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked_documents(_docs(spark, sf_dir).select("doc_id", "text"))


def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.scored(_docs(spark, sf_dir).select("doc_id", "text"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judged(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rows.select("doc_id", *("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), "base_failed", "kept")


def op10_virtual_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(_docs(spark, sf_dir), "doc_id", "text", 8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "map_version", "next_shard")


#: The words of a text, w, with those from a on replaced by a period of p words where crc32(doc_id) ends in 0.
PERIODIC_TEXT = r"""
    CASE WHEN crc32(CAST(doc_id AS STRING)) % 10 = 0 AND text IS NOT NULL THEN
        transform(array(filter(split(text, '[\\x20\\x09-\\x0D]+'), x -> x <> '')), w ->
            transform(array(named_struct('n', size(w), 'g', crc32(CAST(doc_id AS STRING)) div 10)), s -> CASE WHEN s.n > 0 THEN
                transform(array(named_struct('a', s.g % s.n, 'p', 1 + (s.n - s.g % s.n) div (3 + s.g % 8))), r ->
                    array_join(transform(sequence(0, s.n - 1), i -> w[CAST(IF(i < r.a, i, r.a + (i - r.a) % r.p) AS INT)]), ' '))[0]
            END)[0])[0]
    ELSE text END"""


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periods.periodic_runs(_docs(spark, sf_dir).select("doc_id", F.expr(PERIODIC_TEXT).alias("text")))
    top = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n")))
    return rows.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.period")).alias("period"),
        F.expr("1000 * top.length div -top.period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_docs(spark, sf_dir).select("lang", "text"), least=100, best=2000)


OP12_SQL = r"""
WITH pieces AS (
    SELECT lang, r, unnest(p) AS piece, generate_subscripts(p, 1) AS pn FROM (
        SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS r, regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p
        FROM documents)),
words AS (
    SELECT lang, r, pn, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (
        SELECT lang, r, pn, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces)),
next_words AS (
    SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4, lead(w, 4) OVER o AS w5
    FROM words WINDOW o AS (PARTITION BY r, pn ORDER BY i)),
phrases AS (
    SELECT lang, [w1] AS p, count(*) AS a FROM next_words GROUP BY ALL HAVING count(*) >= 100
    UNION ALL SELECT lang, [w1, w2], count(*) FROM next_words WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
    UNION ALL SELECT lang, [w1, w2, w3], count(*) FROM next_words WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
    UNION ALL SELECT lang, [w1, w2, w3, w4], count(*) FROM next_words WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
    UNION ALL SELECT lang, [w1, w2, w3, w4, w5], count(*) FROM next_words WHERE w5 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
longer AS (
    SELECT q.lang, q.p[s.i:s.i + k.k - 1] AS p, max(q.a) AS a
    FROM phrases q, range(1, 5) s(i), range(2, 5) k(k) WHERE k.k < len(q.p) AND s.i + k.k - 1 <= len(q.p) GROUP BY ALL),
cuts AS (
    SELECT c.lang, c.p, c.a, t.n, k.k, l.a AS l, r.a AS r, (1000::HUGEINT * c.a * t.n) // (l.a::HUGEINT * r.a) AS score
    FROM phrases c JOIN totals t USING (lang), range(1, 5) k(k)
    JOIN phrases l ON l.lang = c.lang AND l.p = c.p[1:k.k] JOIN phrases r ON r.lang = c.lang AND r.p = c.p[k.k + 1:]
    WHERE k.k < len(c.p)),
scored AS (
    SELECT c.*, array_to_string(c.p, ' ') AS phrase FROM cuts c LEFT JOIN longer b ON b.lang = c.lang AND b.p = c.p
    WHERE coalesce(b.a < c.a, true) QUALIFY row_number() OVER (PARTITION BY c.lang, c.p ORDER BY score, k) = 1)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scored) WHERE rank <= 2000
"""


URL_RULES = (
    redirects.Rule("allow", "com", "/"), redirects.Rule("block", "example.com", "/en/"), redirects.Rule("allow", "www.example.com", "/en/"),
    redirects.Rule("block", "net", "/es/"), redirects.Rule("block", "net", "/fr/"),
)


def op13_redirect_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redirects.verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_suffix_array_dedup, op2_best_fit_packing, op3_html_extraction, op4_benchmark_decontamination, op5_language_id, op6_ngram_jaccard_join, op7_warc_round_trip, op8_ppm_scores, op9_quality_rules, op10_virtual_slot_sharding, op11_periodic_runs, op12_phrase_collocations, op13_redirect_verdicts)
}
ORACLES: dict[str, str] = {"op12_phrase_collocations": OP12_SQL}
