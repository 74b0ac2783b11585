"""The registered queries opN_<name>, each over its whole table, and their SQL."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .common import documents, new_path

#: Vocabulary file of the token queries (a parameter of the operators).
BYTE_BPE = "byte_bpe_50k.json"
END_ID = 2
SEPARATOR = 50256


def _tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path(BYTE_BPE)


def op1_elias_fano(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_token_files, write_token_files
    folder = write_token_files(documents(spark, sf_dir), new_path(spark, "token-files"), _tokenizer(), END_ID)
    return read_token_files(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32", "ordinal")


def op2_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .gear_chunks import report
    return report(documents(spark, sf_dir))


def op3_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrase_index import contaminated, occurrences
    found = occurrences(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.withColumn("contaminated", contaminated()).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .separator_scan import named_counts, write_flat_files
    folder = write_flat_files(documents(spark, sf_dir), new_path(spark, "flat-files"), _tokenizer(), SEPARATOR)
    return named_counts(spark.read.parquet(folder), SEPARATOR).select(
        "doc_id", "n_tokens", "file", "ordinal", "start", "terminated")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import hex16, near_duplicates
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", hex16("fp").alias("fingerprint"), "component_id")


def op6_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .best_fit import best_fit
    return best_fit(documents(spark, sf_dir))


def op7_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shards import assign
    return assign(documents(spark, sf_dir))


def op8_deobfuscate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .deobfuscate import held_out, toxic, train, with_score
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = with_score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", toxic(F.col("score")).cast("int").alias("predicted"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import report
    return report(documents(spark, sf_dir))


def op10_order_min_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .order_min_hash import as_text, likeness, with_edited
    return with_edited(documents(spark, sf_dir)).select(
        "doc_id", "n_chars", "edited_sha256", as_text("sig").alias("fingerprint"), as_text("edited_sig").alias("edited_fingerprint"),
        likeness("sig", "edited_sig").alias("near_edited"), likeness("sig", "next_sig").alias("near_next"))


def op11_pivotal_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import TYPO_EVERY, variants
    return variants(documents(spark, sf_dir), typo_every=TYPO_EVERY)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import report
    return report(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def planted_run(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a text with the periodic tail that its doc_id asks for (null: none)."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic_runs import periodic_runs
    found = periodic_runs(documents(spark, sf_dir), edit=planted_run)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("minus"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    top = found.withColumn("best", best)
    return top.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
                      (-F.col("best.minus")).alias("length"), F.col("best.period").alias("period"),
                      F.expr("1000 * -best.minus div best.period").alias("exponent_milli"),
                      F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_elias_fano, op2_gear_chunks, op3_phrase_index, op4_separator_scan, op5_simhash, op6_best_fit,
                                    op7_balanced_shards, op8_deobfuscate, op9_license_scan, op10_order_min_hash,
                                    op11_pivotal_grams, op12_line_dedup, op13_periodic_runs)}


_WORDS_SQL = (r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
              r" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

OP3_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_WORDS_SQL}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_SQL} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') AS k
        FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
p AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
hit AS (SELECT DISTINCT rid, s, p.n, item FROM p JOIN win ON win.n = p.n AND k = array_to_string(w[s:s + p.n - 1], ' ')),
cov AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS q FROM hit) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN it USING (rid)"""


def oracle_sql() -> dict:
    return {"op3_phrase_index": OP3_SQL, "op11_pivotal_grams": oracles.OP11_SQL, "op12_line_dedup": oracles.OP12_SQL,
            "op13_periodic_runs": oracles.OP13_SQL}
