"""One thin query per training-data operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom_lm, main_text, mixing, packing, rp_forest, simhash, substring_dedup, toxicity, transport_stream, url_filter

URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    stored = transport_stream.encode(docs).select("doc_id", "n_bytes", "media")
    read = transport_stream.decode(stored)
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(
            ";",
            F.format_string("program=%d", "program"),
            F.format_string("pmt=%d", "program_pid"),
            F.format_string("pid=%d", "stream_pid"),
            F.format_string("type=%d", "stream_type"),
            F.format_string("packets=%d", "packets"),
            F.format_string("errors=%d", F.col("sync_errors") + F.col("continuity_errors")),
            F.format_string("pes=%d", F.size("pts")),
            F.format_string("last_pts=%d", F.array_max("pts")),
            F.format_string("access=%d", F.size("access_points")),
        ).alias("feature"),
    )


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = toxicity.fit_on(docs, table(spark, sf_dir, "labels"))
    held_out = bloom_lm.in_part(F.col("doc_id"), 4, 2).alias("held_out")
    return toxicity.score(docs, net).select("doc_id", held_out, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.nearest(table(spark, sf_dir, "embeddings"), k=10, every=100)


def source_domain() -> Column:
    """Sources end in a number; the domains of the tree are its remainders."""
    number = F.try_to_number(F.regexp_extract("source", r"(\d{1,9})$", 1), F.lit("999999999"))
    return F.concat(F.lit("domain"), F.pmod(number, F.lit(4)).cast("int"))


MIX = mixing.Weights({"domain0": 0.4, "domain1": 0.3, "domain2": 0.2, "domain3": 0.1}, {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}, {}, 1.0)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    mixed = mixing.mix(docs, MIX, source_domain(), share=1.2, max_epochs=4)
    return mixed.select("doc_id", "domain", "lang", "source", "epoch", "n_tokens", "take_tokens")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file; the workers read it there too."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), capacity=1024, end_id=0)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"), width=20)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, budget=2)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_bloom_lm": op2_bloom_lm,
    "op3_rp_forest": op3_rp_forest,
    "op4_mixing": op4_mixing,
    "op5_url_filter": op5_url_filter,
    "op6_packing": op6_packing,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_transport_stream": op8_transport_stream,
    "op9_simhash": op9_simhash,
    "op10_main_text": op10_main_text,
    "pipeline": pipeline,
}

_HOST = "translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"

# Windows are compared by their words, here joined by spaces, which no word holds.
_REPEATS = """
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
    g AS (SELECT doc_id, p, array_to_string(ws[p:p + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS p FROM d WHERE len(ws) >= 20)),
    m AS (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS n FROM g),
    gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM m WHERE n > 1),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
    r AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
    SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(r.n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id) LEFT JOIN kept USING (doc_id)"""

ORACLES: dict[str, str] = {
    "op7_substring_dedup": _REPEATS,
    "op5_url_filter": f"""
        WITH p AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
        r AS (SELECT * FROM (VALUES {", ".join(f"('{v}', '{t}', '{t[: t.find('/')]}', '{t[t.find('/') :]}')" for v, t in URL_RULES)}) AS r(verdict, rule, rhost, rpath)),
        f AS (SELECT p.*, r.rule, r.verdict, row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.rule) DESC NULLS LAST, length(r.rhost) DESC) AS k
              FROM p LEFT JOIN r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE k = 1""",
}
