"""The registered queries of the text operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, line_dedup, main_text, mixing, phrases, quality_rules, secret_scan, sharding, simhash, surrogates, token_files, toxicity
from .common import new_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.item_id", "m.distance", "m.start", "m.stop")


@query
def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = main_text.extract(table(spark, sf_dir, "pages"))
    return text.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


#: The key is a secret of who runs the job; this one is for the registered query only.
SURROGATE_KEY = b"registered-query"


@query
def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = surrogates.checked(table(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY)
    kinds = F.array_distinct(F.transform("surrogate.found", lambda f: f["kind"]))
    return found.select("doc_id", F.col("surrogate.text").alias("text"), F.size("surrogate.found").cast("long").alias("n_entities"), F.array_join(F.array_sort(kinds), ",").alias("kinds"))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    t = F.col("toxicity")
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), t["score"].alias("score"), (t["score"] >= 0.5).cast("int").alias("predicted"), t["neighbours"].alias("neighbours"), t["evidence"].alias("evidence")
    )


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    c = F.col("counts")
    return quality_rules.judge(docs, rules).select(
        "doc_id", *[c[n].alias(n) for n in quality_rules.COUNTS[:5]], quality_rules.base_failed(c).alias("base_failed"), "kept", "rule"
    )


@query
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    # The sign bit makes hex() print all 16 digits of negative numbers only; the others are padded.
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    base, every = F.col("found.base"), F.concat("found.base", "found.entropy")

    def number(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(number, ("assign", "access", "hex")), F.sha2(secret_scan.listed(base), 256).alias("base_sha256"), secret_scan.listed(every).alias("spans"))


ORACLE_SQL["op6_secret_scan"] = secret_scan.oracle_sql()


@query
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_folder(spark, "token-files")
    token_files.write_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_digests(spark, path)


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.weigh(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", "mix.*")
    return mix.withColumns({c: F.round(c, 6) for c in ("weight", "probability")})


ORACLE_SQL["op8_mixing"] = mixing.oracle_sql()


@query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


@query
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.without_repeated(docs, line_dedup.build(docs))
    return kept.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2("lines.text", 256).alias("kept_sha256"))


ORACLE_SQL["op11_line_dedup"] = line_dedup.oracle_sql()


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


ORACLE_SQL["op12_source_divergence"] = divergence.oracle_sql()


@query
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL["op13_phrases"] = phrases.oracle_sql()
