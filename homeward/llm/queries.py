"""The registered queries of the corpus operators.

Five have checking SQL (``oracle``). DuckDB has none of the hash functions, models and merges
that the others rest on; tests compare those with brute force.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homeward.llm import (
    bpe, chosen_path, filter_audit, language, mixing, nn_descent, periodic, pii_crf, quality_model,
    quality_rules, secrets, shards, substrings,
)
from homeward.llm.common import WORD, n_words, table
from homeward.llm.oracle import ORACLE
from homeward.llm.quality_model import remainder


def ranks_path() -> str:
    import public_tokenizers

    return os.path.abspath(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def token_digest(docs: DataFrame) -> DataFrame:
    ranks = ranks_path()
    encoded = bpe.encode(docs.select("doc_id", "text"), ranks).drop("text")
    return bpe.decode(encoded, ranks).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(table(spark, sf_dir, "documents"))


def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nn_descent.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", "kept")


def op2_budget_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", *[F.col(f"mix.{c}") for c in ("size", "source_size", "target", "taken")])


def op3_count_min_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.without_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_ngram_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
               "kept", "score")
    return judged.select("doc_id", *[F.col(f"quality.{c}") for c in columns])


def op5_subword_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    labels = table(spark, sf_dir, "labels").filter(~held_out)
    model = quality_model.train(docs, labels.select("doc_id", F.col("quality").alias("label")))
    return quality_model.score(docs, model).select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op9_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.classes(table(spark, sf_dir, "documents"))


def op10_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 5) == 0
    filters = language.learn(docs.select("doc_id", "text", "lang").filter(~held_out))
    return language.predict(docs, filters).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


def op6_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda rank: F.size(F.filter("secrets.base", lambda s: s["rank"] == rank)).cast("long")
    return scanned.select(
        "doc_id",
        *[count(rank).alias(f"n_{kind}") for rank, kind in enumerate(secrets.KINDS[:3])],
        F.sha2(secrets.listed(F.col("secrets.base")), 256).alias("base_sha256"),
        secrets.listed(F.col("secrets.spans")).alias("spans"),
    )


def op8_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.shuffled(table(spark, sf_dir, "documents"), 24)
    return placed.select(
        "doc_id",
        shards.n_bytes(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        "place.law",
        "place.shard",
        "place.slot",
        "place.grown_shard",
    )


def op11_decision_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return filter_audit.audit(filter_audit.mask_counts(docs, labels))


def with_planted_period(docs: DataFrame) -> DataFrame:
    """(doc_id, text): from some word on, a tenth of the texts repeats a block; ids decide."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    ws = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    n, g = F.size("ws"), F.floor(F.col("h") / 10)
    a = F.col("a").cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    block = F.slice("ws", a + 1, F.col("p"))
    times = F.ceil((n - a) / F.col("p")).cast("int")
    planted = F.slice(F.concat(F.slice("ws", F.lit(1), a), F.flatten(F.array_repeat(block, times))), F.lit(1), n)
    return (
        docs.select("doc_id", "text", h.alias("h"))
        .withColumn("ws", F.when((F.col("h") % 10 == 0) & (n_words(F.col("text")) > 0), ws))
        .withColumn("a", F.when(n > 0, g % n))
        .withColumn("p", p)
        .select("doc_id", F.coalesce(F.array_join(planted, " "), "text").alias("text"))
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic(with_planted_period(table(spark, sf_dir, "documents")), out="found")
    # Quotients of words and periods are equal as doubles exactly if they are equal.
    ranked = F.transform("found.runs", lambda r: F.struct(
        (r["length"] / r["period"]).alias("exponent"), (-r["start"]).alias("start"),
        (-r["period"]).alias("period"), r["length"].alias("length"),
    ))
    lines = F.transform(
        "found.runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    )
    best = F.col("best")
    return found.withColumn("best", F.array_max(ranked)).select(
        "doc_id",
        F.size("found.runs").cast("long").alias("n_runs"),
        (-best["start"]).alias("start"),
        best["length"].alias("length"),
        (-best["period"]).alias("period"),
        F.floor(1000 * best["length"] / -best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("found.collapsed", 256).alias("collapsed_sha256"),
    )


def op13_skip_chain_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii_crf.find(docs, pii_crf.train(docs), "found")
    count = lambda rank: F.size(F.filter("found.base", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        "doc_id",
        *[count(rank).alias(f"n_{kind}") for rank, kind in enumerate(pii_crf.BASE)],
        F.sha2(pii_crf.listed(F.col("found.base")), 256).alias("base_sha256"),
        pii_crf.listed(F.col("found.spans")).alias("spans"),
    )


QUERIES = {
    "op1_nn_descent": op1_nn_descent,
    "op2_budget_mix": op2_budget_mix,
    "op3_count_min_repeats": op3_count_min_repeats,
    "op4_ngram_ratio": op4_ngram_ratio,
    "op5_subword_classifier": op5_subword_classifier,
    "op6_markov_secrets": op6_markov_secrets,
    "op8_external_shuffle": op8_external_shuffle,
    "op9_chosen_path": op9_chosen_path,
    "op10_language_filters": op10_language_filters,
    "op7_byte_bpe": op7_byte_bpe,
    "op11_decision_diagrams": op11_decision_diagrams,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_skip_chain_crf": op13_skip_chain_crf,
}

__all__ = ["ORACLE", "QUERIES"]
