"""The queries of this subpackage: thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cotraining, decontam, hadamard_clusters, html_diff, language_id, line_dedup, mixing, ngram_join, periodic_runs, pii_weak, quality_rules, secret_models, url_filters


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs)
    out = language_id.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", language_id.held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = cotraining.train(docs, _table(spark, sf_dir, "labels"))
    return cotraining.score_documents(docs.select("doc_id", "text", "source", "lang", "n_chars"), model).select("doc_id", "quality_score", "toxic_score", "kept")


#: The rules of op4: (host, path, verdict).
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filters.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.decontaminate(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"), any_length=True)
    return out.select("doc_id", "contaminated", "items")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii_weak.find_personal_data(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.expr(f"filter(base, s -> s.kind = '{kind}')")).cast("long").alias(f"n_{kind}") for kind in ("email", "ip", "card", "phone")]
    return out.select("doc_id", *counts, F.sha2(pii_weak.joined_spans("base"), 256).alias("base_sha256"), pii_weak.joined_spans(F.concat("base", "added")).alias("spans"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_diff.extract_main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared", "n_deleted")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hadamard_clusters.cluster_vectors(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=40, rounds=5)
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", hadamard_clusters.centroid_digest().alias("centroid_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.planted(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    best = periodic_runs.longest_run()
    return periodic_runs.find_runs(docs).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"), F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        periodic_runs.runs_digest().alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = secret_models.find_secrets(docs, secret_models.train(secret_models.label_samples(docs)))
    counts = [F.size(F.expr(f"filter(base, s -> s.kind = '{kind}')")).cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return out.select("doc_id", *counts, F.sha2(secret_models.joined_spans("base"), 256).alias("base_sha256"), secret_models.joined_spans(F.concat("base", "added")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_language_id": op2_language_id,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_url_filters": op4_url_filters,
    "op5_decontamination": op5_decontamination,
    "op6_mixing": op6_mixing,
    "op7_quality_rules": op7_quality_rules,
    "op8_pii": op8_pii,
    "op9_html_extraction": op9_html_extraction,
    "op10_ngram_join": op10_ngram_join,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_secrets": op13_secrets,
}
