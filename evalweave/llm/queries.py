"""The queries of the problems, over their whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.llm import lookalike, neardup, overlap, packing, pairs, quota, subjects, tokens
from evalweave.session import materialise, ship_package
from evalweave.sources.tables import first_per_key, table

TRAINING_KINDS = ("example", "feedback")
#: Vote patterns are numbers of five digits to the base of the subjects and one, in 32 bits.
MOST_SUBJECTS = 70


def _both(spark: SparkSession, d: str) -> DataFrame:
    """(id, text) of kb_hits and gold_items, one row per id."""
    kb = table(spark, d, "kb_hits", "id", "text", "ingested_at")
    gold = table(spark, d, "gold_items", "id", "text", "ingested_at")
    return first_per_key(kb.unionByName(gold).filter("id is not null and text is not null"), ["id"], ["ingested_at"], ["text"])


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_classes(table(spark, d, "kb_hits", "id", "text", "ingested_at"), order_col="ingested_at")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.class_pairs(materialise(p1_classes(spark, d), "p1-classes"))


def _training(spark: SparkSession, d: str) -> DataFrame:
    kb = table(spark, d, "kb_hits", "id", "kind", "text", "source", "ingested_at")
    return kb.filter(F.lower(F.trim("kind")).isin(*TRAINING_KINDS))


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    gold = table(spark, d, "gold_items", "id", "text", "ingested_at")
    return overlap.split_overlaps(gold, _training(spark, d).select("id", "text", "ingested_at"), order_col="ingested_at")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_pairs(spark, d).select("item_id", "hit_id")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    gold = table(spark, d, "gold_items", "id", "subset", "source", "ingested_at").filter("id is not null")
    items = first_per_key(gold, ["id"], ["ingested_at"], ["subset", "source"]).select(F.col("id").alias("item_id"), "subset", F.lower(F.trim("source")).alias("source"))
    hits = first_per_key(_training(spark, d).filter("id is not null"), ["id"], ["ingested_at"], ["source"])
    return overlap.overlap_report(p2_pairs(spark, d), items, hits.select(F.col("id").alias("hit_id"), F.lower(F.trim("source")).alias("hit_source")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    texts = materialise(_both(spark, d), "p3-texts")
    form = lookalike.ConsistentForm.fit(texts)
    return lookalike.lookalike_pairs(materialise(lookalike.lookalike_variants(texts, form), "p3-variants"))


def p3_forms(spark: SparkSession, d: str) -> DataFrame:
    """(id, form_hash, text_hash) of every record and item: equal-looking texts have equal form hashes."""
    texts = materialise(_both(spark, d), "p3-texts")
    form = lookalike.ConsistentForm.fit(texts)
    return texts.select("id", F.substring(F.sha2(form.column(F.col("text")), 256), 1, 16).alias("form_hash"), F.substring(F.sha2("text", 256), 1, 16).alias("text_hash"))


def _state(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "kb_hits", "id", "kind", "lang", "source"), table(spark, d, "sample_targets")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_report(spark, d).filter("not is_met").select("target_id")


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    return quota.sample(*_state(spark, d))[0]


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return quota.sample(*_state(spark, d))[1]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _defects(spark, d).select("run_id", "defect")


def _defects(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "run_results", "run_id", "item_id", "raw_outputs", "logged_at")
    return pairs.defective_answers(runs, table(spark, d, "gold_items", "id", "text", "ingested_at"))


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    """Defects by arm, each rule counted where it fired."""
    arms = table(spark, d, "run_results", "run_id", "arm").groupBy("run_id").agg(F.min("arm").alias("arm"))
    found = _defects(spark, d).select("run_id", F.explode("defects").alias("defect"))
    return found.join(arms, "run_id").groupBy("arm", "defect").agg(F.count("*").alias("n_runs"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(table(spark, d, "documents", "doc_id", "text"))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = tokens.token_counts(table(spark, d, "documents", "doc_id", "text")).select(F.col("doc_id").alias("item"), F.col("n_tokens").cast("long").alias("size"))
    limits = table(spark, d, "pack_limits", "limit_key", F.col("capacity_tokens").cast("long").alias("capacity"))
    return packing.pack(sizes, limits).withColumnRenamed("item", "doc_id").withColumnRenamed("size", "n_tokens")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(p7_packed(spark, d).withColumnRenamed("n_tokens", "size"))


def _areas(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text", "source")
    names = [r[0] for r in table(spark, d, "subjects", "subject").distinct().limit(MOST_SUBJECTS + 1).collect()]
    if len(names) > MOST_SUBJECTS:
        raise ValueError(f"more than {MOST_SUBJECTS} subjects")
    shares = subjects.subject_shares(docs, table(spark, d, "subject_labels", "doc_id", "subject"), names)
    return shares.filter(F.col("share") >= subjects.SHARE)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _areas(spark, d).select("doc_id", "subject")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subject_mix(_areas(spark, d), table(spark, d, "documents", "doc_id").count())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_classes, p2_found, p2_report, p3_found, p3_forms, p4_found, p4_sample, p4_report, p5_found, p5_rates, p6_ids, p7_packed, p7_report, p8_found, p8_mix)
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def shipped(f):
        def run(spark: SparkSession, d: str) -> DataFrame:
            ship_package(spark)
            return f(spark, d)

        return run

    return {k: shipped(f) for k, f in QUERIES.items()}
