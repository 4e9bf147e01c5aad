"""Scoring of voted predictions against annotations.

A dimension is scorable for an item only where it was annotated: NULL means never annotated, an empty list annotated and
empty. Items whose runs all failed are counted as unscored, not scored as negative.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalweave.functions.stats import count_if, f1, precision, ratio, recall
from evalweave.operators.labels import GOLD_COLUMN, MIN_SUPPORT, MULTILABEL, effective_gate, severity_rank


def gate_pairs(voted: DataFrame, items: DataFrame, mapping: str = "strict", lenient_source: str | None = None) -> DataFrame:
    """(item_id, arm, source, truth, pred, uncertain, confidence) of predictions on known items. NULL pred: unscored."""
    gold = items.select(F.col("id").alias("item_id"), "source", effective_gate(mapping, lenient_source).alias("truth"))
    conf = F.col("agreement_hate") if "agreement_hate" in voted.columns else F.lit(None).cast("double")
    return voted.select("item_id", "arm", F.col("hate").alias("pred"), "uncertain", conf.alias("confidence")).join(gold, "item_id").withColumn("mapping", F.lit(mapping))


def _confusion() -> list[Column]:
    t, p = F.col("truth"), F.col("pred")
    return [count_if(t & p).alias("tp"), count_if(~t & p).alias("fp"), count_if(t & ~p).alias("fn"), count_if(~t & ~p).alias("tn")]


def _macro(tp: str = "tp", fp: str = "fp", fn: str = "fn", tn: str = "tn") -> Column:
    a, b, c, d = F.col(tp), F.col(fp), F.col(fn), F.col(tn)
    return (f1(a, b, c) + f1(d, c, b)) / 2


def score_gate(pairs: DataFrame, by: tuple[str, ...] = ("arm", "mapping")) -> DataFrame:
    """Confusion counts, scores of both classes and macro-F1; NULL macro where only one class or nothing is annotated."""
    scored = F.col("truth").isNotNull() & F.col("pred").isNotNull()
    sure = pairs.withColumn("s", scored)
    agg = sure.groupBy(*by).agg(
        *[count_if(F.col("s") & c).alias(n) for n, c in _cells()],
        count_if(F.col("s")).alias("n_scored"),
        count_if(F.col("pred").isNull()).alias("n_unscored"),
        count_if(F.col("s") & F.col("uncertain")).alias("n_uncertain"),
        *[count_if(F.col("s") & c & ~F.col("uncertain")).alias(f"c_{n}") for n, c in _cells()],
    )
    both = (F.col("tp") + F.col("fn") > 0) & (F.col("fp") + F.col("tn") > 0)
    out = agg.withColumn("macro_f1", F.when(both, _macro()))
    out = out.withColumn("macro_f1_confident", F.when((F.col("n_uncertain") > 0) & (F.col("n_uncertain") < F.col("n_scored")), _macro("c_tp", "c_fp", "c_fn", "c_tn")))
    for name, (a, b, c) in {"hate": ("tp", "fp", "fn"), "not_hate": ("tn", "fn", "fp")}.items():
        x, y, z = F.col(a), F.col(b), F.col(c)
        out = out.withColumn(f"precision_{name}", precision(x, y)).withColumn(f"recall_{name}", recall(x, z)).withColumn(f"f1_{name}", f1(x, y, z))
    return out.drop("c_tp", "c_fp", "c_fn", "c_tn")


def _cells() -> list[tuple[str, Column]]:
    t, p = F.col("truth"), F.col("pred")
    return [("tp", t & p), ("fp", ~t & p), ("fn", t & ~p), ("tn", ~t & ~p)]


def gate_by_source(pairs: DataFrame, by: tuple[str, ...] = ("arm", "mapping", "source")) -> DataFrame:
    """False positive and negative rates; NULL where there is nothing to divide by."""
    s = pairs.filter("truth is not null and pred is not null").groupBy(*by).agg(F.count("*").alias("n"), *_confusion())
    benign, hateful = F.col("fp") + F.col("tn"), F.col("tp") + F.col("fn")
    return s.select(*by, "n", benign.alias("benign"), hateful.alias("hateful"), "fp", "fn", ratio(F.col("fp"), benign).alias("fp_rate"), ratio(F.col("fn"), hateful).alias("fn_rate"))


def label_pairs(voted: DataFrame, items: DataFrame, dims: tuple[str, ...] = MULTILABEL) -> DataFrame:
    """(item_id, arm, dimension, gold, pred) where the dimension is scorable; pred is NULL where unscored.

    Fine dimensions count only on items annotated as hateful, ``legal`` on all that it was annotated for.
    """
    gold = items.select(F.col("id").alias("item_id"), "gate", *[F.col(GOLD_COLUMN[d]).alias(f"g_{d}") for d in dims])
    j = voted.select("item_id", "arm", *dims, F.col("n_valid")).join(gold, "item_id")
    each = [
        F.struct(F.lit(d).alias("dimension"), F.when(F.lit(d == "legal") | F.coalesce("gate", F.lit(False)), F.array_distinct(F.col(f"g_{d}"))).alias("gold"), F.when(F.col("n_valid") > 0, F.array_distinct(F.col(d))).alias("pred"))
        for d in dims
    ]
    return j.select("item_id", "arm", F.explode(F.array(*each)).alias("x")).select("item_id", "arm", "x.*").filter("gold is not null")


def per_label(pairs: DataFrame, by: tuple[str, ...] = ("arm", "dimension"), min_support: int = MIN_SUPPORT) -> DataFrame:
    """One row per label seen in annotation or prediction: one explode of the union, no loop over labels."""
    s = pairs.filter("pred is not null").select(*by, "gold", "pred", F.explode(F.array_union("gold", "pred")).alias("label"))
    g, p = F.array_contains("gold", F.col("label")), F.array_contains("pred", F.col("label"))
    c = s.groupBy(*by, "label").agg(count_if(g & p).alias("tp"), count_if(~g & p).alias("fp"), count_if(g & ~p).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(*by, "label", "tp", "fp", "fn", (tp + fn).alias("support"), (tp + fp).alias("predicted"), precision(tp, fp).alias("precision"), recall(tp, fn).alias("recall"), f1(tp, fp, fn).alias("f1"), (tp + fn >= min_support).alias("averaged"))


def multilabel_summary(labels: DataFrame, by: tuple[str, ...] = ("arm", "dimension"), exclude: tuple[str, ...] = (), fixed: DataFrame | None = None) -> DataFrame:
    """Macro-F1 over supported labels (or over the ``fixed`` label table), micro-F1 over all of them.

    A fixed label absent from the sample is skipped, not scored as zero.
    """
    averaged = F.col("averaged")
    if fixed is not None:
        labels = labels.join(fixed.select(*[c for c in fixed.columns if c in labels.columns], F.lit(True).alias("_fixed")), [c for c in fixed.columns if c in labels.columns], "left")
        averaged = F.coalesce("_fixed", F.lit(False))
    if exclude:
        averaged = averaged & ~F.col("label").isin(*exclude)
    a = labels.groupBy(*by).agg(F.avg(F.when(averaged, F.col("f1"))).alias("macro_f1"), f1(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("micro_f1"), count_if(averaged).alias("n_averaged"), F.count("*").alias("n_labels"))
    return a


def multilabel_extras(pairs: DataFrame, labels: DataFrame, by: tuple[str, ...] = ("arm", "dimension")) -> DataFrame:
    """Exact matches, Hamming loss and what puts over-prediction in view."""
    g, p = F.col("gold"), F.col("pred")
    diff = F.size(F.array_except(g, p)) + F.size(F.array_except(p, g))
    a = pairs.groupBy(*by).agg(
        count_if(p.isNotNull()).alias("n_items"),
        count_if(p.isNull()).alias("n_unscored"),
        F.avg(F.when(p.isNotNull(), (diff == 0).cast("double"))).alias("subset_accuracy"),
        F.sum(F.when(p.isNotNull(), diff)).alias("_diff"),
        F.avg(F.when(p.isNotNull(), F.size(g))).alias("mean_gold_labels"),
        F.avg(F.when(p.isNotNull(), F.size(p))).alias("mean_pred_labels"),
        F.avg(F.when(p.isNotNull(), F.arrays_overlap(g, p).cast("double"))).alias("any_overlap_rate"),
        F.avg(F.when(p.isNotNull(), (F.size(F.array_except(g, p)) == 0).cast("double"))).alias("gold_subset_of_pred"),
    )
    n = labels.groupBy(*by).agg(F.count("*").alias("_labels"))
    return a.join(n, list(by), "left").withColumn("hamming_loss", ratio(F.col("_diff"), F.col("n_items") * F.greatest(F.coalesce("_labels", F.lit(1)), F.lit(1)))).drop("_diff", "_labels")


def severity_pairs(voted: DataFrame, items: DataFrame) -> DataFrame:
    gold = items.filter(F.coalesce("gate", F.lit(False)) & F.col("severity").isNotNull()).select(F.col("id").alias("item_id"), F.col("severity").alias("gold"))
    return voted.filter("n_valid > 0").select("item_id", "arm", F.col("severity").alias("pred")).join(gold, "item_id")


def score_severity(pairs: DataFrame, by: tuple[str, ...] = ("arm",), min_support: int = MIN_SUPPORT) -> DataFrame:
    """Ordinal scores: accuracy, macro-F1, mean absolute rank error, share within one rank."""
    g, p = severity_rank("gold"), severity_rank("pred")
    far = F.abs(g - p)
    a = pairs.groupBy(*by).agg(
        F.count("*").alias("n_items"),
        F.avg(F.coalesce((F.col("gold") == F.col("pred")).cast("double"), F.lit(0.0))).alias("accuracy"),
        count_if(F.col("pred").isNull()).alias("n_predicted_null"),
        F.avg(far.cast("double")).alias("mean_abs_rank_error"),
        F.avg((far <= 1).cast("double")).alias("within_one_accuracy"),
    )
    one = pairs.select(*by, F.when(F.col("gold").isNotNull(), F.array("gold")).alias("gold"), F.when(F.col("pred").isNotNull(), F.array("pred")).otherwise(F.array().cast("array<string>")).alias("pred"))
    return a.join(multilabel_summary(per_label(one, by, min_support), by).select(*by, "macro_f1"), list(by), "left")


def calibration_bins(pairs: DataFrame, by: tuple[str, ...] = ("arm",)) -> DataFrame:
    """Accuracy by vote share, the share rounded to three places."""
    s = pairs.filter("truth is not null and pred is not null and confidence is not null")
    return s.groupBy(*by, F.round("confidence", 3).alias("confidence")).agg(F.count("*").alias("n"), F.avg((F.col("truth") == F.col("pred")).cast("double")).alias("accuracy"))


def expected_calibration_error(bins: DataFrame, by: tuple[str, ...] = ("arm",)) -> DataFrame:
    weighted = F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")
    return bins.groupBy(*by).agg(weighted.alias("ece"), F.sum("n").alias("n"))


def honesty(results: DataFrame, by: tuple[str, ...] = ("arm",)) -> DataFrame:
    """How far the scores can be trusted: failures, repairs, ties, latency and the stamps behind them."""
    lat = F.aggregate(F.col("latencies"), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    return results.groupBy(*by).agg(
        F.count("*").alias("n_items"),
        F.sum("n_runs").alias("total_runs"),
        F.sum("parse_failures").alias("parse_failures"),
        ratio(F.sum("parse_failures"), F.greatest(F.sum("n_runs"), F.lit(1))).alias("parse_failure_rate"),
        F.sum("repairs").alias("repairs"),
        F.sum("normalisations").alias("normalisations"),
        count_if(F.col("uncertain")).alias("uncertain"),
        count_if(F.col("hate").isNull()).alias("no_prediction"),
        ratio(F.sum(lat), F.greatest(F.sum(F.greatest(F.size("latencies"), F.lit(0))), F.lit(1))).alias("mean_latency_s"),
        F.array_join(F.array_sort(F.collect_set(F.col("workers").cast("string"))), ",").alias("workers"),
        F.array_join(F.array_sort(F.collect_set("active_model")), ",").alias("models"),
        F.array_join(F.array_sort(F.collect_set("kb_version")), ",").alias("kb_versions"),
        F.array_join(F.array_sort(F.collect_set("prompt_version")), ",").alias("prompt_versions"),
    )


def annotated_and_scorable(items: DataFrame, dims: tuple[str, ...] = MULTILABEL) -> DataFrame:
    """(dimension, annotated, scorable, lost): annotated items and those the gate mask lets through."""
    each = [F.struct(F.lit(d).alias("dimension"), F.col(GOLD_COLUMN[d]).isNotNull().alias("a"), (F.col(GOLD_COLUMN[d]).isNotNull() & (F.lit(d == "legal") | F.coalesce("gate", F.lit(False)))).alias("s")) for d in dims]
    x = items.select(F.explode(F.array(*each)).alias("x")).select("x.*").groupBy("dimension").agg(count_if(F.col("a")).alias("annotated"), count_if(F.col("s")).alias("scorable"))
    return x.withColumn("lost", F.col("annotated") - F.col("scorable"))


def scorable_dimension(summary: DataFrame, order: tuple[str, ...] = MULTILABEL) -> DataFrame:
    """(arm, dimension): the first dimension with a supported label."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("dimension"))
    return summary.filter("n_averaged > 0").groupBy("arm").agg(F.min_by("dimension", place).alias("dimension"))


def top_two_share(labels: DataFrame) -> DataFrame:
    """(arm, dimension, top_two_share): what part of all errors the two worst labels hold."""
    w = Window.partitionBy("arm", "dimension").orderBy(F.desc("errors"), "label")
    e = labels.withColumn("errors", F.col("fp") + F.col("fn")).withColumn("r", F.row_number().over(w))
    return e.groupBy("arm", "dimension").agg(ratio(F.sum(F.when(F.col("r") <= 2, F.col("errors")).otherwise(0)), F.sum("errors")).alias("top_two_share"))
