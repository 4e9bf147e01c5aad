"""Agreement between runs, paired tests and resampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalweave.functions.stats import chi2_1_p, count_if, f1, mcnemar_p, normal_two_sided_p, ratio
from evalweave.operators.labels import MULTILABEL, TAXONOMY, severity_rank
from evalweave.operators.sampling import draw_number
from evalweave.operators.vote import valid

#: So many items of an evaluation set are sent to all executors; more are joined by shuffle.
BROADCAST_ITEMS = 100_000
#: Shuffles of one task.
BLOCK = 1250


def gate_units(runs: DataFrame) -> DataFrame:
    """(arm, dimension, unit, value): one unit an item, a value for each valid run."""
    return runs.filter(valid()).select("arm", F.lit("gate").alias("dimension"), F.col("item_id").alias("unit"), F.col("hate").cast("int").alias("value"))


def label_units(runs: DataFrame, dims: tuple[str, ...] = MULTILABEL) -> DataFrame:
    """One unit an item and label of the taxonomy, the value whether the run chose it."""
    pair = lambda d: lambda x: F.struct(F.lit(d).alias("dimension"), x.alias("label"), F.array_contains(F.coalesce(F.col(d), F.array().cast("array<string>")), x).cast("int").alias("value"))
    every = F.flatten(F.array(*[F.transform(F.array(*[F.lit(x) for x in TAXONOMY[d]]), pair(d)) for d in dims]))
    x = runs.filter(valid()).select("arm", "item_id", F.explode(every).alias("x"))
    return x.select("arm", "x.dimension", F.concat_ws("|", "item_id", "x.label").alias("unit"), "x.value")


def severity_units(runs: DataFrame) -> DataFrame:
    r = runs.filter(valid()).withColumn("value", severity_rank("severity")).filter("value is not null")
    return r.select("arm", F.lit("severity").alias("dimension"), F.col("item_id").alias("unit"), "value")


def alpha(units: DataFrame, ordinal: bool = False, by: tuple[str, ...] = ("arm", "dimension")) -> DataFrame:
    """Krippendorff's alpha per key; NULL where expected disagreement is zero. Units with one value are left out.

    Only counts of values by unit and by pair of categories are formed, never pairs of runs.
    """
    by = list(by)
    c = units.groupBy(*by, "unit", "value").agg(F.count("*").alias("k"))
    m = F.sum("k").over(Window.partitionBy(*by, "unit"))
    c = c.withColumn("m", m).filter("m > 1")
    o = c.select(*by, "unit", F.col("value").alias("a"), F.col("k").alias("ka"), "m").join(c.select(*by, "unit", F.col("value").alias("b"), F.col("k").alias("kb")), [*by, "unit"])
    o = o.groupBy(*by, "a", "b").agg(F.sum(F.col("ka") * (F.col("kb") - (F.col("a") == F.col("b")).cast("int")) / (F.col("m") - 1)).alias("o"))
    n_c = o.groupBy(*by, "a").agg(F.sum("o").alias("nc"))
    w = Window.partitionBy(*by).orderBy("a").rowsBetween(Window.unboundedPreceding, 0)
    n_c = n_c.withColumn("upto", F.sum("nc").over(w)).withColumn("n", F.sum("nc").over(Window.partitionBy(*by)))
    left = n_c.select(*by, "a", F.col("nc").alias("na"), F.col("upto").alias("ua"), "n")
    right = n_c.select(*by, F.col("a").alias("b"), F.col("nc").alias("nb"), F.col("upto").alias("ub"))
    grid = left.join(right, by).join(o, [*by, "a", "b"], "left").withColumn("o", F.coalesce("o", F.lit(0.0)))
    if ordinal:
        between = F.greatest("ua", "ub") - F.least(F.col("ua") - F.col("na"), F.col("ub") - F.col("nb")) - (F.col("na") + F.col("nb")) / 2
        delta = F.when(F.col("a") == F.col("b"), 0.0).otherwise(between * between)
    else:
        delta = (F.col("a") != F.col("b")).cast("double")
    s = grid.groupBy(*by).agg((F.sum(F.col("o") * delta) / F.first("n")).alias("do"), (F.sum(F.col("na") * F.col("nb") * delta) / (F.first("n") * (F.first("n") - 1))).alias("de"), F.first("n").alias("n_values"))
    n_units = c.groupBy(*by).agg(F.countDistinct("unit").alias("n_units"))
    return s.join(n_units, by).select(*by, "n_units", F.round("n_values").cast("long").alias("n_values"), F.when(F.col("de") > 0, 1 - F.col("do") / F.col("de")).alias("alpha"))


def gate_correct(voted: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, arm, truth, pred, ok) of scored gates; items without annotation are left out."""
    g = items.filter("gate is not null").select(F.col("id").alias("item_id"), F.col("gate").alias("truth"))
    return voted.filter("hate is not null").select("item_id", "arm", F.col("hate").alias("pred")).join(g, "item_id").withColumn("ok", F.col("pred") == F.col("truth"))


def paired(correct: DataFrame) -> DataFrame:
    """(arm_a, arm_b, item_id, ok_a, ok_b) for each two arms with the item in both: joined by item, few arms each."""
    a = correct.select("item_id", F.col("arm").alias("arm_a"), F.col("ok").alias("ok_a"), F.col("truth"), F.col("pred").alias("pred_a"))
    b = correct.select("item_id", F.col("arm").alias("arm_b"), F.col("ok").alias("ok_b"), F.col("pred").alias("pred_b"))
    return a.join(b, "item_id").filter("arm_a < arm_b")


def mcnemar(pairs: DataFrame) -> DataFrame:
    """Discordant counts and the exact p of each pair of arms."""
    a, b = F.col("ok_a"), F.col("ok_b")
    c = pairs.groupBy("arm_a", "arm_b").agg(count_if(a & b).alias("both_correct"), count_if(~a & ~b).alias("both_wrong"), count_if(a & ~b).alias("only_a"), count_if(~a & b).alias("only_b"))
    return c.withColumn("discordant", F.col("only_a") + F.col("only_b")).withColumn("p_value", mcnemar_p("only_a", "only_b"))


def resamples(n: DataFrame, b: int, seed: int = 0) -> DataFrame:
    """(b, pos): for each resample as many draws with replacement as there are items, positions from 1.

    ``n`` is one row with the number of items; draws are keyed hashes, so a resample is the same on any engine.
    """
    parts = int(n.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = n.select("n", F.explode(F.sequence(F.lit(1), F.lit(b))).alias("b")).repartition(parts, "b").select("n", "b", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i"))
    return x.select("b", (F.pmod(draw_number(F.concat_ws("-", F.col("b").cast("string"), F.col("i").cast("string")), seed), F.col("n")) + 1).alias("pos"))


def _sent(df: DataFrame, items: DataFrame) -> DataFrame:
    """``df``, broadcast if ``items`` are few: the draws are many and stay where they are made."""
    few = items.limit(BROADCAST_ITEMS + 1).count() <= BROADCAST_ITEMS
    return F.broadcast(df) if few else df.hint("merge")


def paired_bootstrap(pairs: DataFrame, b: int = 1000, seed: int = 0) -> DataFrame:
    """Of each pair of arms: the difference in gate macro-F1, its interval, spread and two-sided mid-p.

    Items are resampled first and scored after; both arms are scored on the same draws. A resample in which a class is
    absent has no score and is left out.
    """
    ids = pairs.select("item_id").distinct()
    pos = ids.withColumn("pos", F.row_number().over(Window.orderBy("item_id")))  # an evaluation set, not the corpus
    drawn = resamples(ids.agg(F.count("*").alias("n")), b, seed).groupBy("b", "pos").agg(F.count("*").alias("k"))
    x = drawn.join(_sent(pairs.join(pos, "item_id"), ids), "pos")
    t = F.col("truth")

    def cells(p: str) -> list[Column]:
        q = F.col(p)
        return [F.sum(F.when(c, F.col("k")).otherwise(0)).alias(f"{p}_{n}") for n, c in (("tp", t & q), ("fp", ~t & q), ("fn", t & ~q), ("tn", ~t & ~q))]

    s = x.groupBy("arm_a", "arm_b", "b").agg(*cells("pred_a"), *cells("pred_b"))
    macro = lambda p: (f1(F.col(f"{p}_tp"), F.col(f"{p}_fp"), F.col(f"{p}_fn")) + f1(F.col(f"{p}_tn"), F.col(f"{p}_fn"), F.col(f"{p}_fp"))) / 2
    s = s.filter((F.col("pred_a_tp") + F.col("pred_a_fn") > 0) & (F.col("pred_a_fp") + F.col("pred_a_tn") > 0)).withColumn("d", macro("pred_a") - macro("pred_b"))
    r = s.groupBy("arm_a", "arm_b").agg(F.count("*").alias("n_resamples"), F.percentile("d", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.stddev_samp("d").alias("sd"), count_if(F.col("d") > 0).alias("favour_a"), count_if(F.col("d") == 0).alias("ties"), count_if(F.col("d") < 0).alias("favour_b"))
    le, ge = (F.col("favour_b") + F.col("ties") / 2) / F.col("n_resamples"), (F.col("favour_a") + F.col("ties") / 2) / F.col("n_resamples")
    return r.select("arm_a", "arm_b", "n_resamples", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"), "sd", F.least(F.lit(1.0), 2 * F.least(le, ge)).alias("p_value"), "favour_a", "ties", "favour_b")


def label_survival(gold: DataFrame, b: int, min_support: int, seed: int = 0) -> DataFrame:
    """(n_labels, n_resamples): how many labels keep their support across resamples of ``gold(item_id, labels)``."""
    pos = gold.withColumn("pos", F.row_number().over(Window.orderBy("item_id")))
    drawn = resamples(gold.agg(F.count("*").alias("n")), b, seed).groupBy("b", "pos").agg(F.count("*").alias("k"))
    x = drawn.join(_sent(pos, gold), "pos").select("b", "k", F.explode("labels").alias("label")).groupBy("b", "label").agg(F.sum("k").alias("support"))
    kept = x.groupBy("b").agg(count_if(F.col("support") >= min_support).alias("n_labels"))
    return kept.groupBy("n_labels").agg(F.count("*").alias("n_resamples"))


def guideline_effect(retrieved: DataFrame, correct: DataFrame, shown_arm: str = "rag", base_arm: str = "zero_shot") -> DataFrame:
    """Per guideline and annotated side: accuracy with it in the prompt against the arm that never saw it, on the same items."""
    shown = retrieved.filter("bucket = 'guidelines'").select("item_id", F.col("hit_id").alias("guideline")).distinct()
    a = correct.filter(F.col("arm") == shown_arm).select("item_id", "truth", "ok")
    b = correct.filter(F.col("arm") == base_arm).select("item_id", F.col("ok").alias("base_ok"))
    j = shown.join(a, "item_id").join(b, "item_id", "left")
    g = j.groupBy("guideline", F.col("truth").alias("gold_hate")).agg(F.count("*").alias("n"), count_if(F.col("ok")).alias("correct"), F.count("base_ok").alias("n_paired"), count_if(F.col("base_ok")).alias("base_correct"))
    return g.withColumn("accuracy", ratio(F.col("correct"), F.col("n"))).withColumn("base_accuracy", ratio(F.col("base_correct"), F.col("n_paired"))).withColumn("delta", F.col("accuracy") - F.col("base_accuracy"))


def replicate_floor(scores: DataFrame, score: str = "score") -> DataFrame:
    """(arm, n, lowest, highest, mean, spread) over replicates and the widest spread of any arm."""
    s = scores.groupBy("arm").agg(F.count("*").alias("n"), F.min(score).alias("lowest"), F.max(score).alias("highest"), F.avg(score).alias("mean"))
    s = s.withColumn("spread", F.col("highest") - F.col("lowest"))
    return s.crossJoin(F.broadcast(s.agg(F.max("spread").alias("floor"))))


def variance_estimate(diffs: DataFrame, by: list[str]) -> DataFrame:
    """(delta, item_se, replicate_sd, total_se) of ``diffs(replicate, item_id, d)``: both sources of variance."""
    rep = diffs.groupBy(*by, "replicate").agg(F.avg("d").alias("m"), (F.stddev_samp("d") / F.sqrt(F.count("*"))).alias("se"))
    a = rep.groupBy(*by).agg(F.count("*").alias("n_replicates"), F.avg("m").alias("delta"), F.avg("se").alias("item_se"), F.coalesce(F.stddev_samp("m"), F.lit(0.0)).alias("replicate_sd"))
    return a.withColumn("total_se", F.sqrt(F.col("item_se") * F.col("item_se") + F.col("replicate_sd") * F.col("replicate_sd") / F.col("n_replicates")))


def pool_estimates(estimates: DataFrame, by: list[str]) -> DataFrame:
    """Inverse-variance pooling with Cochran's Q and I squared of ``estimates(delta, se)``."""
    w = 1 / (F.col("se") * F.col("se"))
    e = estimates.filter("se > 0").withColumn("w", w)
    p = e.groupBy(*by).agg(F.count("*").alias("k"), (F.sum(F.col("w") * F.col("delta")) / F.sum("w")).alias("pooled"), (1 / F.sqrt(F.sum("w"))).alias("pooled_se"), F.sum(F.col("w") * F.col("delta") * F.col("delta")).alias("_s"), F.sum("w").alias("_w"))
    p = p.withColumn("q", F.greatest(F.lit(0.0), F.col("_s") - F.col("_w") * F.col("pooled") * F.col("pooled"))).withColumn("z", F.col("pooled") / F.col("pooled_se"))
    p = p.withColumn("i2", F.when(F.col("q") > 0, F.greatest(F.lit(0.0), (F.col("q") - (F.col("k") - 1)) / F.col("q"))).otherwise(0.0))
    return p.drop("_s", "_w").withColumn("p_pooled", normal_two_sided_p("z")).withColumn("p_q_1df", chi2_1_p("q"))


def threshold_sweep(probs: DataFrame, thresholds: int = 20) -> DataFrame:
    """(arm, threshold, macro_f1, predicted_rate) of ``probs(arm, p, truth)`` over a grid."""
    c = probs.groupBy("arm", "p").agg(count_if(F.col("truth")).alias("pos"), count_if(~F.col("truth")).alias("neg"))  # distinct shares, not items
    x = c.select("*", F.explode(F.sequence(F.lit(1), F.lit(thresholds - 1))).alias("t")).withColumn("hit", F.col("p") >= F.col("t") / thresholds)
    s = x.groupBy("arm", "t").agg(*[F.sum(F.when(k, F.col(v)).otherwise(0)).alias(n) for n, k, v in (("tp", F.col("hit"), "pos"), ("fp", F.col("hit"), "neg"), ("fn", ~F.col("hit"), "pos"), ("tn", ~F.col("hit"), "neg"))])
    m = (f1(F.col("tp"), F.col("fp"), F.col("fn")) + f1(F.col("tn"), F.col("fn"), F.col("fp"))) / 2
    return s.select("arm", (F.col("t") / thresholds).alias("threshold"), m.alias("macro_f1"), ratio(F.col("tp") + F.col("fp"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("predicted_rate"))


def permutation_p(values: DataFrame, b: int = 10_000, seed: int = 0) -> DataFrame:
    """(observed, p_value, gradient, p_gradient, n_near, n_far, n_permutations) of ``values(value, band)``, bands from 1.

    Band membership is shuffled ``b`` times with the bands' sizes kept: how often the nearest band's mean, and its lead over
    the farthest band, come out as high as observed. Items of equal value are the same to a shuffle, so one draws how many
    of each value fall into a band (without replacement: a multivariate hypergeometric draw), never rows; every shuffle has
    its own generator by ``seed`` and number. No rows without a value in both bands.
    """
    spark = values.sparkSession
    v = values.filter("value is not null and band is not null")
    last = v.agg(F.max("band").alias("_last"))
    c = v.crossJoin(F.broadcast(last)).groupBy("value").agg(F.count("*").alias("n"), count_if(F.col("band") == 1).alias("near"), count_if(F.col("band") == F.col("_last")).alias("far"))
    one = c.agg(F.array_sort(F.collect_list(F.struct(F.col("value").cast("double").alias("value"), "n", "near", "far"))).alias("c")).filter("size(c) > 0")

    def shuffled(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for t, rows in zip(pdf["t"], pdf["c"]):
                value, n, near, far = (np.array([r[k] for r in rows]) for k in ("value", "n", "near", "far"))
                k, m = int(near.sum()), int(far.sum())
                if not k or not m or not (n > near).any():
                    continue
                seen, lead = value @ near / k, value @ near / k - value @ far / m
                hits = [0, 0]
                for i in range(t * BLOCK, min(b, (t + 1) * BLOCK)):
                    rng = np.random.default_rng([seed, i])
                    x = rng.multivariate_hypergeometric(n, k, method="marginals")
                    y = rng.multivariate_hypergeometric(n - x, m, method="marginals")
                    hits[0] += value @ x / k >= seen - 1e-12
                    hits[1] += value @ x / k - value @ y / m >= lead - 1e-12
                out.append((seen, lead, k, m, *map(int, hits)))
            yield pd.DataFrame(out, columns=["observed", "gradient", "n_near", "n_far", "as_near", "as_lead"])

    blocks = -(-b // BLOCK)
    x = spark.range(0, blocks, 1, blocks).select(F.col("id").cast("int").alias("t")).crossJoin(F.broadcast(one))
    x = x.mapInPandas(shuffled, "observed double, gradient double, n_near long, n_far long, as_near long, as_lead long")
    p = lambda c: (F.sum(c) + 1) / F.lit(b + 1.0)
    return x.groupBy("observed", "gradient", "n_near", "n_far").agg(p("as_near").alias("p_value"), p("as_lead").alias("p_gradient")).select("observed", "p_value", "gradient", "p_gradient", "n_near", "n_far", F.lit(b).alias("n_permutations"))
