"""One prediction per item and arm from its sampled runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions.stats import count_if
from evalweave.operators.labels import MULTILABEL, severity_label, severity_rank

KEY = ("item_id", "arm")


def valid() -> Column:
    """A run that failed to parse has no opinion: it shrinks the pool and does not vote."""
    return ~F.coalesce(F.col("parse_failure"), F.lit(False)) & F.col("hate").isNotNull()


def label_votes(runs: DataFrame, dims: tuple[str, ...] = MULTILABEL) -> DataFrame:
    """(item_id, arm, dimension, label, c): valid runs that chose the label; repeats inside one run count once."""
    long = runs.filter(valid()).select(*KEY, F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.array_distinct(F.col(d)).alias("labels")) for d in dims])).alias("d"))
    return long.select(*KEY, "d.dimension", F.explode("d.labels").alias("label")).filter("label is not null").groupBy(*KEY, "dimension", "label").agg(F.count("*").alias("c"))


def vote(runs: DataFrame) -> DataFrame:
    """Majority gate (a tie is not hateful, and uncertain), strict-majority labels, lower-median severity.

    The gate clears target group, hate type and severity, never ``legal``. ``hate`` is NULL where every run failed.
    Runs are aggregated once by item and arm; the labels join on the same key.
    """
    base = _base(runs)
    n = base.select(*KEY, "n_valid")
    per = label_votes(runs).join(n, list(KEY)).groupBy(*KEY).agg(
        *[F.array_sort(F.collect_list(F.when((F.col("dimension") == d) & (F.col("c") * 2 > F.col("n_valid")), F.col("label")))).alias(d) for d in MULTILABEL],
        *[F.min(F.when(F.col("dimension") == d, F.col("c") / F.col("n_valid"))).alias(f"least_{d}") for d in MULTILABEL],
    )
    j = base.join(per, list(KEY), "left")
    some, hateful = F.col("n_valid") > 0, F.col("yes") * 2 > F.col("n_valid")
    empty = F.array().cast("array<string>")
    out = {
        "hate": F.when(some, hateful),
        "uncertain": some & (F.col("yes") * 2 == F.col("n_valid")),
        "severity": F.when(some & hateful, severity_label(F.col("rank"))),
        "agreement_hate": F.when(some, F.greatest(F.col("yes"), F.col("n_valid") - F.col("yes")) / F.col("n_valid")),
        "agreement_severity": F.when(some, F.when(F.col("n_severity") > 0, F.col("n_severity") / F.col("n_valid")).otherwise(1.0)),
        "reasoning": F.when(hateful, F.coalesce("r_yes", "r_any")).otherwise(F.coalesce("r_no", "r_any")),
    }
    for d in MULTILABEL:
        labels = F.coalesce(F.col(d), empty)
        out[d] = F.when(some, labels if d == "legal" else F.when(hateful, labels).otherwise(empty))
        out[f"agreement_{d}"] = F.when(some, F.coalesce(f"least_{d}", F.lit(1.0)))
    voted = j.select(*KEY, "n_runs", "n_valid", *[c.alias(k) for k, c in out.items()], *[f"any_{d}" for d in MULTILABEL])
    dropped = F.array_compact(F.array(*[F.when((F.col(f"any_{d}") == 1) & (F.size(d) == 0), F.lit(d)) for d in MULTILABEL]))
    return voted.withColumn("dropped", F.when(F.col("n_valid") > 0, dropped)).drop(*[f"any_{d}" for d in MULTILABEL])


def _base(runs: DataFrame) -> DataFrame:
    r = runs.withColumn("ok", valid()).withColumn("rank", severity_rank("severity"))
    yes = F.col("ok") & F.col("hate")
    return r.groupBy(*KEY).agg(
        F.count("*").alias("n_runs"),
        count_if(F.col("ok")).alias("n_valid"),
        count_if(yes).alias("yes"),
        F.expr("percentile_disc(0.5) within group (order by case when ok then rank end)").cast("int").alias("rank"),
        count_if(F.col("ok") & F.col("rank").isNotNull()).alias("n_severity"),
        F.min_by("reasoning", F.when(yes, F.col("run_idx"))).alias("r_yes"),
        F.min_by("reasoning", F.when(F.col("ok") & ~F.col("hate"), F.col("run_idx"))).alias("r_no"),
        F.min_by("reasoning", F.when(F.col("ok"), F.col("run_idx"))).alias("r_any"),
        *[F.max(F.coalesce(F.col("ok") & (F.size(d) > 0), F.lit(False)).cast("int")).alias(f"any_{d}") for d in MULTILABEL],
    )


def single_run_view(runs: DataFrame, run_index: int = 0) -> DataFrame:
    """Predictions as if one run had been sampled: no tie is possible, a failed run is no prediction."""
    r = runs.filter(F.col("run_idx") == run_index).withColumn("ok", valid())
    pick = [F.when(F.col("ok"), F.col(c)).alias(c) for c in ("hate", *MULTILABEL, "severity", "reasoning")]
    return r.select(*KEY, F.lit(1).cast("long").alias("n_runs"), F.col("ok").cast("long").alias("n_valid"), F.lit(False).alias("uncertain"), *pick)


def revote_changes(voted: DataFrame, stored: DataFrame) -> DataFrame:
    """(item_id, arm, old_hate, new_hate) where a new vote over the stored runs differs from the stored prediction."""
    j = voted.select(*KEY, F.col("hate").alias("new_hate")).join(stored.select(*KEY, F.col("hate").alias("old_hate")), list(KEY))
    return j.filter(~F.col("new_hate").eqNullSafe(F.col("old_hate")))


def agreement_all_runs(runs: DataFrame) -> DataFrame:
    """(item_id, arm, all_agree) over valid runs: whether every one gave the same gate."""
    return runs.filter(valid()).groupBy(*KEY).agg((F.min("hate") == F.max("hate")).alias("all_agree"), F.count("*").alias("n_valid"))
