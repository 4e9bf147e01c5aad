"""Problem 4: a sample whose categories have given shares.

Method: every id gets a fixed random priority; the reservoir of a category holds its ids of lowest priority. In one pass
over the ids, dealt to partitions by hash, each partition counts every category and keeps a reservoir that holds its part
of what the category can be asked for, with slack. Counts add up and reservoirs merge by union. After the final counts the
merged reservoirs are trimmed uniformly, by priority, to feasible quotas: whole priority buckets below the cut are taken,
the ids of the cut's own bucket are ranked. No category, however large, is sorted or gathered in one task, and what is
stored is about the size of the sample.

That no reservoir was too small is checked on the merged state (a partition that dropped ids must have kept all below the
cut); should it fail, the pass is made again with twice the slack.

A category with fewer ids than its quota is exhausted: all its ids are drawn and the others keep their quotas, so the
report gives both the share of the planned sample and that of the sample drawn.

Odd input: a NULL id is no row; an id counts once, in every category that one of its rows falls in; a NULL kind, lang or
source matches only "any"; ties of priority go by id; an empty table leaves every target with min_rows or a share above 0
unmet; of targets with the same target_id one counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalweave.operators.sampling import HEX, draw_number
from evalweave.session import materialise

FIELDS = ("kind", "lang", "source")
BUCKET_BITS = 14
MOST_TARGETS = 10_000


def _clean(df: DataFrame, fields: tuple[str, ...]) -> list:
    return [F.lower(F.trim(F.col(c).cast("string"))).alias(c) for c in fields]


def _plan(targets: DataFrame, fields: tuple[str, ...]) -> list[dict]:
    """The targets, one per target_id; a small table of settings."""
    wanted = targets.filter("target_id is not null").dropDuplicates(["target_id"]).select("target_id", "plan_key", F.coalesce("sample_share", F.lit(0.0)).alias("sample_share"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("min_rows", F.lit(0)).alias("min_rows"), *[c.alias(f"t_{f}") for c, f in zip(_clean(targets, fields), fields)])
    plan = [r.asDict() for r in wanted.limit(MOST_TARGETS + 1).collect()]
    if len(plan) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets: split the plan")
    return plan


def _holds(p: dict, fields: tuple[str, ...]):
    ok = F.lit(True)
    for f in fields:
        if p[f"t_{f}"] is not None:
            ok = ok & F.coalesce(F.col(f) == F.lit(p[f"t_{f}"]), F.lit(False))
    return ok


def reservoirs(records: DataFrame, targets: DataFrame, id_col: str = "id", fields: tuple[str, ...] = FIELDS, seed: int = 7, slack: float = 8.0) -> DataFrame:
    """(part, target_id, id, p, n, top): the mergeable state, as a stored table.

    Rows with an id are of a reservoir; those without carry a partition's count ``n`` of the target's distinct ids and, if
    the reservoir dropped some, its highest kept priority ``top``. The row without a target counts all ids.
    """
    plan = _plan(targets, fields)
    rows = records.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), *_clean(records, fields))
    # each row's targets as an array built from the plan: a projection, not a join
    hits = [F.when(_holds(t, fields), F.lit(i)) for i, t in enumerate(plan)] or [F.lit(None).cast("int")]
    rows = rows.select("id", F.array_compact(F.array(*hits)).alias("hits"))
    each = rows.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_set("hits"))).alias("hits")).select("id", draw_number(F.col("id"), seed).alias("p"), "hits")

    def keep(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        held: list[list[pd.DataFrame]] = [[] for _ in plan]
        for pdf in it:
            n += len(pdf)
            lengths = pdf["hits"].map(len).to_numpy()
            hit = np.concatenate(pdf["hits"].to_list()) if lengths.sum() else np.zeros(0, int)
            at = np.repeat(np.arange(len(pdf)), lengths)
            for i in np.unique(hit):
                held[i].append(pdf.iloc[at[hit == i]][["id", "p"]])
        yield pd.DataFrame({"part": [part], "target_id": pd.array([None], "Int64"), "id": [None], "p": pd.array([None], "Int64"), "n": [n], "top": pd.array([None], "Int64")})
        for t, mine in zip(plan, held):
            if mine:
                own = pd.concat(mine).sort_values(["p", "id"])
                # the partition's part of the largest quota that its ids can add up to
                fair = t["target_share"] * t["sample_share"] * n
                room = int(fair + slack * (fair**0.5 + 4)) + t["min_rows"]
                kept = own.iloc[:room].assign(part=part, target_id=t["target_id"], n=0, top=pd.NA)
                yield kept[["part", "target_id", "id", "p", "n", "top"]]
                top = int(kept["p"].iloc[-1]) if len(own) > room and len(kept) else pd.NA
                yield pd.DataFrame({"part": [part], "target_id": [t["target_id"]], "id": [None], "p": pd.array([None], "Int64"), "n": [len(own)], "top": pd.array([top], "Int64")})

    return materialise(each.mapInPandas(keep, "part int, target_id long, id string, p long, n long, top long"), "p4-reservoirs")


def quotas(state: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target: sample_n, available, needed, quota (feasible), is_met, planned_share, achieved_share.

    needed = max(min_rows, target_share * n) with n = floor(sample_share * number of ids); the wish is needed rounded to
    whole rows, never below min_rows; the quota is the smaller of wish and available. planned_share is the quota's share
    of n, achieved_share its share of what is drawn for all targets of the plan; NULL where nothing is.
    """
    counts = state.filter("id is null").groupBy("target_id").agg(F.sum("n").alias("available"))
    n_ids = state.filter("id is null and target_id is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    t = targets.filter("target_id is not null").dropDuplicates(["target_id"]).join(F.broadcast(counts), "target_id", "left")  # at most a row per target
    share, least = F.coalesce("target_share", F.lit(0.0)), F.coalesce("min_rows", F.lit(0))
    t = t.withColumn("available", F.coalesce("available", F.lit(0)).cast("long")).withColumn("sample_n", F.floor(F.coalesce("sample_share", F.lit(0.0)) * F.lit(n_ids)))
    t = t.withColumn("needed", F.greatest(least.cast("double"), share * F.col("sample_n"))).withColumn("wish", F.greatest(least.cast("long"), F.round(share * F.col("sample_n")).cast("long")))
    t = t.withColumn("quota", F.least("wish", "available"))
    drawn = F.sum("quota").over(Window.partitionBy("plan_key"))
    return t.select("target_id", "plan_key", "sample_n", "available", "needed", "quota", (F.col("available") >= F.col("needed")).alias("is_met"), F.try_divide(F.col("quota"), F.col("sample_n")).alias("planned_share"), F.try_divide(F.col("quota"), drawn).alias("achieved_share"))


def _bucket():
    # the top bits of a priority
    return F.shiftright(F.col("p"), 4 * HEX - BUCKET_BITS)


def trim(state: DataFrame, plan: DataFrame) -> DataFrame:
    """(target_id, id, p): the ``quota`` ids of lowest priority of every target, of the merged reservoirs."""
    m = state.filter("id is not null").withColumn("bucket", _bucket())
    counts = m.groupBy("target_id", "bucket").agg(F.count("*").alias("n"))
    below = Window.partitionBy("target_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cut = counts.withColumn("before", F.coalesce(F.sum("n").over(below), F.lit(0))).join(F.broadcast(plan.select("target_id", "quota")), "target_id")
    cut = cut.filter("before < quota").groupBy("target_id").agg(F.max("bucket").alias("cut"), F.max("quota").alias("quota"), F.max("before").alias("before"))
    m = m.join(F.broadcast(cut), "target_id").filter("bucket <= cut")
    whole = m.filter("bucket < cut").select("target_id", "id", "p")
    rank = F.row_number().over(Window.partitionBy("target_id").orderBy("p", "id"))
    return whole.unionByName(m.filter("bucket = cut").withColumn("r", rank).filter(F.col("r") <= F.col("quota") - F.col("before")).select("target_id", "id", "p"))


def sample(records: DataFrame, targets: DataFrame, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(target_id, id) drawn and the quotas of the targets. Both come from the same reservoirs."""
    slack = 8.0
    while True:
        state = reservoirs(records, targets, seed=seed, slack=slack)
        plan = quotas(state, targets)
        drawn = materialise(trim(state, plan), "p4-drawn")
        cuts = drawn.groupBy("target_id").agg(F.max("p").alias("cut"), F.count("*").alias("k"))
        short = state.filter("id is null and target_id is not null").join(F.broadcast(plan.select("target_id", "quota")), "target_id").join(F.broadcast(cuts), "target_id", "left")
        if not short.filter("quota > 0 and (coalesce(k, 0) < quota or top < cut)").limit(1).count():
            return drawn.select("target_id", "id"), plan
        slack *= 2
