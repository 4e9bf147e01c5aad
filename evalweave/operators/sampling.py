"""Stratified draws without a sequential generator: a keyed hash orders rows, so every draw is repeatable anywhere.

Ranks within a stratum are found in two steps, counts by hash bucket and a rank within the bucket, so a stratum that
holds a third of all rows is spread over thousands of small sorts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalweave.sources.tables import join_nullsafe

HEX = 15  # digits of the digest that make a draw's number: 60 bits
BUCKET_BITS = 12


def draw_number(key: Column, seed: int = 0) -> Column:
    """The number that orders ``key`` in a shuffle; the same in any engine with md5."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}"))), 1, HEX), 16, 10).cast("long")


def rank_within(df: DataFrame, strata: list[str], key: str = "id", seed: int = 0, name: str = "rank") -> DataFrame:
    """``df`` with the 1-based rank of each row in its stratum's shuffle. ``key`` is unique; NULL strata are strata."""
    x = df.withColumn("_n", draw_number(F.col(key), seed)).withColumn("_b", F.shiftright("_n", 4 * HEX - BUCKET_BITS))
    counts = x.groupBy(*strata, "_b").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    j = join_nullsafe(x, counts.drop("_c"), [*strata, "_b"])
    inside = F.row_number().over(Window.partitionBy(*strata, "_b").orderBy("_n", key))
    return j.withColumn(name, F.col("_before") + inside).drop("_n", "_b", "_before")


def largest_remainder(counts: DataFrame, total: int, count_col: str = "n", keys: list[str] | None = None) -> DataFrame:
    """Whole shares of ``total`` in proportion to counts: floors, then the largest fractions, ties to the larger key.

    ``counts`` has one row per stratum, so its windows are over strata, not rows. Empty counts give no rows.
    """
    keys = keys or [c for c in counts.columns if c != count_col]
    every = Window.partitionBy()
    x = counts.withColumn("_exact", F.col(count_col) * F.lit(float(total)) / F.sum(count_col).over(every)).withColumn("_floor", F.floor("_exact"))
    x = x.withColumn("_left", F.lit(total) - F.sum("_floor").over(every))
    order = Window.orderBy(F.desc(F.round(F.col("_exact") - F.col("_floor"), 9)), *[F.desc_nulls_last(k) for k in keys])
    take = F.col("_floor") + (F.row_number().over(order) <= F.col("_left")).cast("long")
    return x.withColumn("take", F.least(take, F.col(count_col))).drop("_exact", "_floor", "_left")


def draw_pool(df: DataFrame, strata: list[str], total: int, key: str = "id", seed: int = 0) -> DataFrame:
    """A proportional sample over ``strata`` including the NULL stratum."""
    takes = largest_remainder(df.groupBy(*strata).agg(F.count("*").alias("n")), total, keys=strata)
    r = rank_within(df, strata, key, seed)
    return join_nullsafe(r, takes.select(*strata, "take"), strata).filter(F.col("rank") <= F.col("take")).select(*df.columns)


def split_by_share(df: DataFrame, strata: list[str], shares: dict[str, float], key: str = "id", seed: int = 0) -> DataFrame:
    """``split`` of every row: consecutive parts of each stratum's shuffle; the last named part takes the rest."""
    r = rank_within(df, strata, key, seed)
    n = df.groupBy(*strata).agg(F.count("*").alias("_n"))
    j = join_nullsafe(r, n, strata)
    names, edge, out = list(shares), 0.0, F.lit(list(shares)[-1])
    steps = []
    for name in names[:-1]:
        edge += shares[name]
        steps.append((name, F.floor(F.col("_n") * F.lit(round(edge, 9)))))
    for name, e in reversed(steps):
        out = F.when(F.col("rank") <= e, F.lit(name)).otherwise(out)
    return j.withColumn("split", out).drop("rank", "_n")


def partition_slices(df: DataFrame, strata: list[str], sizes: dict[str, int], key: str = "id", seed: int = 0) -> DataFrame:
    """Disjoint named slices of given sizes, each proportional over ``strata``; rows in no slice are left out."""
    counts = df.groupBy(*strata).agg(F.count("*").alias("n"))
    r, edge = rank_within(df, strata, key, seed), F.lit(0)
    takes = counts
    for name, size in sizes.items():
        t = largest_remainder(counts, size, keys=strata).select(*strata, F.col("take").alias(f"t_{name}"))
        takes = join_nullsafe(takes, t, strata)
    j = join_nullsafe(r, takes.drop("n"), strata)
    out = F.lit(None).cast("string")
    for name in sizes:
        low, edge = edge, edge + F.col(f"t_{name}")
        out = F.when((F.col("rank") > low) & (F.col("rank") <= edge), F.lit(name)).otherwise(out)
    return j.withColumn("slice", out).filter("slice is not null").select(*df.columns, "slice")


def label_stratified(df: DataFrame, labels_col: str, labels: list[str], per_label: int, key: str = "id", seed: int = 0, first: Column | None = None) -> DataFrame:
    """Rarest label first, rows are drawn until each label has ``per_label``; a row counts for all of its labels.

    ``first`` orders rows before the shuffle does.

    The first ``per_label`` rows of a label's shuffle hold all that can be drawn for it, whatever was drawn before. They
    are found for all labels in one pass; the draw itself is over those few rows.
    """
    x = df.withColumn("_n", draw_number(F.col(key), seed)).withColumn("_o", F.lit(0) if first is None else first).select(key, labels_col, "_n", "_o")
    each = x.select("*", F.explode(F.array_distinct(labels_col)).alias("_label")).filter(F.col("_label").isin(labels))
    support = {r["_label"]: r["n"] for r in each.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    few = each.withColumn("_r", F.row_number().over(Window.partitionBy("_label").orderBy("_o", "_n", key))).filter(F.col("_r") <= per_label)
    lists: dict = {}
    for r in sorted(few.collect(), key=lambda r: r["_r"]):  # per_label rows a label, whatever the table
        lists.setdefault(r["_label"], []).append(r)
    drawn: dict = {}
    for label in sorted(labels, key=lambda v: (support.get(v, 0), v)):
        have = sum(label in r[labels_col] for r in drawn.values())
        for r in lists.get(label, ()):
            if have < per_label and r[key] not in drawn:
                drawn[r[key]], have = r, have + 1
    return df.sparkSession.createDataFrame([(r[key], r[labels_col]) for r in drawn.values()], df.select(key, labels_col).schema)


def at_ranks(df: DataFrame, by: list[str], value: str, ranks: dict[str, Column], edges: int = 256) -> DataFrame:
    """(by, n, a column for each of ``ranks``): the values at given 0-based ranks of each key's sorted values.

    ``ranks`` are expressions over ``n``, the key's number of values. Equal values are counted first; the rest are dealt to
    buckets between approximate quantiles, which bear on time only, and ranked inside their bucket, so no task sorts a key.
    """
    c = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_k"))
    at = [i / edges for i in range(1, edges)]
    e = c.groupBy(*by).agg(F.percentile_approx(value, F.array(*[F.lit(x) for x in at]), F.lit(10_000)).alias("_e"), F.sum("_k").alias("n"))
    x = join_nullsafe(c, e, by) if by else c.crossJoin(F.broadcast(e))
    x = x.withColumn("_b", F.size(F.filter("_e", lambda q: q < F.col(value)))).drop("_e")
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    b = x.groupBy(*by, "_b").agg(F.sum("_k").alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    x = join_nullsafe(x, b, [*by, "_b"])
    x = x.withColumn("_hi", F.col("_before") + F.sum("_k").over(Window.partitionBy(*by, "_b").orderBy(value)))
    hit = lambda r: F.max(F.when((r >= F.col("_hi") - F.col("_k")) & (r < F.col("_hi")), F.col(value)))
    return x.groupBy(*by).agg(F.max("n").alias("n"), *[hit(r).alias(k) for k, r in ranks.items()])


def keep_first(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key by ``order``; an aggregate, so it combines before the shuffle."""
    x = df.withColumn("_k", key)
    first = x.groupBy("_k").agg(F.min(F.struct(*order, *[c for c in df.columns if c not in order])).alias("_r"))
    return first.select(*[F.col(f"_r.{c}").alias(c) for c in df.columns])


def severity_band(df: DataFrame, score: str, cut: float) -> DataFrame:
    """``df`` with ``band``: none at or below ``cut``, else terciles of the mass above it (linear interpolation)."""
    ranks = {f"{w}{i}": f(F.lit(i) * (F.col("n") - 1) / 3) for i in (1, 2) for w, f in (("low", F.floor), ("high", F.ceil))}
    q = at_ranks(df.filter(F.col(score) > cut).select(score), [], score, ranks)
    part = lambda i: F.lit(i) * (F.col("n") - 1) / 3 - F.floor(F.lit(i) * (F.col("n") - 1) / 3)
    q = q.select(*[(F.col(f"low{i}") + (F.col(f"high{i}") - F.col(f"low{i}")) * part(i)).alias(f"_q{i}") for i in (1, 2)])
    c = F.col(score)
    band = F.when(c <= cut, F.lit(None).cast("string")).when(c <= F.col("_q1"), "low").when(c <= F.col("_q2"), "medium").when(c.isNotNull(), "high")
    return df.crossJoin(F.broadcast(q)).withColumn("band", band).drop("_q1", "_q2")  # one row
