"""Leakage, feedback, provenance and usage audits over logged tables."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalweave.functions.stats import count_if, ratio
from evalweave.functions.text import dedup_key, norm_text, tokens
from evalweave.operators.retrieve import dense_top_k
from evalweave.operators.sampling import at_ranks
from evalweave.session import materialise
from evalweave.sources.tables import join_nullsafe

#: Least cosine of a near copy; the most frequent words, by a sample, that come last in the search for near copies.
NEAR, COMMON_WORDS = 0.95, 50_000


def leak_keys(df: DataFrame) -> DataFrame:
    """(id, lang, text_key, key) with the digests that leak checks match on."""
    t = df.filter("text is not null").select("id", F.lower(F.trim("lang")).alias("lang"), F.md5("text").alias("text_key"), F.md5(norm_text("text")).alias("key"))
    return t


def token_sets(df: DataFrame) -> DataFrame:
    """(lang, cls, w, ids): sets of distinct tokens, sorted, with the texts that have them; ``cls`` names the set."""
    t = df.filter("text is not null").select("id", F.lower(F.trim("lang")).alias("lang"), F.array_sort(F.array_distinct(tokens("text"))).alias("w"))
    t = t.filter("size(w) > 0 and lang is not null").withColumn("cls", F.md5(F.concat_ws(" ", "w")))
    return t.groupBy("lang", "cls").agg(F.first("w").alias("w"), F.collect_list("id").alias("ids"))


def near_copies(evaluation: DataFrame, training: DataFrame, near: float = NEAR) -> DataFrame:
    """(eval_id, train_id, sim): all pairs of one language whose token sets have a cosine of ``near`` or more, exactly.

    Two such sets share a word among the rarest ``n - ceil(near^2 n) + 1`` of each, in any common order of words; only those
    words are joined. The order comes from a sample, which bears on time, not on pairs. ``parity`` flips a bit for each word,
    so bits that differ are a lower bound of the words that differ.
    """
    es, ts = materialise(token_sets(evaluation), "leak-evaluation"), materialise(token_sets(training), "leak-training")
    words = es.select("w").unionByName(ts.select("w")).filter(F.pmod(F.xxhash64("w"), F.lit(8)) == 0).select(F.explode("w").alias("word"))
    common = [r["word"] for r in words.groupBy("word").count().orderBy("count", "word", ascending=False).limit(COMMON_WORDS).collect()]
    place = evaluation.sparkSession.sparkContext.broadcast({w: -i for i, w in enumerate(common)})

    def rarest(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = place.value
        for pdf in it:
            out = []
            for lang, cls, w in zip(pdf["lang"], pdf["cls"], pdf["w"]):
                parity = 0
                for x in w:
                    parity ^= 1 << (zlib.crc32(x.encode()) & 63)
                order = sorted(w, key=lambda x: (at.get(x, -COMMON_WORDS), x))
                out += [(lang, cls, len(w), parity - (parity >> 63 << 64), x) for x in order[: len(w) - math.ceil(near * near * len(w) - 1e-9) + 1]]
            yield pd.DataFrame(out, columns=["lang", "cls", "n", "parity", "word"])

    keys = lambda x, k: x.select("lang", "cls", "w").mapInPandas(rarest, "lang string, cls string, n int, parity long, word string").select("lang", "word", *[F.col(c).alias(f"{k}_{c}") for c in ("cls", "n", "parity")])
    root = F.sqrt(F.col("e_n") * F.col("t_n"))
    may = F.bit_count(F.col("e_parity").bitwiseXOR(F.col("t_parity"))) <= F.col("e_n") + F.col("t_n") - 2 * near * root + 1e-9
    pairs = keys(es, "e").join(keys(ts, "t"), ["lang", "word"]).filter(may).select("lang", "e_cls", "t_cls").distinct()
    side = lambda x, k: x.select("lang", F.col("cls").alias(f"{k}_cls"), F.col("w").alias(f"{k}_w"), F.col("ids").alias(f"{k}_ids"))
    pairs = pairs.join(side(es, "e"), ["lang", "e_cls"]).join(side(ts, "t"), ["lang", "t_cls"])
    pairs = pairs.withColumn("sim", F.size(F.array_intersect("e_w", "t_w")) / F.sqrt(F.size("e_w") * F.size("t_w"))).filter(F.col("sim") >= near - 1e-12)
    return pairs.select("sim", "t_ids", F.explode("e_ids").alias("eval_id")).select("eval_id", F.explode("t_ids").alias("train_id"), "sim")


def near_vectors(evaluation: DataFrame, training: DataFrame, near: float = NEAR) -> DataFrame:
    """(eval_id, train_id, sim) of stored vectors ``(id, vec)``: each item's best record and each record's best item.

    Both directions, as a record near an item need not be that item's best.
    """
    best = lambda c, q: dense_top_k(c.select(F.lit(0).alias("bucket"), "id", "vec"), q.select(F.col("id").alias("query_id"), "vec"), 1).filter(F.round("score", 6) >= near)
    a = best(training, evaluation).select(F.col("query_id").alias("eval_id"), F.col("id").alias("train_id"), F.col("score").alias("sim"))
    b = best(evaluation, training).select(F.col("id").alias("eval_id"), F.col("query_id").alias("train_id"), F.col("score").alias("sim"))
    return a.unionByName(b)


def leakage(evaluation: DataFrame, training: DataFrame, near: float = NEAR, vectors: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(eval_id, train_id, exact, normalised, sim) of items and records of one language that are the same or nearly so.

    Three detectors: equal text, equal normalised text, a cosine of ``near`` or more, of the texts' token sets and, where
    ``vectors`` names evaluation and training vectors ``(id, vec)``, of those. ``sim`` is 1 for equal texts.
    """
    e, t = leak_keys(evaluation), leak_keys(training)
    j = e.select(F.col("id").alias("eval_id"), "lang", "key", F.col("text_key").alias("ek")).join(t.select(F.col("id").alias("train_id"), "lang", "key", F.col("text_key").alias("tk")), ["lang", "key"])
    same = j.select("eval_id", "train_id", (F.col("ek") == F.col("tk")).alias("exact"), F.lit(True).alias("normalised"), F.lit(1.0).alias("sim"))
    close = near_copies(evaluation, training, near)
    if vectors:
        close = close.unionByName(near_vectors(*vectors, near))
    both = same.unionByName(close.select("eval_id", "train_id", F.lit(False).alias("exact"), F.lit(False).alias("normalised"), "sim"))
    return both.groupBy("eval_id", "train_id").agg(F.max("exact").alias("exact"), F.max("normalised").alias("normalised"), F.max("sim").alias("sim"))


def leakage_report(pairs: DataFrame, items: DataFrame, full_scan: bool = True, top: int = 3) -> tuple[DataFrame, DataFrame]:
    """(subset, n_items, n_exact, n_normalised, n_near, max_sim) and the nearest pairs of each subset (subset, r, eval_id,
    train_id, sim). Only a full scan may be reported: exclusions drawn from a part would pass for all."""
    if not full_scan:
        raise ValueError("a partial scan makes no report and no exclusions")
    j = pairs.join(items.select(F.col("id").alias("eval_id"), "subset"), "eval_id")
    n = lambda c: F.countDistinct(F.when(c, F.col("eval_id")))
    g = j.groupBy("subset").agg(F.countDistinct("eval_id").alias("n_items"), n(F.col("exact")).alias("n_exact"), n(F.col("normalised")).alias("n_normalised"), n(~F.col("normalised")).alias("n_near"), F.max("sim").alias("max_sim"))
    w = Window.partitionBy("subset").orderBy(F.desc(F.round("sim", 6)), "eval_id", "train_id")
    return g, j.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top).select("subset", "r", "eval_id", "train_id", "sim")


def source_run(feedback: DataFrame, runs: DataFrame) -> DataFrame:
    """(id, run_key, predicted): each feedback record with the run that selected it, the round before its own, and what that
    run predicted. ``feedback(id, round, feedback_arm, origin_item_id)``, ``runs(run_key, item_id, hate)``."""
    f = feedback.withColumn("run_key", F.concat_ws("_", "feedback_arm", F.concat(F.lit("r"), (F.col("round") - 1).cast("string"))))
    return f.join(runs.select("run_key", F.col("item_id").alias("origin_item_id"), F.col("hate").alias("predicted")), ["run_key", "origin_item_id"], "left").select("id", "run_key", "predicted")


def exclusions(pairs: DataFrame, training: DataFrame, near: float = NEAR) -> DataFrame:
    """(lang, id): training records to leave out, by the highest similarity to any item."""
    top = pairs.groupBy(F.col("train_id").alias("id")).agg(F.max("sim").alias("sim")).filter(F.round("sim", 6) >= near)
    return top.select("id").join(training.select("id", F.lower(F.trim("lang")).alias("lang")), "id").select("lang", "id")


def without(voted: DataFrame, ids: DataFrame) -> DataFrame:
    """Predictions of the items that are not in ``ids(item_id)``."""
    return voted.join(ids, "item_id", "left_anti")


def correct(gold: str, pred: str, mode: str) -> Column:
    """Item correctness by label sets: exact, or all annotated labels predicted; no prediction is wrong."""
    g, p = F.col(gold), F.col(pred)
    inside = F.size(F.array_except(g, p)) == 0
    ok = inside & (F.size(F.array_except(p, g)) == 0) if mode == "exact" else inside
    return F.coalesce(ok & p.isNotNull(), F.lit(False))


def stability(runs: DataFrame, gold: DataFrame, dim: str, mode: str = "contains") -> DataFrame:
    """(item_id, arm, all_correct, any_correct, n_runs) of the runs on items annotated for the dimension."""
    j = runs.join(gold, "item_id").withColumn("ok", correct("gold", dim, mode))
    return j.groupBy("item_id", "arm").agg(F.min(F.col("ok").cast("int")).cast("boolean").alias("all_correct"), F.max(F.col("ok").cast("int")).cast("boolean").alias("any_correct"), F.count("*").alias("n_runs"))


def feedback_round(errors: DataFrame, right: DataFrame, per_arm: int, order: Column) -> DataFrame:
    """(item_id, feedback_arm): ``per_arm`` errors for feedback and as many right items as control, in a fixed order."""
    pick = lambda df, arm: df.orderBy(order, "item_id").limit(per_arm).select("item_id", F.lit(arm).alias("feedback_arm"))
    return pick(errors, "feedback").unionByName(pick(right, "control"))


def cumulative(log: DataFrame, upto: int) -> DataFrame:
    """The last write of every record in rounds up to ``upto``."""
    w = Window.partitionBy("id").orderBy(F.desc("round"), "origin_item_id")
    return log.filter(F.col("round") <= upto).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def distance_bands(ranked: DataFrame, bands: int) -> DataFrame:
    """``ranked(item_id, sim)`` with band 1..bands from most to least similar; edges round(n * b / bands), half to even."""
    w = Window.orderBy(F.desc(F.round("sim", 6)), "item_id")
    x = ranked.withColumn("r", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy()))
    edge = sum(((F.col("r") > F.bround(F.col("n") * b / F.lit(float(bands)), 0)).cast("int") for b in range(1, bands)), F.lit(1))
    return x.withColumn("band", edge).drop("r", "n")


def calls_per_day(log: DataFrame, ts: str, by: str) -> DataFrame:
    return log.filter(F.col(ts).isNotNull()).groupBy(F.date_format(ts, "yyyy-MM-dd").alias("day"), by).agg(F.count("*").alias("n"))


def active_range(log: DataFrame, ts: str, by: str) -> DataFrame:
    """(by, n, first_day, last_day, active_days)."""
    day = F.date_format(ts, "yyyy-MM-dd")
    return log.groupBy(by).agg(F.count("*").alias("n"), F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.countDistinct(day).alias("active_days"))


def by_phase(log: DataFrame, ts: str, phases: list[tuple[str, str, str]]) -> DataFrame:
    """(phase, n) by day ranges; a projection, as phases are a setting."""
    day = F.date_format(ts, "yyyy-MM-dd")
    hit = F.array_compact(F.array(*[F.when((day >= a) & (day <= b), F.lit(n)) for n, a, b in phases]))
    return log.select(F.explode(hit).alias("phase")).groupBy("phase").agg(F.count("*").alias("n"))


def latency_at(log: DataFrame, value: str, by: str, shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """The value at index int(n * share) of the sorted values of each key, found by rank rather than by collecting them."""
    ranks = {f"p{round(x * 100)}": F.least(F.floor(F.col("n") * x), F.col("n") - 1) for x in shares}
    hours = log.filter(F.col(value).isNotNull()).groupBy(by).agg((F.sum(value) / 3600).alias("hours"))
    return join_nullsafe(at_ranks(log, [by], value, ranks), hours, [by])


def stamp_audit(results: DataFrame, stamps: list[str], by: str = "arm") -> DataFrame:
    """(by, stamp, n_values, values): stamps with more than one value in a run are mixed."""
    long = results.select(by, F.explode(F.array(*[F.struct(F.lit(s).alias("stamp"), F.col(s).cast("string").alias("value")) for s in stamps])).alias("x")).select(by, "x.*")
    return long.groupBy(by, "stamp").agg(F.countDistinct("value").alias("n_values"), F.array_join(F.array_sort(F.collect_set("value")), ",").alias("values"))


def comparability_groups(results: DataFrame, stamps: list[str]) -> DataFrame:
    """Results that may be compared: equal stamps, a missing stamp being a value of its own."""
    keys = [F.coalesce(F.col(s).cast("string"), F.lit("unstamped")).alias(s) for s in stamps]
    return results.groupBy(*keys).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("arm")), ",").alias("arms"))


def requested_vs_observed(requested: DataFrame, observed: DataFrame, key: str, stamps: list[str]) -> DataFrame:
    """(key, stamp, requested, observed) where a manifest's wish and the log differ."""
    r = requested.select(key, F.explode(F.array(*[F.struct(F.lit(s).alias("stamp"), F.col(s).cast("string").alias("requested")) for s in stamps])).alias("x")).select(key, "x.*")
    o = observed.select(key, F.explode(F.array(*[F.struct(F.lit(s).alias("stamp"), F.col(s).cast("string").alias("observed")) for s in stamps])).alias("x")).select(key, "x.*").distinct()
    return r.join(o, [key, "stamp"]).filter(~F.col("requested").eqNullSafe(F.col("observed")))


def slot_allocation(hits: DataFrame, definitions: DataFrame) -> DataFrame:
    """(dimension, slots, slot_share, items, item_share) of definition slots; unknown ids under NULL."""
    h = hits.filter("bucket = 'definitions'").select("item_id", "hit_id").distinct()
    j = h.join(definitions.select(F.col("id").alias("hit_id"), "dimension"), "hit_id", "left")
    total = h.agg(F.count("*").alias("_s"), F.countDistinct("item_id").alias("_i"))
    g = j.groupBy("dimension").agg(F.count("*").alias("slots"), F.countDistinct("item_id").alias("items"))
    return g.crossJoin(F.broadcast(total)).select("dimension", "slots", ratio(F.col("slots"), F.col("_s")).alias("slot_share"), "items", ratio(F.col("items"), F.col("_i")).alias("item_share"))


def never_used(records: DataFrame, hits: DataFrame) -> DataFrame:
    return records.join(hits.select(F.col("hit_id").alias("id")).distinct(), "id", "left_anti")


def most_used(hits: DataFrame, n: int, least: bool = False) -> DataFrame:
    c = hits.groupBy("hit_id").agg(F.count("*").alias("n"))
    return c.orderBy(F.asc("n") if least else F.desc("n"), "hit_id").limit(n)


def label_relevance(hits: DataFrame, records: DataFrame, gold: DataFrame) -> DataFrame:
    """(arm of none) n_items, observed and chance rate that a shown example carries a label of the item.

    ``records(id, labels)``, ``gold(item_id, labels)``; chance is one minus the chance that k random records all miss.
    """
    n = records.agg(F.count("*").alias("_n"))
    by_set = records.withColumn("key", F.array_join(F.array_sort("labels"), ",")).groupBy("key").agg(F.count("*").alias("c"), F.first("labels").alias("r_labels"))
    asked = gold.withColumn("key", F.array_join(F.array_sort("labels"), ",")).groupBy("key").agg(F.first("labels").alias("labels"))
    # label by label; a label set meets another once however many labels they share
    met = asked.select("key", F.explode(F.array_distinct("labels")).alias("label")).join(by_set.select(F.col("key").alias("r_key"), "c", F.explode(F.array_distinct("r_labels")).alias("label")), "label").select("key", "r_key", "c").distinct()
    met = asked.select("key").join(met.groupBy("key").agg(F.sum("c").alias("s")), "key", "left")
    share = met.crossJoin(F.broadcast(n)).select("key", (F.coalesce("s", F.lit(0)) / F.col("_n")).alias("share"))
    h = hits.filter("bucket = 'examples'").select("item_id", "hit_id").distinct().join(records.select(F.col("id").alias("hit_id"), F.col("labels").alias("h_labels")), "hit_id")
    g = gold.withColumn("key", F.array_join(F.array_sort("labels"), ","))
    i = h.join(g, "item_id").groupBy("item_id", "key").agg(F.max(F.arrays_overlap("labels", "h_labels").cast("int")).alias("hit"), F.count("*").alias("k")).join(share, "key")
    return i.agg(F.count("*").alias("n_items"), F.avg("hit").alias("observed"), F.avg(1 - F.pow(1 - F.col("share"), F.col("k"))).alias("chance"))


def dimension_reach(results: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(dimension, n, voted, first_voted): on how many predictions a dimension was voted on, and since when."""
    each = F.array(*[F.struct(F.lit(k).alias("dimension"), F.col(c).isNotNull().alias("has")) for k, c in columns.items()])
    x = results.select("run_ts", F.explode(each).alias("x")).select("run_ts", "x.*")
    return x.groupBy("dimension").agg(F.count("*").alias("n"), count_if(F.col("has")).alias("voted"), F.min(F.when(F.col("has"), F.date_format("run_ts", "yyyy-MM-dd"))).alias("first_voted"))


def draw_ladder(labels: DataFrame) -> DataFrame:
    """(dropped, kept, ceiling): what an equal draw could reach with the rarest labels dropped, of ``labels(label, n)``."""
    w = Window.orderBy("n", "label")
    x = labels.withColumn("r", F.row_number().over(w)).withColumn("k", F.count("*").over(Window.partitionBy()))
    return x.select((F.col("r") - 1).cast("long").alias("dropped"), (F.col("k") - F.col("r") + 1).alias("kept"), ((F.col("k") - F.col("r") + 1) * F.col("n")).alias("ceiling"))


def gate_origin(feedback: DataFrame, voted: DataFrame) -> DataFrame:
    """(feedback_arm, round, predicted, n) of feedback records by the gate prediction that made them, with totals."""
    j = feedback.join(voted.select(F.col("item_id").alias("origin_item_id"), F.col("hate").alias("predicted")), "origin_item_id", "left")
    return j.groupBy("feedback_arm", "round", "predicted").agg(F.count("*").alias("n"))


def mixture(base, full, share):
    """What a share of injected items predicts between two scores."""
    return base + share * (full - base)
