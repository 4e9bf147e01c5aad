"""Queries over agreement, tests, leakage, feedback, provenance and the log."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalweave.operators import analysis as A
from evalweave.operators import audit as U
from evalweave.operators import kb as K
from evalweave.operators import metrics as M
from evalweave.operators import sampling as S
from evalweave.operators import vote as V
from evalweave.operators.labels import TAXONOMY
from evalweave.plans import building, data, norm, scoring
from evalweave.plans.data import sql
from evalweave.sources.tables import table
from evalweave.streaming import log as L

#: Resamples, and steps of the threshold grid.
B, STEPS = 1000, 100
STAMPS = ["active_model", "prompt_version", "kb_version", "temperature", "workers"]
PHASES = [("pilot", "2025-01-01", "2025-02-15"), ("main", "2025-02-01", "2025-04-30"), ("rerun", "2025-05-01", "2025-12-31")]


def _r(c, n=6):
    return F.round(c, n).alias(c)


def _runs(s, d):
    return data.runs(s, d, *scoring._RUN)


def alpha_nominal(s, d):
    return A.alpha(A.gate_units(_runs(s, d))).select("arm", "dimension", "n_units", "n_values", _r("alpha"))


def alpha_multilabel(s, d):
    return A.alpha(A.label_units(_runs(s, d))).select("arm", "dimension", "n_units", "n_values", _r("alpha"))


def alpha_ordinal(s, d):
    return A.alpha(A.severity_units(_runs(s, d)), ordinal=True).select("arm", "dimension", "n_units", "n_values", _r("alpha"))


def _correct(s, d):
    return A.gate_correct(scoring.voted(s, d), data.items(s, d, "gate"))


def _logged(s, d):
    """Correctness of the logged predictions, where an item has several arms."""
    return A.gate_correct(data.results(s, d, "hate"), data.items(s, d, "gate"))


def mcnemar_counts(s, d):
    return A.mcnemar(A.paired(_logged(s, d))).select("arm_a", "arm_b", "both_correct", "both_wrong", "only_a", "only_b", "discordant", _r("p_value"))


def _bootstrap(s, d, b):
    x = A.paired_bootstrap(A.paired(_logged(s, d)), b)
    return x.select("arm_a", "arm_b", "n_resamples", _r("ci_low"), _r("ci_high"), _r("sd"), _r("p_value"), "favour_a", "ties", "favour_b")


def paired_bootstrap(s, d):
    return _bootstrap(s, d, B)


def _survival(s, d, b):
    g = data.items(s, d, "gate", "hate_types").filter("gate and hate_types is not null").select(F.col("id").alias("item_id"), F.col("hate_types").alias("labels"))
    return A.label_survival(g, b, 12)


def label_survival(s, d):
    return _survival(s, d, B)


def guideline_effect(s, d):
    x = A.guideline_effect(data.retrieved(s, d), _correct(s, d))
    return x.select("guideline", "gold_hate", "n", "correct", "n_paired", "base_correct", _r("accuracy"), _r("base_accuracy"), _r("delta"))


def _replicates(s, d):
    r = _runs(s, d).filter(V.valid()).join(data.items(s, d, "gate").filter("gate is not null").select(F.col("id").alias("item_id"), F.col("gate").alias("truth")), "item_id")
    return r.select("arm", "run_idx", "item_id", F.col("hate").alias("pred"), "truth", (F.col("hate") == F.col("truth")).cast("int").alias("ok"))


def replicate_floor(s, d):
    x = A.replicate_floor(_replicates(s, d).groupBy("arm", "run_idx").agg(F.avg("ok").alias("score")))
    return x.select("arm", "n", *[_r(c) for c in ("lowest", "highest", "mean", "spread", "floor")])


def _diffs(s, d):
    r = _replicates(s, d)
    a = r.filter("arm = 'rag'").select("item_id", "run_idx", F.col("ok").alias("a"))
    b = _logged(s, d).filter("arm = 'zero_shot'").select("item_id", F.col("ok").cast("int").alias("b"))
    i = data.items(s, d, "subset").select(F.col("id").alias("item_id"), F.substring("subset", 1, 2).alias("part"))
    return a.join(b, "item_id").join(i, "item_id").select("part", F.col("run_idx").alias("replicate"), "item_id", (F.col("a") - F.col("b")).alias("d"))


def variance_estimate(s, d):
    return A.variance_estimate(_diffs(s, d), ["part"]).select("part", "n_replicates", *[_r(c) for c in ("delta", "item_se", "replicate_sd", "total_se")])


def heterogeneity_pool(s, d):
    e = A.variance_estimate(_diffs(s, d), ["part"]).select(F.lit("rag - zero_shot").alias("contrast"), "delta", F.col("total_se").alias("se"))
    return A.pool_estimates(e, ["contrast"]).select("contrast", "k", *[_r(c) for c in ("pooled", "pooled_se", "q", "z", "i2", "p_pooled", "p_q_1df")])


def arm_disagreement(s, d):
    p = A.paired(_logged(s, d))
    return p.groupBy("arm_a", "arm_b").agg(F.count("*").alias("n"), F.round(F.avg((F.col("pred_a") == F.col("pred_b")).cast("double")), 6).alias("agreement"), F.count(F.when(F.col("ok_a") & ~F.col("ok_b"), 1)).alias("wins"), F.count(F.when(~F.col("ok_a") & F.col("ok_b"), 1)).alias("losses"))


def _sweep(s, d, thresholds):
    r = _runs(s, d).filter(V.valid()).groupBy("item_id", "arm").agg(F.avg(F.col("hate").cast("double")).alias("p"))
    j = r.join(data.items(s, d, "gate").filter("gate is not null").select(F.col("id").alias("item_id"), F.col("gate").alias("truth")), "item_id")
    return A.threshold_sweep(j, thresholds).select("arm", _r("threshold"), _r("macro_f1"), _r("predicted_rate"))


def threshold_sweep(s, d):
    return _sweep(s, d, STEPS)


def permutation_test(s, d):
    """Whether the items nearest to the records shown gain most: the lead of the arm with context, by similarity band."""
    ok = _logged(s, d).select("item_id", "arm", F.col("ok").cast("double").alias("ok"))
    lead = ok.filter("arm = 'rag'").select("item_id", F.col("ok").alias("a")).join(ok.filter("arm = 'zero_shot'").select("item_id", F.col("ok").alias("b")), "item_id")
    sim = _similarity(s, d).join(lead, "item_id")
    x = A.permutation_p(U.distance_bands(sim, 5).select((F.col("a") - F.col("b")).alias("value"), "band"))
    return x.select(_r("observed"), _r("p_value"), _r("gradient"), _r("p_gradient"), "n_near", "n_far", "n_permutations")


def _train(s, d):
    return data.kb(s, d, "kind", "text", "lang").filter("kind in ('example', 'feedback')").select("id", "text", "lang")


def _stored(s, d):
    """Vectors of evaluation and training: the texts have none, so a tenth of the stored ones stands for items."""
    v = table(s, d, "embeddings", F.concat(F.lit("vec-"), "vec_id").alias("id"), "vec_id", F.col("embedding").alias("vec"))
    return v.filter("vec_id % 10 = 0").select("id", "vec"), v.filter("vec_id % 10 <> 0").select("id", "vec")


def _leaks(s, d):
    return U.leakage(data.items(s, d, "text", "lang"), _train(s, d), vectors=_stored(s, d))


def leakage_scan(s, d):
    i = data.items(s, d, "subset").select(F.col("id").alias("eval_id"), "subset").unionByName(_stored(s, d)[0].select(F.col("id").alias("eval_id"), F.lit("stored vectors").alias("subset")))
    n = lambda c: F.countDistinct(F.when(c, F.col("eval_id")))
    return _leaks(s, d).join(i, "eval_id").groupBy("subset").agg(F.countDistinct("eval_id").alias("n_items"), n(F.col("exact")).alias("n_exact"), n(F.col("normalised")).alias("n_normalised"), n(~F.col("normalised")).alias("n_near"), F.count("*").alias("n_pairs"))


def leak_exclusions(s, d):
    return U.exclusions(_leaks(s, d), _train(s, d).unionByName(_stored(s, d)[1].select("id", F.lit(None).cast("string").alias("lang")), True))


def retrieval_leak_rescore(s, d):
    """Gate scores of the arm with context, with and without items whose leaked twin was shown to them."""
    p = _leaks(s, d)
    shown = p.join(data.retrieved(s, d).select(F.col("item_id").alias("eval_id"), F.col("hit_id").alias("train_id")), ["eval_id", "train_id"]).select(F.col("eval_id").alias("item_id")).distinct()
    pairs = M.gate_pairs(scoring.voted(s, d).filter("arm = 'rag'"), data.items(s, d, "source", "gate", "raw"))
    a = M.score_gate(pairs, ("arm",)).withColumn("items", F.lit("all"))
    b = M.score_gate(U.without(pairs, shown), ("arm",)).withColumn("items", F.lit("clean"))
    return a.unionByName(b).select("items", "n_scored", "tp", "fp", "fn", "tn", _r("macro_f1"))


def _gold_types(s, d):
    return data.items(s, d, "gate", "hate_types").filter("gate and hate_types is not null").select(F.col("id").alias("item_id"), F.array_distinct("hate_types").alias("gold"))


def item_stability(s, d):
    r = _runs(s, d).withColumn("hate_type", F.when(V.valid(), F.col("hate_type")))
    x = U.stability(r, _gold_types(s, d), "hate_type")
    return x.groupBy("arm").agg(F.count("*").alias("n"), F.count(F.when(F.col("all_correct"), 1)).alias("all_correct"), F.count(F.when(F.col("any_correct"), 1)).alias("any_correct"))


def sentinel(s, d):
    """Items right in all runs of the arm with context."""
    r = _runs(s, d).filter("arm = 'rag'").withColumn("hate_type", F.when(V.valid(), F.col("hate_type")))
    return U.stability(r, _gold_types(s, d), "hate_type").filter("all_correct").select("item_id", "n_runs")


def sentinel_flips(s, d):
    """Labels of items right in the first run and wrong in the second."""
    r = _runs(s, d).withColumn("hate_type", F.when(V.valid(), F.col("hate_type"))).join(_gold_types(s, d), "item_id").withColumn("ok", U.correct("gold", "hate_type", "contains"))
    w = r.groupBy("item_id", "arm").agg(F.first("gold").alias("gold"), F.max(F.when(F.col("run_idx") == 0, F.col("ok"))).alias("before"), F.max(F.when(F.col("run_idx") == 1, F.col("ok"))).alias("after"))
    x = w.filter("before and after is not null").select("arm", "after", F.explode("gold").alias("label"))
    return x.groupBy("arm", "label").agg(F.count("*").alias("support"), F.count(F.when(~F.col("after"), 1)).alias("flips"))


def batch_errors(s, d):
    """Correctness by drawn slice, and over the batches that a round before the last had not seen."""
    g = _gold_types(s, d).join(building.role_partition(s, d).withColumnRenamed("id", "item_id"), "item_id")
    r = scoring.voted(s, d).join(g, "item_id").withColumn("ok", U.correct("gold", "hate_type", "exact")).withColumn("inside", U.correct("gold", "hate_type", "contains"))
    r = r.select("arm", "ok", "inside", F.explode(F.when(F.col("slice").startswith("batch_") & (F.col("slice") > "batch_1"), F.array("slice", F.lit("unseen"))).otherwise(F.array("slice"))).alias("batch"))
    return r.groupBy("arm", "batch").agg(F.count("*").alias("n"), F.count(F.when(F.col("ok"), 1)).alias("n_correct"), F.count(F.when(F.col("inside"), 1)).alias("n_contains"))


def feedback_round(s, d):
    g = _gold_types(s, d)
    v = scoring.voted(s, d).filter("arm = 'rag'").join(g, "item_id").withColumn("ok", U.correct("gold", "hate_type", "exact"))
    return U.feedback_round(v.filter("not ok"), v.filter("ok"), 12, S.draw_number(F.col("item_id"), 1))


def _feedback(s, d):
    k = K.with_meta(data.kb(s, d, "kind", "text", "meta")).filter("kind = 'feedback' and meta is not null")
    return k.select("id", F.col("meta.round").cast("long").alias("round"), F.col("meta.origin_item_id").alias("origin_item_id"), F.col("meta.feedback_arm").alias("feedback_arm"), F.col("meta.criterion").alias("criterion"))


def feedback_cumulative(s, d):
    return U.cumulative(_feedback(s, d), 2).groupBy("feedback_arm", "round").agg(F.count("*").alias("n"))


def feedback_gate_origin(s, d):
    x = U.gate_origin(_feedback(s, d), scoring.voted(s, d).filter("arm = 'rag'"))
    return x.withColumn("predicted", F.col("predicted").cast("string"))


def _similarity(s, d):
    """Of each item the best retrieval score."""
    return data.retrieved(s, d).filter("score is not null").groupBy("item_id").agg(F.max("score").alias("sim"))


def generalisation_bands(s, d):
    """Accuracy by distance to the nearest shown record: bands by the best retrieval score."""
    b = U.distance_bands(_similarity(s, d), 4).join(_correct(s, d).filter("arm = 'rag'"), "item_id")
    return b.groupBy("band").agg(F.count("*").alias("n"), F.round(F.avg(F.col("ok").cast("double")), 6).alias("accuracy"), F.round(F.min("sim"), 6).alias("lowest"))


def log_calls_per_day(s, d):
    return U.calls_per_day(data.runs(s, d, "run_ts", "arm"), "run_ts", "arm")


def log_by_model(s, d):
    return U.active_range(data.results(s, d, "run_ts", "active_model"), "run_ts", "active_model")


def log_phase_ranges(s, d):
    return U.by_phase(data.runs(s, d, "run_ts"), "run_ts", PHASES)


def log_latency_percentiles(s, d):
    x = U.latency_at(data.runs(s, d, "arm", "latency_s"), "latency_s", "arm")
    return x.select("arm", "n", "p50", "p90", "p99", _r("hours"))


def log_events_per_type(s, d):
    return U.calls_per_day(table(s, d, "events", "ts", "event_type"), "ts", "event_type")


def log_corrupt_lines(s, d):
    """Lines of the items' raw JSON that do not parse."""
    i = data.items(s, d, "raw", "source")
    return i.groupBy("source").agg(F.count("raw").alias("n_lines"), F.count(F.when(F.col("raw").isNotNull() & F.try_parse_json("raw").isNull(), 1)).alias("n_corrupt"))


def stamp_audit(s, d):
    return U.stamp_audit(data.results(s, d, *STAMPS), STAMPS)


def comparability_groups(s, d):
    return U.comparability_groups(data.results(s, d, *STAMPS), ["active_model", "prompt_version", "kb_version", "temperature"])


def requested_vs_observed(s, d):
    want = s.createDataFrame([("zero_shot", "strong-a", "4"), ("few_shot", "medium-b", "4"), ("rag", "strong-a", "8")], "arm string, active_model string, workers string")
    return U.requested_vs_observed(want, data.results(s, d, "active_model", "workers"), "arm", ["active_model", "workers"])


def dimension_reach(s, d):
    r = data.runs(s, d, "arm", "run_ts", "hate", "target_group", "hate_type", "severity", "legal")
    return U.dimension_reach(r, {c: c for c in ("hate", "target_group", "hate_type", "severity", "legal")})


def slot_allocation(s, d):
    x = U.slot_allocation(data.retrieved(s, d), data.kb(s, d, "kind", "dimension").filter("kind = 'definition'"))
    return x.select("dimension", "slots", _r("slot_share"), "items", _r("item_share"))


def dead_records(s, d):
    """Records never retrieved, by kind."""
    return U.never_used(data.kb(s, d, "kind"), data.retrieved(s, d)).groupBy("kind").agg(F.count("*").alias("n"))


def most_used_records(s, d):
    return U.most_used(data.retrieved(s, d), 10)


def label_relevance(s, d):
    k = K.with_meta(data.kb(s, d, "kind", "meta")).filter("kind = 'example'").select("id", F.coalesce("meta.hate_types", F.array().cast("array<string>")).alias("labels"))
    x = U.label_relevance(data.retrieved(s, d), k, _gold_types(s, d).withColumnRenamed("gold", "labels"))
    return x.select("n_items", _r("observed"), _r("chance"))


def draw_ladder(s, d):
    g = _gold_types(s, d).select(F.explode("gold").alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    return U.draw_ladder(g)


def comment_level(s, d):
    """Items over all their runs: how many, mean latency, whether any was hateful."""
    return _runs_latency(s, d).groupBy("item_id").agg(F.count("*").alias("n"), F.round(F.avg("latency_s"), 6).alias("mean_latency"), F.max(F.coalesce("hate", F.lit(False)).cast("int")).cast("boolean").alias("any_hate"), F.min_by("arm", F.struct("run_ts", "run_id")).alias("first_arm"))


def _runs_latency(s, d):
    return data.runs(s, d, "item_id", "arm", "latency_s", "hate", "run_ts")


def batch_of_name(s, d):
    """The number in a record's name."""
    return data.kb(s, d, "kind").select(F.regexp_extract("id", r"-(\d)\d*$", 1).alias("digit")).groupBy("digit").agg(F.count("*").alias("n"))


def text_hash_conflicts(s, d):
    """Items with more than one stored hash over their arms."""
    r = table(s, d, "item_results", "item_id", "text_hash").distinct().groupBy("item_id").agg(F.count("*").alias("n_hashes"))
    return r.groupBy("n_hashes").agg(F.count("*").alias("n_items"))


def stream_log_daily(s, d):
    return L.run_available(L.daily_counts(L.stream_table(s, d, "run_results").select("run_id", "arm", F.col("run_ts").cast("timestamp").alias("run_ts")), "run_ts", "run_id", "arm"))


def stream_append(s, d):
    """Each item and arm once, however often it was logged."""
    x = L.append_new(L.stream_table(s, d, "item_results").select("item_id", "arm", F.col("logged_at").cast("timestamp").alias("logged_at")).filter("item_id is not null"), ["item_id", "arm"], "logged_at", "400 days")
    return x.groupBy("arm").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (alpha_nominal, alpha_multilabel, alpha_ordinal, mcnemar_counts, paired_bootstrap, label_survival, guideline_effect, replicate_floor, variance_estimate, heterogeneity_pool, arm_disagreement, threshold_sweep, permutation_test, leakage_scan, leak_exclusions, retrieval_leak_rescore, item_stability, sentinel, sentinel_flips, batch_errors, feedback_round, feedback_cumulative, feedback_gate_origin, generalisation_bands, log_calls_per_day, log_by_model, log_phase_ranges, log_latency_percentiles, log_events_per_type, log_corrupt_lines, stamp_audit, comparability_groups, requested_vs_observed, dimension_reach, slot_allocation, dead_records, most_used_records, label_relevance, draw_ladder, comment_level, batch_of_name, text_hash_conflicts, stream_log_daily, stream_append)
}

_ALPHA = """, c as (select arm, dimension, unit, value, count(*) as k from units group by all), m as (select *, sum(k) over (partition by arm, dimension, unit) as m from c), f as (select * from m where m > 1),
o as (select a.arm, a.dimension, a.value as a, b.value as b, sum(a.k * (b.k - (a.value = b.value)::int) / (a.m - 1)::double) as o from f a join f b on a.arm = b.arm and a.dimension = b.dimension and a.unit = b.unit group by all),
nc as (select arm, dimension, a, sum(o) as nc from o group by all), t as (select *, sum(nc) over (partition by arm, dimension order by a) as upto, sum(nc) over (partition by arm, dimension) as n from nc),
g as (select x.arm, x.dimension, x.a, y.a as b, x.nc as na, y.nc as nb, x.upto as ua, y.upto as ub, x.n, coalesce(o.o, 0) as o from t x join t y on x.arm = y.arm and x.dimension = y.dimension left join o on o.arm = x.arm and o.dimension = x.dimension and o.a = x.a and o.b = y.a),
dl as (select *, {delta} as delta from g),
s as (select arm, dimension, sum(o * delta) / any_value(n) as d_o, sum(na * nb * delta) / (any_value(n) * (any_value(n) - 1)) as d_e, any_value(n) as n from dl group by all)
select s.arm, s.dimension, n_units, cast(round(n) as bigint) as n_values, round(case when d_e > 0 then 1 - d_o / d_e end, 6) as alpha from s join (select arm, dimension, count(distinct unit) as n_units from f group by all) u on u.arm = s.arm and u.dimension = s.dimension"""
_NOM = _ALPHA.format(delta="(a <> b)::int")
_ORD = _ALPHA.format(delta="case when a = b then 0 else pow(greatest(ua, ub) - least(ua - na, ub - nb) - (na + nb) / 2, 2) end")
_LAB = " union all ".join(f"select arm, '{k}' as dimension, item_id || '|' || l as unit, coalesce(list_contains({k}, l), false)::int as value from (select *, unnest({list(TAXONOMY[k])}) as l from ok_runs)" for k in ("target_group", "hate_type", "legal"))
_CORR = "select v.item_id, v.arm, i.gate as truth, v.hate as pred, v.hate = i.gate as ok from votes v join items i on v.item_id = i.id where i.gate is not null and v.hate is not null"
_LOGGED = "select v.item_id, v.arm, i.gate as truth, v.hate as pred, v.hate = i.gate as ok from results v join items i on v.item_id = i.id where i.gate is not null and v.hate is not null"
_PAIR = f", corr as ({_LOGGED}), pr as (select a.item_id, a.arm as arm_a, b.arm as arm_b, a.truth, a.pred as pred_a, b.pred as pred_b, a.ok as ok_a, b.ok as ok_b from corr a join corr b on a.item_id = b.item_id and a.arm < b.arm)"
_DRAWS = f"select b, 1 + ('0x' || substr(md5(b::varchar || '-' || i::varchar || '|0'), 1, 15))::bigint % n as pos from (select n, b, unnest(range(1, n + 1)) as i from (select n, unnest(range(1, {B} + 1)) as b from {{}}))"
_MAC = "(coalesce(2 * {0}tp / nullif(2 * {0}tp + {0}fp + {0}fn, 0)::double, 0) + coalesce(2 * {0}tn / nullif(2 * {0}tn + {0}fn + {0}fp, 0)::double, 0)) / 2"
_CELLS = ", ".join(f"sum(k) filter (where {t} and {q}) as {p}{n}" for p, c in (("a_", "pred_a"), ("b_", "pred_b")) for n, t, q in (("tp", "truth", c), ("fp", "not truth", c), ("fn", "truth", f"not {c}"), ("tn", "not truth", f"not {c}")))
_REP = ", rep as (select o.arm, o.run_idx, o.item_id, (o.hate = i.gate)::int as ok, substr(i.subset, 1, 2) as part from ok_runs o join items i on o.item_id = i.id where i.gate is not null)"
_DIFF = _REP + ", df as (select a.part, a.run_idx as replicate, a.ok - b.ok::int as d from rep a join (" + _LOGGED + ") b on a.item_id = b.item_id and b.arm = 'zero_shot' where a.arm = 'rag'), rp as (select part, replicate, avg(d) as m, stddev_samp(d) / sqrt(count(*)) as se from df group by all), ve as (select part, count(*) as n_replicates, avg(m) as delta, avg(se) as item_se, coalesce(stddev_samp(m), 0) as replicate_sd from rp group by part)"
_TYPES = ", gt as (select id as item_id, list_distinct(hate_types) as gold from items where gate and hate_types is not null), rk as (select r.*, g.gold, coalesce(list_has_all(o.hate_type, g.gold), false) as ok from runs r join gt g using (item_id) left join ok_runs o using (run_id))"
_VT = ", gt as (select id as item_id, list_distinct(hate_types) as gold from items where gate and hate_types is not null), vt as (select v.arm, v.item_id, g.gold, coalesce(list_has_all(v.hate_type, g.gold), false) as contains_ok, coalesce(list_has_all(v.hate_type, g.gold) and list_has_all(g.gold, v.hate_type), false) as exact_ok from votes v join gt g using (item_id))"
_FB = ", fb as (select id, cast(json_extract_string(m, '$.round') as bigint) as round, json_extract_string(m, '$.origin_item_id') as origin_item_id, json_extract_string(m, '$.feedback_arm') as feedback_arm from (select id, try_cast(meta as json) as m from kb where kind = 'feedback') where m is not null)"
_N = "('0x' || substr(md5(item_id || '|{}'), 1, 15))::bigint"

_COS = "list_cosine_similarity(a.vec::double[], b.vec::double[])"
#: CTEs down to ``leaks(eval_id, train_id, exact, normalised, sim)``.
_LEAKS = (
    norm.ctes("items") + ", train as (select * from kb where kind in ('example', 'feedback') and text is not null)" + norm.ctes("train").replace(", nf_wide", ", nf_wide2", 1).replace("nf_fold(c, v)", "nf_fold2(c, v)", 1)
    + """, ev as (select i.id, lower(trim(i.lang)) as lang, i.text, n.norm from items i join items_norm n using (id) where i.text is not null), tr as (select t.id, t.lang, t.text, n.norm from train t join train_norm n using (id)),
    same as (select e.id as eval_id, t.id as train_id, e.text = t.text as exact, true as normalised, 1.0 as sim from ev e join tr t on e.lang = t.lang and e.norm = t.norm),
    tok as (select distinct side, id, lang, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+')) as w from (select 'e' as side, id, lang, text from ev union all select 't', id, lang, text from tr) where lang is not null),
    tn as (select side, id, count(*) as n from tok group by all), sh as (select e.id as eval_id, t.id as train_id, count(*) as k from tok e join tok t on e.side = 'e' and t.side = 't' and e.lang = t.lang and e.w = t.w group by all),
    close as (select eval_id, train_id, k / sqrt(a.n * b.n) as sim from sh join tn a on a.side = 'e' and a.id = eval_id join tn b on b.side = 't' and b.id = train_id where k / sqrt(a.n * b.n) >= 0.95 - 1e-12),
    st as (select 'vec-' || vec_id as id, vec_id % 10 = 0 as is_eval, embedding as vec from embeddings), vp as (select a.id as eval_id, b.id as train_id, """ + _COS + """ as sim from st a join st b on a.is_eval and not b.is_eval),
    vr as (select *, row_number() over (partition by eval_id order by round(sim, 6) desc, train_id) as r1, row_number() over (partition by train_id order by round(sim, 6) desc, eval_id) as r2 from vp),
    every as (select * from same union all select eval_id, train_id, false, false, sim from close union all select eval_id, train_id, false, false, sim from vr where (r1 = 1 or r2 = 1) and round(sim, 6) >= 0.95),
    leaks as (select eval_id, train_id, bool_or(exact) as exact, bool_or(normalised) as normalised, max(sim) as sim from every group by all)"""
)

#: erfc by the power series of erf; 120 terms hold six places up to five standard deviations.
_ERFC = "greatest(0, 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 120), lambda k: case when k % 2 = 0 then 1 else -1 end * exp((2 * k + 1) * ln(greatest({0}, 1e-12)) - lgamma(k + 1)) / (2 * k + 1))))"

ORACLE = {
    "heterogeneity_pool": sql(
        _DIFF + """, e as (select delta, sqrt(item_se * item_se + replicate_sd * replicate_sd / n_replicates) as se from ve), w as (select *, 1 / (se * se) as w from e where se > 0),
        p as (select count(*) as k, sum(w * delta) / sum(w) as pooled, 1 / sqrt(sum(w)) as pooled_se, sum(w * delta * delta) as sw, sum(w) as ww from w), q as (select *, greatest(0, sw - ww * pooled * pooled) as q, pooled / pooled_se as z from p)
        select 'rag - zero_shot' as contrast, k, round(pooled, 6) as pooled, round(pooled_se, 6) as pooled_se, round(q, 6) as q, round(z, 6) as z, round(case when q > 0 then greatest(0, (q - (k - 1)) / q) else 0 end, 6) as i2, """
        + f"round({_ERFC.format('abs(z) / sqrt(2)')}, 6) as p_pooled, round({_ERFC.format('sqrt(q / 2)')}, 6) as p_q_1df from q where k > 0",
        "ok_runs", "items", "results",
    ),
    "leakage_scan": sql(_LEAKS + ", i as (select id as eval_id, subset from items union all select id, 'stored vectors' from st where is_eval) select subset, count(distinct eval_id) as n_items, count(distinct eval_id) filter (where exact) as n_exact, count(distinct eval_id) filter (where normalised) as n_normalised, count(distinct eval_id) filter (where not normalised) as n_near, count(*) as n_pairs from leaks join i using (eval_id) group by subset", "items", "kb"),
    "leak_exclusions": sql(_LEAKS + ", top as (select train_id as id, max(sim) as sim from leaks group by 1), l as (select id, lower(trim(lang)) as lang from train union all select id, null from st where not is_eval) select lang, id from top join l using (id) where round(sim, 6) >= 0.95", "items", "kb"),
    "retrieval_leak_rescore": sql(_LEAKS + f", shown as (select distinct eval_id from leaks join hits h on h.item_id = eval_id and h.hit_id = train_id), gp as (select g.item_id, g.truth, g.pred from gate_pairs g where arm = 'rag' and mapping = 'strict'), x as (select 'all' as items, * from gp union all select 'clean', * from gp where item_id not in (select eval_id from shown)), z as (select items, count(*) filter (where truth and pred) as tp, count(*) filter (where not truth and pred) as fp, count(*) filter (where truth and not pred) as fn, count(*) filter (where not truth and not pred) as tn from x where truth is not null and pred is not null group by items) select items, tp + fp + fn + tn as n_scored, tp, fp, fn, tn, round({_MAC.format('')}, 6) as macro_f1 from z", "items", "kb", "hits", "gate_pairs"),
    "alpha_nominal": sql(", units as (select arm, 'gate' as dimension, item_id as unit, hate::int as value from ok_runs)" + _NOM, "ok_runs"),
    "alpha_multilabel": sql(f", units as ({_LAB})" + _NOM, "ok_runs"),
    "alpha_ordinal": sql(", units as (select arm, 'severity' as dimension, item_id as unit, rank as value from ok_runs where rank is not null)" + _ORD, "ok_runs"),
    "mcnemar_counts": sql(
        _PAIR + """, cc as (select arm_a, arm_b, count(*) filter (where ok_a and ok_b) as both_correct, count(*) filter (where not ok_a and not ok_b) as both_wrong, count(*) filter (where ok_a and not ok_b) as only_a, count(*) filter (where not ok_a and ok_b) as only_b from pr group by all)
        select *, only_a + only_b as discordant, round(case when only_a + only_b = 0 then 1.0 else least(1.0, 2 * list_sum(list_transform(range(0, least(only_a, only_b) + 1), lambda i: exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2))))) end, 6) as p_value from cc""",
        "results", "items",
    ),
    "paired_bootstrap": sql(
        _PAIR + f""", ids as (select item_id, row_number() over (order by item_id) as pos from (select distinct item_id from pr)), n as (select count(*) as n from ids), dr as (select b, pos, count(*) as k from ({_DRAWS.format('n')}) group by all),
        z as (select arm_a, arm_b, b, {_CELLS} from pr join ids using (item_id) join dr using (pos) group by all), y as (select arm_a, arm_b, {', '.join(f'coalesce({p}{c}, 0) as {p}{c}' for p in ('a_', 'b_') for c in ('tp', 'fp', 'fn', 'tn'))} from z),
        w as (select arm_a, arm_b, {_MAC.format('a_')} - {_MAC.format('b_')} as d from y where a_tp + a_fn > 0 and a_fp + a_tn > 0),
        r as (select arm_a, arm_b, count(*) as n_resamples, quantile_cont(d, 0.025) as lo, quantile_cont(d, 0.975) as hi, stddev_samp(d) as sd, count(*) filter (where d > 0) as favour_a, count(*) filter (where d = 0) as ties, count(*) filter (where d < 0) as favour_b from w group by all)
        select arm_a, arm_b, n_resamples, round(lo, 6) as ci_low, round(hi, 6) as ci_high, round(sd, 6) as sd, round(least(1.0, 2 * least((favour_b + ties / 2) / n_resamples, (favour_a + ties / 2) / n_resamples)), 6) as p_value, favour_a, ties, favour_b from r""",
        "results", "items",
    ),
    "label_survival": sql(f", g as (select row_number() over (order by id) as pos, hate_types from items where gate and hate_types is not null), n as (select count(*) as n from g), dr as (select b, pos, count(*) as k from ({_DRAWS.format('n')}) group by all), x as (select b, label, sum(k) as support from (select b, k, unnest(hate_types) as label from dr join g using (pos)) group by all) select n_labels, count(*) as n_resamples from (select b, count(*) filter (where support >= 12) as n_labels from x group by b) group by n_labels", "items"),
    "guideline_effect": sql(f", corr as ({_CORR}), sh as (select distinct item_id, hit_id as guideline from hits where bucket = 'guidelines'), g as (select guideline, a.truth as gold_hate, count(*) as n, count(*) filter (where a.ok) as correct, count(b.ok) as n_paired, count(*) filter (where b.ok) as base_correct from sh join corr a on a.item_id = sh.item_id and a.arm = 'rag' left join corr b on b.item_id = sh.item_id and b.arm = 'zero_shot' group by all) select *, round(correct / n, 6) as accuracy, round(base_correct / nullif(n_paired, 0)::double, 6) as base_accuracy, round(correct / n - base_correct / nullif(n_paired, 0)::double, 6) as delta from g", "votes", "items", "hits"),
    "replicate_floor": sql(_REP + ", sc as (select arm, run_idx, avg(ok) as score from rep group by all), a as (select arm, count(*) as n, min(score) as lowest, max(score) as highest, avg(score) as mean, max(score) - min(score) as spread from sc group by arm) select arm, n, round(lowest, 6) as lowest, round(highest, 6) as highest, round(mean, 6) as mean, round(spread, 6) as spread, round(max(spread) over (), 6) as floor from a", "ok_runs", "items"),
    "variance_estimate": sql(_DIFF + " select part, n_replicates, round(delta, 6) as delta, round(item_se, 6) as item_se, round(replicate_sd, 6) as replicate_sd, round(sqrt(item_se * item_se + replicate_sd * replicate_sd / n_replicates), 6) as total_se from ve", "ok_runs", "items", "results"),
    "arm_disagreement": sql(_PAIR + " select arm_a, arm_b, count(*) as n, round(avg((pred_a = pred_b)::int), 6) as agreement, count(*) filter (where ok_a and not ok_b) as wins, count(*) filter (where not ok_a and ok_b) as losses from pr group by all", "results", "items"),
    "threshold_sweep": sql(f", p as (select arm, item_id, avg(hate::int) as p from ok_runs group by all), x as (select p.arm, t, p.p >= t / {STEPS} as hit, i.gate as truth from p join items i on p.item_id = i.id cross join (select unnest(range(1, {STEPS})) as t) where i.gate is not null), z as (select arm, t, count(*) filter (where truth and hit) as tp, count(*) filter (where not truth and hit) as fp, count(*) filter (where truth and not hit) as fn, count(*) filter (where not truth and not hit) as tn from x group by all) select arm, round(t / {STEPS}, 6) as threshold, round({_MAC.format('')}, 6) as macro_f1, round((tp + fp) / (tp + fp + fn + tn), 6) as predicted_rate from z", "ok_runs", "items"),
    "item_stability": sql(_TYPES + " select arm, count(*) as n, count(*) filter (where a) as all_correct, count(*) filter (where o) as any_correct from (select item_id, arm, bool_and(ok) as a, bool_or(ok) as o from rk group by all) group by arm", "runs", "ok_runs", "items"),
    "sentinel": sql(_TYPES + " select item_id, count(*) as n_runs from rk where arm = 'rag' group by item_id having bool_and(ok)", "runs", "ok_runs", "items"),
    "sentinel_flips": sql(_TYPES + ", w as (select item_id, arm, any_value(gold) as gold, bool_or(ok) filter (where run_idx = 0) as before, bool_or(ok) filter (where run_idx = 1) as after from rk group by all) select arm, label, count(*) as support, count(*) filter (where not after) as flips from (select arm, after, unnest(gold) as label from w where before and after is not null) group by all", "runs", "ok_runs", "items"),
    "batch_errors": sql(_VT + ", z as (select id, array_to_string(list_sort(hate_types), ',') as labels from items where gate and hate_types is not null)" + building.ROLES_CTE + ", j as (select arm, exact_ok, contains_ok, unnest(case when slice > 'batch_1' and starts_with(slice, 'batch_') then [slice, 'unseen'] else [slice] end) as batch from vt join sl on sl.id = vt.item_id) select arm, batch, count(*) as n, count(*) filter (where exact_ok) as n_correct, count(*) filter (where contains_ok) as n_contains from j group by all", "votes", "items"),
    "feedback_round": sql(_VT + f" select item_id, case when exact_ok then 'control' else 'feedback' end as feedback_arm from (select *, row_number() over (partition by exact_ok order by {_N.format(1)}, item_id) as r from vt where arm = 'rag') where r <= 12", "votes", "items"),
    "feedback_cumulative": sql(_FB + " select feedback_arm, round, count(*) as n from (select *, row_number() over (partition by id order by round desc, origin_item_id) as r from fb where round <= 2) where r = 1 group by all", "kb"),
    "feedback_gate_origin": sql(_FB + " select feedback_arm, round, v.hate::varchar as predicted, count(*) as n from fb left join votes v on v.item_id = fb.origin_item_id and v.arm = 'rag' group by all", "kb", "votes"),
    "generalisation_bands": sql(f", corr as ({_CORR}), b as (select item_id, max(score) as sim from hits where score is not null group by item_id), r as (select *, row_number() over (order by round(sim, 6) desc, item_id) as r, count(*) over () as n from b), z as (select item_id, sim, 1 + (r > round_even(n / 4.0, 0))::int + (r > round_even(n * 2 / 4.0, 0))::int + (r > round_even(n * 3 / 4.0, 0))::int as band from r) select band, count(*) as n, round(avg(ok::int), 6) as accuracy, round(min(sim), 6) as lowest from z join corr using (item_id) where arm = 'rag' group by band", "votes", "items", "hits"),
    "log_calls_per_day": sql("select strftime(run_ts, '%Y-%m-%d') as day, arm, count(*) as n from runs where run_ts is not null group by all", "runs"),
    "log_by_model": sql("select active_model, count(*) as n, strftime(min(run_ts), '%Y-%m-%d') as first_day, strftime(max(run_ts), '%Y-%m-%d') as last_day, count(distinct strftime(run_ts, '%Y-%m-%d')) as active_days from results group by active_model", "results"),
    "log_phase_ranges": sql(", ph as (select * from (values " + ", ".join(f"('{n}', '{a}', '{b}')" for n, a, b in PHASES) + ") t(phase, a, b)) select phase, count(*) as n from runs join ph on strftime(run_ts, '%Y-%m-%d') between a and b group by phase", "runs"),
    "log_latency_percentiles": sql("select arm, count(*) as n, list_extract(l, cast(floor(len(l) * 0.5) as bigint) + 1) as p50, list_extract(l, cast(floor(len(l) * 0.9) as bigint) + 1) as p90, list_extract(l, cast(floor(len(l) * 0.99) as bigint) + 1) as p99, round(list_sum(l) / 3600, 6) as hours from (select arm, unnest(l) as u, l from (select arm, list_sort(list(latency_s)) as l from runs where latency_s is not null group by arm)) group by arm, l", "runs"),
    "log_events_per_type": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n from events where ts is not null group by all",
    "log_corrupt_lines": sql("select source, count(raw) as n_lines, count(*) filter (where raw is not null and try_cast(raw as json) is null) as n_corrupt from items group by source", "items"),
    "stamp_audit": sql(" union all ".join(f"select arm, '{c}' as stamp, count(distinct {c}) as n_values, coalesce(array_to_string(list_sort(list(distinct {c}::varchar) filter (where {c} is not null)), ','), '') as values from results group by arm" for c in STAMPS), "results"),
    "comparability_groups": sql("select coalesce(active_model, 'unstamped') as active_model, coalesce(prompt_version, 'unstamped') as prompt_version, coalesce(kb_version, 'unstamped') as kb_version, coalesce(temperature::varchar, 'unstamped') as temperature, count(*) as n, array_to_string(list_sort(list(distinct arm)), ',') as arms from results group by 1, 2, 3, 4", "results"),
    "requested_vs_observed": sql(", w as (select * from (values ('zero_shot', 'active_model', 'strong-a'), ('zero_shot', 'workers', '4'), ('few_shot', 'active_model', 'medium-b'), ('few_shot', 'workers', '4'), ('rag', 'active_model', 'strong-a'), ('rag', 'workers', '8')) t(arm, stamp, requested)), o as (select distinct arm, 'active_model' as stamp, active_model as observed from results union select distinct arm, 'workers', workers::varchar from results) select arm, stamp, requested, observed from w join o using (arm, stamp) where requested is distinct from observed", "results"),
    "dimension_reach": sql(" union all ".join(f"select '{c}' as dimension, count(*) as n, count({c}) as voted, strftime(min(run_ts) filter (where {c} is not null), '%Y-%m-%d') as first_voted from runs" for c in ("hate", "target_group", "hate_type", "severity", "legal")), "runs"),
    "slot_allocation": sql(", h as (select distinct item_id, hit_id from hits where bucket = 'definitions') select k.dimension, count(*) as slots, round(count(*) / (select count(*) from h), 6) as slot_share, count(distinct item_id) as items, round(count(distinct item_id) / (select count(distinct item_id) from h), 6) as item_share from h left join (select id, dimension from kb where kind = 'definition') k on h.hit_id = k.id group by k.dimension", "hits", "kb"),
    "dead_records": sql("select kind, count(*) as n from kb where id not in (select hit_id from hits where hit_id is not null) group by kind", "kb", "hits"),
    "most_used_records": sql("select hit_id, count(*) as n from hits group by hit_id order by n desc, hit_id limit 10", "hits"),
    "label_relevance": sql(
        """, k as (select id, coalesce(from_json(json_extract(try_cast(meta as json), '$.hate_types'), '["VARCHAR"]'), []) as labels from kb where kind = 'example'), gt as (select id as item_id, list_distinct(hate_types) as gold from items where gate and hate_types is not null),
        h as (select distinct item_id, hit_id from hits where bucket = 'examples'), i as (select g.item_id, any_value(g.gold) as gold, max(list_has_any(g.gold, k.labels)::int) as hit, count(*) as n from h join k on h.hit_id = k.id join gt g using (item_id) group by g.item_id),
        sh as (select g.gold, (select count(*) from k where list_has_any(g.gold, k.labels)) / (select count(*) from k)::double as share from (select distinct gold from gt) g)
        select count(*) as n_items, round(avg(hit), 6) as observed, round(avg(1 - pow(1 - share, n)), 6) as chance from i join sh using (gold)""",
        "hits", "kb", "items",
    ),
    "draw_ladder": sql(", g as (select label, count(*) as n from (select unnest(list_distinct(hate_types)) as label from items where gate and hate_types is not null) group by label), r as (select *, row_number() over (order by n, label) as r, count(*) over () as k from g) select r - 1 as dropped, k - r + 1 as kept, (k - r + 1) * n as ceiling from r", "items"),
    "comment_level": sql("select item_id, count(*) as n, round(avg(latency_s), 6) as mean_latency, bool_or(coalesce(hate, false)) as any_hate, arg_min(arm, (run_ts, run_id)) as first_arm from runs group by item_id", "runs"),
    "batch_of_name": sql(r"select regexp_extract(id, '-(\d)\d*$', 1) as digit, count(*) as n from kb group by 1", "kb"),
    "text_hash_conflicts": "select n_hashes, count(*) as n_items from (select item_id, count(distinct text_hash) as n_hashes from item_results group by item_id) group by n_hashes",
    "stream_log_daily": "select strftime(run_ts, '%Y-%m-%d') as day, arm, count(distinct run_id) as n from run_results group by all",
    "stream_append": "select arm, count(distinct item_id) as n from item_results group by arm",
}
