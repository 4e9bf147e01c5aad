"""Queries over votes and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalweave.operators import labels as L
from evalweave.operators import metrics as M
from evalweave.operators import vote as V
from evalweave.plans import data
from evalweave.plans.data import sql

LENIENT = "agora"
_RUN = ("item_id", "arm", "run_idx", "reasoning", "hate", "target_group", "hate_type", "severity", "legal", "parse_failure")


def _join(c: str):
    return F.array_join(c, ",").alias(c)


def _r(c: str):
    return F.round(c, 6).alias(c)


def voted(s, d):
    return V.vote(data.runs(s, d, *_RUN))


def _gate_pairs(s, d):
    v, i = voted(s, d), data.items(s, d, "source", "gate", "raw")
    return M.gate_pairs(v, i).unionByName(M.gate_pairs(v, i, "lenient", LENIENT))


def gate_score_by_arm(s, d):
    x = M.score_gate(_gate_pairs(s, d))
    return x.select("arm", "mapping", "tp", "fp", "fn", "tn", "n_scored", "n_unscored", "n_uncertain", *[_r(c) for c in ("macro_f1", "macro_f1_confident", "precision_hate", "recall_hate", "f1_hate", "precision_not_hate", "recall_not_hate", "f1_not_hate")])


def gate_score_per_source(s, d):
    x = M.gate_by_source(_gate_pairs(s, d))
    return x.select("arm", "mapping", "source", "n", "benign", "hateful", "fp", "fn", _r("fp_rate"), _r("fn_rate"))


def original_class_counts(s, d):
    return data.items(s, d, "raw").select(L.original_class("raw").alias("cls")).groupBy("cls").agg(F.count("*").alias("n"))


def hate_rate_by_class(s, d):
    cls = data.items(s, d, "raw").select(F.col("id").alias("item_id"), L.original_class("raw").alias("cls"))
    v = voted(s, d).filter("hate is not null").join(cls, "item_id")
    return v.groupBy("cls", "arm").agg(F.count("*").alias("n"), F.round(F.avg(F.col("hate").cast("double")), 6).alias("hate_rate"))


def _label_pairs(s, d):
    return M.label_pairs(voted(s, d), data.items(s, d, "gate", "target_groups", "hate_types", "legal"))


def multilabel_per_label(s, d):
    x = M.per_label(_label_pairs(s, d))
    return x.select("arm", "dimension", "label", "tp", "fp", "fn", "support", "predicted", "averaged", _r("precision"), _r("recall"), _r("f1"))


def multilabel_macro_micro(s, d):
    x = M.multilabel_summary(M.per_label(_label_pairs(s, d)))
    return x.select("arm", "dimension", "n_averaged", "n_labels", _r("macro_f1"), _r("micro_f1"))


def multilabel_fixed_labels(s, d):
    labels = M.per_label(_label_pairs(s, d))
    fixed = labels.filter("arm = 'rag' and averaged").select("dimension", "label")
    return M.multilabel_summary(labels, fixed=fixed).select("arm", "dimension", "n_averaged", _r("macro_f1"))


def macro_exclude(s, d):
    x = M.multilabel_summary(M.per_label(_label_pairs(s, d)), exclude=("other", "irony"))
    return x.select("arm", "dimension", "n_averaged", _r("macro_f1"))


def multilabel_extras(s, d):
    p = _label_pairs(s, d)
    x = M.multilabel_extras(p, M.per_label(p))
    return x.select("arm", "dimension", "n_items", "n_unscored", *[_r(c) for c in ("subset_accuracy", "hamming_loss", "mean_gold_labels", "mean_pred_labels", "any_overlap_rate", "gold_subset_of_pred")])


def scorable_dimension(s, d):
    return M.scorable_dimension(M.multilabel_summary(M.per_label(_label_pairs(s, d))))


def label_error_share(s, d):
    return M.top_two_share(M.per_label(_label_pairs(s, d))).select("arm", "dimension", _r("top_two_share"))


def severity_score(s, d):
    x = M.score_severity(M.severity_pairs(voted(s, d), data.items(s, d, "gate", "severity")))
    return x.select("arm", "n_items", "n_predicted_null", *[_r(c) for c in ("accuracy", "mean_abs_rank_error", "within_one_accuracy", "macro_f1")])


def calibration_bins(s, d):
    x = M.calibration_bins(M.gate_pairs(voted(s, d), data.items(s, d, "source", "gate", "raw")))
    return x.select("arm", "confidence", "n", _r("accuracy"))


def calibration_ece(s, d):
    x = M.expected_calibration_error(M.calibration_bins(M.gate_pairs(voted(s, d), data.items(s, d, "source", "gate", "raw"))))
    return x.select("arm", "n", _r("ece"))


def honesty_stats(s, d):
    x = M.honesty(data.results(s, d))
    return x.withColumn("parse_failure_rate", F.round("parse_failure_rate", 6)).withColumn("mean_latency_s", F.round("mean_latency_s", 4))


def scorable_vs_annotated(s, d):
    return M.annotated_and_scorable(data.items(s, d, "gate", "target_groups", "hate_types", "legal"))


def vote_full(s, d):
    x = voted(s, d)
    return x.select("item_id", "arm", "n_runs", "n_valid", F.col("hate").cast("string").alias("hate"), "uncertain", _join("target_group"), _join("hate_type"), _join("legal"), "severity", *[_r(f"agreement_{c}") for c in ("hate", "severity", "target_group", "hate_type", "legal")], _join("dropped"))


def vote_label_counts(s, d):
    return V.label_votes(data.runs(s, d, *_RUN))


def single_run_view(s, d):
    x = V.single_run_view(data.runs(s, d, *_RUN))
    return x.groupBy("arm").agg(F.count("*").alias("n_items"), F.sum("n_valid").alias("n_valid"), F.sum(F.col("hate").cast("long")).alias("n_hate"), F.sum(F.size(F.coalesce("hate_type", F.array()))).alias("n_hate_types"))


def single_run_gate(s, d):
    x = M.score_gate(M.gate_pairs(V.single_run_view(data.runs(s, d, *_RUN)), data.items(s, d, "source", "gate", "raw")), ("arm",))
    return x.select("arm", "tp", "fp", "fn", "tn", "n_unscored", _r("macro_f1"))


def revote_changed(s, d):
    return V.revote_changes(voted(s, d), data.results(s, d, "hate"))


def run_stability(s, d):
    x = V.agreement_all_runs(data.runs(s, d, *_RUN))
    return x.groupBy("arm").agg(F.count("*").alias("n"), F.count(F.when(F.col("all_agree"), 1)).alias("n_agree"))


def fill_rate(s, d):
    x = voted(s, d).filter("n_valid > 0")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), (F.size(k) > 0).alias("filled")) for k in L.MULTILABEL]))
    return x.select("arm", each.alias("x")).groupBy("arm", "x.dimension").agg(F.count("*").alias("n"), F.round(F.avg(F.col("x.filled").cast("double")), 6).alias("fill_rate"))


_CELL = "count(*) filter (where truth and pred) as tp, count(*) filter (where not truth and pred) as fp, count(*) filter (where truth and not pred) as fn, count(*) filter (where not truth and not pred) as tn"
_F1 = "coalesce(2 * {0} / nullif(2 * {0} + {1} + {2}, 0)::double, 0)"
_HATE, _NOT = _F1.format("tp", "fp", "fn"), _F1.format("tn", "fn", "fp")
_CH, _CN = _F1.format("ctp", "cfp", "cfn"), _F1.format("ctn", "cfn", "cfp")
_CCELL = "count(*) filter (where truth and pred and not uncertain) as ctp, count(*) filter (where not truth and pred and not uncertain) as cfp, count(*) filter (where truth and not pred and not uncertain) as cfn, count(*) filter (where not truth and not pred and not uncertain) as ctn"
_ONE_RUN = "select r.item_id, r.arm, 1 as n_runs, case when o.run_id is null then 0 else 1 end as n_valid, o.hate, o.hate_type from runs r left join ok_runs o using (run_id) where r.run_idx = 0"

QUERIES = {
    f.__name__: f
    for f in (gate_score_by_arm, gate_score_per_source, original_class_counts, hate_rate_by_class, multilabel_per_label, multilabel_macro_micro, multilabel_fixed_labels, macro_exclude, multilabel_extras, scorable_dimension, label_error_share, severity_score, calibration_bins, calibration_ece, honesty_stats, scorable_vs_annotated, vote_full, vote_label_counts, single_run_view, single_run_gate, revote_changed, run_stability, fill_rate)
}

ORACLE = {
    "gate_score_by_arm": sql(
        f"""select arm, mapping, tp, fp, fn, tn, n_scored, n_unscored, n_uncertain,
          round(case when tp + fn > 0 and fp + tn > 0 then ({_HATE} + {_NOT}) / 2 end, 6) as macro_f1,
          round(case when n_uncertain > 0 and n_uncertain < n_scored then ({_CH} + {_CN}) / 2 end, 6) as macro_f1_confident,
          round(coalesce(tp / nullif(tp + fp, 0)::double, 0), 6) as precision_hate, round(coalesce(tp / nullif(tp + fn, 0)::double, 0), 6) as recall_hate, round({_HATE}, 6) as f1_hate,
          round(coalesce(tn / nullif(tn + fn, 0)::double, 0), 6) as precision_not_hate, round(coalesce(tn / nullif(tn + fp, 0)::double, 0), 6) as recall_not_hate, round({_NOT}, 6) as f1_not_hate
        from (select arm, mapping, {_CELL}, {_CCELL}, count(*) filter (where truth is not null and pred is not null) as n_scored, count(*) filter (where pred is null) as n_unscored,
          count(*) filter (where truth is not null and pred is not null and uncertain) as n_uncertain from gate_pairs group by arm, mapping)""",
        "gate_pairs",
    ),
    "gate_score_per_source": sql(
        f"select arm, mapping, source, n, fp + tn as benign, tp + fn as hateful, fp, fn, round(fp / nullif(fp + tn, 0)::double, 6) as fp_rate, round(fn / nullif(tp + fn, 0)::double, 6) as fn_rate from (select arm, mapping, source, count(*) as n, {_CELL} from gate_pairs where truth is not null and pred is not null group by all)",
        "gate_pairs",
    ),
    "original_class_counts": sql("select cls, count(*) as n from items left join classes using (id) group by cls", "items", "classes"),
    "hate_rate_by_class": sql("select cls, arm, count(*) as n, round(avg(hate::int), 6) as hate_rate from votes v join items i on v.item_id = i.id left join classes c on c.id = i.id where hate is not null group by cls, arm", "votes", "classes"),
    "multilabel_per_label": sql("select arm, dimension, label, tp, fp, fn, support, predicted, averaged, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from per_label", "per_label"),
    "multilabel_macro_micro": sql("select arm, dimension, count(*) filter (where averaged) as n_averaged, count(*) as n_labels, round(avg(f1) filter (where averaged), 6) as macro_f1, round(coalesce(2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0)::double, 0), 6) as micro_f1 from per_label group by arm, dimension", "per_label"),
    "multilabel_fixed_labels": sql("select arm, dimension, count(f.label) as n_averaged, round(avg(f1) filter (where f.label is not null), 6) as macro_f1 from per_label p left join (select dimension, label from per_label where arm = 'rag' and averaged) f using (dimension, label) group by arm, dimension", "per_label"),
    "macro_exclude": sql("select arm, dimension, count(*) filter (where averaged and label not in ('other', 'irony')) as n_averaged, round(avg(f1) filter (where averaged and label not in ('other', 'irony')), 6) as macro_f1 from per_label group by arm, dimension", "per_label"),
    "multilabel_extras": sql(
        """select e.arm, e.dimension, n_items, n_unscored, round(subset_accuracy, 6) as subset_accuracy, round(diff / (n_items * greatest(coalesce(k, 1), 1))::double, 6) as hamming_loss,
          round(mean_gold_labels, 6) as mean_gold_labels, round(mean_pred_labels, 6) as mean_pred_labels, round(any_overlap_rate, 6) as any_overlap_rate, round(gold_subset_of_pred, 6) as gold_subset_of_pred
        from (select arm, dimension, count(pred) as n_items, count(*) - count(pred) as n_unscored, avg((d = 0)::int) as subset_accuracy, sum(d) as diff, avg(len(gold)) filter (where pred is not null) as mean_gold_labels,
            avg(len(pred)) as mean_pred_labels, avg(list_has_any(gold, pred)::int) filter (where pred is not null) as any_overlap_rate, avg(list_has_all(pred, gold)::int) filter (where pred is not null) as gold_subset_of_pred
          from (select *, case when pred is not null then len(list_filter(gold, lambda x: not list_contains(pred, x))) + len(list_filter(pred, lambda x: not list_contains(gold, x))) end as d from label_pairs) group by arm, dimension) e
        left join (select arm, dimension, count(*) as k from per_label group by all) n on e.arm = n.arm and e.dimension = n.dimension""",
        "label_pairs", "per_label",
    ),
    "scorable_dimension": sql("select arm, arg_min(dimension, pos) as dimension from (select arm, dimension, case dimension when 'target_group' then 1 when 'hate_type' then 2 else 3 end as pos from per_label where averaged) group by arm", "per_label"),
    "label_error_share": sql("select arm, dimension, round(sum(e) filter (where r <= 2) / nullif(sum(e), 0)::double, 6) as top_two_share from (select *, fp + fn as e, row_number() over (partition by arm, dimension order by fp + fn desc, label) as r from per_label) group by arm, dimension", "per_label"),
    "severity_score": sql(
        """, p as (select v.arm, i.severity as gold, v.severity as pred from votes v join items i on v.item_id = i.id where n_valid > 0 and gate and i.severity is not null),
        q as (select *, list_position(['low', 'medium', 'high'], gold) as g, list_position(['low', 'medium', 'high'], pred) as r from p),
        l as (select arm, label, count(*) filter (where gold = label and pred = label) as tp, count(*) filter (where gold <> label) as fp, count(*) filter (where pred is distinct from label) as fn
              from (select arm, gold, pred, unnest(list_distinct([gold, pred])) as label from p) group by all),
        m as (select arm, avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 0)) filter (where tp + fn >= 10) as macro_f1 from l group by arm)
        select q.arm, count(*) as n_items, count(*) - count(pred) as n_predicted_null, round(avg(coalesce(gold = pred, false)::int), 6) as accuracy, round(avg(abs(g - r)) filter (where r > 0), 6) as mean_abs_rank_error,
          round(avg((abs(g - r) <= 1)::int) filter (where r > 0), 6) as within_one_accuracy, round(any_value(macro_f1), 6) as macro_f1 from q left join m using (arm) group by q.arm""",
        "votes", "items",
    ),
    "calibration_bins": sql("select arm, round(confidence, 3) as confidence, count(*) as n, round(avg((truth = pred)::int), 6) as accuracy from gate_pairs where mapping = 'strict' and truth is not null and pred is not null group by 1, 2", "gate_pairs"),
    "calibration_ece": sql(", b as (select arm, round(confidence, 3) as c, count(*) as n, avg((truth = pred)::int) as a from gate_pairs where mapping = 'strict' and truth is not null and pred is not null group by 1, 2) select arm, cast(sum(n) as bigint) as n, round(sum(n * abs(a - c)) / sum(n), 6) as ece from b group by arm", "gate_pairs"),
    "honesty_stats": sql(
        """select arm, count(*) as n_items, cast(sum(n_runs) as bigint) as total_runs, cast(sum(parse_failures) as bigint) as parse_failures, round(sum(parse_failures) / greatest(sum(n_runs), 1)::double, 6) as parse_failure_rate,
          cast(sum(repairs) as bigint) as repairs, cast(sum(normalisations) as bigint) as normalisations, count(*) filter (where uncertain) as uncertain, count(*) - count(hate) as no_prediction,
          round(sum(list_sum(latencies)) / greatest(sum(len(latencies)), 1)::double, 4) as mean_latency_s, array_to_string(list_sort(list(distinct workers::varchar)), ',') as workers,
          array_to_string(list_sort(list(distinct active_model) filter (where active_model is not null)), ',') as models, coalesce(array_to_string(list_sort(list(distinct kb_version) filter (where kb_version is not null)), ','), '') as kb_versions,
          array_to_string(list_sort(list(distinct prompt_version) filter (where prompt_version is not null)), ',') as prompt_versions from results group by arm""",
        "results",
    ),
    "scorable_vs_annotated": sql(
        """select dimension, annotated, scorable, annotated - scorable as lost from (
          select 'target_group' as dimension, count(target_groups) as annotated, count(target_groups) filter (where gate) as scorable from items
          union all select 'hate_type', count(hate_types), count(hate_types) filter (where gate) from items union all select 'legal', count(legal), count(legal) from items)""",
        "items",
    ),
    "vote_full": sql(
        """select item_id, arm, n_runs, n_valid, hate::varchar as hate, uncertain, array_to_string(target_group, ',') as target_group, array_to_string(hate_type, ',') as hate_type, array_to_string(legal, ',') as legal, severity,
          round(agreement_hate, 6) as agreement_hate, round(agreement_severity, 6) as agreement_severity, round(agreement_target_group, 6) as agreement_target_group, round(agreement_hate_type, 6) as agreement_hate_type, round(agreement_legal, 6) as agreement_legal,
          case when n_valid > 0 then array_to_string(list_filter([case when any_target_group and len(target_group) = 0 then 'target_group' end, case when any_hate_type and len(hate_type) = 0 then 'hate_type' end, case when any_legal and len(legal) = 0 then 'legal' end], lambda x: x is not null), ',') end as dropped from votes""",
        "votes",
    ),
    "vote_label_counts": sql("select item_id, arm, dimension, label, c from label_votes", "label_votes"),
    "single_run_view": sql(f"select arm, count(*) as n_items, cast(sum(n_valid) as bigint) as n_valid, cast(sum(hate::int) as bigint) as n_hate, cast(sum(coalesce(len(hate_type), 0)) as bigint) as n_hate_types from ({_ONE_RUN}) group by arm", "ok_runs"),
    "single_run_gate": sql(f"select arm, tp, fp, fn, tn, n_unscored, round(case when tp + fn > 0 and fp + tn > 0 then ({_HATE} + {_NOT}) / 2 end, 6) as macro_f1 from (select arm, {_CELL}, count(*) filter (where pred is null) as n_unscored from (select o.arm, o.hate as pred, i.gate as truth from ({_ONE_RUN}) o join items i on o.item_id = i.id) group by arm)", "ok_runs", "items"),
    "revote_changed": sql("select v.item_id, v.arm, r.hate as old_hate, v.hate as new_hate from votes v join results r on v.item_id = r.item_id and v.arm = r.arm where v.hate is distinct from r.hate", "votes", "results"),
    "run_stability": sql("select arm, count(*) as n, count(*) filter (where a) as n_agree from (select item_id, arm, min(hate::int) = max(hate::int) as a from ok_runs group by all) group by arm", "ok_runs"),
    "fill_rate": sql("select arm, dimension, count(*) as n, round(avg((n > 0)::int), 6) as fill_rate from (select arm, 'target_group' as dimension, len(target_group) as n from votes where n_valid > 0 union all select arm, 'hate_type', len(hate_type) from votes where n_valid > 0 union all select arm, 'legal', len(legal) from votes where n_valid > 0) group by all", "votes"),
}
