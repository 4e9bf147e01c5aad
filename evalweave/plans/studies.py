"""Queries over probabilities, roles, feedback, injected records, stored files and comparisons."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evalweave.functions import text as X
from evalweave.operators import analysis as A
from evalweave.operators import audit as U
from evalweave.operators import kb as K
from evalweave.operators import prompt as T
from evalweave.operators import retrieve as R
from evalweave.operators import sampling as S
from evalweave.operators import study as Y
from evalweave.operators import vote as V
from evalweave.operators.labels import TAXONOMY
from evalweave.plans import audits, building, data, retrieval, scoring
from evalweave.plans.data import sql
from evalweave.session import shared_dir, track
from evalweave.sources import config as C
from evalweave.sources import jsonl as J
from evalweave.sources.tables import head, table

TYPES = TAXONOMY["hate_type"]
_DIMS = ("hate", "target_group", "hate_type", "severity", "legal")
#: Dimensions that an arm is not asked for.
BY_DESIGN = {"zero_shot": ("legal",)}
#: The round up to which corrections were written, and the next one.
UPTO, ROUND = 2, 1


def _r(c, n=6):
    return F.round(c, n).alias(c)


def _valid(s, d):
    return data.runs(s, d, *scoring._RUN).filter(V.valid())


def _gold(s, d):
    return audits._gold_types(s, d)


def legal_flags(s, d):
    """Paragraphs that more than half of an item's runs flagged."""
    r = _valid(s, d)
    n = r.groupBy("item_id").agg(F.count("*").alias("n"))
    k = r.select("item_id", "run_id", F.explode(F.array_distinct("legal")).alias("label")).groupBy("item_id", "label").agg(F.count("*").alias("k")).join(n, "item_id")
    return k.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("label", F.col("k") / F.col("n")))).alias("m")).select("item_id", Y.flagged(F.col("m")).alias("flags"))


def language_filter(s, d):
    return Y.by_language(data.items(s, d, "lang", "subset"), "en", ["subset"])


def exclude_labels(s, d):
    return Y.exclude_labels(data.items(s, d, "hate_types").filter("hate_types is not null"), "hate_types", ["grievance", "irony"]).select("id", F.array_join("hate_types", ",").alias("labels"))


def _probs(s, d):
    return Y.label_shares(_valid(s, d), "hate_type", "hate_type")


def thresholded_labels(s, d):
    """Labels of each item and arm from probabilities, as they are and as deployed behind the gate."""
    p = _probs(s, d).join(scoring.voted(s, d).select("item_id", "arm", "hate"), ["item_id", "arm"])
    cut, masked = 0.4, Y.gate_masked(F.col("p"), F.col("hate"))
    return p.select("item_id", "arm", F.array_join(Y.at_threshold(F.col("p"), "hate_type", cut), ",").alias("labels"), F.array_join(Y.at_threshold(masked, "hate_type", cut), ",").alias("deployed"), Y.most_probable(F.col("p"), "hate_type").alias("top"), F.round(Y.margin(F.col("p"), cut), 6).alias("margin"))


def _swept(s, d):
    p = _probs(s, d).join(_gold(s, d), "item_id")
    return Y.macro_at_thresholds(p, "hate_type"), p.groupBy("arm").agg(F.avg(F.size("gold").cast("double")).alias("wanted"))


def label_threshold_sweep(s, d):
    return _swept(s, d)[0].select("arm", "t", _r("macro_f1"), _r("cardinality"))


def threshold_optimum(s, d):
    return Y.best_thresholds(*_swept(s, d)).select("arm", "best_t", _r("best_f1"), "card_t", _r("card_f1"))


def _drawn(s, d):
    return building.role_partition(s, d).withColumnRenamed("id", "item_id")


def score_by_role(s, d):
    """Label outcomes by stratum of the drawn items."""
    v = scoring.voted(s, d).select("item_id", "arm", F.col("hate_type").alias("pred")).join(_gold(s, d), "item_id")
    x = v.join(_drawn(s, d), "item_id").select("arm", "gold", "pred", F.explode(Y.strata("slice", UPTO)).alias("stratum"))
    return Y.label_outcomes(x, ["stratum", "arm"]).select("stratum", "arm", "n", _r("exact"), _r("contains"), _r("pred_labels"))


def clean_stratum(s, d):
    """Predictions on items that no correction up to the round concerns."""
    return Y.in_stratum(scoring.voted(s, d).select("item_id", "arm", F.col("hate").cast("string").alias("hate")), _drawn(s, d), "clean", UPTO)


def topped_up_round(s, d):
    """The first round over its batch: errors of the arm with context, matched control, topped up from other items."""
    key = data.items(s, d, "text").filter("text is not null").select(F.col("id").alias("item_id"), F.md5(X.dedup_key("text")).alias("key"))
    v = scoring.voted(s, d).filter("arm = 'rag'").select("item_id", F.col("hate_type").alias("pred"))
    b = _drawn(s, d).filter(f"slice = 'batch_{ROUND}'").join(_gold(s, d), "item_id").join(v, "item_id").join(key, "item_id")
    batch = b.select("item_id", "key", (~U.correct("gold", "pred", "exact")).alias("wrong"))
    pool = _gold(s, d).join(key, "item_id").join(_drawn(s, d), "item_id", "left_anti").select("item_id", "key")
    base = data.kb(s, d, "text").filter("text is not null").select(F.md5(X.dedup_key("text")).alias("key"))
    return Y.topped_up_round(batch, pool, base, ROUND)


def text_clashes(s, d):
    """Feedback records whose text another kind of record has too."""
    k = data.kb(s, d, "kind", "text").filter("text is not null").select("id", "kind", F.md5(X.dedup_key("text")).alias("key"))
    return Y.text_clashes(k.filter("kind = 'feedback'"), k.filter("kind <> 'feedback'"))


def _fb_labels(s, d):
    k = K.with_meta(data.kb(s, d, "kind", "meta")).filter("kind = 'feedback'")
    return k.select("id", F.coalesce("meta.hate_types", F.array().cast("array<string>")).alias("labels"))


def feedback_reach(s, d):
    shown = data.retrieved(s, d).filter("bucket = 'feedback'").select("item_id", "hit_id")
    return Y.feedback_reach(shown, _fb_labels(s, d), _gold(s, d).withColumnRenamed("gold", "labels")).withColumn("chance", F.round("chance", 6))


def example_slots(s, d):
    """How many items were shown how many examples: corrections must add a slot, not take one."""
    n = data.retrieved(s, d).groupBy("item_id").agg(F.countDistinct(F.when(F.col("bucket") == "examples", F.col("hit_id"))).alias("n_examples"), F.max((F.col("bucket") == "feedback").cast("int")).cast("boolean").alias("has_feedback"))
    return n.groupBy("n_examples", "has_feedback").agg(F.count("*").alias("n_items"))


def injection_check(s, d):
    i, k = retrieval._labelled(s, d)
    a = Y.injection_check(R.injected(i, k, True), i, k, True)
    return a.unionByName(Y.injection_check(R.injected(i, k, False), i, k, False))


def dimension_verdicts(s, d):
    r = data.runs(s, d, "arm", "run_ts", *_DIMS)
    return Y.dimension_verdicts(r, {c: c for c in _DIMS}, BY_DESIGN)


def arms_vs_base(s, d):
    """Each arm's accuracy against the arm without context, read against the spread of replicates."""
    reps = audits._replicates(s, d).groupBy("arm", "run_idx").agg(F.avg("ok").alias("score"))
    floor = A.replicate_floor(reps).agg(F.max("floor").alias("floor"))
    x = Y.readable_deltas(reps.groupBy("arm").agg(F.avg("score").alias("score")), "zero_shot", floor)
    return x.select("arm", _r("score"), _r("base_score"), _r("delta"), _r("floor"), "is_readable")


def new_label_effect(s, d):
    """A label restored (the arm with context) against the arm without it, seeds being runs."""
    r = _valid(s, d).filter("arm in ('rag', 'few_shot')").select("arm", "run_idx", "item_id", F.when(F.col("arm") == "few_shot", F.array_except("hate_type", F.array(F.lit("grievance")))).otherwise(F.col("hate_type")).alias("pred")).join(_gold(s, d), "item_id")
    known = F.array(*[F.lit(x) for x in TYPES])
    each = r.select("arm", "run_idx", F.explode(F.transform(known, lambda x: F.struct(x.alias("label"), F.array_contains("gold", x).alias("g"), F.coalesce(F.array_contains("pred", x), F.lit(False)).alias("p")))).alias("x")).select("arm", "run_idx", "x.*")
    n = lambda c: F.count(F.when(c, 1))
    per = each.groupBy("arm", "run_idx", "label").agg(n(F.col("g") & F.col("p")).alias("tp"), n(~F.col("g") & F.col("p")).alias("fp"), n(F.col("g") & ~F.col("p")).alias("fn"))
    per = per.select(F.col("arm").alias("condition"), F.col("run_idx").alias("seed"), "label", F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)).alias("f1"))
    x = Y.new_label_effect(per, "grievance", "rag", "few_shot")
    return x.select("n_seeds", "n_labels", "seeds_up", *[_r(c) for c in ("delta", "label_f1", "mechanical", "excess", "displacement", "displacement_t")])


def training_rows(s, d):
    """Training rows for the type of hate, without items whose text is also a record."""
    leaked = building.norm_key_leak(s, d).select("id").distinct()
    x = Y.training_rows(data.items(s, d, "gate", "hate_types"), "hate_types", leaked)
    return x.select("id", F.array_join("labels", ",").alias("labels"), "split")


def split_legal(s, d):
    """70/15/15 by truncation, stratified on whether any legal label is annotated."""
    i = data.items(s, d, "legal").filter("legal is not null").withColumn("any_legal", F.size("legal") > 0)
    return S.split_by_share(i, ["any_legal"], {"train": 0.7, "dev": 0.15, "test": 0.15}).select("id", "split")


def sentinel_capped(s, d):
    """Items right in all runs, a few of each label (rarest label first), the rest as remainder."""
    t = audits.sentinel(s, d).select("item_id").join(_gold(s, d), "item_id").select(F.col("item_id").alias("id"), F.col("gold").alias("hate_types"))
    picked = S.label_stratified(t, "hate_types", list(TYPES), 3).select("id", F.lit("sentinel").alias("part"))
    return t.select("id").join(picked, "id", "left").select("id", F.coalesce("part", F.lit("remainder")).alias("part"))


def legal_examples(s, d):
    """Legal examples: rarest label first up to a cap, items of several labels first, and some without any."""
    i = data.items(s, d, "legal").filter("legal is not null")
    pos = S.label_stratified(i, "legal", list(TAXONOMY["legal"]), 15, first=-F.size("legal"))
    neg = S.rank_within(i.filter(F.size("legal") == 0), [], "id", 0).filter("rank <= 20")
    return pos.select("id", F.array_join("legal", ",").alias("labels")).unionByName(neg.select("id", F.lit("").alias("labels")))


def first_rows(s, d):
    """The first items of each run by their place in the table: a deterministic prefix."""
    return head(data.items(s, d, "subset").select("id", "subset"), ["id"], 25)


def bucket_counts(s, d):
    """Records by the buckets that search uses: kind, kind and language, kind and dimension."""
    k = data.kb(s, d, "kind", "lang", "dimension")
    return k.select(F.explode(K.buckets()).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def definition_budgets(s, d):
    """Slots of each dimension's definitions under every way of dealing them."""
    k = data.kb(s, d, "kind", "dimension").filter("kind = 'definition'")
    modes = [R.definition_budget(k, mode=m).withColumn("mode", F.lit(m)) for m in ("flat", "per_dimension", "proportional")]
    return modes[0].unionByName(modes[1]).unionByName(modes[2])


def nearest_twins(s, d):
    """The twenty items nearest to a training vector, with their twin, and whether they are above the threshold."""
    e, t = audits._stored(s, d)
    best = R.dense_top_k(t.withColumn("bucket", F.lit(0)), e.select(F.col("id").alias("query_id"), "vec"), 1)
    x = best.select(F.col("query_id").alias("eval_id"), F.col("id").alias("train_id"), "score").orderBy(F.desc(F.round("score", 6)), "eval_id").limit(20)
    return x.select("eval_id", "train_id", F.round("score", 5).alias("score"), (F.round("score", 6) >= 0.4).alias("is_near"))


def worst_leaked(s, d):
    """Of each training vector the highest similarity to any item."""
    e, t = audits._stored(s, d)
    return R.dense_top_k(e.withColumn("bucket", F.lit(0)), t.select(F.col("id").alias("query_id"), "vec"), 1).select(F.col("query_id").alias("train_id"), F.col("id").alias("eval_id"), F.round("score", 5).alias("score"))


def retrieve_bm25(s, d):
    """A whole retrieval call by terms: definitions by dimension, guidelines, examples and feedback of the item's language."""
    q, k = _call(s, d)
    x = R.retrieve(k, q, R.BUDGETS | {"strategy": "bm25", "definitions_mode": "proportional"})
    return x.select("query_id", "bucket", "id", "pos")


def _call(s, d):
    i = data.items(s, d, "lang").select(F.col("id").alias("query_id"), F.lower(F.trim("lang")).alias("lang"))
    return retrieval._text_queries(s, d).join(i, "query_id"), data.kb(s, d, "kind", "dimension", "lang", "text").filter("text is not null")


def retrieve_dense(s, d):
    """The same call by vectors; the texts have no stored ones, so hashed tokens stand in."""
    q, k = _call(s, d)
    return R.retrieve(R.hashed_vectors(k), R.hashed_vectors(q), R.BUDGETS | {"strategy": "dense", "use_mmr": True}).select("query_id", "bucket", "id", "pos")


def retrieve_fused(s, d):
    """The same call by both, fused."""
    q, k = _call(s, d)
    return R.retrieve(R.hashed_vectors(k), R.hashed_vectors(q), R.BUDGETS | {"strategy": "hybrid", "use_mmr": True}).select("query_id", "bucket", "id", "pos", "ranks")


def arm_contexts(s, d):
    """What each arm's prompt is given, by bucket."""
    i = data.items(s, d, "lang").select(F.col("id").alias("item_id"), F.lower(F.trim("lang")).alias("lang"))
    c = R.arm_contexts(i, retrieval.fewshot_static(s, d), data.retrieved(s, d))
    return c.groupBy("arm", "bucket").agg(F.countDistinct("item_id").alias("n_items"), F.count("id").alias("n_hits"))


def sentinel_flip_rates(s, d):
    """Flips over all sentinel labels, and the mean rate over labels with support."""
    x = audits.sentinel_flips(s, d)
    return x.groupBy("arm").agg(F.sum("support").alias("support"), F.sum("flips").alias("flips"), F.round(F.sum("flips") / F.sum("support"), 6).alias("micro"), F.round(F.avg(F.when(F.col("support") >= 5, F.col("flips") / F.col("support"))), 6).alias("macro"))


def guideline_contradictions(s, d):
    """Of each guideline shown: how often the annotation contradicts that it argues for hate."""
    g = audits.guideline_effect(s, d)
    n = g.groupBy("guideline").agg(F.sum("n").alias("n_shown"), F.sum(F.when(~F.col("gold_hate"), F.col("n")).otherwise(0)).alias("n_contradicts"))
    return n.withColumn("contradiction_rate", F.round(F.col("n_contradicts") / F.col("n_shown"), 6))


def score_all(s, d):
    """Everything scored, long: arm, mapping, dimension, metric, value."""
    def long(x, ids, metrics):
        pair = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
        return x.select(*ids, F.explode(pair).alias("x")).select(*ids, "x.*")

    ids = ["arm", "mapping", "dimension"]
    gate = scoring.gate_score_by_arm(s, d).withColumn("dimension", F.lit("gate"))
    multi = scoring.multilabel_macro_micro(s, d).withColumn("mapping", F.lit("strict"))
    sev = scoring.severity_score(s, d).withColumn("mapping", F.lit("strict")).withColumn("dimension", F.lit("severity"))
    return long(gate, ids, _GATE).unionByName(long(multi, ids, _MULTI)).unionByName(long(sev, ids, _SEV))


_GATE, _MULTI, _SEV = ("n_scored", "macro_f1", "f1_hate"), ("n_averaged", "macro_f1", "micro_f1"), ("n_items", "accuracy", "macro_f1")


def coverage_faults(s, d):
    """Dimensions that a source annotates for some of its items only."""
    i = data.items(s, d, "source", "gate", "target_groups", "hate_types", "severity", "legal")
    each = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).isNotNull().cast("int").alias("has")) for c in ("gate", "target_groups", "hate_types", "severity", "legal")])
    g = i.select("source", F.explode(each).alias("x")).select("source", "x.*").groupBy("source", "dimension").agg(F.count("*").alias("n"), F.sum("has").alias("annotated"))
    return g.filter("annotated > 0 and annotated < n")


def mixed_stamps(s, d):
    """Stamps of which an arm's results carry more than one value."""
    return audits.stamp_audit(s, d).filter("n_values > 1").select("arm", "stamp", "n_values")


def _file(s, name):
    return track(f"{shared_dir(s)}/{name}-{uuid.uuid4().hex[:12]}")


def jsonl_round_trip(s, d):
    """Records written as JSON lines and read back."""
    k = data.kb(s, d, "kind", "dimension", "label", "lang", "text", "source", "meta")
    J.write_jsonl(k, p := _file(s, "kb"))
    return J.read_kb(s, p).select("id", "kind", "dimension", "label", "lang", F.md5("text").alias("text"), "source")


def run_files(s, d):
    """Predictions written as one file of lines per arm and found again by their names."""
    r = data.results(s, d, "hate", "n_valid").filter("item_id is not null")
    p = _file(s, "runs")
    for arm in ("zero_shot", "few_shot", "rag"):
        J.append_log(r.filter(F.col("arm") == arm).coalesce(1), f"{p}/{arm}_r0_live")
    x = J.results_under(s, f"{p}/*_live", "item_id string, arm string, hate boolean, n_valid int")
    return x.groupBy("run", "round").agg(F.count("*").alias("n"), F.count(F.when(F.col("hate"), 1)).alias("n_hate"))


def log_line_quality(s, d):
    """The items' raw JSON as a log of lines, torn ones counted by the reader."""
    i = data.items(s, d, "raw").filter("raw is not null and trim(raw) <> ''")
    i.select(F.regexp_replace("raw", "[\\r\\n]+", " ").alias("value")).write.text(p := _file(s, "log"))
    return J.line_quality(s, p).agg(F.sum("n_lines").alias("n_lines"), F.sum("n_corrupt").alias("n_corrupt"))


def resumed_append(s, d):
    """Predictions appended in two overlapping parts: no key twice."""
    r = data.results(s, d, "hate").select("item_id", "arm", "hate")
    p = _file(s, "append")
    J.append_missing(r.filter("arm <> 'rag'"), p, ["item_id", "arm"])
    J.append_missing(r, p, ["item_id", "arm"])
    return s.read.parquet(p).groupBy("arm").agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("n_items"))


def feedback_log(s, d):
    """Both arms' records of a round appended to the log, read back with the last write of a key."""
    x = topped_up_round(s, d).withColumn("round", F.lit(ROUND))
    p = _file(s, "feedback")
    J.append_log(x, p)
    return J.last_line_wins(J.read_results(s, p, "feedback_arm string, item_id string, origin string, round int")[1], ["feedback_arm", "item_id"]).groupBy("feedback_arm", "origin").agg(F.count("*").alias("n"))


def metric_sidecar(s, d):
    """The scores of the gate written beside a run as JSON and read back."""
    J.write_sidecar(scoring.gate_score_by_arm(s, d).select("arm", "mapping", "n_scored", "macro_f1"), p := _file(s, "metrics"))
    return s.read.schema("arm string, mapping string, n_scored long, macro_f1 double").json(p)


def sentinel_file(s, d):
    """The sentinel frozen as JSON and read back; a second write is refused."""
    J.write_frozen(sentinel_capped(s, d), p := _file(s, "sentinel"))
    try:
        J.write_frozen(s.createDataFrame([("x", "y")], "id string, part string"), p)
    except Exception as e:
        if "PATH_ALREADY_EXISTS" not in str(e):
            raise
    return s.read.parquet(p).groupBy("part").agg(F.count("*").alias("n"))


def comparability_ledger(s, d):
    """The groups of comparable results as rows of a Markdown table."""
    return J.ledger(audits.comparability_groups(s, d), ["active_model", "prompt_version", "kb_version", "temperature", "n", "arms"])


def split_histogram(s, d):
    """The sources of each split as a sidecar, read back."""
    J.write_sidecar(data.items(s, d, "subset", "source").groupBy("subset", "source").agg(F.count("*").alias("n")), p := _file(s, "histogram"))
    return s.read.schema("subset string, source string, n long").json(p)


def retrieval_debug(s, d):
    """The first fused hits of every query with their place in each channel and the start of the text."""
    t = table(s, d, "documents", F.col("doc_id").alias("id"), F.substring("text", 1, 40).alias("start"))
    return retrieval.rrf_fuse(s, d).filter("rank <= 3").join(t, "id").select("query_id", "rank", "id", "bm25_rank", "dense_rank", F.md5("start").alias("start"))


def edit_study(s, d):
    """Of every guideline: on how many items it was shown, and whether those were judged otherwise than without it."""
    shown = data.retrieved(s, d).filter(F.col("bucket") == "guidelines").select("item_id", F.col("hit_id").alias("guideline")).distinct()
    a = audits._logged(s, d).filter("arm = 'rag'").select("item_id", F.col("ok").alias("ok_a"))
    b = audits._logged(s, d).filter("arm = 'zero_shot'").select("item_id", F.col("ok").alias("ok_b"))
    pairs = shown.join(a, "item_id").join(b, "item_id").select(F.col("guideline").alias("arm_a"), F.lit("without").alias("arm_b"), "ok_a", "ok_b")
    return A.mcnemar(pairs).select(F.col("arm_a").alias("guideline"), (F.col("both_correct") + F.col("both_wrong") + F.col("discordant")).alias("n_paired"), "only_a", "only_b", F.round(F.col("p_value") + 1e-9, 6).alias("p_value"))  # binary fractions end in ties


def prompt_sections(s, d):
    """Characters of each section over all prompts, and how many examples shown are hateful."""
    k = K.with_meta(data.kb(s, d, "kind", "text", "meta")).select(F.col("id").alias("hit_id"), F.length("text").alias("n"), F.col("meta.gate").alias("gate"))
    h = data.retrieved(s, d).select("item_id", "bucket", "hit_id").distinct().join(k, "hit_id")
    return h.groupBy("bucket").agg(F.count("*").alias("n_hits"), F.sum("n").alias("chars"), F.count(F.when(F.col("gate"), 1)).alias("n_hateful"), F.count(F.when(~F.col("gate"), 1)).alias("n_benign"))


def label_removal_check(s, d):
    k = K.with_meta(data.kb(s, d, "kind", "dimension", "label", "meta"))
    return K.label_removal_check(k, K.remove_label(k, "hate_type", "grievance", "hate_types"), "hate_type", "grievance")


def feedback_sources(s, d):
    """Feedback records by what the run that selected them predicted."""
    r = _valid(s, d).filter("arm = 'rag'").select("item_id", "run_idx", "hate")
    keyed = r.select(F.explode(F.array(F.lit("feedback"), F.lit("control"))).alias("a"), "item_id", "run_idx", "hate").groupBy(F.concat_ws("_", "a", F.concat(F.lit("r"), F.col("run_idx").cast("string"))).alias("run_key"), "item_id").agg(F.max("hate").alias("hate"))
    x = U.source_run(audits._feedback(s, d), keyed)
    return x.groupBy("run_key", F.col("predicted").cast("string").alias("predicted")).agg(F.count("*").alias("n"))


def leakage_report(s, d):
    return U.leakage_report(audits._leaks(s, d), data.items(s, d, "subset"))[0].withColumn("max_sim", F.round("max_sim", 6))


def leakage_top(s, d):
    return U.leakage_report(audits._leaks(s, d), data.items(s, d, "subset"))[1].withColumn("sim", F.round("sim", 6))


def vector_index(s, d):
    """Vectors of the records stored with what made them, read back by kind; another model is refused."""
    k = R.hashed_vectors(data.kb(s, d, "kind", "text").filter("text is not null"))
    J.write_vectors(k.select("id", "kind", "vec"), p := _file(s, "vectors"), "hashed-64", "1")
    try:
        J.open_vectors(s, p, "another")
    except ValueError:
        pass
    return J.open_vectors(s, p, "hashed-64").groupBy("kind").agg(F.count("*").alias("n"), F.min(F.size("vec")).alias("dims"))


def mixture_check(s, d):
    """Whether the arm with context lies where a mixture of items shown a related record and others puts it."""
    gold = _gold(s, d)
    k = K.with_meta(data.kb(s, d, "kind", "meta")).select(F.col("id").alias("hit_id"), F.col("meta.hate_types").alias("labels")).filter("labels is not null")
    rel = data.retrieved(s, d).select("item_id", "hit_id").distinct().join(k, "hit_id").join(gold, "item_id").groupBy("item_id").agg(F.max(F.arrays_overlap("labels", "gold").cast("int")).alias("related"))
    v = scoring.voted(s, d).filter("arm = 'rag'").select("item_id", F.col("hate_type").alias("pred")).join(gold, "item_id").join(rel, "item_id").withColumn("ok", U.correct("gold", "pred", "contains").cast("int"))
    m = v.agg(F.count("*").alias("n"), F.avg("related").alias("p"), F.avg(F.when(F.col("related") == 1, F.col("ok"))).alias("full"), F.avg(F.when(F.col("related") == 0, F.col("ok"))).alias("base"), F.avg("ok").alias("observed"))
    return m.withColumn("predicted", U.mixture(F.col("base"), F.col("full"), F.col("p"))).select("n", *[_r(c) for c in ("p", "full", "base", "observed", "predicted")])


def example_groups(s, d):
    """Examples shown, regular and illustrative ones apart as the prompt lists them: items by the groups they have."""
    k = K.with_meta(data.kb(s, d, "kind", "meta")).select(F.col("id").alias("hit_id"), F.col("meta.illustrative_only").alias("illustrative"))
    h = data.retrieved(s, d).filter("bucket = 'examples'").select("item_id", "hit_id").distinct().join(k, "hit_id")
    g = h.groupBy("item_id").agg(F.collect_list(F.struct("hit_id", "illustrative")).alias("hits"))  # a prompt's few examples
    x = g.select(F.explode(T.split_groups(F.col("hits"))).alias("g"))
    return x.groupBy("g.name").agg(F.count("*").alias("n_items"), F.sum(F.size("g.hits")).alias("n_hits"))


def run_cost(s, d):
    """Calls and hours that a run over every subset would take."""
    m = C.Manifest(name="plan", subset="all", arms=("zero_shot", "few_shot", "rag"), provider="mock")
    n = data.items(s, d, "subset").groupBy("subset").agg(F.count("*").alias("n_items"))
    calls, seconds = C.estimate(m, 1)
    return n.select("subset", "n_items", (F.col("n_items") * calls).alias("calls"), F.round(F.col("n_items") * F.lit(seconds) / 3600, 6).alias("hours"))


QUERIES = {
    f.__name__: f
    for f in (legal_flags, language_filter, exclude_labels, thresholded_labels, label_threshold_sweep, threshold_optimum, score_by_role, clean_stratum, topped_up_round, text_clashes, feedback_reach, example_slots, injection_check, dimension_verdicts, arms_vs_base, new_label_effect, training_rows, split_legal, sentinel_capped, legal_examples, first_rows, bucket_counts, definition_budgets, nearest_twins, worst_leaked, retrieve_bm25, retrieve_dense, retrieve_fused, arm_contexts, sentinel_flip_rates, guideline_contradictions, score_all, coverage_faults, mixed_stamps, jsonl_round_trip, run_files, log_line_quality, resumed_append, feedback_log, metric_sidecar, sentinel_file, comparability_ledger, split_histogram, retrieval_debug, edit_study, prompt_sections, label_removal_check, feedback_sources, leakage_report, leakage_top, vector_index, mixture_check, example_groups, run_cost)
}

_GT = ", gt as (select id as item_id, list_distinct(hate_types) as gold from items where gate and hate_types is not null)"
_LIST = str(list(TYPES))
_PROBS = f", sh as (select item_id, arm, run_id, coalesce(hate_type, []) as h from ok_runs), pr as (select item_id, arm, [{', '.join(f'avg(list_contains(h, {x!r})::int)' for x in TYPES)}] as p from sh group by all)"
_SWEEP = f""", pg as (select pr.*, gold from pr join gt using (item_id)), un as (select arm, unnest({_LIST}) as label, unnest(p) as p, unnest(list_transform({_LIST}, lambda x: list_contains(gold, x))) as truth from pg), cn as (select arm, label, p, truth, count(*) as n from un group by all),
cl as (select arm, t, label, coalesce(sum(n) filter (where p >= t / 100 and truth), 0) as tp, coalesce(sum(n) filter (where p >= t / 100 and not truth), 0) as fp, coalesce(sum(n) filter (where p < t / 100 and truth), 0) as fn from cn cross join (select unnest(range(1, 100)) as t) group by all),
sw as (select c.arm, c.t, avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 0)) filter (where tp + fn >= 10) as macro_f1, sum(tp + fp) / any_value(k.items) as cardinality from cl c join (select arm, count(*) as items from pg group by arm) k using (arm) group by c.arm, c.t)"""
_ROLES = _GT + ", z as (select id, array_to_string(list_sort(hate_types), ',') as labels from items where gate and hate_types is not null)" + building.ROLES_CTE
_STRATA = f", st as (select id as item_id, slice, unnest(list_filter([slice, case when slice in ('pool', 'held_out') then 'fixed' end, case when slice in ('pool', 'held_out') or try_cast(nullif(regexp_extract(slice, '^batch_([0-9]+)$', 1), '') as int) > {UPTO} then 'clean' end, 'all'], lambda x: x is not null)) as stratum from sl)"
_EXACT = "coalesce(list_has_all({p}, gold) and list_has_all(gold, {p}), false)"
_KEY = building._KEY_SQL
_ROUND = _ROLES + f""", ky as (select id as item_id, md5({_KEY.format('text')}) as key from items where text is not null), bt as (select gt.item_id, ky.key, not {_EXACT.format(p='v.hate_type')} as wrong from sl join gt on gt.item_id = sl.id join votes v on v.item_id = gt.item_id and v.arm = 'rag' join ky on ky.item_id = gt.item_id where slice = 'batch_{ROUND}'),
n as (select count(*) filter (where wrong) as k, count(*) filter (where not wrong) as ok from bt), used as (select key from bt union select md5({_KEY.format('text')}) from kb where text is not null),
po as (select gt.item_id, row_number() over (order by ('0x' || substr(md5(gt.item_id || '|{ROUND}'), 1, 15))::bigint, gt.item_id) as r from gt join ky using (item_id) where gt.item_id not in (select id from sl) and key not in (select key from used)),
rd as (select 'feedback' as feedback_arm, item_id, 'batch' as origin from bt where wrong union all select 'control', item_id, 'batch' from (select item_id, row_number() over (order by item_id) as r from bt where not wrong), n where r <= k union all select 'control', item_id, 'pool' from po, n where r <= k - ok)"""
_META = "from_json(json_extract(try_cast(meta as json), '$.hate_types'), '[\"VARCHAR\"]')"
_REL = f", i as (select id as item_id, hate_types as gold from items where gate and hate_types is not null), k as (select id as kb_id, {_META} as labels, ('0x' || substr(md5(id || '|0'), 1, 15))::bigint as n from kb where kind = 'example'), p as (select item_id, kb_id, n, list_has_any(gold, labels) as related from i join k on labels is not null), inj as (select * from (select *, row_number() over (partition by item_id, related order by n, kb_id) as r from p) where r = 1)"


def _label_draw_over(source: str, column: str, labels, per_label: int, order: str = "n, id") -> str:
    return building._label_draw(list(labels), per_label, source, column, order)


_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')"
_BM = f", tx as (select id, kind, dimension, lang, {_TOK} as w from kb where text is not null and kind in ('definition', 'guideline', 'example', 'feedback')),"
_CALL = f"""{_BM} c as (select case kind when 'definition' then 'definition:' || dimension when 'guideline' then 'guideline' else kind || ':' || lang end as bucket, id, w from tx where (kind <> 'definition' or dimension is not null) and (kind not in ('example', 'feedback') or lang is not null)),
sz as (select bucket, count(*) as n, avg(len(w)) as avgdl from c group by bucket), tf as (select bucket, id, term, count(*) as tf, any_value(dl) as dl from (select bucket, id, len(w) as dl, unnest(w) as term from c) group by all),
rw as (select bucket, term, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) as raw from tf join sz using (bucket) group by all), idf as (select r.bucket, term, case when raw < 0 then 0.25 * mean else raw end as idf from rw r join (select bucket, avg(raw) as mean from rw group by bucket) m using (bucket)),
bg as (select bucket, case when starts_with(bucket, 'definition:') then greatest(1, round_even(n * 0.3, 0))::bigint when bucket = 'guideline' then 2 when starts_with(bucket, 'example:') then 5 else 1 end as k, case when starts_with(bucket, 'definition:') then 'definitions' when bucket = 'guideline' then 'guidelines' when starts_with(bucket, 'example:') then 'examples' else 'feedback' end as part from sz),
q as (select id as query_id, lower(trim(lang)) as lang, {_TOK} as w from items where text is not null and try_cast(regexp_extract(id, '([0-9]+)$', 1) as bigint) % 50 = 0), qt as (select query_id, lang, term, count(*) as qtf from (select query_id, lang, unnest(w) as term from q) group by all),
sc as (select query_id, t.bucket, t.id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score from qt join tf t using (term) join idf using (bucket, term) join sz using (bucket) where split_part(t.bucket, ':', 1) not in ('example', 'feedback') or split_part(t.bucket, ':', 2) = qt.lang group by all),
hit as (select query_id, part, bucket, id, r from (select *, row_number() over (partition by query_id, bucket order by round(score, 6) desc, id) as r from sc) join bg using (bucket) where r <= k and score > 0)
select query_id, part as bucket, id, row_number() over (partition by query_id, part order by case when starts_with(bucket, 'definition:') then list_position(['hate', 'target_group', 'hate_type', 'severity', 'legal'], substr(bucket, 12)) else 0 end, r) as pos from hit"""


def _sub(name: str, oracle: dict[str, str]) -> str:
    return f"({oracle[name]})"


def _long(q: str, mapping: str, dimension: str, metrics) -> str:
    return " union all ".join(f"select arm, {mapping} as mapping, {dimension} as dimension, '{m}' as metric, {m}::double as value from {q}" for m in metrics)


_AO, _SO = audits.ORACLE, scoring.ORACLE
ORACLE = {
    "legal_flags": sql(", n as (select item_id, count(*) as n from ok_runs group by item_id), k as (select item_id, label, count(*) as k from (select item_id, unnest(list_distinct(legal)) as label from ok_runs) where label is not null group by all) select item_id, nullif(coalesce(string_agg(label, ',' order by label) filter (where k * 2 > n), ''), '') as flags from k join n using (item_id) group by item_id", "ok_runs"),
    "language_filter": sql("select subset, count(*) filter (where lower(trim(lang)) = 'en') as n_kept, count(*) filter (where lower(trim(lang)) is distinct from 'en') as n_dropped from items group by subset", "items"),
    "exclude_labels": sql("select id, array_to_string(r, ',') as labels from (select id, hate_types, list_filter(hate_types, lambda x, i: x not in ('grievance', 'irony') and list_position(hate_types, x) = i) as r from items where hate_types is not null) where len(hate_types) = 0 or len(r) > 0", "items"),
    "thresholded_labels": sql(_PROBS + f", v as (select pr.*, hate from pr join votes using (item_id, arm)) select item_id, arm, array_to_string(list_filter({_LIST}, lambda x, i: p[i] >= 0.4), ',') as labels, case when hate then array_to_string(list_filter({_LIST}, lambda x, i: p[i] >= 0.4), ',') else '' end as deployed, {_LIST}[list_position(p, list_max(p))] as top, round(list_sum(list_transform(p, lambda x: abs(x - 0.4))) / {len(TYPES)}, 6) as margin from v", "ok_runs", "votes"),
    "label_threshold_sweep": sql(_GT + _PROBS + _SWEEP + " select arm, t, round(macro_f1, 6) as macro_f1, round(cardinality, 6) as cardinality from sw", "ok_runs", "items"),
    "threshold_optimum": sql(_GT + _PROBS + _SWEEP + ", w as (select arm, avg(len(gold)) as wanted from pg group by arm), b as (select *, row_number() over (partition by arm order by round(macro_f1, 9) desc nulls last, t desc) as rb, row_number() over (partition by arm order by round(abs(cardinality - wanted), 9), t) as rc from sw join w using (arm)) select arm, max(t) filter (where rb = 1) as best_t, round(max(macro_f1) filter (where rb = 1), 6) as best_f1, max(t) filter (where rc = 1) as card_t, round(max(macro_f1) filter (where rc = 1), 6) as card_f1 from b group by arm", "ok_runs", "items"),
    "score_by_role": sql(_ROLES + _STRATA + f" select stratum, v.arm, count(*) as n, round(avg({_EXACT.format(p='v.hate_type')}::int), 6) as exact, round(avg(coalesce(list_has_all(v.hate_type, gold), false)::int), 6) as contains, round(avg(len(v.hate_type)), 6) as pred_labels from votes v join gt using (item_id) join st using (item_id) group by all", "items", "votes"),
    "clean_stratum": sql(_ROLES + _STRATA + " select item_id, arm, hate::varchar as hate from votes where item_id in (select item_id from st where stratum = 'clean')", "items", "votes"),
    "topped_up_round": sql(_ROUND + " select * from rd", "items", "votes", "kb"),
    "text_clashes": sql(f", k as (select id, kind, md5({_KEY.format('text')}) as key from kb where text is not null) select a.id, b.id as base_id from k a join k b using (key) where a.kind = 'feedback' and b.kind <> 'feedback'", "kb"),
    "feedback_reach": sql(_GT + f", k as (select id, coalesce({_META}, []) as labels from kb where kind = 'feedback'), h as (select distinct item_id, hit_id from hits where bucket = 'feedback'), j as (select h.*, list_has_any(gold, labels) as hit from h join gt using (item_id) join k on k.id = hit_id) select (select count(*) from gt) as n_items, (select count(distinct item_id) from j) as n_reached, (select count(distinct item_id) from j where hit) as n_label_hit, (select count(*) from k) as n_records, (select count(distinct hit_id) from j) as n_used, (select max(c) from (select count(*) as c from j group by hit_id)) as most_used, round((select count(*) from gt, k where list_has_any(gold, labels)) / ((select count(*) from gt) * (select count(*) from k)), 6) as chance", "hits", "items", "kb"),
    "example_slots": sql("select n_examples, has_feedback, count(*) as n_items from (select item_id, count(distinct hit_id) filter (where bucket = 'examples') as n_examples, bool_or(bucket = 'feedback') as has_feedback from hits group by item_id) group by all", "hits"),
    "injection_check": sql(_REL + " select related, count(*) as n_items, count(*) filter (where k = 1) as n_single, count(*) filter (where hit = related) as n_intended from (select related, item_id, count(*) as k, bool_or(list_has_any(i.gold, k.labels)) as hit from inj join i using (item_id) join k using (kb_id) group by all) group by related", "items", "kb"),
    "dimension_verdicts": sql(", x as (" + " union all ".join(f"select arm, '{c}' as dimension, {c} is not null as has, run_ts from runs" for c in _DIMS) + ") select arm, dimension, count(*) as n, count(*) filter (where has) as voted, case when count(*) filter (where has) = count(*) then 'complete' when count(*) filter (where has) > 0 then 'mixed' when arm = 'zero_shot' and dimension = 'legal' then 'by design' else 'missing' end as verdict, strftime(min(run_ts) filter (where has), '%Y-%m-%d') as first_voted from x group by arm, dimension", "runs"),
    "arms_vs_base": sql(audits._REP + ", sc as (select arm, run_idx, avg(ok) as score from rep group by all), a as (select arm, avg(score) as score, max(score) - min(score) as spread from sc group by arm) select a.arm, round(a.score, 6) as score, round(b.score, 6) as base_score, round(a.score - b.score, 6) as delta, round((select max(spread) from a), 6) as floor, abs(a.score - b.score) > (select max(spread) from a) as is_readable from a, a b where b.arm = 'zero_shot' and a.arm <> 'zero_shot'", "ok_runs", "items"),
    "new_label_effect": sql(_GT + f""", e as (select arm, run_idx, unnest({_LIST}) as label, unnest(list_transform({_LIST}, lambda x: list_contains(gold, x))) as g, unnest(list_transform({_LIST}, lambda x: coalesce(list_contains(hate_type, x), false) and not (arm = 'few_shot' and x = 'grievance'))) as p from ok_runs join gt using (item_id) where arm in ('rag', 'few_shot')),
        f as (select arm, run_idx, label, coalesce(2 * count(*) filter (where g and p) / nullif(2 * count(*) filter (where g and p) + count(*) filter (where g <> p), 0)::double, 0) as f1 from e group by all),
        w as (select run_idx, avg(f1) filter (where arm = 'rag') - avg(f1) filter (where arm = 'few_shot') as d, avg(f1) filter (where arm = 'rag' and label <> 'grievance') - avg(f1) filter (where arm = 'few_shot' and label <> 'grievance') as o from f group by run_idx),
        n as (select count(distinct label) as n_labels, avg(f1) filter (where label = 'grievance') as label_f1 from f where arm = 'rag'), a as (select count(*) as n_seeds, avg(d) as delta, count(*) filter (where d > 0) as seeds_up, avg(o) as displacement, stddev_samp(o) as sd from w)
        select n_seeds, n_labels, seeds_up, round(delta, 6) as delta, round(label_f1, 6) as label_f1, round(label_f1 / n_labels, 6) as mechanical, round(delta - label_f1 / n_labels, 6) as excess, round(displacement, 6) as displacement, round(displacement / nullif(sd / sqrt(n_seeds), 0), 6) as displacement_t from a, n""", "ok_runs", "items"),
    "training_rows": sql(f", lk as (select distinct i.id from items i join kb k on lower(trim(i.lang)) = k.lang and {_KEY.format('i.text')} = {_KEY.format('k.text')} where k.kind in ('example', 'feedback')), x as (select id, list_filter(hate_types, lambda v, i: list_position(hate_types, v) = i) as labels from items where gate and hate_types is not null and id not in (select id from lk)), rare as (select label from (select unnest(labels) as label from x) group by label having count(*) < 10), rr as (select coalesce(list(label), []) as rr from rare), y as (select id, labels, list_filter(labels, lambda v: not list_contains(rr, v)) as rest from x, rr) select id, array_to_string(rest, ',') as labels, case when ('0x' || substr(md5(id || '|0'), 1, 15))::bigint % 10 = 0 then 'validation' else 'train' end as split from y where len(labels) = 0 or len(rest) > 0", "items", "kb"),
    "split_legal": sql(", x as (select id, row_number() over (partition by len(legal) > 0 order by ('0x' || substr(md5(id || '|0'), 1, 15))::bigint, id) as r, count(*) over (partition by len(legal) > 0) as n from items where legal is not null) select id, case when r <= floor(n * 0.7) then 'train' when r <= floor(n * 0.85) then 'dev' else 'test' end as split from x", "items"),
    "sentinel_capped": sql(audits._TYPES + ", sn as (select item_id as id, any_value(gold) as hate_types from rk where arm = 'rag' group by item_id having bool_and(ok))" + _label_draw_over("sn", "hate_types", TYPES, 3).replace(" select id, array_to_string", ", pk as (select id, array_to_string") + ") select sn.id, case when pk.id is not null then 'sentinel' else 'remainder' end as part from sn left join pk using (id)", "runs", "ok_runs", "items"),
    "legal_examples": sql(_label_draw_over("items", "legal", TAXONOMY["legal"], 15, "len(legal) desc, n, id") + " union all (select id, '' from items where len(legal) = 0 order by ('0x' || substr(md5(id || '|0'), 1, 15))::bigint, id limit 20)", "items"),
    "first_rows": sql("select id, subset from items order by id limit 25", "items"),
    "bucket_counts": sql("select bucket, count(*) as n from (select unnest(list_filter([kind, kind || ':' || lang, kind || '/' || dimension], lambda x: x is not null)) as bucket from kb) group by bucket", "kb"),
    "definition_budgets": sql(", n as (select dimension, count(*) as n from kb where kind = 'definition' group by dimension) select null as dimension, sum(n)::bigint as n, 2::bigint as budget, 'flat' as mode from n union all select dimension, n, 1, 'per_dimension' from n union all select dimension, n, greatest(1, round_even(n * 0.3, 0))::bigint, 'proportional' from n", "kb"),
    "nearest_twins": f"with st as (select 'vec-' || vec_id as id, vec_id % 10 = 0 as is_eval, embedding as vec from embeddings), vp as (select a.id as eval_id, b.id as train_id, {audits._COS} as sim from st a join st b on a.is_eval and not b.is_eval), b as (select * from (select *, row_number() over (partition by eval_id order by round(sim, 6) desc, train_id) as r from vp) where r = 1) select eval_id, train_id, round(sim, 5) as score, round(sim, 6) >= 0.4 as is_near from b order by round(sim, 6) desc, eval_id limit 20",
    "worst_leaked": f"with st as (select 'vec-' || vec_id as id, vec_id % 10 = 0 as is_eval, embedding as vec from embeddings), vp as (select a.id as eval_id, b.id as train_id, {audits._COS} as sim from st a join st b on a.is_eval and not b.is_eval) select train_id, eval_id, round(sim, 5) as score from (select *, row_number() over (partition by train_id order by round(sim, 6) desc, eval_id) as r from vp) where r = 1",
    "retrieve_bm25": sql(_CALL, "kb", "items"),
    "arm_contexts": sql(", fs as (select lang, id from (select lang, id, row_number() over (partition by lang order by ('0x' || substr(md5(id || '|0'), 1, 15))::bigint, id) as pick from kb where kind = 'example' and coalesce(json_extract_string(try_cast(meta as json), '$.illustrative_only'), 'false') <> 'true') where pick <= 6), c as (select 'zero_shot' as arm, 'none' as bucket, id as item_id, null as id from items union all select 'few_shot', 'examples', i.id, fs.id from items i join fs on fs.lang = lower(trim(i.lang)) union all select distinct 'rag', bucket, item_id, hit_id from hits) select arm, bucket, count(distinct item_id) as n_items, count(id) as n_hits from c group by all", "items", "kb", "hits"),
    "sentinel_flip_rates": f"select arm, sum(support)::bigint as support, sum(flips)::bigint as flips, round(sum(flips) / sum(support), 6) as micro, round(avg(flips / support::double) filter (where support >= 5), 6) as macro from {_sub('sentinel_flips', _AO)} group by arm",
    "guideline_contradictions": f"select guideline, sum(n)::bigint as n_shown, coalesce(sum(n) filter (where not gold_hate), 0)::bigint as n_contradicts, round(coalesce(sum(n) filter (where not gold_hate), 0) / sum(n), 6) as contradiction_rate from {_sub('guideline_effect', _AO)} group by guideline",
    "score_all": " union all ".join((_long(_sub("gate_score_by_arm", _SO), "mapping", "'gate'", _GATE), _long(_sub("multilabel_macro_micro", _SO), "'strict'", "dimension", _MULTI), _long(_sub("severity_score", _SO), "'strict'", "'severity'", _SEV))),
    "coverage_faults": sql(", x as (" + " union all ".join(f"select source, '{c}' as dimension, ({c} is not null)::int as has from items" for c in ("gate", "target_groups", "hate_types", "severity", "legal")) + ") select source, dimension, count(*) as n, sum(has)::bigint as annotated from x group by all having sum(has) > 0 and sum(has) < count(*)", "items"),
    "mixed_stamps": f"select arm, stamp, n_values from {_sub('stamp_audit', _AO)} where n_values > 1",
    "jsonl_round_trip": sql("select id, kind, dimension, label, lang, md5(text) as text, source from kb", "kb"),
    "run_files": sql("select arm || '_r0_live' as run, 0 as round, count(*) as n, count(*) filter (where hate) as n_hate from results group by arm", "results"),
    "log_line_quality": sql("select count(*) as n_lines, count(*) filter (where try_cast(raw as json) is null) as n_corrupt from items where raw is not null and trim(raw) <> ''", "items"),
    "resumed_append": sql("select arm, count(*) as n, count(distinct item_id) as n_items from results group by arm", "results"),
    "feedback_log": sql(_ROUND + " select feedback_arm, origin, count(*) as n from rd group by all", "items", "votes", "kb"),
    "metric_sidecar": f"select arm, mapping, n_scored, macro_f1 from {_sub('gate_score_by_arm', _SO)}",
    "comparability_ledger": "select '| ' || concat_ws(' | ', active_model, prompt_version, kb_version, temperature, n, arms) || ' |' as line from " + _sub("comparability_groups", _AO),
    "split_histogram": sql("select subset, source, count(*) as n from items group by all", "items"),
}
_P = "round(1e-9 + case when only_a + only_b = 0 then 1.0 else least(1.0, 2 * list_sum(list_transform(range(0, least(only_a, only_b) + 1), lambda i: exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2))))) end, 6)"
ORACLE |= {
    "retrieval_debug": "select query_id, rank, id, bm25_rank, dense_rank, md5(substr(d.text, 1, 40)) as start from " + _sub("rrf_fuse", retrieval.ORACLE) + " join documents d on d.doc_id = id where rank <= 3",
    "edit_study": sql(f", corr as ({audits._LOGGED}), sh as (select distinct item_id, hit_id as guideline from hits where bucket = 'guidelines'), c as (select guideline, count(*) as n_paired, count(*) filter (where a.ok and not b.ok) as only_a, count(*) filter (where not a.ok and b.ok) as only_b from sh join corr a on a.item_id = sh.item_id and a.arm = 'rag' join corr b on b.item_id = sh.item_id and b.arm = 'zero_shot' group by guideline) select *, {_P} as p_value from c", "results", "items", "hits"),
    "prompt_sections": sql(", g as (select id, length(text) as n, cast(json_extract_string(try_cast(meta as json), '$.gate') as boolean) as gate from kb) select bucket, count(*) as n_hits, sum(n)::bigint as chars, count(*) filter (where gate) as n_hateful, count(*) filter (where not gate) as n_benign from (select distinct item_id, bucket, hit_id from hits) h join g on g.id = h.hit_id group by bucket", "hits", "kb"),
    "label_removal_check": sql(", x as (select dimension, count(*) as n_before, count(*) filter (where not (dimension = 'hate_type' and label = 'grievance')) as n_after from kb where kind = 'definition' and dimension is not null group by dimension) select *, n_before - n_after = (dimension = 'hate_type')::int as is_right from x", "kb"),
    "feedback_sources": sql(audits._FB + ", r as (select item_id, run_idx, bool_or(hate) as hate from ok_runs where arm = 'rag' group by all) select feedback_arm || '_r' || (round - 1) as run_key, r.hate::varchar as predicted, count(*) as n from fb left join r on r.item_id = fb.origin_item_id and r.run_idx = round - 1 group by all", "kb", "ok_runs"),
    "leakage_report": sql(audits._LEAKS + ", j as (select l.*, subset from leaks l join items i on i.id = eval_id) select subset, count(distinct eval_id) as n_items, count(distinct eval_id) filter (where exact) as n_exact, count(distinct eval_id) filter (where normalised) as n_normalised, count(distinct eval_id) filter (where not normalised) as n_near, round(max(sim), 6) as max_sim from j group by subset", "items", "kb"),
    "leakage_top": sql(audits._LEAKS + ", j as (select l.*, subset from leaks l join items i on i.id = eval_id) select subset, r, eval_id, train_id, round(sim, 6) as sim from (select *, row_number() over (partition by subset order by round(sim, 6) desc, eval_id, train_id) as r from j) where r <= 3", "items", "kb"),
    "vector_index": sql("select kind, count(*) as n, 64 as dims from kb where text is not null group by kind", "kb"),
    "mixture_check": sql(_GT + f", k as (select id, {_META} as labels from kb), rl as (select h.item_id, max(list_has_any(k.labels, gt.gold)::int) as related from (select distinct item_id, hit_id from hits) h join k on k.id = h.hit_id and k.labels is not null join gt using (item_id) group by h.item_id), v as (select related, coalesce(list_has_all(hate_type, gold), false)::int as ok from votes join gt using (item_id) join rl using (item_id) where arm = 'rag'), m as (select count(*) as n, avg(related) as p, avg(ok) filter (where related = 1) as full_, avg(ok) filter (where related = 0) as base, avg(ok) as observed from v) select n, round(p, 6) as p, round(full_, 6) as full, round(base, 6) as base, round(observed, 6) as observed, round(base + p * (full_ - base), 6) as predicted from m", "hits", "kb", "items", "votes"),
}
_CALLS = 3 * C.Manifest(name="plan", subset="all").n_votes
ORACLE |= {
    "example_groups": sql(", g as (select h.item_id, case when coalesce(cast(json_extract_string(try_cast(k.meta as json), '$.illustrative_only') as boolean), false) then 'illustrative' else 'regular' end as name from (select distinct item_id, hit_id from hits where bucket = 'examples') h join kb k on k.id = h.hit_id) select name, count(distinct item_id) as n_items, count(*) as n_hits from g group by name", "hits", "kb"),
    "run_cost": sql(f"select subset, count(*) as n_items, count(*) * {_CALLS} as calls, round(count(*) * {_CALLS} * {C.SECONDS_A_CALL.get('mock', C.SECONDS_A_CALL['a'])} / 3600, 6) as hours from items group by subset", "items"),
}
ORACLE["sentinel_file"] = f"select part, count(*) as n from ({ORACLE['sentinel_capped']}) group by part"
