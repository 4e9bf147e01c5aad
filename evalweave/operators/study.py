"""Studies over predictions: probabilities and thresholds, roles, injected records, feedback reach, training data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalweave.functions.stats import count_if, f1, ratio
from evalweave.operators.labels import MIN_SUPPORT, TAXONOMY
from evalweave.operators.sampling import draw_number

FIXED_ROLES = ("pool", "held_out")


# ---- labels


def flagged(shares: Column, cut: float = 0.5) -> Column:
    """The keys of a map of shares that lie above ``cut``, sorted and joined by comma; NULL where none does."""
    over = F.array_sort(F.map_keys(F.map_filter(shares, lambda k, v: v > cut)))
    return F.nullif(F.array_join(over, ","), F.lit(""))


def by_language(df: DataFrame, lang: str, by: list[str]) -> DataFrame:
    """(by, n_kept, n_dropped): rows of one language and how many the filter drops. A NULL language is dropped."""
    hit = F.coalesce(F.lower(F.trim("lang")) == lang, F.lit(False))
    return df.groupBy(*by).agg(count_if(hit).alias("n_kept"), count_if(~hit).alias("n_dropped"))


def exclude_labels(df: DataFrame, column: str, labels: list[str]) -> DataFrame:
    """``df`` without the labels; a row that loses its last label goes, one annotated as empty stays."""
    rest = F.array_except(column, F.array(*[F.lit(x) for x in labels]))
    return df.filter(~((F.size(column) > 0) & (F.size(rest) == 0))).withColumn(column, rest)


# ---- probabilities


def label_shares(runs: DataFrame, column: str, dimension: str) -> DataFrame:
    """(item_id, arm, p): of each label of the dimension, in order, the share of an item's valid runs that chose it."""
    share = lambda x: F.avg(F.array_contains(F.coalesce(F.col(column), F.array().cast("array<string>")), x).cast("double"))
    return runs.groupBy("item_id", "arm").agg(F.array(*[share(x) for x in TAXONOMY[dimension]]).alias("p"))


def at_threshold(p: Column, dimension: str, cut: float) -> Column:
    """The labels whose probability reaches ``cut``."""
    pairs = F.arrays_zip(F.array(*[F.lit(x) for x in TAXONOMY[dimension]]).alias("label"), p.alias("p"))
    return F.transform(F.filter(pairs, lambda x: x["p"] >= cut), lambda x: x["label"])


def most_probable(p: Column, dimension: str) -> Column:
    """The label of highest probability, the first on ties."""
    return F.element_at(F.array(*[F.lit(x) for x in TAXONOMY[dimension]]), F.array_position(p, F.array_max(p)).cast("int"))


def margin(p: Column, cut: float) -> Column:
    """How far the probabilities lie from the threshold on average."""
    return F.aggregate(p, F.lit(0.0), lambda s, x: s + F.abs(x - cut)) / F.size(p)


def gate_masked(p: Column, gate: Column) -> Column:
    """As deployed: every probability is 0 where the gate says no or nothing."""
    return F.transform(p, lambda x: F.when(F.coalesce(gate, F.lit(False)), x).otherwise(F.lit(0.0)))


def macro_at_thresholds(probs: DataFrame, dimension: str, steps: int = 100, least: int = MIN_SUPPORT) -> DataFrame:
    """(arm, t, macro_f1, cardinality) of ``probs(arm, p, gold)`` at t/steps: macro F1 over labels with support, mean labels.

    Items meet the grid as counts by label, probability and truth.
    """
    labels = F.array(*[F.lit(x) for x in TAXONOMY[dimension]])
    each = probs.select("arm", F.explode(F.arrays_zip(labels.alias("label"), F.col("p"), F.transform(labels, lambda x: F.array_contains("gold", x)).alias("truth"))).alias("x")).select("arm", "x.*")
    c = each.groupBy("arm", "label", "p", "truth").agg(F.count("*").alias("n"))
    g = c.select("*", F.explode(F.sequence(F.lit(1), F.lit(steps - 1))).alias("t")).withColumn("hit", F.col("p") >= F.col("t") / steps)
    cells = [F.sum(F.when(k, F.col("n")).otherwise(0)).alias(v) for v, k in (("tp", F.col("hit") & F.col("truth")), ("fp", F.col("hit") & ~F.col("truth")), ("fn", ~F.col("hit") & F.col("truth")))]
    s = g.groupBy("arm", "t", "label").agg(*cells)
    n = probs.groupBy("arm").agg(F.count("*").alias("items"))
    s = s.groupBy("arm", "t").agg(F.avg(F.when(F.col("tp") + F.col("fn") >= least, f1(F.col("tp"), F.col("fp"), F.col("fn")))).alias("macro_f1"), F.sum(F.col("tp") + F.col("fp")).alias("_k"))
    return s.join(n, "arm").select("arm", "t", "macro_f1", (F.col("_k") / F.col("items")).alias("cardinality"))


def best_thresholds(swept: DataFrame, target: DataFrame) -> DataFrame:
    """(arm, best_t, best_f1, card_t, card_f1): the best threshold, the higher on ties, and the one whose mean number of labels
    is nearest to ``target(arm, wanted)``, the lower on ties. Both compare at nine places."""
    x = swept.join(target, "arm")
    best = F.max_by(F.struct("t", "macro_f1"), F.struct(F.round("macro_f1", 9), F.col("t"))).alias("b")
    near = F.min_by(F.struct("t", "macro_f1"), F.struct(F.round(F.abs(F.col("cardinality") - F.col("wanted")), 9), F.col("t"))).alias("c")
    return x.groupBy("arm").agg(best, near).select("arm", F.col("b.t").alias("best_t"), F.col("b.macro_f1").alias("best_f1"), F.col("c.t").alias("card_t"), F.col("c.macro_f1").alias("card_f1"))


# ---- roles


def strata(slice_col: str, upto: int) -> Column:
    """The strata a drawn item belongs to: its slice; ``fixed`` if it is never corrected; ``clean`` if it is not corrected by
    round ``upto``; ``all``."""
    c = F.col(slice_col)
    fixed = c.isin(*FIXED_ROLES)
    later = F.coalesce(F.regexp_extract(c, r"^batch_(\d+)$", 1).try_cast("int") > upto, F.lit(False))
    return F.array_compact(F.array(c, F.when(fixed, F.lit("fixed")), F.when(fixed | later, F.lit("clean")), F.lit("all")))


def in_stratum(df: DataFrame, drawn: DataFrame, name: str, upto: int) -> DataFrame:
    """The rows of ``df(item_id, ..)`` whose item is in a stratum of ``drawn(item_id, slice)``."""
    return df.join(drawn.filter(F.array_contains(strata("slice", upto), name)).select("item_id"), "item_id", "left_semi")


def label_outcomes(scored: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, exact, contains, pred_labels) of ``scored(gold, pred)``: rates of equal and of included label sets."""
    inside = F.coalesce(F.size(F.array_except("gold", "pred")) == 0, F.lit(False))
    equal = inside & F.coalesce(F.size(F.array_except("pred", "gold")) == 0, F.lit(False))
    rate = lambda c: F.avg(c.cast("double"))
    return scored.groupBy(*by).agg(F.count("*").alias("n"), rate(equal).alias("exact"), rate(inside).alias("contains"), F.avg(F.size("pred").cast("double")).alias("pred_labels"))


# ---- feedback


def topped_up_round(batch: DataFrame, pool: DataFrame, base_keys: DataFrame, round_no: int) -> DataFrame:
    """(feedback_arm, item_id, origin) of one feedback round.

    ``batch(item_id, key, wrong)``: all wrong items are corrected. The control takes as many right ones in order of id and,
    where the batch has too few, others of ``pool(item_id, key)`` by keyed hash of the round; ``key`` is the text's key, and a
    pool item whose text is in the batch or among ``base_keys(key)`` is not eligible.
    """
    k = batch.agg(count_if(F.col("wrong")).alias("_k"), count_if(~F.col("wrong")).alias("_right"))  # one row
    wrong = batch.filter("wrong").select(F.lit("feedback").alias("feedback_arm"), "item_id", F.lit("batch").alias("origin"))
    right = batch.filter("not wrong").crossJoin(F.broadcast(k)).withColumn("r", F.row_number().over(Window.orderBy("item_id"))).filter("r <= _k")  # a batch, not the corpus
    used = batch.select("key").unionByName(base_keys.select("key")).distinct()
    n = draw_number(F.col("item_id"), round_no)
    most = batch.count()  # no more can be wanted than the batch has
    fresh = pool.join(used, "key", "left_anti").select("item_id", n.alias("n")).orderBy("n", "item_id").limit(most)
    fresh = fresh.withColumn("r", F.row_number().over(Window.orderBy("n", "item_id"))).crossJoin(F.broadcast(k)).filter("r <= _k - _right")
    control = right.select(F.lit("control").alias("feedback_arm"), "item_id", F.lit("batch").alias("origin")).unionByName(fresh.select(F.lit("control").alias("feedback_arm"), "item_id", F.lit("pool").alias("origin")))
    return wrong.unionByName(control)


def text_clashes(new: DataFrame, base: DataFrame) -> DataFrame:
    """(id, base_id) of new records whose text key is that of a base record: a base must not hold a text twice."""
    return new.select("id", "key").join(base.select(F.col("id").alias("base_id"), "key"), "key").filter("id <> base_id").select("id", "base_id")


def feedback_reach(shown: DataFrame, records: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: how many items a correction reached, how many with a label of theirs, what chance gives, and the spread.

    ``shown(item_id, hit_id)``, ``records(id, labels)``, ``gold(item_id, labels)``. Chance is the share of records that carry
    one of the item's labels, by label sets.
    """
    h = shown.distinct().join(gold.select("item_id", F.col("labels").alias("gold")), "item_id").join(records.select(F.col("id").alias("hit_id"), "labels"), "hit_id")
    item = h.groupBy("item_id").agg(F.max(F.arrays_overlap("gold", "labels").cast("int")).alias("hit"))
    used = h.groupBy("hit_id").agg(F.count("*").alias("n"))
    items = gold.agg(F.count("*").alias("n_items"))
    reached = item.agg(F.count("*").alias("n_reached"), F.coalesce(F.sum("hit"), F.lit(0)).alias("n_label_hit"))
    spread = used.agg(F.count("*").alias("n_used"), F.max("n").alias("most_used"))
    total = records.agg(F.count("*").alias("n_records"))
    # label by label: an item meets a record once for each set of labels, of which the taxonomy allows few
    key = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    r = records.filter(F.size("labels") > 0).groupBy(key("labels").alias("rk")).agg(F.count("*").alias("c"), F.first("labels").alias("labels"))
    g = gold.filter(F.size("labels") > 0).groupBy(key("labels").alias("gk")).agg(F.count("*").alias("m"), F.first("labels").alias("gold"))
    met = g.select("gk", "m", F.explode(F.array_distinct("gold")).alias("label")).join(r.select("rk", "c", F.explode(F.array_distinct("labels")).alias("label")), "label").select("gk", "m", "rk", "c").distinct()
    chance = met.agg(F.coalesce(F.sum(F.col("m") * F.col("c")), F.lit(0)).alias("_met"))
    one = items.crossJoin(reached).crossJoin(spread).crossJoin(total).crossJoin(chance)  # one row each
    return one.select("n_items", "n_reached", "n_label_hit", "n_records", "n_used", "most_used", ratio(F.col("_met"), F.col("n_items") * F.col("n_records")).alias("chance"))


def injection_check(injected: DataFrame, items: DataFrame, records: DataFrame, related: bool) -> DataFrame:
    """One row: items, those with exactly one injected record, and those whose record is related to them as intended."""
    j = injected.join(items.select("item_id", F.col("labels").alias("gold")), "item_id").join(records.select("kb_id", "labels"), "kb_id")
    i = j.groupBy("item_id").agg(F.count("*").alias("k"), F.max(F.coalesce(F.arrays_overlap("gold", "labels"), F.lit(False)).cast("int")).alias("hit"))
    return i.agg(F.lit(related).alias("related"), F.count("*").alias("n_items"), count_if(F.col("k") == 1).alias("n_single"), count_if(F.col("hit") == int(related)).alias("n_intended"))


# ---- comparisons


def dimension_verdicts(results: DataFrame, columns: dict[str, str], by_design: dict[str, tuple[str, ...]]) -> DataFrame:
    """(arm, dimension, n, voted, verdict, first_voted): whether a dimension was voted on always, never or now and then.

    ``by_design`` names the dimensions that an arm is not asked for: never is no fault there.
    """
    each = F.array(*[F.struct(F.lit(k).alias("dimension"), F.col(c).isNotNull().alias("has")) for k, c in columns.items()])
    x = results.select("arm", "run_ts", F.explode(each).alias("x")).select("arm", "run_ts", "x.*")
    g = x.groupBy("arm", "dimension").agg(F.count("*").alias("n"), count_if(F.col("has")).alias("voted"), F.min(F.when(F.col("has"), F.date_format("run_ts", "yyyy-MM-dd"))).alias("first_voted"))
    meant = F.lit(False)
    for arm, dims in by_design.items():
        meant = meant | ((F.col("arm") == arm) & F.col("dimension").isin(*dims))
    verdict = F.when(F.col("voted") == F.col("n"), "complete").when(F.col("voted") > 0, "mixed").when(meant, "by design").otherwise("missing")
    return g.select("arm", "dimension", "n", "voted", verdict.alias("verdict"), "first_voted")


def readable_deltas(scores: DataFrame, base: str, floor: DataFrame) -> DataFrame:
    """(arm, score, base_score, delta, floor, is_readable) of ``scores(arm, score)``: a difference counts if it is wider than the
    widest spread of replicates, ``floor(floor)``, one row."""
    b = scores.filter(F.col("arm") == base).select(F.col("score").alias("base_score"))
    x = scores.filter(F.col("arm") != base).crossJoin(F.broadcast(b)).crossJoin(F.broadcast(floor))
    return x.withColumn("delta", F.col("score") - F.col("base_score")).withColumn("is_readable", F.abs("delta") > F.col("floor"))


def new_label_effect(per_label: DataFrame, label: str, with_it: str, without: str) -> DataFrame:
    """One row of ``per_label(condition, seed, label, f1)``: what a new label adds to the macro average, what it must add if nothing
    else changes (its F1 over the number of labels), the rest, and the t of the change of the other labels over seeds."""
    w = per_label.groupBy("seed").pivot("condition", [with_it, without]).agg(F.avg("f1").alias("f"))
    other = per_label.filter(F.col("label") != label).groupBy("seed").pivot("condition", [with_it, without]).agg(F.avg("f1").alias("f"))
    n = per_label.filter(F.col("condition") == with_it).agg(F.countDistinct("label").alias("n_labels"), F.avg(F.when(F.col("label") == label, F.col("f1"))).alias("label_f1"))
    d = w.select("seed", (F.col(with_it) - F.col(without)).alias("d")).join(other.select("seed", (F.col(with_it) - F.col(without)).alias("o")), "seed")
    a = d.agg(F.count("*").alias("n_seeds"), F.avg("d").alias("delta"), count_if(F.col("d") > 0).alias("seeds_up"), F.avg("o").alias("displacement"), F.stddev_samp("o").alias("_sd"))
    a = a.crossJoin(n).withColumn("mechanical", F.col("label_f1") / F.col("n_labels"))
    return a.select("n_seeds", "n_labels", "delta", "seeds_up", "label_f1", "mechanical", (F.col("delta") - F.col("mechanical")).alias("excess"), "displacement", F.try_divide(F.col("displacement"), F.col("_sd") / F.sqrt("n_seeds")).alias("displacement_t"))


def training_rows(items: DataFrame, column: str, leaked: DataFrame, least: int = MIN_SUPPORT, every: int = 10, seed: int = 0) -> DataFrame:
    """(id, labels, split): hateful items annotated for the dimension, without those in ``leaked(id)``; labels with too little
    support go as ``exclude_labels`` does; about one in ``every`` is for validation, by keyed hash."""
    x = items.filter(F.col("gate") & F.col(column).isNotNull()).join(leaked.select("id"), "id", "left_anti").select("id", F.array_distinct(column).alias("labels"))
    n = x.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    rare = n.filter(F.col("n") < least).agg(F.collect_list("label").alias("_rare"))  # labels of a taxonomy
    y = x.crossJoin(F.broadcast(rare)).withColumn("_rest", F.array_except("labels", "_rare")).filter(~((F.size("labels") > 0) & (F.size("_rest") == 0)))
    return y.select("id", F.col("_rest").alias("labels"), F.when(F.pmod(draw_number(F.col("id"), seed), F.lit(every)) == 0, "validation").otherwise("train").alias("split"))
