"""Queries over texts, splits, samples and the knowledge base."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalweave.functions import text as X
from evalweave.operators import kb as K
from evalweave.operators import labels as L
from evalweave.operators import sampling as S
from evalweave.plans import data, norm
from evalweave.plans.data import sql
from evalweave.sources.tables import table

_FLAT_SQL = r"trim(regexp_replace({}, '[\s\x{{00a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))"
_KEY_SQL = f"lower({_FLAT_SQL})"
_DRAW = "('0x' || substr(md5({}::varchar || '|{}'), 1, 15))::bigint"


def tokenize_counts(s, d):
    t = data.kb(s, d, "text", "kind").filter("text is not null").select("kind", F.explode(X.tokens("text")).alias("t"))
    return t.groupBy("kind").agg(F.count("*").alias("n_tokens"), F.countDistinct("t").alias("n_terms"))


def flatten_text(s, d):
    return data.items(s, d, "text").filter("text is not null").select("id", F.md5(X.flatten("text")).alias("flat"), F.length(X.flatten("text")).cast("long").alias("n"))


def text_hash(s, d):
    """Items whose stored hash in item_results is that of their stored text, by arm."""
    i = data.items(s, d, "text").select(F.col("id").alias("item_id"), F.substring(F.sha2("text", 256), 1, 16).alias("h"), X.text_hash("text").alias("fh"))
    j = data.results(s, d, "text_hash").join(i, "item_id")
    return j.groupBy("arm").agg(F.count("*").alias("n"), F.count(F.when(F.col("h") == F.col("text_hash"), 1)).alias("stored_equal"), F.count(F.when(F.col("fh") == F.col("text_hash"), 1)).alias("flat_equal"))


def feedback_ids(s, d):
    return data.items(s, d, "text").filter("text is not null").select("id", X.feedback_id("text").alias("fid"))


def norm_text(s, d):
    return data.items(s, d, "text").select("id", X.norm_text("text").alias("norm"))


def dedup_keep_first(s, d):
    i = data.items(s, d, "text", "source").filter("text is not null")
    return S.keep_first(i, X.dedup_key("text"), ["id"]).select("id", "source")


def record_rows(s, d):
    """Items as stored rows: lists as JSON, never-annotated kept apart from empty."""
    i = data.items(s, d, "gate", "target_groups", "hate_types", "legal")
    return i.select("id", F.col("gate").cast("string").alias("gate"), *[K.encode_meta(F.col(c)).alias(c) for c in ("target_groups", "hate_types", "legal")])


def sentinel_round_trip(s, d):
    i = data.items(s, d, "target_groups", "hate_types", "legal")
    same = [K.decode_meta(K.encode_meta(F.col(c))).eqNullSafe(F.col(c)) for c in ("target_groups", "hate_types", "legal")]
    return i.agg(F.count("*").alias("n"), *[F.count(F.when(c, 1)).alias(f"same_{k}") for k, c in enumerate(same)])


def annotation_richness(s, d):
    return data.items(s, d, "gate", "target_groups", "hate_types", "severity", "legal").groupBy(L.richness().cast("long").alias("rich")).agg(F.count("*").alias("n"))


def multi_hot_targets(s, d):
    i = data.items(s, d, "hate_types").filter("hate_types is not null")
    return i.select("id", F.array_join(F.transform(L.multi_hot(F.col("hate_types"), "hate_type"), lambda x: x.cast("int").cast("string")), "").alias("hot"))


def split_70_15_15(s, d):
    i = data.items(s, d, "lang", "gate")
    return S.split_by_share(i, ["lang", "gate"], {"train": 0.7, "dev": 0.15, "test": 0.15}).select("id", "split")


def split_disjoint_check(s, d):
    """Texts that would sit in more than one split, by pair of splits."""
    i = data.items(s, d, "text", "lang", "gate").filter("text is not null")
    x = S.split_by_share(i, ["lang", "gate"], {"train": 0.7, "dev": 0.15, "test": 0.15}).select("split", F.md5(X.dedup_key("text")).alias("k"))
    m = x.groupBy("k").agg(F.array_join(F.array_sort(F.collect_set("split")), "+").alias("splits"), F.count("*").alias("n")).filter(F.col("splits").contains("+"))
    return m.groupBy("splits").agg(F.count("*").alias("n_texts"), F.sum("n").alias("n_rows"))


def largest_remainder(s, d):
    n = data.items(s, d, "source").groupBy("source").agg(F.count("*").alias("n"))
    return S.largest_remainder(n, 150, keys=["source"])


def draw_pool_stratified(s, d):
    return S.draw_pool(data.items(s, d, "source", "gate"), ["source", "gate"], 200).select("id", "source", F.col("gate").cast("string").alias("gate"))


def draw_pool_lineitem(s, d):
    """The same draw over the largest general table."""
    t = table(s, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus").withColumn("id", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.lit("x")))
    x = t.groupBy("id").agg(F.min("l_returnflag").alias("l_returnflag"), F.min("l_linestatus").alias("l_linestatus"))
    return S.draw_pool(x, ["l_returnflag", "l_linestatus"], 1000, seed=3).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def partition_slices(s, d):
    i = data.items(s, d, "source")
    return S.partition_slices(i, ["source"], {"pool": 120, "held_out": 80, "batch_1": 40, "batch_2": 40}).select("id", "slice")


def role_partition(s, d):
    """Roles stratified on the exact label set."""
    i = data.items(s, d, "gate", "hate_types").filter("gate and hate_types is not null")
    i = i.select("id", F.array_join(F.array_sort("hate_types"), ",").alias("labels"))
    return S.partition_slices(i, ["labels"], ROLES, seed=5).select("id", "slice")


def label_stratified(s, d):
    i = data.items(s, d, "hate_types").filter("hate_types is not null")
    return S.label_stratified(i, "hate_types", list(L.TAXONOMY["hate_type"]), 12).select("id", F.array_join("hate_types", ",").alias("labels"))


def severity_bands(s, d):
    r = data.runs(s, d, "latency_s")
    return S.severity_band(r, "latency_s", 1.0).groupBy("band").agg(F.count("*").alias("n"))


def label_histogram(s, d):
    i = data.items(s, d, "target_groups", "hate_types", "legal", "severity")
    pair = lambda k: lambda x: F.struct(F.lit(k).alias("dimension"), x.alias("label"))
    lists = [F.transform(F.coalesce(F.col(L.GOLD_COLUMN[k]), F.array().cast("array<string>")), pair(k)) for k in L.MULTILABEL]
    each = F.flatten(F.array(*lists, F.transform(F.array_compact(F.array("severity")), pair("severity"))))
    n = i.select(F.explode(each).alias("x")).groupBy("x.dimension", "x.label").agg(F.count("*").alias("n"))
    return F.broadcast(L.label_table(s)).join(n, ["dimension", "label"], "left").select("dimension", "label", F.coalesce("n", F.lit(0)).alias("n"))


def source_histogram(s, d):
    return data.items(s, d, "subset", "source", "gate").groupBy("subset", "source").agg(F.count("*").alias("n"), F.count(F.when(F.col("gate"), 1)).alias("n_hateful"), F.count(F.when(F.col("gate").isNull(), 1)).alias("n_unannotated"))


def coverage_matrix(s, d):
    i = data.items(s, d, "source", "lang", "gate", "target_groups", "hate_types", "severity", "legal")
    return i.groupBy("source").agg(*[F.max(F.col(c).isNotNull().cast("int")).cast("long").alias(f"has_{c}") for c in ("gate", "target_groups", "hate_types", "severity", "legal")], F.array_join(F.array_sort(F.collect_set(F.lower(F.trim("lang")))), ",").alias("langs"))


def label_cardinality(s, d):
    return data.items(s, d, "hate_types").filter("hate_types is not null").groupBy(F.size("hate_types").cast("long").alias("n_labels")).agg(F.count("*").alias("n"))


def kb_definitions(s, d):
    """Definitions built from the label space, and whether the stored base has the same under the same id."""
    stored = data.kb(s, d, "kind", "dimension", "label", "text").filter("kind = 'definition'").select("id", F.col("dimension").alias("stored_dimension"), F.col("label").alias("stored_label"))
    words = {("hate", ""): "hateful"} | {(k, x): x.replace("_", " ") for k, xs in L.TAXONOMY.items() for x in xs}
    built = K.definitions(s, words)
    same = F.col("dimension").eqNullSafe(F.col("stored_dimension")) & F.col("label").eqNullSafe(F.col("stored_label"))
    return built.join(stored, "id", "left").select("id", "dimension", "label", "text", same.alias("is_stored"))


def kb_examples_richest(s, d):
    return K.examples(data.items(s, d, "gate", "target_groups", "hate_types", "severity", "legal"), "hate_types")


def kb_merge_illustrations(s, d):
    k = data.kb(s, d, "kind", "label")
    base = k.filter("kind = 'example'").select("id", "label")
    extra = k.filter("kind in ('feedback')").select("id", F.lit("illustration").alias("label")).unionByName(k.filter("kind = 'example' and label = 'irony'").select("id", F.lit("illustration").alias("label")))
    return K.merge_attribute(base, extra, "id", "label").select("id", "label")


def kb_validate(s, d):
    return K.problems(K.with_meta(data.kb(s, d))).groupBy("problem").agg(F.count("*").alias("n"))


def kb_duplicate_text(s, d):
    return K.duplicate_texts(data.kb(s, d, "text"))


def kb_duplicate_ids(s, d):
    return table(s, d, "kb_hits", "id").groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")


def kb_kind_counts(s, d):
    return data.kb(s, d, "kind", "lang").groupBy("kind", "lang").agg(F.count("*").alias("n"))


def kb_held_out_drop(s, d):
    k = data.kb(s, d, "kind", "text").filter("kind in ('example', 'feedback') and text is not null")
    held = data.items(s, d, "text", "subset").filter(F.col("subset").contains("test"))
    return K.drop_held_out(k, held).groupBy("kind").agg(F.count("*").alias("n_kept"))


def kb_row_diff(s, d):
    k = data.kb(s, d, "kind", "dimension", "label", "lang", "text")
    edited = K.edit_record(k.filter("id <> 'def-hate'"), "def-severity-low", "text", "another text")
    return K.row_diff(k, edited, "id", ["kind", "dimension", "label", "lang", "text"])


def kb_label_removed(s, d):
    k = K.with_meta(data.kb(s, d, "kind", "dimension", "label", "meta"))
    return K.remove_label(k, "hate_type", "grievance", "hate_types").groupBy("kind").agg(F.count("*").alias("n"))


def kb_version(s, d):
    return K.kb_version(data.kb(s, d, "kind", "lang", "text"), ["id", "kind", "lang", "text"])


def kb_feedback_records(s, d):
    i = data.items(s, d, "text", "lang", "source", "gate", "target_groups", "hate_types", "severity", "legal").filter("gate and text is not null")
    x = K.with_meta(K.feedback_records(i, 1, "feedback", "exact"))
    return x.select("id", "source", F.col("meta.origin_item_id").alias("origin"), F.col("meta.gate").alias("gate"), F.array_join("meta.hate_types", ",").alias("hate_types"))


def resume_antijoin(s, d):
    """Work still to do: items by arms without a logged prediction."""
    work = data.items(s, d, "subset").select(F.col("id").alias("item_id"), F.explode(F.array(*[F.lit(a) for a in ("zero_shot", "few_shot", "rag")])).alias("arm"))
    return work.join(data.results(s, d, "hate").select("item_id", "arm"), ["item_id", "arm"], "left_anti").groupBy("arm").agg(F.count("*").alias("n_todo"))


def n_way_intersection(s, d):
    r = data.results(s, d, "hate").groupBy("item_id").agg(F.countDistinct("arm").alias("k"))
    return r.groupBy("k").agg(F.count("*").alias("n_items"))


def norm_key_leak(s, d):
    """Items whose text is also a training record in the same language, exactly or by key."""
    i = data.items(s, d, "text", "lang").filter("text is not null").select("id", F.lower(F.trim("lang")).alias("lang"), "text", X.dedup_key("text").alias("k"))
    k = data.kb(s, d, "kind", "text", "lang").filter("kind in ('example', 'feedback') and text is not null").select(F.col("id").alias("kb_id"), F.col("lang"), F.col("text").alias("kb_text"), X.dedup_key("text").alias("k"))
    return i.join(k, ["lang", "k"]).select("id", "kb_id", (F.col("text") == F.col("kb_text")).alias("exact"))


QUERIES = {
    f.__name__: f
    for f in (tokenize_counts, flatten_text, text_hash, feedback_ids, norm_text, dedup_keep_first, record_rows, sentinel_round_trip, annotation_richness, multi_hot_targets, split_70_15_15, split_disjoint_check, largest_remainder, draw_pool_stratified, draw_pool_lineitem, partition_slices, role_partition, label_stratified, severity_bands, label_histogram, source_histogram, coverage_matrix, label_cardinality, kb_definitions, kb_examples_richest, kb_merge_illustrations, kb_validate, kb_duplicate_text, kb_duplicate_ids, kb_kind_counts, kb_held_out_drop, kb_row_diff, kb_label_removed, kb_version, kb_feedback_records, resume_antijoin, n_way_intersection, norm_key_leak)
}

_SPLIT = f"select id, text, case when r <= floor(n * 0.7) then 'train' when r <= floor(n * 0.85) then 'dev' else 'test' end as split from (select id, text, row_number() over (partition by lang, gate order by {_DRAW.format('id', 0)}, id) as r, count(*) over (partition by lang, gate) as n from items {{}})"


def _takes(strata: str, total: int, source: str, order: str) -> str:
    return f"select *, least(fl + case when row_number() over (order by round(ex - fl, 9) desc, {order}) <= {total} - sum(fl) over () then 1 else 0 end, n) as take from (select *, n * {total}.0::double / sum(n) over () as ex, cast(floor(n * {total}.0::double / sum(n) over ()) as bigint) as fl from (select {strata}, count(*) as n from {source} group by {strata}))"


def _slices(strata: str, sizes: dict[str, int], source: str, seed: int) -> str:
    parts, cases, low = [], [], "0"
    for name, size in sizes.items():
        parts.append(f"t_{name} as ({_takes(strata, size, source, f'{strata} desc nulls last')})")
        high = f"{low} + t_{name}.take"
        cases.append(f"when r > {low} and r <= {high} then '{name}'")
        low = high
    joins = " ".join(f"join t_{n} on o.{strata} is not distinct from t_{n}.{strata}" for n in sizes)
    ranked = f"select id, {strata}, row_number() over (partition by {strata} order by {_DRAW.format('id', seed)}, id) as r from {source}"
    return f", {', '.join(parts)}, o as ({ranked}) select * from (select o.id, case {' '.join(cases)} end as slice from o {joins}) where slice is not null"


def _label_draw(labels: list[str], per_label: int, source: str = "items", column: str = "hate_types", order: str = "n, id") -> str:
    """The draw label by label: the rarest first, each step among the rows that earlier steps left."""
    x = f", x as (select id, {column}, {_DRAW.format('id', 0)} as n from {source} where {column} is not null), lb as (select l.label, row_number() over (order by coalesce(c.n, 0), l.label) as r from (select unnest({labels}) as label) l left join (select label, count(*) as n from (select unnest(list_distinct({column})) as label from x) group by label) c using (label)), d0 as (select id, {column} from x where false)"
    for i in range(1, len(labels) + 1):
        carries = f"list_contains({column}, (select label from lb where r = {i}))"
        x += f", d{i} as (select * from d{i - 1} union all (select id, {column} from x where {carries} and id not in (select id from d{i - 1}) order by {order} limit (select greatest(0, {per_label} - count(*)) from d{i - 1} where {carries})))"
    return x + f" select id, array_to_string({column}, ',') as labels from d{len(labels)}"


ROLES = {"pool": 40, "held_out": 40, "batch_1": 15, "batch_2": 15, "batch_3": 15, "batch_4": 15}
_ROLES = _slices("labels", ROLES, "z", 5)
#: CTEs down to ``sl(id, slice)``, over ``z(id, labels)``.
ROLES_CTE = _ROLES.replace(" select * from (select o.id", ", sl as (select * from (select o.id", 1) + ")"
_META = "json_extract(try_cast(meta as json), '$.{}')"
ORACLE = {
    "tokenize_counts": sql(r"select kind, count(*) as n_tokens, count(distinct t) as n_terms from (select kind, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')) as t from kb where text is not null) group by kind", "kb"),
    "flatten_text": sql(f"select id, md5({_FLAT_SQL.format('text')}) as flat, length({_FLAT_SQL.format('text')}) as n from items where text is not null", "items"),
    "text_hash": sql(f"select arm, count(*) as n, count(*) filter (where substr(sha256(text), 1, 16) = text_hash) as stored_equal, count(*) filter (where substr(sha256({_FLAT_SQL.format('text')}), 1, 16) = text_hash) as flat_equal from results r join items i on r.item_id = i.id group by arm", "results", "items"),
    "feedback_ids": sql(f"select id, 'fb-' || substr(sha1({_FLAT_SQL.format('text')}), 1, 12) as fid from items where text is not null", "items"),
    "dedup_keep_first": sql(f"select id, source from (select id, source, row_number() over (partition by {_KEY_SQL.format('text')} order by id) as r from items where text is not null) where r = 1", "items"),
    "record_rows": sql("select id, gate::varchar as gate, " + ", ".join(f"coalesce(to_json({c})::varchar, '__none__') as {c}" for c in ("target_groups", "hate_types", "legal")) + " from items", "items"),
    "sentinel_round_trip": sql("select count(*) as n, " + ", ".join(f"count(*) filter (where from_json(case when {c} is not null then to_json({c}) end, '[\"VARCHAR\"]') is not distinct from {c}) as same_{i}" for i, c in enumerate(("target_groups", "hate_types", "legal"))) + " from items", "items"),
    "annotation_richness": sql("select cast((gate is not null)::int + (target_groups is not null)::int + (hate_types is not null)::int + (severity is not null)::int + (legal is not null)::int as bigint) as rich, count(*) as n from items group by 1", "items"),
    "multi_hot_targets": sql("select id, array_to_string(list_transform(['explicit', 'incitement', 'inferiority', 'irony', 'stereotyping', 'threatening', 'grievance'], lambda x: list_contains(hate_types, x)::int), '') as hot from items where hate_types is not null", "items"),
    "split_70_15_15": sql(f"select id, split from ({_SPLIT.format('')})", "items"),
    "split_disjoint_check": sql(f"select splits, count(*) as n_texts, cast(sum(n) as bigint) as n_rows from (select {_KEY_SQL.format('text')} as k, array_to_string(list_sort(list(distinct split)), '+') as splits, count(*) as n from ({_SPLIT.format('where text is not null')}) group by 1) where contains(splits, '+') group by splits", "items"),
    "largest_remainder": sql(f"select source, n, take from ({_takes('source', 150, 'items', 'source desc nulls last')})", "items"),
    "draw_pool_stratified": sql(f", t as ({_takes('source, gate', 200, 'items', 'source desc nulls last, gate desc nulls last')}), o as (select id, source, gate, row_number() over (partition by source, gate order by {_DRAW.format('id', 0)}, id) as r from items) select o.id, o.source, o.gate::varchar as gate from o join t on o.source is not distinct from t.source and o.gate is not distinct from t.gate where r <= take", "items"),
    "draw_pool_lineitem": f"with x as (select l_orderkey::varchar || '-' || l_linenumber::varchar || '-x' as id, min(l_returnflag) as l_returnflag, min(l_linestatus) as l_linestatus from lineitem group by 1), t as ({_takes('l_returnflag, l_linestatus', 1000, 'x', 'l_returnflag desc, l_linestatus desc')}), o as (select *, row_number() over (partition by l_returnflag, l_linestatus order by {_DRAW.format('id', 3)}, id) as r from x) select o.l_returnflag, o.l_linestatus, count(*) as n, min(id) as first_id from o join t using (l_returnflag, l_linestatus) where r <= take group by all",
    "partition_slices": sql(_slices("source", {"pool": 120, "held_out": 80, "batch_1": 40, "batch_2": 40}, "items", 0), "items"),
    "role_partition": sql(", z as (select id, array_to_string(list_sort(hate_types), ',') as labels from items where gate and hate_types is not null)" + _ROLES, "items"),
    "severity_bands": sql(", q as (select quantile_cont(latency_s, [1/3, 2/3]) as q from runs where latency_s > 1.0) select case when latency_s <= 1.0 then null when latency_s <= q[1] then 'low' when latency_s <= q[2] then 'medium' when latency_s is not null then 'high' end as band, count(*) as n from runs, q group by 1", "runs"),
    "label_histogram": sql(
        ", l as (" + " union all ".join(f"select '{k}' as dimension, '{x}' as label" for k, xs in L.TAXONOMY.items() for x in xs) + "), n as (select dimension, label, count(*) as n from (select 'target_group' as dimension, unnest(target_groups) as label from items union all select 'hate_type', unnest(hate_types) from items union all select 'legal', unnest(legal) from items union all select 'severity', severity from items) group by all) select l.dimension, l.label, coalesce(n, 0) as n from l left join n using (dimension, label)",
        "items",
    ),
    "source_histogram": sql("select subset, source, count(*) as n, count(*) filter (where gate) as n_hateful, count(*) filter (where gate is null) as n_unannotated from items group by subset, source", "items"),
    "coverage_matrix": sql("select source, " + ", ".join(f"cast(max(({c} is not null)::int) as bigint) as has_{c}" for c in ("gate", "target_groups", "hate_types", "severity", "legal")) + ", coalesce(array_to_string(list_sort(list(distinct lower(trim(lang))) filter (where lang is not null)), ','), '') as langs from items group by source", "items"),
    "label_cardinality": sql("select len(hate_types) as n_labels, count(*) as n from items where hate_types is not null group by 1", "items"),
    "kb_definitions": sql(", l as (select 'def-hate' as id, 'hate' as dimension, null as label, 'hateful' as text union all " + " union all ".join(f"select 'def-{k}-{x}', '{k}', '{x}', '{x.replace('_', ' ')}'" for k, xs in L.TAXONOMY.items() for x in xs) + ") select l.*, k.dimension is not distinct from l.dimension and k.label is not distinct from l.label as is_stored from l left join (select * from kb where kind = 'definition') k using (id)", "kb"),
    "kb_examples_richest": sql(", r as (select *, (gate is not null)::int + (target_groups is not null)::int + (hate_types is not null)::int + (severity is not null)::int + (legal is not null)::int as rich from items), x as (select id, rich, unnest(hate_types) as label from r union all select id, rich, 'none' from r where not gate) select id, label, pick from (select id, label, row_number() over (partition by label order by rich desc, id) as pick from x where label is not null) where pick <= case label when 'none' then 20 else 10 end", "items"),
    "kb_merge_illustrations": sql("select id, case when kind = 'feedback' or label = 'irony' then 'illustration' else label end as label from kb where kind in ('example', 'feedback')", "kb"),
    "kb_validate": sql(
        f"""select problem, count(*) as n from (
          select 'missing id' as problem from kb where coalesce(trim(id), '') = '' union all select 'missing text' from kb where coalesce(trim(text), '') = ''
          union all select 'missing source' from kb where coalesce(trim(source), '') = '' union all select 'missing lang' from kb where coalesce(trim(lang), '') = ''
          union all select 'unknown kind' from kb where not coalesce(kind in ('definition', 'guideline', 'example', 'feedback'), false)
          union all select 'definition without dimension' from kb where kind = 'definition' and dimension is null
          union all select 'example with torn meta' from kb where kind in ('example', 'feedback') and try_cast(meta as json) is null
          union all select 'feedback without origin' from kb where kind = 'feedback' and try_cast(meta as json) is not null and json_extract_string(try_cast(meta as json), '$.origin_item_id') is null
          union all select 'feedback without round' from kb where kind = 'feedback' and try_cast(meta as json) is not null and json_extract_string(try_cast(meta as json), '$.round') is null
          union all select 'labels on a benign example' from kb where kind = 'example' and json_extract_string(try_cast(meta as json), '$.gate') = 'false' and json_array_length(try_cast(meta as json), '$.hate_types') > 0) group by problem""",
        "kb",
    ),
    "kb_duplicate_text": sql(f"select md5({_KEY_SQL.format('text')}) as text_key, count(*) as n, min(id) as first_id from kb where text is not null group by 1 having count(*) > 1", "kb"),
    "kb_duplicate_ids": "select id, count(*) as n from kb_hits group by id having count(*) > 1",
    "kb_kind_counts": sql("select kind, lang, count(*) as n from kb group by kind, lang", "kb"),
    "kb_held_out_drop": sql(f"select kind, count(*) as n_kept from kb where kind in ('example', 'feedback') and text is not null and {_KEY_SQL.format('text')} not in (select {_KEY_SQL.format('text')} from items where contains(subset, 'test') and text is not null) group by kind", "kb", "items"),
    "label_stratified": sql(_label_draw(list(L.TAXONOMY["hate_type"]), 12), "items"),
    "kb_version": sql(", r as (select sha256(concat_ws(chr(31), " + ", ".join(f"coalesce('=' || {c}, '-')" for c in ("id", "kind", "lang", "text")) + ")) as h from kb) select substr(sha256(concat_ws('|', " + ", ".join(f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::hugeint)" for i in range(4)) + ", count(*))), 1, 16) as version, count(*) as n from r", "kb"),
    "norm_text": sql(norm.ctes("items") + " select id, norm from items_norm", "items"),
    "kb_row_diff": sql(", old as (select id, unnest(['kind', 'dimension', 'label', 'lang', 'text']) as field, unnest([kind, dimension, label, lang, text]) as value from kb), new as (select id, field, case when id = 'def-severity-low' and field = 'text' then 'another text' else value end as value from old where id <> 'def-hate'), gone as (select id from old except select id from new) select id, '*' as field, 'removed' as change from gone union all select o.id, o.field, 'changed' from old o join new n using (id, field) where o.value is distinct from n.value", "kb"),
    "kb_label_removed": sql("select kind, count(*) as n from kb where not (kind = 'definition' and dimension is not distinct from 'hate_type' and label is not distinct from 'grievance') and not coalesce(list_contains(from_json(json_extract(try_cast(meta as json), '$.hate_types'), '[\"VARCHAR\"]'), 'grievance'), false) group by kind", "kb"),
    "kb_feedback_records": sql(f"select 'fb-' || substr(sha1({_FLAT_SQL.format('text')}), 1, 12) as id, source, id as origin, gate, array_to_string(hate_types, ',') as hate_types from items where gate and text is not null", "items"),
    "resume_antijoin": sql("select arm, count(*) as n_todo from (select id as item_id, unnest(['zero_shot', 'few_shot', 'rag']) as arm from items) w where not exists (select 1 from results r where r.item_id = w.item_id and r.arm = w.arm) group by arm", "items", "results"),
    "n_way_intersection": sql("select k, count(*) as n_items from (select item_id, count(distinct arm) as k from results group by item_id) group by k", "results"),
    "norm_key_leak": sql(f"select i.id, k.id as kb_id, i.text = k.text as exact from items i join kb k on lower(trim(i.lang)) = k.lang and {_KEY_SQL.format('i.text')} = {_KEY_SQL.format('k.text')} where k.kind in ('example', 'feedback')", "items", "kb"),
}
