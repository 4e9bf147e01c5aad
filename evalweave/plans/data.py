"""The tables as the queries read them, one row per key, and the same as SQL building blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.sources.tables import first_per_key, table

ITEM = ["text", "lang", "source", "subset", "gate", "target_groups", "hate_types", "severity", "legal", "raw"]
RUN = ["item_id", "arm", "run_idx", "raw_outputs", "reasoning", "hate", "target_group", "hate_type", "severity", "legal", "repairs", "normalisations", "gate_normalised", "parse_failure", "error_msg", "latency_s", "run_ts"]
KB = ["kind", "dimension", "label", "lang", "text", "source", "meta", "created_at"]
RESULT = ["text_hash", "lang", "run_ts", "workers", "temperature", "active_model", "prompt_version", "kb_version", "hate", "uncertain", "n_valid", "n_runs", "gate_agreement", "parse_failures", "repairs", "normalisations", "latencies"]


def items(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Annotated items, the first row of each id."""
    cols = list(columns) or ITEM
    return first_per_key(table(spark, d, "gold_items", "id", "ingested_at", *cols).filter("id is not null"), ["id"], ["ingested_at"], cols)


def runs(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Sampled runs, the last logged row of each run: the later line wins."""
    cols = list(columns) or RUN
    t = table(spark, d, "run_results", "run_id", "logged_at", *cols).filter("run_id is not null")
    last = t.groupBy("run_id").agg(F.max(F.struct("logged_at", *cols)).alias("r"))
    return last.select("run_id", *[F.col(f"r.{c}").alias(c) for c in cols])


def kb(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Knowledge-base records, the first row of each id; kind, lang and source in lower case and trimmed."""
    cols = list(columns) or KB
    t = first_per_key(table(spark, d, "kb_hits", "id", "ingested_at", *cols).filter("id is not null"), ["id"], ["ingested_at"], cols)
    return t.select("id", *[F.lower(F.trim(c)).alias(c) if c in ("kind", "lang", "source") else F.col(c) for c in cols])


def results(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Voted predictions as logged, the last row of each item and arm."""
    cols = list(columns) or RESULT
    t = table(spark, d, "item_results", "item_id", "arm", "logged_at", *cols).filter("item_id is not null")
    last = t.groupBy("item_id", "arm").agg(F.max(F.struct("logged_at", *cols)).alias("r"))
    return last.select("item_id", "arm", *[F.col(f"r.{c}").alias(c) for c in cols])


def retrieved(spark: SparkSession, d: str) -> DataFrame:
    """Retrieved hits without repeated rows."""
    return table(spark, d, "retrieved_hits", "item_id", "hit_id", "bucket", "hit_pos", "score", "via").distinct()


def _one(table_name: str, key: str, order: str, extra: str = "") -> str:
    return f"select * exclude (rn) from (select *, row_number() over (partition by {key} order by {order}{extra}) as rn from {table_name} where {key.split(',')[0]} is not null) where rn = 1"


CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "items": ((), _one("gold_items", "id", "ingested_at nulls first", ", text nulls first")),
    "runs": ((), _one("run_results", "run_id", "logged_at desc nulls last")),
    "kb": ((), "select * replace (lower(trim(kind)) as kind, lower(trim(lang)) as lang, lower(trim(source)) as source) from (" + _one("kb_hits", "id", "ingested_at nulls first", ", text nulls first") + ")"),
    "results": ((), _one("item_results", "item_id, arm", "logged_at desc nulls last")),
    "hits": ((), "select distinct item_id, hit_id, bucket, hit_pos, score, via from retrieved_hits"),
    "ok_runs": (("runs",), "select *, case severity when 'low' then 0 when 'medium' then 1 when 'high' then 2 end as rank from runs where not coalesce(parse_failure, false) and hate is not null"),
    "dims": ((), "select * from (values ('target_group'), ('hate_type'), ('legal')) t(dimension)"),
    "run_labels": (
        ("ok_runs",),
        """select distinct run_id, item_id, arm, dimension, label from (
             select run_id, item_id, arm, 'target_group' as dimension, unnest(target_group) as label from ok_runs
             union all select run_id, item_id, arm, 'hate_type', unnest(hate_type) from ok_runs
             union all select run_id, item_id, arm, 'legal', unnest(legal) from ok_runs) where label is not null""",
    ),
    "pool": (
        ("runs", "ok_runs"),
        """select r.item_id, r.arm, count(*) as n_runs, count(o.run_id) as n_valid, coalesce(sum(cast(o.hate as int)), 0) as yes,
             quantile_disc(o.rank, 0.5) as rank, count(o.rank) as n_severity
           from runs r left join ok_runs o using (run_id) group by r.item_id, r.arm""",
    ),
    "label_votes": (("run_labels",), "select item_id, arm, dimension, label, count(*) as c from run_labels group by all"),
    "kept": (
        ("label_votes", "pool"),
        """select v.item_id, v.arm, v.dimension, list(label order by label) filter (where c * 2 > n_valid) as labels, min(c / n_valid::double) as least
           from label_votes v join pool p on v.item_id is not distinct from p.item_id and v.arm is not distinct from p.arm group by 1, 2, 3""",
    ),
    "votes": (
        ("pool", "kept"),
        """select p.item_id, p.arm, n_runs, n_valid, case when n_valid > 0 then yes * 2 > n_valid end as hate, n_valid > 0 and yes * 2 = n_valid as uncertain,
             case when n_valid > 0 then case when yes * 2 > n_valid then coalesce(t.labels, []) else [] end end as target_group,
             case when n_valid > 0 then case when yes * 2 > n_valid then coalesce(h.labels, []) else [] end end as hate_type,
             case when n_valid > 0 then coalesce(l.labels, []) end as legal,
             case when n_valid > 0 and yes * 2 > n_valid then list_extract(['low', 'medium', 'high'], cast(rank as int) + 1) end as severity,
             case when n_valid > 0 then greatest(yes, n_valid - yes) / n_valid::double end as agreement_hate,
             case when n_valid > 0 then case when n_severity > 0 then n_severity / n_valid::double else 1.0 end end as agreement_severity,
             case when n_valid > 0 then coalesce(t.least, 1.0) end as agreement_target_group,
             case when n_valid > 0 then coalesce(h.least, 1.0) end as agreement_hate_type,
             case when n_valid > 0 then coalesce(l.least, 1.0) end as agreement_legal,
             t.item_id is not null as any_target_group, h.item_id is not null as any_hate_type, l.item_id is not null as any_legal
           from pool p left join kept t on t.dimension = 'target_group' and p.item_id = t.item_id and p.arm = t.arm
             left join kept h on h.dimension = 'hate_type' and p.item_id = h.item_id and p.arm = h.arm
             left join kept l on l.dimension = 'legal' and p.item_id = l.item_id and p.arm = l.arm""",
    ),
    "vote_list": (
        ("items",),
        "select id, unnest(v) as vote, generate_subscripts(v, 1) as pos from (select id, from_json(json_extract(try_cast(raw as json), '$.votes'), '[\"VARCHAR\"]') as v from items)",
    ),
    "classes": (
        ("vote_list",),
        "select id, vote as cls from (select id, vote, row_number() over (partition by id order by count(*) desc, min(pos)) as r from vote_list where vote is not null group by id, vote) where r = 1",
    ),
    "gates": (
        ("items", "classes"),
        """select i.id, i.source, m.mapping, case when m.mapping = 'strict' or i.gate is null then i.gate when i.source = 'agora' and c.cls = 'offensive' then true else i.gate end as truth
           from items i left join classes c using (id) cross join (values ('strict'), ('lenient')) m(mapping)""",
    ),
    "gate_pairs": (
        ("votes", "gates"),
        "select v.item_id, v.arm, g.source, g.mapping, g.truth, v.hate as pred, v.uncertain, v.agreement_hate as confidence from votes v join gates g on v.item_id = g.id",
    ),
    "label_pairs": (
        ("votes", "items"),
        """select * from (
             select v.item_id, v.arm, 'target_group' as dimension, case when i.gate then list_distinct(i.target_groups) end as gold, v.target_group as pred from votes v join items i on v.item_id = i.id
             union all select v.item_id, v.arm, 'hate_type', case when i.gate then list_distinct(i.hate_types) end, v.hate_type from votes v join items i on v.item_id = i.id
             union all select v.item_id, v.arm, 'legal', list_distinct(i.legal), v.legal from votes v join items i on v.item_id = i.id) where gold is not null""",
    ),
    "per_label": (
        ("label_pairs",),
        """select arm, dimension, label, tp, fp, fn, tp + fn as support, tp + fp as predicted, coalesce(tp / nullif(tp + fp, 0)::double, 0) as precision,
             coalesce(tp / nullif(tp + fn, 0)::double, 0) as recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 0) as f1, tp + fn >= 10 as averaged
           from (select arm, dimension, label, count(*) filter (where list_contains(gold, label) and list_contains(pred, label)) as tp,
                   count(*) filter (where not list_contains(gold, label)) as fp, count(*) filter (where not list_contains(pred, label)) as fn
                 from (select arm, dimension, gold, pred, unnest(list_distinct(list_concat(gold, pred))) as label from label_pairs where pred is not null) group by all)""",
    ),
}


def sql(body: str, *needs: str) -> str:
    """``body`` after the building blocks it needs, each once and in order."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in CTE[name][0]:
            add(n)
        if name not in order:
            order.append(name)

    for n in needs:
        add(n)
    head = ",\n".join(f"{n} as ({CTE[n][1]})" for n in order)
    sep = "" if body.lstrip().startswith(",") else "\n"
    return (f"with {head}{sep}" if head else "") + body
