"""Knowledge-base records: building, merging, checking, comparing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalweave.functions.text import dedup_key, feedback_id
from evalweave.operators.labels import TAXONOMY, label_table, richness

KINDS = ("definition", "guideline", "example", "feedback")
META = "gate boolean, target_groups array<string>, hate_types array<string>, severity string, legal array<string>, illustrative_only boolean, stgb string, round int, origin_item_id string, criterion string, feedback_arm string"
NONE = "__none__"


def with_meta(records: DataFrame) -> DataFrame:
    """The JSON ``meta`` as a struct; torn JSON gives NULL, absent and null keys give NULL, [] stays []."""
    ok = F.try_parse_json("meta").isNotNull()
    return records.withColumn("meta", F.when(ok, F.from_json("meta", META)))


def encode_meta(value: Column) -> Column:
    """A list for a store without NULLs and lists: NULL becomes a sentinel, a list its JSON."""
    return F.coalesce(F.to_json(value), F.lit(NONE))


def decode_meta(text: Column) -> Column:
    return F.when(text != NONE, F.from_json(text, "array<string>"))


def definitions(spark: SparkSession, definitions_of: dict[tuple[str, str], str]) -> DataFrame:
    """KB rows of the gate and of every label; a label without definition is an error."""
    rows = [("def-hate", "definition", "hate", None, definitions_of["hate", ""])]
    rows += [(f"def-{d}-{x}", "definition", d, x, definitions_of[d, x]) for d, xs in TAXONOMY.items() for x in xs]
    return spark.createDataFrame(rows, "id string, kind string, dimension string, label string, text string")


def examples(items: DataFrame, labels_col: str, cap: int = 10, negatives: int = 20) -> DataFrame:
    """(id, label, pick): per label the richest rows up to ``cap``, and ``negatives`` rows annotated as not hateful.

    A row may be picked for several labels. The rank filter is pushed before the shuffle, so at most ``cap`` rows per
    label and partition move.
    """
    x = items.withColumn("rich", richness())
    pos = x.select("id", "rich", F.explode(labels_col).alias("label")).filter("label is not null")
    neg = x.filter("gate = false").select("id", "rich", F.lit("none").alias("label"))
    w = Window.partitionBy("label").orderBy(F.desc("rich"), "id")
    ranked = pos.unionByName(neg).withColumn("pick", F.row_number().over(w))
    return ranked.filter((F.col("pick") <= max(cap, negatives)) & (F.col("pick") <= F.when(F.col("label") == "none", negatives).otherwise(cap))).select("id", "label", "pick")


def merge_attribute(base: DataFrame, extra: DataFrame, key: str, column: str) -> DataFrame:
    """``extra``'s column merged onto records that exist, its other rows appended: no record twice."""
    j = base.join(extra.select(key, F.col(column).alias("_new")), key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")
    rest = extra.join(base.select(key), key, "left_anti")
    return j.unionByName(rest, allowMissingColumns=True)


def problems(records: DataFrame) -> DataFrame:
    """(id, problem) of every rule a record breaks. ``meta`` is the parsed struct."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    m = F.col("meta")
    rules = {
        "missing id": blank("id"),
        "missing text": blank("text"),
        "missing source": blank("source"),
        "missing lang": blank("lang"),
        "unknown kind": ~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)),
        "definition without dimension": (F.col("kind") == "definition") & F.col("dimension").isNull(),
        "example with torn meta": F.col("kind").isin("example", "feedback") & m.isNull(),
        "feedback without origin": (F.col("kind") == "feedback") & m.isNotNull() & m["origin_item_id"].isNull(),
        "feedback without round": (F.col("kind") == "feedback") & m.isNotNull() & m["round"].isNull(),
        "labels on a benign example": (F.col("kind") == "example") & ~F.coalesce(m["gate"], F.lit(True)) & (F.size(F.coalesce(m["hate_types"], F.array())) > 0),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    return records.select("id", F.explode(found).alias("problem"))


def duplicate_texts(records: DataFrame) -> DataFrame:
    """(text_key, n, first_id) of texts that more than one record has."""
    x = records.filter("text is not null").groupBy(F.md5(dedup_key("text")).alias("text_key")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    return x.filter("n > 1")


def drop_held_out(records: DataFrame, held_out: DataFrame) -> DataFrame:
    """Records whose text is not in a held-out split."""
    keys = held_out.filter("text is not null").select(dedup_key("text").alias("_k")).distinct()
    return records.withColumn("_k", dedup_key("text")).join(keys, "_k", "left_anti").drop("_k")


def row_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field, change) between two versions: removed and added records, changed fields."""
    a = old.select(key, F.struct(*columns).alias("a"))
    b = new.select(key, F.struct(*columns).alias("b"))
    j = a.join(b, key, "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.struct(F.lit(c).alias("field"), F.lit("changed").alias("change"))) for c in columns]))
    whole = lambda w: F.array(F.struct(F.lit("*").alias("field"), F.lit(w).alias("change")))
    return j.select(key, F.explode(F.when(F.col("a").isNull(), whole("added")).when(F.col("b").isNull(), whole("removed")).otherwise(changed)).alias("d")).select(key, "d.field", "d.change")


def remove_label(records: DataFrame, dimension: str, label: str, meta_field: str) -> DataFrame:
    """The base without one label: its definition and every example that carries it are gone."""
    carries = F.coalesce(F.array_contains(F.col(f"meta.{meta_field}"), label), F.lit(False))
    return records.filter(~((F.col("kind") == "definition") & F.col("dimension").eqNullSafe(F.lit(dimension)) & F.col("label").eqNullSafe(F.lit(label))) & ~carries)


def label_removal_check(before: DataFrame, after: DataFrame, dimension: str, label: str) -> DataFrame:
    """(dimension, n_before, n_after, is_right): definitions by dimension; the label's own loses exactly one, the others none.

    ``before`` must define the label exactly once: anything else is an error.
    """
    n = before.filter((F.col("kind") == "definition") & (F.col("dimension") == dimension) & (F.col("label") == label)).count()
    if n != 1:
        raise ValueError(f"{dimension}/{label} is defined {n} times")
    count = lambda df, name: df.filter(F.col("kind") == "definition").groupBy("dimension").agg(F.count("*").alias(name))
    j = count(before, "n_before").join(count(after, "n_after"), "dimension", "left").withColumn("n_after", F.coalesce("n_after", F.lit(0)))
    return j.withColumn("is_right", F.col("n_before") - F.col("n_after") == F.when(F.col("dimension") == dimension, 1).otherwise(0))


def edit_record(records: DataFrame, record_id: str, column: str, value: str) -> DataFrame:
    """One field of one record replaced. ``row_diff`` of the two versions is exactly that field; no such record is an error."""
    if records.filter(F.col("id") == record_id).limit(2).count() != 1:
        raise ValueError(f"{record_id} is not one record")
    return records.withColumn(column, F.when(F.col("id") == record_id, F.lit(value)).otherwise(F.col(column)))


def buckets() -> Column:
    """The buckets a record is searched in: its kind, its kind and language, its kind and dimension."""
    return F.array_compact(F.array("kind", F.when(F.col("lang").isNotNull(), F.concat_ws(":", "kind", "lang")), F.when(F.col("dimension").isNotNull(), F.concat_ws("/", "kind", "dimension"))))


def kb_version(records: DataFrame, columns: list[str]) -> DataFrame:
    """(version, n): a digest of the content that no order of rows changes, by sums of row digests. NULL is not the empty text."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]), 256)
    part = lambda at: F.conv(F.substring(row, at, 8), 16, 10).cast("decimal(38,0)")
    s = records.agg(*[F.coalesce(F.sum(part(1 + 8 * i)), F.lit(0)).alias(f"s{i}") for i in range(4)], F.count("*").alias("n"))
    return s.select(F.substring(F.sha2(F.concat_ws("|", "s0", "s1", "s2", "s3", "n"), 256), 1, 16).alias("version"), "n")


def feedback_records(items: DataFrame, round_no: int, arm: str, criterion: str) -> DataFrame:
    """KB rows of corrected items, with where they came from."""
    meta = F.to_json(F.struct("gate", "target_groups", "hate_types", "severity", "legal", F.lit(False).alias("illustrative_only"), F.lit(round_no).alias("round"), F.col("id").alias("origin_item_id"), F.lit(criterion).alias("criterion"), F.lit(arm).alias("feedback_arm")), {"ignoreNullFields": "false"})
    return items.select(feedback_id("text").alias("id"), F.lit("feedback").alias("kind"), "lang", "text", "source", meta.alias("meta"))


def labels_of(spark: SparkSession) -> DataFrame:
    return label_table(spark)
