"""The label space: dimensions, their labels and order, and what follows from it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The five dimensions with their labels in order. A deployment may pass its own table instead.
TAXONOMY: dict[str, tuple[str, ...]] = {
    "target_group": ("race", "religion", "gender", "sexual_orientation", "disability", "national_origin", "other"),
    "hate_type": ("explicit", "incitement", "inferiority", "irony", "stereotyping", "threatening", "grievance"),
    "severity": ("low", "medium", "high"),
    "legal": ("propaganda", "incitement_public_peace", "insult_defamation"),
}
MULTILABEL = ("target_group", "hate_type", "legal")
#: Column of the annotated table for each dimension.
GOLD_COLUMN = {"target_group": "target_groups", "hate_type": "hate_types", "legal": "legal", "severity": "severity", "hate": "gate"}
#: A label with fewer annotated items is reported but left out of macro averages.
MIN_SUPPORT = 10


def label_table(spark: SparkSession, taxonomy: Mapping[str, tuple[str, ...]] = TAXONOMY) -> DataFrame:
    """(dimension, label, pos): small by nature, one row per label."""
    return spark.createDataFrame([(d, x, i) for d, xs in taxonomy.items() for i, x in enumerate(xs)], "dimension string, label string, pos int")


def severity_rank(col: Column | str, taxonomy: Mapping[str, tuple[str, ...]] = TAXONOMY) -> Column:
    """Rank of an ordinal label by its place in the taxonomy, NULL for any other value."""
    c = F.col(col) if isinstance(col, str) else col
    out = F.lit(None).cast("int")
    for i, x in enumerate(taxonomy["severity"]):
        out = F.when(c == x, F.lit(i)).otherwise(out)
    return out


def severity_label(rank: Column, taxonomy: Mapping[str, tuple[str, ...]] = TAXONOMY) -> Column:
    return F.try_element_at(F.array(*[F.lit(x) for x in taxonomy["severity"]]), (rank + 1).cast("int"))


def multi_hot(labels: Column, dimension: str, taxonomy: Mapping[str, tuple[str, ...]] = TAXONOMY) -> Column:
    """Array of 0.0 and 1.0 in taxonomy order; an unknown label is an error, NULL stays NULL."""
    known = F.array(*[F.lit(x) for x in taxonomy[dimension]])
    unknown = F.array_except(labels, known)
    hot = F.transform(known, lambda x: F.array_contains(labels, x).cast("double"))
    return F.when(F.size(unknown) > 0, F.raise_error(F.concat(F.lit("unknown label: "), F.array_join(unknown, ", "))).cast("array<double>")).otherwise(hot)


def original_class(raw: Column | str) -> Column:
    """Majority of the JSON votes, the first seen on ties; NULL where the JSON is torn or has no votes."""
    c = F.col(raw) if isinstance(raw, str) else raw
    votes = F.try_variant_get(F.try_parse_json(c), "$.votes", "array<string>")
    seen = F.filter(F.array_distinct(votes), lambda x: x.isNotNull())
    ranked = F.transform(seen, lambda x, i: F.struct(F.size(F.filter(votes, lambda y: y == x)).alias("n"), (-i).alias("o"), x.alias("v")))
    return F.array_max(ranked)["v"]


def effective_gate(mapping: str, lenient_source: str | None = None, gate: str = "gate", source: str = "source", raw: str = "raw") -> Column:
    """The annotated gate under a reading of "offensive". NULL (never annotated) stays NULL under every reading."""
    if mapping == "strict":
        return F.col(gate)
    offensive = original_class(raw) == "offensive"
    if lenient_source is not None:
        offensive = offensive & (F.col(source) == lenient_source)
    return F.when(F.col(gate).isNull(), F.lit(None).cast("boolean")).when(F.coalesce(offensive, F.lit(False)), F.lit(True)).otherwise(F.col(gate))


def richness(columns: tuple[str, ...] = ("gate", "target_groups", "hate_types", "severity", "legal")) -> Column:
    """How many dimensions are annotated at all: empty lists count, NULLs do not."""
    return sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
