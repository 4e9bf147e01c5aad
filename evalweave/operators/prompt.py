"""Prompts as data: label space, rendered annotations, messages."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions.text import flatten
from evalweave.operators.labels import TAXONOMY


def label_space(taxonomy: Mapping[str, tuple[str, ...]] = TAXONOMY) -> str:
    """One line a dimension, in order; a driver string of a few hundred characters."""
    lines = ["- hate: true or false"]
    for dim, labels in taxonomy.items():
        lines.append(f"- {dim}: {'one of' if dim == 'severity' else 'any of'} {', '.join(labels)}")
    return "\n".join(lines)


def render_gold(gate: str = "gate") -> Column:
    """An example's annotation in words: only what was annotated, an empty list as none."""
    lists = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{n}: "), F.when(F.size(c) == 0, F.lit("none")).otherwise(F.array_join(c, ", ")))) for n, c in (("target_group", "target_groups"), ("hate_type", "hate_types"), ("legal", "legal"))]
    return F.concat_ws("; ", F.when(F.col(gate).isNotNull(), F.concat(F.lit("hate: "), F.col(gate).cast("string"))), lists[0], lists[1], F.when(F.col("severity").isNotNull(), F.concat(F.lit("severity: "), F.col("severity"))), lists[2])


def build_prompts(items: DataFrame, context: DataFrame, system: str, heads: Mapping[str, str]) -> DataFrame:
    """(item_id, messages): the two messages of each item.

    ``context(item_id, bucket, pos, line)`` is grouped into sections in the order of ``heads``; an empty section is left
    out, head and all; an item without context has only its text.
    """
    order = {b: i for i, b in enumerate(heads)}
    place = F.create_map(*[x for b, i in order.items() for x in (F.lit(b), F.lit(i))])
    head = F.create_map(*[x for b, h in heads.items() for x in (F.lit(b), F.lit(h))])
    sections = context.filter(F.col("bucket").isin(*heads)).groupBy("item_id", "bucket").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: F.concat(F.lit("- "), x["line"])), "\n").alias("body"))
    sections = sections.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place[F.col("bucket")].alias("o"), F.concat(head[F.col("bucket")], F.lit("\n"), F.col("body")).alias("s")))), lambda x: x["s"]), "\n\n").alias("known"))
    j = items.select(F.col("id").alias("item_id"), flatten("text").alias("text")).join(sections, "item_id", "left")
    user = F.concat_ws("\n\n", "known", F.concat(F.lit("Text: "), F.col("text")))
    return j.select("item_id", F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("text")), F.struct(F.lit("user").alias("role"), user.alias("text"))).alias("messages"))


def split_groups(hits: Column) -> Column:
    """Regular and illustrative examples apart, empty groups left out."""
    groups = F.array(F.struct(F.lit("regular").alias("name"), F.filter(hits, lambda h: ~F.coalesce(h["illustrative"], F.lit(False))).alias("hits")), F.struct(F.lit("illustrative").alias("name"), F.filter(hits, lambda h: F.coalesce(h["illustrative"], F.lit(False))).alias("hits")))
    return F.filter(groups, lambda g: F.size(g["hits"]) > 0)


def sections_of_template(text: str) -> dict[str, str]:
    """Name -> body of a template whose parts begin with a line ``=== NAME ===``."""
    out: dict[str, str] = {}
    name = None
    for line in text.splitlines():
        if line.startswith("=== ") and line.endswith(" ===") and line[4:-4].isidentifier():
            name = line[4:-4]
            out[name] = ""
        elif name is not None:
            out[name] += line + "\n"
    return {k: v.strip("\n") for k, v in out.items()}
