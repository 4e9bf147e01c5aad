"""Problem 2: records of an evaluation split that also appear, exactly or almost, on the training side.

Method: minwise hashes of the word sets in banded buckets; only pairs of one evaluation and one training record are
formed; candidates are verified by exact Jaccard similarity; confirmed pairs are counted per subset and source.

Odd input: NULL or blank texts never overlap; rows with the same id count once on either side (the first by order_col,
ties going to the smaller digest of the text's form); records with the same form are one node on their side; an empty
side gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.llm.buckets import meetings, pairs_of
from evalweave.llm.lookalike import ConsistentForm
from evalweave.llm.shingles import one_per_form, sketcher, stored_forms, verified
from evalweave.session import materialise

BANDS, ROWS = 64, 6


def split_overlaps(evaluation: DataFrame, training: DataFrame, form: ConsistentForm | None = None, similarity: float = 0.6, bands: int = BANDS, rows: int = ROWS, seed: int = 23, order_col: str | None = None) -> DataFrame:
    """(item_id, hit_id, similarity) of all confirmed pairs; both inputs have id and text."""
    if form is None:
        form = ConsistentForm.default()  # equality of forms does not depend on the representatives
    nodes, ids = one_per_form(stored_forms([evaluation, training], form, "p2", "id", "text", order_col), "p2")
    met = meetings(nodes, sketcher(bands, rows, 0, seed), 2, 0, "p2")
    links = materialise(verified(pairs_of(met, True), met, nodes, similarity, "p2"), "p2-links")
    out = links.join(ids.filter("side = 0").select(F.col("rid").alias("a"), F.col("id").alias("item_id")), "a")
    out = out.join(ids.filter("side = 1").select(F.col("rid").alias("b"), F.col("id").alias("hit_id")), "b")
    return out.select("item_id", "hit_id", "similarity")


def overlap_report(pairs: DataFrame, items: DataFrame, hits: DataFrame) -> DataFrame:
    """(subset, source, hit_source, n_pairs, n_items, n_hits, n_exact) of confirmed pairs. A NULL label is a value of its own.

    ``items`` has item_id, subset and source, ``hits`` hit_id and hit_source, one row per id.
    """
    named = pairs.join(items, "item_id", "left").join(hits, "hit_id", "left")
    return named.groupBy("subset", "source", "hit_source").agg(
        F.count("*").alias("n_pairs"), F.countDistinct("item_id").alias("n_items"), F.countDistinct("hit_id").alias("n_hits"), F.sum((F.col("similarity") >= 1).cast("long")).alias("n_exact")
    )
