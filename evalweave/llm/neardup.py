"""Problem 1: groups of records that repeat each other with small edits, insertions or changed order.

Method: multi-index hashing. The fingerprint of a record is its minwise signature over words, ``segments`` segments of
``width`` symbols. Around every segment the Hamming ball of ``radius`` symbols is enumerated; records that meet in a
ball are candidates. Their complete distance is verified on the fingerprint and then exactly on the word sets, and the
links are closed into classes.

Of a crowded bucket the first record is compared with all others. Members that are then still of another class than most
of the bucket are compared with all its members, tile by tile over many tasks: every pair of a bucket is either compared
or already of one class.

Odd input: NULL or blank texts and texts without words have no class row; rows with the same id count once (the first by
order_col, ties going to the smaller digest of the text's form); records with the same form are one node, so groups of
exact copies of any size cost one node; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.llm.buckets import PRINT_WORDS, meetings, pairs_of
from evalweave.llm.graph import components
from evalweave.llm.lookalike import ConsistentForm
from evalweave.llm.shingles import far_bits, few_rows, one_per_form, sketcher, stored_forms, verified, word_hashes
from evalweave.session import materialise

SEGMENTS, WIDTH, RADIUS = 18, 7, 1
#: Buckets up to this size are paired within at once.
BUCKET = 48
#: Records on the two sides of a tile.
OUTSIDERS, MEMBERS = 256, 2048
_PRINTS = [f"p{i}" for i in range(PRINT_WORDS)]


def _rest_links(met: DataFrame, nodes: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """Links within crowded buckets between records that are not of one class yet: exact, tile by tile."""
    bucket = met.filter("ys is not null").select(F.xxhash64(F.col("ys")[0], F.col("xs")[0]).alias("key"), F.explode("xs").alias("rid")).distinct()
    member = bucket.join(roots.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    member = materialise(member, "p1-members")
    # the root that most members of a bucket have, by counts
    main = member.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all"))
    main = main.filter("top.n < all").select("key", F.col("top.root").alias("main"), "all", (F.col("all") - F.col("top.n")).alias("out"))
    kept = materialise(member.join(main, "key"), "p1-open")
    if not kept.limit(1).count():
        return met.filter("false").select("a", "b")
    words = nodes.select("rid", "form").join(few_rows(kept.select("rid").distinct()), "rid", "left_semi").select("rid", word_hashes(F.col("form")).alias("words"))
    kept = kept.join(met.filter("p0 is not null").select(F.col("a").alias("rid"), *_PRINTS), "rid").join(words, "rid")
    row = F.struct("rid", "root", *_PRINTS, "words")

    def pieces(df: DataFrame, size: int, total: str, name: str) -> DataFrame:
        df = df.withColumn("piece", F.pmod(F.xxhash64("rid"), F.ceil(F.col(total) / size)))
        return df.groupBy("key", "piece").agg(F.collect_list(row).alias(name)).drop("piece")

    tiles = pieces(kept.filter("root <> main"), OUTSIDERS, "out", "outs").join(pieces(kept, MEMBERS, "all", "members"), "key")
    bits = far_bits(64 * PRINT_WORDS, similarity)

    def links(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            found: list[tuple[int, int]] = []
            for outs, members in zip(pdf["outs"], pdf["members"]):
                mp = np.array([[m[p] for p in _PRINTS] for m in members], np.int64).view(np.uint64)
                roots, sets = np.array([m["root"] for m in members]), [None] * len(members)
                for o in outs:
                    far = np.bitwise_count(mp ^ np.array([o[p] for p in _PRINTS], np.int64).view(np.uint64)).sum(axis=1)
                    own, met_roots = frozenset(o["words"]), {o["root"]}
                    for i in np.flatnonzero((far <= bits) & (roots != o["root"])):
                        if roots[i] in met_roots:
                            continue
                        sets[i] = sets[i] or frozenset(members[i]["words"])
                        shared = len(own & sets[i])
                        if shared * 1000 >= (len(own) + len(sets[i]) - shared) * round(similarity * 1000):
                            met_roots.add(roots[i])
                            found.append((o["rid"], members[i]["rid"]))
            yield pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return tiles.repartition(int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInPandas(links, "a long, b long")


def near_duplicate_classes(records: DataFrame, form: ConsistentForm | None = None, similarity: float = 0.6, id_col: str = "id", text_col: str = "text", order_col: str | None = None, segments: int = SEGMENTS, width: int = WIDTH, radius: int = RADIUS, bucket: int = BUCKET, seed: int = 11) -> DataFrame:
    """(id, class_id, class_size): one row per record with words; class_id is the smallest id of the class."""
    if form is None:
        form = ConsistentForm.default()  # equality of forms does not depend on the representatives
    nodes, ids = one_per_form(stored_forms([records], form, "p1", id_col, text_col, order_col), "p1")
    met = meetings(nodes, sketcher(segments, width, radius, seed), 1, bucket, "p1")
    links = materialise(verified(pairs_of(met, False), met, nodes, similarity, "p1").select("a", "b"), "p1-links")
    roots = components(links)
    if met.filter("ys is not null").limit(1).count():
        roots = materialise(roots, "p1-roots")
        more = materialise(_rest_links(met, nodes, roots, similarity), "p1-more")
        if more.limit(1).count():
            # the classes found so far are stars already
            roots = components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(more))
    rooted = ids.join(roots.withColumnRenamed("node", "rid"), "rid", "left").select("id", F.coalesce("root", "rid").alias("root"))
    rooted = materialise(rooted, "p1-rooted")
    names = rooted.groupBy("root").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))
    return rooted.join(names, "root").select("id", "class_id", "class_size")


def class_pairs(classes: DataFrame, salt_rows: int = 512) -> DataFrame:
    """(id_a, id_b): all pairs within a class, smaller id first. Large classes are salted over many tasks."""
    many = classes.filter("class_size > 1").withColumn("salts", F.ceil(F.col("class_size") / salt_rows).cast("int"))
    a = many.select("class_id", F.col("id").alias("id_a"), F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"))
    b = many.select("class_id", F.col("id").alias("id_b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return a.join(b, ["class_id", "salt"]).filter("id_a < id_b").select("id_a", "id_b")
