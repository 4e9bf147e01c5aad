"""Problem 7: items of varying length into containers of fixed capacity.

Method: Karmarkar-Karp multiway differencing. Every item begins as a partial partition into k windows with one of them
filled; the two partial partitions of widest spread are merged with opposing order, the fullest window of one onto the
emptiest of the other, until one is left: k near-equal windows. Items of windows above capacity are lifted out and put
where they fit, if need be in place of smaller ones; what is left over raises the number of windows.

Differencing needs its items together, so items are dealt by hash into groups of about ``windows`` windows and at most
GROUP_ITEMS items; windows left with unused space are opened again and repacked with those of other groups, in rounds
over ever fewer items. No group grows with the data.

Odd input: NULL, negative or zero sizes are items of size 0, which take no space; only an item larger than the capacity
is split, into full containers and a rest; NULL or non-positive capacities have no rows; ties go by id; repeated ids
count once; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.session import materialise

WINDOWS = 192
ROUNDS = 5
REOPEN = 0.995
#: Items of a group, also where many are short or empty; groups of a partition.
GROUP_ITEMS, PART_GROUPS = 20_000, 64


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window (0 to k-1) of each item by largest differencing; near-equal window sums."""
    n = len(sizes)
    nxt, order = np.full(n, -1, np.int64), np.argsort(-sizes, kind="stable")
    heap: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []
    for c, i in enumerate(order):
        # windows from full to empty; only filled ones are stored, the other k - len are empty
        one = np.array([i], np.int64)
        heap.append((-int(sizes[i]), c, np.array([sizes[i]], np.int64), one, one))
    heapq.heapify(heap)
    c = n
    while len(heap) > 1:
        _, _, sa, ha, ta = heapq.heappop(heap)
        _, _, sb, hb, tb = heapq.heappop(heap)
        la, lb = len(sa), len(sb)
        both = max(0, la + lb - k)  # windows filled in both: a's emptiest meet b's fullest in opposing order
        s = np.concatenate([sa[: la - both], sb[: lb - both], sa[la - both :] + sb[::-1][:both]])
        h = np.concatenate([ha[: la - both], hb[: lb - both], ha[la - both :]])
        t = np.concatenate([ta[: la - both], tb[: lb - both], tb[::-1][:both]])
        if both:
            nxt[ta[la - both :]] = hb[::-1][:both]
        o = np.argsort(-s, kind="stable")
        s, h, t = s[o], h[o], t[o]
        low = int(s[-1]) if len(s) == k else 0
        if low:
            s = s - low  # only differences matter; sums are taken again at the end
            keep = len(s)
            s = s[:keep]
        heapq.heappush(heap, (-(int(s[0]) - (int(s[-1]) if len(s) == k else 0)), c, s, h, t))
        c += 1
    window = np.empty(n, np.int64)
    for w, first in enumerate(heap[0][3] if heap else ()):
        i = int(first)
        while i >= 0:
            window[i] = w
            i = int(nxt[i])
    return window


def pack_group(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each item (none larger than ``capacity``); no window is above capacity.

    Differencing fills as many windows as the items could fill without a gap. What is lifted out of windows above
    capacity goes where it fits closest; an item that fits nowhere takes the place of a smaller one, which then is the
    one to be placed, and so on. What is left in the end is packed into further windows the same way.
    """
    window = np.full(len(sizes), -1, np.int64)
    todo, first = np.arange(len(sizes)), 0
    while len(todo):
        own = sizes[todo]
        k = max(1, int(own.sum()) // capacity)
        w, left = _fill(own, k, capacity)
        window[todo] = np.where(left, -1, w + first)
        todo, first = todo[left], first + k
    return window


def _fill(sizes: np.ndarray, k: int, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, whether left out) of each item in ``k`` windows of ``capacity``."""
    window = differencing(sizes, k)
    free = capacity - np.bincount(window, weights=sizes, minlength=k).astype(np.int64)
    loose: list[int] = []
    for w in np.flatnonzero(free < 0):
        inside = sorted(np.flatnonzero(window == w), key=lambda i: (sizes[i], i))
        while free[w] < 0:
            # the smallest item that brings the window to capacity at once, else the largest
            i = next((i for i in inside if sizes[i] >= -free[w]), inside[-1])
            inside.remove(i)
            free[w] += sizes[i]
            loose.append(i)
    left = np.zeros(len(sizes), bool)
    left[loose] = True
    window[left] = 0
    for i in sorted(loose, key=lambda i: (-sizes[i], i)):
        while True:
            rest = free - sizes[i]
            w = int(np.where(rest >= 0, rest, capacity + 1).argmin())
            if rest[w] >= 0:
                window[i], left[i] = w, False
                free[w] = rest[w]
                break
            # what would stay free if it took the place of a smaller item; the smallest such item, then the closest fit
            rest = free[window] + sizes - sizes[i]
            able = np.flatnonzero((rest >= 0) & (sizes < sizes[i]) & ~left)
            if not len(able):
                break
            j = able[np.lexsort((rest[able], sizes[able]))[0]]
            w = window[j]
            window[i], left[i], left[j] = w, False, True
            free[w] = rest[j]
            i = j
    return window, left


def _deal(pieces: DataFrame, windows: int, salt: int) -> DataFrame:
    """``pieces`` with their group, each group's rows in one partition; partitions grow in number with the groups."""
    total = pieces.groupBy("limit_key", "capacity").agg(F.sum("size").alias("total"), F.count("*").alias("n"))
    total = total.select("limit_key", F.greatest(F.lit(1), F.ceil(F.col("total") / (F.col("capacity") * windows)), F.ceil(F.col("n") / GROUP_ITEMS)).cast("long").alias("groups"))
    groups = {r[0]: r[1] for r in total.collect()}  # a row per capacity, of which there are 10,000 at most
    pick = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])[F.col("limit_key")] if groups else F.lit(1)
    # a fixed number of partitions: groups cost far more time than bytes, so they are not merged into few tasks by size
    parts = max(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sum(groups.values()) // PART_GROUPS))
    return pieces.withColumn("grp", F.pmod(F.xxhash64("item", "piece", F.lit(salt)), pick)).repartition(parts, "limit_key", "grp")


def _group_packer(run_id: str):
    def windows_of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["item", "piece"], kind="stable").reset_index(drop=True)
        capacity = int(pdf["capacity"].iloc[0])
        sizes = pdf["size"].to_numpy(np.int64)
        some = np.flatnonzero(sizes > 0)
        window = np.zeros(len(pdf), np.int64)
        if len(some):
            window[some] = pack_group(sizes[some], capacity)
        fill = np.bincount(window, weights=sizes) / capacity
        name = f"{pdf['limit_key'].iloc[0]}-{run_id}-{int(pdf['grp'].iloc[0])}-"
        return pdf.assign(window_id=[f"{name}{w}" for w in window], fill=fill[window])[["limit_key", "capacity", "window_id", "item", "piece", "start", "size", "fill"]]

    return windows_of


def pack(items: DataFrame, limits: DataFrame, windows: int = WINDOWS, rounds: int = ROUNDS, reopen: float = REOPEN) -> DataFrame:
    """(limit_key, capacity, window_id, item, piece, start, size): every piece of ``items(item, size)`` with its container.

    ``limits`` (limit_key, capacity) is a small table of settings: it is read to the driver (10,000 rows at most).
    """
    caps = [(r[0], r[1]) for r in limits.filter("limit_key is not null and capacity > 0").groupBy("limit_key").agg(F.max("capacity")).limit(10_001).collect()]
    if len(caps) > 10_000:
        raise ValueError("more than 10,000 capacities")
    spark = items.sparkSession
    small = spark.createDataFrame([(k, int(c)) for k, c in caps], "limit_key string, capacity long")
    kind = items.schema["item"].dataType.simpleString()
    once = items.filter("item is not null").groupBy("item").agg(F.greatest(F.coalesce(F.max("size"), F.lit(0)), F.lit(0)).cast("long").alias("size"))
    each = once.withColumn("limit", F.explode(F.array(*[F.struct(F.lit(k).alias("limit_key"), F.lit(int(c)).cast("long").alias("capacity")) for k, c in caps]))) if caps else once.crossJoin(small.limit(0)).select("item", "size", F.struct("limit_key", "capacity").alias("limit"))
    each = each.select("limit.limit_key", "limit.capacity", "item", "size")
    each = each.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("size") / F.col("capacity")).cast("int") - 1))))
    each = each.withColumn("start", F.col("piece") * F.col("capacity")).withColumn("size", F.least("capacity", F.col("size") - F.col("start")))
    pieces = materialise(each, "p7-pieces")
    schema = f"limit_key string, capacity long, window_id string, item {kind}, piece int, start long, size long, fill double"
    done, todo = None, pieces
    for r in range(rounds):
        run_id = uuid.uuid5(uuid.NAMESPACE_OID, f"round {r}").hex[:4]
        dealt = _deal(todo, windows, r)
        packed = materialise(dealt.select("limit_key", "capacity", "grp", "item", "piece", "start", "size").groupBy("limit_key", "grp").applyInPandas(_group_packer(run_id), schema), f"p7-round{r}")
        last = r == rounds - 1
        keep = packed if last else packed.filter(F.col("fill") >= reopen)
        done = keep if done is None else done.unionByName(keep)
        todo = packed.filter(F.col("fill") < reopen)
    return done.select("limit_key", "capacity", "window_id", "item", "piece", "start", "size")


def packing_report(packed: DataFrame) -> DataFrame:
    """(limit_key, capacity, n_pieces, n_windows, tokens, unused, fill, least_windows) per capacity."""
    by = packed.groupBy("limit_key", "capacity").agg(F.count("*").alias("n_pieces"), F.countDistinct("window_id").alias("n_windows"), F.sum("size").alias("tokens"))
    room = F.col("n_windows") * F.col("capacity")
    return by.select("*", (room - F.col("tokens")).alias("unused"), (F.col("tokens") / room).alias("fill"), F.ceil(F.col("tokens") / F.col("capacity")).alias("least_windows"))
