"""Meeting of records in key buckets, packed for the shuffle.

A record has dozens of 64-bit bucket keys. As rows they would outweigh the text they come from, so they travel packed:
the upper half of a key names its partition, blocks of one partition hold the sorted lower halves (4 bytes a key) and the
record's place in the block's range of record numbers (2 bytes). Both are stored byte plane by byte plane, so the slowly
changing leading bytes compress away. The lower half alone tells keys of one partition apart but for one in 2**32
by the number of keys in the partition; candidates are verified anyway.

A bucket whose pairs would be many is handed on as tiles (between two sides) or as a star and a list of its members
(within one side), never as all its pairs at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.session import materialise

PRINT_WORDS = 4
#: Records whose keys are packed together; a record's place in the block takes two bytes.
FLUSH, REACH = 20_000, 1 << 16
#: Sides of a tile; a bucket of more cross pairs than TILE * TILE is handed on in tiles.
TILE = 64
#: Pairs that are put out at a time.
CHUNK = 1 << 19
_MET = "a long, b long, p0 long, p1 long, p2 long, p3 long, xs array<long>, ys array<long>"
_BLOCK = "part int, side int, base long, n int, body binary, p0 long, p1 long, p2 long, p3 long"
_FIELDS = [x.split()[0] for x in _BLOCK.split(", ")]


def pack(low: np.ndarray, place: np.ndarray) -> bytes:
    """The sorted 4-byte keys and the 2-byte places, plane by plane."""
    return low.astype(">u4").view(np.uint8).reshape(-1, 4).T.tobytes() + place.astype(">u2").view(np.uint8).reshape(-1, 2).T.tobytes()


def unpack(body: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(body, np.uint8).reshape(6, n)
    return np.ascontiguousarray(planes[:4].T).view(">u4").ravel().astype(np.uint32), np.ascontiguousarray(planes[4:].T).view(">u2").ravel().astype(np.int64)


def _blocks(rid: np.ndarray, side: int, keys: np.ndarray, parts: int) -> pa.RecordBatch:
    base = int(rid[0])
    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    joint = ((part << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))).ravel()
    order = np.argsort(joint)
    joint, place = joint[order], np.repeat(rid - base, keys.shape[1])[order]
    at = np.searchsorted(joint, np.arange(parts + 1, dtype=np.uint64) << np.uint64(32))
    some = np.flatnonzero(np.diff(at))
    low = (joint & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    bodies = [pack(low[at[p] : at[p + 1]], place[at[p] : at[p + 1]]) for p in some]
    k, none = len(some), pa.nulls(len(some), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(np.full(k, side), pa.int32()), pa.array(np.full(k, base), pa.int64()), pa.array(np.diff(at)[some], pa.int32()), pa.array(bodies, pa.binary()), none, none, none, none], names=_FIELDS)


def _prints(rid: np.ndarray, prints: np.ndarray, parts: int) -> pa.RecordBatch:
    k = len(rid)
    return pa.RecordBatch.from_arrays([pa.array((rid % parts).astype(np.int32)), pa.array(np.full(k, -1), pa.int32()), pa.array(rid), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), *[pa.array(np.ascontiguousarray(prints[:, i])) for i in range(PRINT_WORDS)]], names=_FIELDS)


def _met(a=None, b=None, prints=None, xs=None, ys=None) -> pa.RecordBatch:
    n = len(a) if a is not None else len(xs)
    lists = pa.list_(pa.int64())
    cols = [pa.array(a) if a is not None else pa.nulls(n, pa.int64()), pa.array(b) if b is not None else pa.nulls(n, pa.int64())]
    cols += prints or [pa.nulls(n, pa.int64())] * PRINT_WORDS
    cols += [pa.array(x, lists) if x is not None else pa.nulls(n, lists) for x in (xs, ys)]
    return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _MET.split(", ")])


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[keep], b[keep]


def cross_pairs(ka: np.ndarray, ra: np.ndarray, kb: np.ndarray, rb: np.ndarray, tile: int = TILE) -> Iterator[tuple]:
    """("pairs", a, b) of records of the two sides that share a key, or ("tiles", [as], [bs]) of crowded keys."""
    oa, ob = np.argsort(ka, kind="stable"), np.argsort(kb, kind="stable")
    ka, ra, kb, rb = ka[oa], ra[oa], kb[ob], rb[ob]
    key, first_b, many_b = np.unique(kb, return_index=True, return_counts=True)
    first_a = np.searchsorted(ka, key, "left")
    many_a = np.searchsorted(ka, key, "right") - first_a
    met = many_a > 0
    first_a, many_a, first_b, many_b = first_a[met], many_a[met], first_b[met], many_b[met]
    product = many_a * many_b
    big = product > tile * tile
    for i in np.flatnonzero(big):
        ys = np.split(rb[first_b[i] : first_b[i] + many_b[i]], range(tile, many_b[i], tile))
        for x in np.split(ra[first_a[i] : first_a[i] + many_a[i]], range(tile, many_a[i], tile)):
            yield "tiles", [x] * len(ys), ys
    first_a, first_b, many_b, product = first_a[~big], first_b[~big], many_b[~big], product[~big]
    ends = np.cumsum(product)
    start = 0
    while start < len(product):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CHUNK, "right")))
        size = product[start:stop]
        k = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        width = np.repeat(many_b[start:stop], size)
        a, b = ra[np.repeat(first_a[start:stop], size) + k // width], rb[np.repeat(first_b[start:stop], size) + k % width]
        yield "pairs", *_distinct(a, b)
        start = stop


def own_pairs(key: np.ndarray, rid: np.ndarray, bucket: int) -> Iterator[tuple]:
    """("pairs", a, b), a < b, of records of one side that share a key; of buckets above ``bucket`` records only those with the
    bucket's first record, and ("tiles", [members], [None]) in pieces, the first record at the head of each."""
    order = np.lexsort((rid, key))
    key, rid = key[order], rid[order]
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (rid[1:] != rid[:-1])
    key, rid = key[keep], rid[keep]
    _, first, many = np.unique(key, return_index=True, return_counts=True)
    for n in np.unique(many[(many > 1) & (many <= bucket)]):
        i, j = np.triu_indices(n, 1)
        at = first[many == n]
        step = max(1, CHUNK // len(i))
        for s in range(0, len(at), step):
            yield "pairs", *_distinct(rid[(at[s : s + step, None] + i).ravel()], rid[(at[s : s + step, None] + j).ravel()])
    for f, n in zip(first[many > bucket], many[many > bucket]):
        yield "pairs", np.full(n - 1, rid[f]), rid[f + 1 : f + n]
        # the key in 32 bits and the first record name the bucket
        yield "tiles", [np.concatenate([rid[f : f + 1], rid[s : min(s + 4096, f + n)]]) for s in range(f, f + n, 4096)], [np.array([key[f]], np.int64)] * len(range(f, f + n, 4096))


def meetings(nodes: DataFrame, keys_of: Callable, sides: int, bucket: int, name: str, parts: int | None = None) -> DataFrame:
    """What meets in the buckets of ``nodes(rid, side, form)``, as a stored table of three kinds of rows.

    (a, b): a candidate pair. (a, p0..p3): the fingerprint of record a. (xs, ys): records of a crowded bucket.
    ``keys_of(forms)`` gives (keys, fingerprints) of a batch of forms. With two sides pairs are formed across them only.
    """
    parts = parts or int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, int, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            for side in sorted({s for _, s, _ in held}):
                mine = [(r, k) for r, s, k in held if s == side]
                rid, keys = np.concatenate([r for r, _ in mine]), np.concatenate([k for _, k in mine])
                block = np.cumsum(np.concatenate([[0], _jumps(rid)]))
                for g in np.unique(block):
                    yield _blocks(rid[block == g], side, keys[block == g], parts)
            held.clear()

        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                rid, side = part.column(0).to_numpy(), part.column(1).to_numpy()
                keys, prints = keys_of(part.column(2).to_pylist())
                yield _prints(rid, prints, parts)
                for s in np.unique(side):
                    held.append((rid[side == s], int(s), keys[side == s]))
                if sum(len(r) for r, _, _ in held) >= FLUSH:
                    yield from flush()
        yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows: list[list[np.ndarray]] = [[] for _ in range(sides)]
        rids: list[list[np.ndarray]] = [[] for _ in range(sides)]
        blocks = {}
        for batch in batches:
            side = batch.column(1).to_numpy()
            sketch = np.flatnonzero(side < 0)
            if len(sketch):
                take = batch.take(pa.array(sketch))
                yield _met(take.column(2).to_numpy(), prints=[take.column(i) for i in range(5, 5 + PRINT_WORDS)])
            for i in np.flatnonzero(side >= 0):
                # a partition may be given blocks of others where their number is set from outside
                low, place = unpack(batch.column(4)[i].as_py(), batch.column(3)[i].as_py())
                blocks.setdefault(batch.column(0)[i].as_py(), []).append((int(side[i]), low, place + batch.column(2)[i].as_py()))
        for mine in blocks.values():
            lows, rids = [[x[1] for x in mine if x[0] == s] for s in range(sides)], [[x[2] for x in mine if x[0] == s] for s in range(sides)]
            join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
            if sides == 2:
                found = cross_pairs(join(lows[0], np.uint32), join(rids[0], np.int64), join(lows[1], np.uint32), join(rids[1], np.int64))
            else:
                found = own_pairs(join(lows[0], np.uint32), join(rids[0], np.int64), bucket)
            held: list[tuple[np.ndarray, np.ndarray]] = []
            for kind, x, y in found:
                if kind == "tiles":
                    yield _met(xs=x, ys=y)
                    continue
                # records much alike meet in many buckets of a partition
                held.append((x, y))
                if sum(len(a) for a, _ in held) >= 2 * CHUNK:
                    held = [_distinct(*(np.concatenate(z) for z in zip(*held)))]
                    if len(held[0][0]) >= CHUNK:
                        yield _met(*held.pop())
            if held:
                yield _met(*_distinct(*(np.concatenate(z) for z in zip(*held))))

    packed = nodes.select("rid", "side", "form").mapInArrow(emit, _BLOCK)
    return materialise(packed.repartitionById(parts, F.col("part")).mapInArrow(meet, _MET), f"{name}-met")


def _jumps(rid: np.ndarray) -> np.ndarray:
    """1 where a new block must begin, as places are counted from the first record of a block."""
    out = np.zeros(max(len(rid) - 1, 0), np.int64)
    base = rid[0] if len(rid) else 0
    i = 0
    while True:
        far = np.flatnonzero((rid[i:] - base >= REACH) | (rid[i:] < base))
        if not len(far):
            return out
        i += int(far[0])
        base = rid[i]
        out[i - 1] = 1


def pairs_of(met: DataFrame, tiled: bool) -> DataFrame:
    """The distinct candidate pairs (a, b), with ``tiled`` those of tiles included."""
    flat = met.filter("b is not null").select("a", "b")
    if not tiled:
        return flat.distinct()
    tiles = met.filter("ys is not null").select("xs", "ys").repartition(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return flat.unionByName(tiles.select(F.explode("xs").alias("a"), "ys").select("a", F.explode("ys").alias("b"))).distinct()
