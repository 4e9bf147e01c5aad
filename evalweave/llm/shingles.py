"""Word sets, minwise signatures and exact set similarity, shared by the operators on similar records."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.llm.buckets import PRINT_WORDS
from evalweave.llm.lookalike import ConsistentForm, _broadcast, _rewriter
from evalweave.session import materialise

_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: An odd multiplier and its inverse modulo 2**64, for word hashes as differences of running sums.
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_HAS_WORD = re.compile(r"[^\W_]").search
#: Up to so many record numbers (8 bytes each) are sent to all executors; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Forms that one task remembers, so that copies it meets again are not stored again.
REMEMBERED = 500_000


def mix(x: np.ndarray) -> np.ndarray:
    """A public 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def word_hashes(form: Column) -> Column:
    """Sorted distinct 64-bit hashes of the words (runs of letters or digits) of ``form``, which is in lower case."""
    words = F.regexp_extract_all(form, F.lit("[\\p{L}\\p{N}]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter or digit."""
    out = np.zeros(0x110000, bool)
    for first in (0, 0xE000):  # no surrogates
        last = 0xD800 if not first else 0x110000
        for m in re.finditer(r"[^\W_]+", "".join(map(chr, range(first, last)))):
            out[first + m.start() : first + m.end()] = True
    return out


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_STEP, _BACK)):
            _powers[i] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n + n // 4, base, np.uint64)]), dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(points: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans of code points from first to before last.

    A hash is the span's polynomial in the multiplier: a difference of running sums, shifted back to the span's start.
    """
    up, down = _power(len(points) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)])
    return mix((sums[last] - sums[first]) * down[first])


def code_points(texts: list[str]) -> np.ndarray:
    """The code points of the texts, joined by line ends."""
    return np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def flat_words(forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, where each form's words start). Every form has a word; words may repeat."""
    points = code_points(forms)
    inside = np.concatenate([[False], _letters()[points], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edges[::2], edges[1::2]
    hashes = span_hashes(points, first, last)
    begin = np.cumsum([0, *[len(f) + 1 for f in forms[:-1]]])
    return hashes, np.searchsorted(first, begin)


def signatures(hashes: np.ndarray, starts: np.ndarray, n: int, seed: int) -> np.ndarray:
    """(documents, n) minwise values of word hashes; ``starts`` has where each document's words begin, none being empty."""
    # multiply-shift over hashes that are mixed already; 32 bits halve the memory traffic of the innermost loop
    mult = np.random.default_rng(seed).integers(1, 1 << 32, n, dtype=np.uint32) | np.uint32(1)
    base, out = (hashes >> np.uint64(32)).astype(np.uint32), np.empty((len(starts), n), np.uint32)
    x = np.empty_like(base)
    for j in range(n):
        np.multiply(base, mult[j], out=x)
        out[:, j] = np.minimum.reduceat(x, starts)
    return out.astype(np.uint64)


def ball_keys(sig: np.ndarray, segments: int, width: int, radius: int) -> np.ndarray:
    """Keys of the Hamming ball around each segment of a signature.

    A segment is ``width`` symbols; two segments that differ in at most ``radius`` (0 or 1) symbols share a key: of
    radius 1 the ball is enumerated by leaving out each symbol in turn.
    """
    places = mix(np.arange(1, segments * width + 1, dtype=np.uint64))
    cells = mix(sig[:, : segments * width] ^ places).reshape(len(sig), segments, width)
    total = cells.sum(axis=2, dtype=np.uint64)
    salt = mix(np.arange(1, segments * (width + 1) + 1, dtype=np.uint64) + np.uint64(1 << 40)).reshape(segments, width + 1)
    if radius == 0:
        return mix(total + salt[:, 0])
    return mix(total[:, :, None] - cells + salt[None, :, 1:]).reshape(len(sig), segments * width)


def bit_print(sig: np.ndarray) -> np.ndarray:
    """One bit of each of the first 256 symbols, as four words: two prints differ in about (1 - similarity) / 2 of their bits."""
    bits = (mix(sig[:, : 64 * PRINT_WORDS]) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.int64)


def sketcher(segments: int, width: int, radius: int, seed: int):
    """forms -> (bucket keys, fingerprints)."""

    def run(forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sig = signatures(*flat_words(forms), max(segments * width, 64 * PRINT_WORDS), seed)
        return ball_keys(sig, segments, width, radius), bit_print(sig)

    return run


def stored_forms(sides: list[DataFrame], form: ConsistentForm, name: str, id_col: str, text_col: str, order_col: str | None) -> DataFrame:
    """(side, id, ord, h, rid, form) of every row whose text has a word, as a stored table.

    ``h`` is a 128-bit digest of the form, ``rid`` a number of the row. Where a task meets a form again, rid is that of
    the first and form is NULL, so copies are stored once a task.
    """
    named = [df.select(F.lit(i).cast("int").alias("side"), F.col(id_col).alias("id"), (F.col(order_col) if order_col else F.lit(0)).alias("ord"), F.col(text_col).alias("text")) for i, df in enumerate(sides)]
    rows = named[0]
    for df in named[1:]:
        rows = rows.unionByName(df)
    rows = rows.filter("id is not null and text is not null")
    shared = _broadcast(form.pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite, seen, n = _rewriter(shared.value), {}, TaskContext.get().partitionId() << 33
        for batch in batches:
            keep, h, rid, new = [], [], [], []
            for i, (side, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist())):
                f = rewrite(text).lower()
                if _HAS_WORD(f):
                    d = xxhash.xxh3_128_digest(f.encode("utf-8", "surrogatepass"))
                    keep.append(i)
                    h.append(d)
                    first = seen.get((side, d))
                    if first is None:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        first = seen[side, d] = n
                        n += 1
                        new.append(f)
                    else:
                        new.append(None)
                    rid.append(first)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(take) for i in range(3)], pa.array(h, pa.binary()), pa.array(rid, pa.int64()), pa.array(new, pa.string())], names=["side", "id", "ord", "h", "rid", "form"])

    kinds = dict(rows.dtypes)
    return materialise(rows.mapInArrow(run, f"side int, id {kinds['id']}, ord {kinds['ord']}, h binary, rid long, form string"), f"{name}-rows")


def one_per_form(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(rid, side, form) of each distinct form of a side, and (side, id, rid): the form of each id, its first row by ord counting.

    Only digests are shuffled. Rows whose form another task stored too are taken out by their numbers.
    """
    known = rows.filter("form is not null").select("side", "h", "rid")
    reps = known.groupBy("side", "h").agg(F.min("rid").alias("rep"), F.count("*").alias("n"))
    again = materialise(known.join(reps.filter("n > 1"), ["side", "h"]).filter("rid <> rep").select("rid"), f"{name}-again")
    nodes = rows.filter("form is not null").select("rid", "side", "form").join(few_rows(again), "rid", "left_anti")
    first = rows.groupBy("side", "id").agg(F.min(F.struct("ord", "h")).alias("r")).select("side", "id", F.col("r.h").alias("h"))
    return nodes, first.join(reps.select("side", "h", F.col("rep").alias("rid")), ["side", "h"]).select("side", "id", "rid")


def few_rows(ids: DataFrame) -> DataFrame:
    """Marked for broadcast if few enough, which is counted first."""
    return F.broadcast(ids) if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids


def far_bits(symbols: int, similarity: float, sigmas: float = 5.0) -> int:
    """Bits that two prints of sets at ``similarity`` differ in at most, but for a chance of under one in a million."""
    p = (1 - similarity) / 2
    return int(symbols * p + sigmas * (symbols * p * (1 - p)) ** 0.5) + 1


def print_distance(left: str, right: str) -> Column:
    """Bits in which the fingerprints ``{left}0..`` and ``{right}0..`` differ."""
    out = F.lit(0)
    for i in range(PRINT_WORDS):
        out = out + F.bit_count(F.col(f"{left}{i}").bitwiseXOR(F.col(f"{right}{i}")))
    return out


def verified(pairs: DataFrame, met: DataFrame, nodes: DataFrame, similarity: float, name: str) -> DataFrame:
    """(a, b, similarity) of the distinct ``pairs(a, b)`` whose word sets have Jaccard similarity of ``similarity`` at least.

    First the complete distance of the fingerprints (32 bytes a side), then the exact similarity of what remains.
    """
    prints = met.filter("p0 is not null")
    for end in ("a", "b"):
        # one fingerprint a record, spread evenly: each task hashes its share of them, and the pairs need no sorting
        pairs = pairs.join(prints.select(F.col("a").alias(end), *[F.col(f"p{i}").alias(f"{end}p{i}") for i in range(PRINT_WORDS)]).hint("shuffle_hash"), end)
    near = materialise(pairs.filter(print_distance("ap", "bp") <= far_bits(64 * PRINT_WORDS, similarity)).select("a", "b"), f"{name}-near")
    wanted = near.select(F.col("a").alias("rid")).unionByName(near.select(F.col("b").alias("rid"))).distinct()
    words = nodes.select("rid", "form").join(few_rows(wanted), "rid", "left_semi").select("rid", word_hashes(F.col("form")).alias("w"))
    both = near.join(words.select(F.col("rid").alias("a"), F.col("w").alias("wa")), "a").join(words.select(F.col("rid").alias("b"), F.col("w").alias("wb")), "b")
    both = both.withColumn("shared", F.size(F.array_intersect("wa", "wb"))).withColumn("either", F.size("wa") + F.size("wb") - F.col("shared"))
    # 0.6 is compared in whole numbers, as the quotient of two ints at the border may round either way
    parts = round(similarity * 1000)
    return both.filter(F.col("shared") * 1000 >= F.col("either") * parts).select("a", "b", (F.col("shared") / F.col("either")).alias("similarity"))
