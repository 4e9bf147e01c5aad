"""Problem 6: token ids of every text by a public tokenizer.

Method: tiktoken with a local rank file; long texts are cut at boundaries where the pre-splitting pattern always ends a
piece; decoding goes through raw bytes. The file (under 1 MB) is read on the driver and sent with the job, so executors
need no copy of it.

Odd input: NULL and empty texts give an empty list; strings that look like special tokens are ordinary text; a text of
any length is encoded whole.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the public tokenizers' files are; a parameter, as they are no part of this repository.
FOLDER = os.environ.get("EVALWEAVE_TOKENIZERS", "/opt/tokenizers")
NAME = "byte_bpe_50k"
# Fixed value: the published pre-splitting pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer texts are encoded in parts. A part ends before white space that follows a visible character: no piece of the
#: pattern spans that place, so the ids are those of the whole text.
PART_CHARS = 1 << 16
_SAFE = re.compile(r"(?<=\S)(?=\s)")


def rank_bytes(folder: str = FOLDER, name: str = NAME) -> bytes:
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def encoding(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """``text`` cut at safe boundaries into parts of ``size`` characters or more (fewer only at its end)."""
    start = 0
    while len(text) - start > size:
        m = _SAFE.search(text, start + size)
        if not m:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def encode(text: str | None, ranks: bytes) -> list[int]:
    if not text:
        return []
    enc = encoding(ranks)
    if len(text) <= PART_CHARS:
        return enc.encode_ordinary(text)
    return [i for p in parts(text) for i in enc.encode_ordinary(p)]


def decode(ids: list[int], ranks: bytes) -> str:
    """The text of ``ids``: their bytes are joined before decoding, as one character may span tokens."""
    return encoding(ranks).decode_bytes(list(ids)).decode("utf-8")


def token_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """(id_col, ids array<int>) for every row."""
    return _mapped(docs, id_col, text_col, folder, name, "ids array<int>", lambda lists: pa.array([np.asarray(x, np.int32) for x in lists], pa.list_(pa.int32())))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """(id_col, n_tokens int) for every row; ids do not leave the Python worker."""
    return _mapped(docs, id_col, text_col, folder, name, "n_tokens int", lambda lists: pa.array([len(x) for x in lists], pa.int32()))


def _mapped(docs: DataFrame, id_col: str, text_col: str, folder: str, name: str, field: str, build) -> DataFrame:
    ranks = SparkSession.getActiveSession().sparkContext.broadcast(rank_bytes(folder, name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                lists = [encode(t, ranks.value) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), build(lists)], names=[id_col, field.split()[0]])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, {field}")
