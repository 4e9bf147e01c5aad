"""Text keys, hashes and tokens as Column expressions."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: marks stripped from both ends of a normalised text.
EDGE_MARKS = " .,;:!?\"'`()[]{}<>-–—…*#_~|/\\“”„‘’«»"


def flatten(text: Column | str) -> Column:
    """White space runs become one space; ends are stripped."""
    return F.trim(F.regexp_replace(_c(text), r"[\s   -   　]+", " "))


def dedup_key(text: Column | str) -> Column:
    """Key under which two texts are the same text: flattened and in lower case. One function for all its uses."""
    return F.lower(flatten(text))


def text_hash(text: Column | str) -> Column:
    return F.substring(F.sha2(flatten(text), 256), 1, 16)


def feedback_id(text: Column | str) -> Column:
    return F.concat(F.lit("fb-"), F.substring(F.sha1(flatten(text)), 1, 12))


def tokens(text: Column | str) -> Column:
    """Runs of letters, digits and underscore of any script, in lower case."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0))


_ASCII_WORD = np.array([c < 128 and (chr(c).isalnum() or c == 95) for c in range(256)])


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The ``tokens`` of texts in lower case, none of them null, one after the other, and how many each has.

    By byte for a batch at once; which characters are letters, marks and digits is Python's Unicode, newer than the JVM's.
    """
    texts = texts.cast(pa.string())
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset) if len(texts) else np.zeros(1, np.int32)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    inside = _ASCII_WORD[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        b = data[lead]
        size = 2 + (b >= 0xE0) + (b >= 0xF0)
        code = (b & (0x7F >> size)).astype(np.int32)
        for k in (1, 2, 3):
            more = size > k
            code[more] = code[more] << 6 | data[lead[more] + k] & 0x3F
        known, at = np.unique(code, return_inverse=True)
        ok = np.array([unicodedata.category(chr(c))[0] in "LMN" for c in known.tolist()])[at]
        for k in range(4):
            inside[lead[ok & (size > k)] + k] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    starts = (offsets[:-1] - offsets[0])[np.diff(offsets) > 0]
    begins[starts] = inside[starts]  # also where the text before ends in a word
    # words one after the other, without what is between them
    first = np.flatnonzero(begins[inside])
    words = pa.StringArray.from_buffers(len(first), pa.py_buffer(np.append(first, np.count_nonzero(inside)).astype(np.int32)), pa.py_buffer(data[inside]))
    return words, np.diff(np.searchsorted(np.flatnonzero(begins), offsets - offsets[0]))


def normalise(text: str | None) -> str | None:
    if text is None:
        return None
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split()).strip(EDGE_MARKS)


@F.pandas_udf(T.StringType())
def norm_text(text: pd.Series) -> pd.Series:
    """NFKC, case folded, flattened, edge marks stripped: Spark has no built-in for the first two."""
    return text.map(normalise, na_action="ignore")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x
