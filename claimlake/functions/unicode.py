"""Functions for which Spark has no built-in, in Arrow batches."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType


@F.arrow_udf(StringType())
def _composed(texts: pa.Array) -> pa.Array:
    """Unicode composition, some rows at a time, so that only these are Python's strings."""
    some = (pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts[a : a + 64].to_pylist()], pa.string()) for a in range(0, len(texts), 64))
    return pa.concat_arrays([pa.array([], pa.string()), *some])


def nfc(text: Column | str) -> Column:
    """Unicode composition; texts of characters below U+0300 alone are composed and do not go to Python."""
    t = F.col(text) if isinstance(text, str) else text
    return F.coalesce(_composed(F.when(t.rlike(r"[^\x{0000}-\x{02FF}]"), t)), t)


def word_distance(a: list[str], b: list[str]) -> int:
    row = np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + np.array([x != y for y in b], int))
        new = np.concatenate([[i], new])
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return int(row[-1])


@F.arrow_udf(LongType())
def word_edit_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """Words to insert, delete or replace; null where a side is null."""
    return pa.array([None if x is None or y is None else word_distance(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int64())
