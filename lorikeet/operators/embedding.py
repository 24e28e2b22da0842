"""Hashed bag-of-words vectors, the deterministic stand-in of an embedding model."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIM = 64
_TOKEN = re.compile("[a-z0-9]+")


def _hashed(texts: pd.Series) -> pd.Series:
    bucket: dict[str, int] = {}  # every distinct token of a batch is hashed once

    def one(t: str | None) -> np.ndarray | None:
        if t is None:
            return None
        ids = []
        for w in _TOKEN.findall(t.lower()):
            if w not in bucket:
                bucket[w] = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % DIM
            ids.append(bucket[w])
        return np.bincount(np.array(ids, dtype=np.int64), minlength=DIM).astype(np.float64)

    return texts.map(one)


def hashed_vector(text: Column | str) -> Column:
    """Counts of the ``[a-z0-9]+`` tokens of a lower-cased text by bucket, ``DIM`` of them; null for null."""
    return F.pandas_udf(_hashed, "array<double>")(text)
