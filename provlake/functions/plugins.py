"""Boundaries to models: embedding by hashing, judges and generators by table. Deterministic and offline."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .text import search_tokens

DIM = 64


@F.pandas_udf(ArrayType(FloatType()))
def _fold(slots: pd.Series) -> pd.Series:
    def one(x):
        if x is None or not len(x):
            return None
        v = np.bincount(np.asarray(x), minlength=DIM).astype(np.float64)
        return (v / np.sqrt((v * v).sum())).astype(np.float32)

    return slots.map(one)


def hashed_embedding(text: F.Column) -> F.Column:
    """Term frequencies hashed to DIM slots, of unit length; null without tokens."""
    return _fold(F.transform(search_tokens(text), lambda t: F.conv(F.substring(F.md5(t), 1, 4), 16, 10).cast("int") % DIM))


def from_table(rows: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """What a model said, looked up by keys; null where it said nothing, which takes the default path."""
    return rows.join(answers, keys, "left")


def only_where(rows: DataFrame, needs: F.Column, ask) -> DataFrame:
    """ask(rows that need it) and the other rows with null answers: a model never sees rows that rules decide."""
    asked = ask(rows.filter(needs))
    return asked.unionByName(rows.filter(~F.coalesce(needs, F.lit(False))), allowMissingColumns=True)
