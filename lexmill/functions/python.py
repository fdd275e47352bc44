"""The few functions Spark has no built-in for, batched through Arrow."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else html.unescape(t))


def nfc(c: Column) -> Column:
    """Unicode NFC; null as empty. Only texts with characters from U+0300 on, which alone can change, go through Python."""
    return F.coalesce(_nfc(F.when(c.rlike(r"[^\x00-\x{2ff}]"), c)), c, F.lit(""))


def unescape(c: Column, some: Column | None = None) -> Column:
    """All HTML entities, named and numeric. Only texts with an ampersand go through Python; `some` tells them if c is costly."""
    some = c.contains("&") if some is None else some
    return F.when(some, _unescape(F.when(some, c))).otherwise(c)
