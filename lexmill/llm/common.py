"""What the operators share: words, batches of texts, hashes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

WORD = re.compile(r"[^\W_]+")
#: Characters of text handled at once; bounds a Python worker's memory whatever the batch size.
CHARS = 1_000_000


_ASCII = {c: " " for c in range(128) if not chr(c).isalnum()}


def words_of(text: str) -> list[str]:
    """Maximal runs of letters and digits of the lower-cased text."""
    if text.isascii():  # the same, several times faster
        return text.lower().translate(_ASCII).split()
    return WORD.findall(text.lower())


def text_batches(batches, *columns: str) -> Iterator[list[list]]:
    """Lists of the columns' values, the last one being text; cut so that a list holds about CHARS characters. Null texts are left out."""
    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns]
        out: list[list] = [[] for _ in columns]
        size = 0
        for row in zip(*cols):
            if row[-1] is None:
                continue
            for o, v in zip(out, row):
                o.append(v)
            size += len(row[-1]) + 1
            if size >= CHARS:
                yield out
                out, size = [[] for _ in columns], 0
        if out[0]:
            yield out


def map_texts(df: DataFrame, schema: str, make: Callable[[], Callable[..., dict]], *columns: str) -> DataFrame:
    """Arrow-batched map: make() is called once a task and gives f(*lists of columns) -> {column: values}."""
    from pyspark.sql.types import StructType

    try:
        from pyspark.sql.pandas.types import to_arrow_schema
    except ImportError:  # older layouts
        from pyspark.sql.pandas.types import to_arrow_type

        def to_arrow_schema(s):
            return pa.schema([(f.name, to_arrow_type(f.dataType)) for f in s])

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        f = make()
        for cols in text_batches(batches, *columns):
            got = f(*cols)
            arrays = [pa.array(got[c.name], type=c.type) for c in target]
            if len(arrays[0]):
                yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.select(*columns).mapInArrow(run, schema)


class Hashes(dict):
    """Word -> 64-bit hash as a signed long, remembered; forgets all when it grows beyond a bound."""

    def __missing__(self, w: str) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


def flat_hashes(lists: list[list[str]], memo: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in one array, and where each list starts (one more at the end)."""
    lens = np.fromiter((len(x) for x in lists), np.int64, len(lists))
    starts = np.concatenate([[0], np.cumsum(lens)])
    flat = np.fromiter(map(memo.__getitem__, chain.from_iterable(lists)), np.uint64, int(starts[-1]))
    return flat, starts


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit mixing hash."""
    x = (x ^ (x >> np.uint64(31))) * _M2
    return x ^ (x >> np.uint64(29))


def runs_hash(flat: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive values."""
    if len(flat) < n:
        return np.zeros(0, np.uint64)
    m = len(flat) - n + 1
    h = np.zeros(m, np.uint64)
    for j in range(n):
        h = (h + flat[j : j + m]) * _M1
        h ^= h >> np.uint64(32)
    return mix(h)
