"""Every problem has its query with exactly the columns asked for; the core doesn't know this subpackage."""

import os
import re

import pytest

from lexmill.llm.queries import queries

DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": {"row_id": "bigint", "subject": "string"}, "p2_found": {"row_id_a": "bigint", "row_id_b": "bigint"}, "p3_found": {"row_id": "bigint", "lang": "string"},
    "p4_found": {"row_id": "bigint", "form": "string"}, "p5_found": {"row_id": "bigint"}, "p6_found": {"doc_id": "bigint", "item_id": "bigint"}, "p7_found": {"source": "string"},
    "p8_found": {"doc_id": "bigint", "span_start": "bigint", "span_end": "bigint"},
}


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, name):
    df = queries()[name](spark, DIR)
    rows = df.collect()
    if name in COLUMNS:
        assert dict(df.dtypes) == COLUMNS[name]
        assert len(set(rows)) == len(rows)


def test_core_is_separate():
    root = os.path.join(os.path.dirname(__file__), "..", "..", "lexmill")
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                assert not re.search(r"lexmill\.llm|from \.llm", open(os.path.join(folder, f), encoding="utf-8").read()), f
