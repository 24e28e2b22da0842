"""Every query of the subpackage on the smallest tables, against its SQL where it has one."""

import os

import duckdb
import pytest

from lorikeet.llm import catalogue

COLUMNS = {
    "p2_found": "chunk_id line_no", "p3_found": "chunk_id_a chunk_id_b", "p4_found": "src row_key kind start_pos end_pos", "p5_found": "chunk_id", "p6_found": "id defect",
    "p7_found": "id field pos", "p8_ids": "doc_id ids", "p9_found": "doc_id item_id", "p10_found": "doc_id",
}


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf, name):
    got = catalogue.queries()[name](spark, sf)
    if name in COLUMNS:
        assert got.columns == COLUMNS[name].split()
    rows = got.collect()
    if name in COLUMNS and name != "p8_ids":
        assert len(set(rows)) == len(rows)
    if name in catalogue.oracle_sql():
        c = duckdb.connect()
        for f in os.listdir(sf):
            c.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
        want = c.execute(catalogue.oracle_sql()[name])
        cols = [d[0] for d in want.description]
        assert sorted(tuple(r[x] for x in cols) for r in rows) == sorted(want.fetchall())
