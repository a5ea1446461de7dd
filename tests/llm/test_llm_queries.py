"""Every query of the subpackage over the smallest tables, beside its SQL where it has one."""

from pathlib import Path

import duckdb
import pytest

from lattiq.llm.llm_queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
#: The columns that a found query must have.
COLUMNS = {
    "p2_found": ["edge_id_first", "edge_id_copy"], "p3_found": ["field_name", "row_id", "mondo_id"], "p4_found": ["node_key_a", "node_key_b"], "p5_found": ["group_drugbank_id", "drugbank_id"],
    "p7_found": ["test_id", "triple_id"], "p8_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "seg_no", "lang"],
}


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    from tools.compare import rows_of

    df = QUERIES[name](spark, SF)
    assert df.columns == COLUMNS.get(name, df.columns)
    got = rows_of(df.toPandas())
    if name in COLUMNS:
        assert len(set(got[1])) == len(got[1])
    if name in SQL:
        con = duckdb.connect()
        for p in Path(SF).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        assert repr(got) == repr(rows_of(con.execute(SQL[name]).df()))
