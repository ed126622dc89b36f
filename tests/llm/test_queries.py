import pytest

from quillsieve.llm.queries import QUERIES

COLUMNS = {
    "p1_found": "src rec_id", "p3_found": "src row_id ref_id", "p4_found": "scan_id line_no lang", "p5_found": "src rec_id", "p6_found": "scan_id kind start_pos", "p7_ids": "doc_id ids", "p9_found": "doc_id",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns == COLUMNS.get(name, " ".join(df.columns)).split()
    assert df.count() >= 1
