"""Documents of no text or of null: files of no bits have no strands, and still come back from every codec, as their SQL says."""

import duckdb
import pytest
from support import SF, same_rows

from helixlake.plans.queries import ORACLE_SQL, QUERIES

CODECS = ["cod4_no_correction", "cod5_hamming", "cod6_reed_solomon", "cod8_church_roundtrip", "cod9_goldman", "cod10_grass", "cod11_blawat", "cod14_info", "cod15_reassembled"]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    duckdb.sql(f"COPY (SELECT * REPLACE (CASE doc_id % 7 WHEN 0 THEN '' WHEN 3 THEN NULL ELSE left(text, 200) END AS text) FROM '{SF}/documents.parquet' WHERE doc_id < 40) TO '{folder}/documents.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", CODECS)
def test_files_of_no_bits_come_back(spark, odd, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{odd}/documents.parquet'")
    found = QUERIES[name](spark, odd)
    assert found.count() == 40
    same_rows(found, con.sql(ORACLE_SQL[name]))
