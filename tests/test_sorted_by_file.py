"""Reads sorted by how often their sequence occurs, by file: copies in other files count, and reads are not exchanged."""

import duckdb
from support import same_rows

from helixlake.plans.queries import ORACLE_SQL, QUERIES


def test_copies_in_other_files_count(spark, tmp_path):
    duckdb.sql(f"""COPY (SELECT * FROM (VALUES (1, repeat('the same text ', 40)), (20, repeat('the same text ', 40)), (3, 'a short one'), (4, ''), (5, NULL), (6, repeat('another text ', 90)),
        (7, repeat('the same text ', 20))) t(doc_id, text)) TO '{tmp_path}/documents.parquet'""")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    found = QUERIES["snk5_sorted_fasta"](spark, str(tmp_path))
    same_rows(found, con.sql(ORACLE_SQL["snk5_sorted_fasta"]))
    plan = found._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    assert "hashpartitioning(seq" not in plan and "rangepartitioning" not in plan
