"""Queries without SQL that work row by row run over the strands of all documents."""

import pytest
from support import SF

from helixlake.plans.fixtures import strands
from helixlake.plans.queries import QUERIES


@pytest.mark.parametrize("name", ["sim5_error_loop", "sim7b_long_deletions", "sim8_stutter", "sim9_copies_from_density"])
def test_every_strand_of_documents_is_worked_on(spark, name):
    want = strands(spark, SF).select("file_id", "pos")
    got = QUERIES[name](spark, SF).select("file_id", "pos").distinct()
    assert want.count() > 1000 and got.count() == want.count() and not got.exceptAll(want).count()
