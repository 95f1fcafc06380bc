import os

import pytest
from oracle import compare

from tidemark import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_twin(spark, name):
    query = queries.QUERIES[name]
    if name in queries.ORACLES:
        assert compare(spark, FOLDER, query, queries.ORACLES[name]) == ""
    else:
        assert query(spark, FOLDER).count() > 0
