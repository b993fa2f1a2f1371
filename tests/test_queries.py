import pytest
from conftest import same

from fieldspark.jobs import queries as q


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query_equals_its_sql(spark, sf_dir, oracle, name):
    same(q.QUERIES[name](spark, sf_dir).toPandas(), oracle(q.ORACLES[name]))
