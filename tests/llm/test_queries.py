import pytest

from quarry.llm import queries as llm
from tests.oracle import SF, agree, there

pytestmark = pytest.mark.skipif(not there, reason="no test tables")


@pytest.mark.parametrize("name", llm.queries())
def test_query(spark, name):
    df = llm.queries()[name](spark, SF)
    if name in llm.oracle_sql():
        agree(df, llm.oracle_sql()[name])
    else:
        assert df.count() == (df.select("doc_id").distinct().count() if name == "op4_decontaminate" else spark.read.parquet(f"{SF}/documents.parquet").count())


def test_every_number_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in llm.queries()) == list(range(1, 11))
