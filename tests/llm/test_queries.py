import pytest

import __spark_entry__ as E


@pytest.mark.parametrize("name, columns", [("p7_found", ["item_id", "doc_id"]), ("p8_found", ["doc_id"])])
def test_found(spark, small, name, columns):
    df = E.queries()[name](spark, small)
    assert df.columns == columns and df.count() == df.distinct().count() > 0


def test_others(spark, small):
    q = E.queries()
    assert q["p6_summary"](spark, small).where("fill > 0.9").count() == 3
    assert q["p8_scores"](spark, small).count() == 100
