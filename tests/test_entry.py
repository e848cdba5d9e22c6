import __spark_entry__ as E
from stockpulse.plans.registry import all_queries


def test_entry_flagship(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[:3] == ["ds", "hospital_id", "sku_id"]
    assert len(df.columns) == 19


def test_keys_named_by_survey_id():
    for k in all_queries():
        head = k.split("_")[0]
        assert head[0].isalpha() and head[1:].isdigit(), k
