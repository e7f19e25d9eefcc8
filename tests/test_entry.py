import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["i", "rank", "j", "dist"]
    assert df.count() == 5 * df.select("i").distinct().count() > 0
