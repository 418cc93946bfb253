"""Every registered query against its SQL on the smallest tables."""

import pytest

from basewright.plans import registry

registry.load()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(name, spark, duck, sf, same_rows):
    same_rows(registry.QUERIES[name](spark, sf).toPandas(), duck.sql(registry.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(name, spark, sf):
    assert registry.QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", ["b04_qc_classify", "e04_record_split", "f02_weighted_draws", "h06_ranking", "j03_as_of_backfill"])
def test_partitioning_does_not_matter(name, spark, duck, sf, same_rows):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        same_rows(registry.QUERIES[name](spark, sf).toPandas(), duck.sql(registry.ORACLES[name]).df())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
