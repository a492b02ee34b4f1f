"""What tables of the operators leave in the driver."""

from quillon.llm import _shared


def test_driver_heap_is_given_back_beyond_its_share(spark, monkeypatch):
    monkeypatch.setattr(_shared, "HEAP", 0.0)
    assert _shared.give_back(spark)
    monkeypatch.setattr(_shared, "HEAP", 1.1)
    assert not _shared.give_back(spark)


def test_tables_are_joined_with_small_broadcasts_only(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    with _shared.small_broadcasts(spark):
        assert int(spark.conf.get(name).rstrip("b")) <= _shared.SENT
    assert spark.conf.get(name) == before
