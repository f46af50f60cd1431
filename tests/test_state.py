"""Streams with timers over files that come one by one."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lexspark.operators import access
from lexspark.streaming import state

T0 = datetime(2024, 3, 1)


@pytest.fixture(autouse=True)
def provider(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, state.PROVIDER)
    yield
    spark.conf.set(name, before)


def feed(spark, folder, schema: str, made, files: list[list[tuple]]) -> list[tuple]:
    """What a stream has written after each file came in a batch of its own, in all."""
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        stream = made(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in")))
        stream.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start().awaitTermination()
    return sorted(map(tuple, spark.read.parquet(str(folder / "out")).collect()), key=str)


def keys(spark, folder) -> set:
    held = spark.read.format("statestore").option("stateVarName", "state").load(str(folder / "cp"))
    return {r[0] for r in held.select("key.*").collect()}


def test_throttle(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    files = [[(1, at(s)) for s in (5, 0, 1, 2, 30)] + [(2, at(59))], [(1, at(60)), (1, at(61)), (2, at(70))] + [(3, at(62 + i)) for i in range(10)], [(2, at(500)), (1, at(480))]]
    got = feed(spark, tmp_path, "client long, at timestamp", state.throttle, files)
    batch = access.throttle(spark.createDataFrame([r for f in files for r in f], "client long, at timestamp"), F.lit("1970-01-01").cast("timestamp"))
    assert got == sorted(map(tuple, batch.collect()), key=str)
    # by the watermark (500 s less a minute) client 3 has no window any more; those of 1 and 2 are new
    assert keys(spark, tmp_path) == {1, 2}


def test_expiries(spark, tmp_path):
    day = lambda n: T0 + timedelta(days=n)
    schema = "label string, kind string, indexed_at timestamp"
    files = [
        [("a", "ephemeral", day(0)), ("b", "ephemeral", day(0)), ("c", "durable", day(0)), ("d", "session", day(0)), ("e", "ephemeral", day(0)), ("e", "durable", day(0.5))],
        [("b", "ephemeral", day(0.9)), ("f", "ephemeral", day(1.5))], [("g", "ephemeral", day(30))], [("c", "session", day(31))], [("h", "durable", day(100))],
    ]
    got = feed(spark, tmp_path, schema, state.expiries, files)
    assert got == sorted([("a", "ephemeral", day(1)), ("b", "ephemeral", day(1.9)), ("f", "ephemeral", day(2.5)), ("d", "session", day(60)), ("g", "ephemeral", day(31)), ("c", "session", day(91))], key=str)
    assert keys(spark, tmp_path) == {"e", "h"}
