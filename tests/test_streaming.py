import datetime as dt

from tidegraph.operators.membership import turnover
from tidegraph.streaming.prices import arrived_turnover, turnover_on_arrival, windowed_prices

SCHEMA = "reading_id long, run_id long, ticker string, fecha timestamp, adjclose double"


def test_stream_equals_table(spark, tmp_path):
    at = lambda d, h=0: dt.datetime(2021, 1, 4) + dt.timedelta(days=d, hours=h)
    rows = [(1, 1, "A", at(0), 5.0), (1, 1, "A", at(0), 5.0), (2, 1, "A", at(1), 6.0), (3, 1, "A", at(8), None), (4, 1, "A", at(9), -1.0), (5, 1, "A", at(10), 7.0), (6, 1, None, at(2), 3.0), (7, 1, "A", None, 3.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(str(tmp_path / "in"))
    stream = windowed_prices(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("weekly").outputMode("update").start()
    query.processAllAvailable()
    query.stop()
    got = {(r.ticker, r.start, r.price, r.n) for r in spark.sql("select * from weekly").collect()}
    assert got == {(r.ticker, r.start, r.price, r.n) for r in windowed_prices(df).collect()}
    assert len(got) == 3


def test_turnover_of_batches(spark, tmp_path):
    df = spark.createDataFrame([("X", 1, dt.date(2020, 1, 1), "a"), ("X", 2, dt.date(2020, 2, 1), "b")], "index_code string, n int, effective_date date, ticker string")
    df.write.parquet(str(tmp_path / "in"))
    members = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = turnover_on_arrival(members, str(tmp_path / "out"), "ticker").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r.added, r.dropped) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("b", "a")]


def test_turnover_over_batches(spark, tmp_path):
    """A list a batch, a list split over two batches, a list that comes late, and another index."""
    day = lambda m: dt.date(2020, m, 1)
    batches = [
        [("X", 1, day(1), "a"), ("X", 1, day(1), "b")], [("X", 2, day(2), "b"), ("Y", 1, day(1), "q")], [("X", 2, day(2), "c")], [("X", 4, day(4), "d")], [("Y", 2, day(3), "r")], [("X", 3, day(3), "c")],
    ]
    schema, source, out = "index_code string, n int, effective_date date, ticker string", str(tmp_path / "in"), str(tmp_path / "out")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        query = turnover_on_arrival(spark.readStream.schema(schema).parquet(source), out, "ticker").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        if k == 1:
            assert [(r.added, r.dropped) for r in arrived_turnover(spark, out).collect()] == [("", "a")]
    whole = turnover(spark.createDataFrame([r for b in batches for r in b], schema), "ticker")
    got = arrived_turnover(spark, out).select(whole.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))
    assert got.count() == 4
