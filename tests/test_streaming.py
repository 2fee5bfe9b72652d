import datetime
import random

from sillage.operators import pacing
from sillage.streaming import pacing as streams


def _log():
    r = random.Random(3)
    start = datetime.datetime(2024, 1, 1)
    return [(d, start + datetime.timedelta(seconds=i), i, r.choice([200, 200, 200, 200, 429])) for i in range(120) for d in (1, 2)] + [
        (3, start + datetime.timedelta(seconds=i), i, 200) for i in range(30)
    ]


def _fold(rows):
    rate, window = pacing.START, []
    for *_, status in sorted(rows, key=lambda x: (x[1], x[2])):
        rate, window = streams.step(rate, window, status)
    return round(rate, 6)


def test_batch_fold(spark):
    rows = _log()
    df = spark.createDataFrame(rows, "domain_id long, ts timestamp, event_id long, status int")
    got = {r["domain_id"]: r["rps"] for r in pacing.adaptive_rate(df).collect()}
    assert got == {d: _fold([x for x in rows if x[0] == d]) for d in (1, 2, 3)}


def test_send_times(spark):
    rows = [(1, datetime.datetime(2024, 1, 1, 0, 0, s), i, 200) for i, s in enumerate((0, 1, 1, 10))]
    df = spark.createDataFrame(rows, "domain_id long, ts timestamp, event_id long, status int")
    assert [r["wait"] // 1_000_000 for r in pacing.send_times(df).orderBy("event_id").collect()] == [0, 1, 3, 0]


def test_stream(spark, tmp_path):
    rows = _log()
    df = spark.createDataFrame(rows, "domain_id long, ts timestamp, event_id long, status int")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = streams.adaptive_rates(source).writeStream.outputMode("update").format("memory").queryName("rates").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    got = {r["domain_id"]: round(r["rps"], 6) for r in spark.table("rates").collect()}
    assert got == {d: _fold([x for x in rows if x[0] == d]) for d in (1, 2, 3)}
