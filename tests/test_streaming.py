from __future__ import annotations

import datetime as dt

from meridia.streaming import labels as sl


def test_windowed_counts_and_hazard(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i % 3, ["purchase", "error"][i % 2], start + dt.timedelta(hours=6 * i)) for i in range(40)]
    df = spark.createDataFrame(rows, "user_id int, event_type string, ts timestamp")
    for k in range(4):
        df.where(f"pmod(hash(ts), 4) = {k}").coalesce(1).write.parquet(str(tmp_path / f"in/part={k}"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in/part=*"))
    q = sl.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.start.day, r.event_type): r.n for r in spark.table("counts").collect()}
    want = {}
    for _, e, t in rows:
        want[t.day, e] = want.get((t.day, e), 0) + 1
    assert got == want
    o = stream.where("event_type = 'purchase'").selectExpr("user_id as entity", "ts as moment")
    c = stream.where("event_type = 'error'").selectExpr("user_id as entity", "ts as filed")
    q = sl.hazard_stream(o, c, "3 days").writeStream.outputMode("append").format("memory").queryName("hazard").start()
    q.processAllAvailable()
    q.stop()
    want = {(a, t, u) for a, e, t in rows for b, f, u in rows if e == "purchase" and f == "error" and a == b and t < u <= t + dt.timedelta(days=3)}
    assert {tuple(r) for r in spark.table("hazard").collect()} == want
