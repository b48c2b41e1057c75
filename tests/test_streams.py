"""Keyed streams against their batch counterparts: rows out of order, late rows, ties, and restarts from a checkpoint."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import pytest

from tidegauge.operators import temporal as tm
from tidegauge.sources import sinks
from tidegauge.streaming import states

SCHEMA = "id long, user string, ts timestamp, high boolean"
START = dt.datetime(2024, 1, 1)


def readings(n=300, users=4, seed=3):
    """Rows of some users a few minutes to hours apart, with ties and unknown states."""
    draw, rows, at = random.Random(seed), [], dict.fromkeys(range(users), START)
    for k in range(n):
        u = draw.randrange(users)
        at[u] += dt.timedelta(minutes=draw.choice([0, 5, 20, 45, 89, 90, 91, 400]), seconds=draw.choice([0, 0, 1]))
        rows.append((k, f"u{u}", at[u], draw.choice([True, False, None])))
    return sorted(rows, key=lambda r: r[2])


def shuffled(rows, within: dt.timedelta, seed=5):
    draw = random.Random(seed)
    return sorted(rows, key=lambda r: r[2] + within * draw.random())


def run(spark, folder, out, checkpoint):
    stream = states.file_stream(spark, folder, SCHEMA, per_batch=1)
    labels = states.next_state_labels(stream, "user", "ts", "high", 90.0, "2 hours", tie="id")
    q = labels.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_next_state_labels_equal_the_batch_when_rows_are_out_of_order_and_the_query_restarts(spark, tmp_path):
    rows = readings()
    end = rows[-1][2] + dt.timedelta(days=3)
    sent = shuffled(rows, dt.timedelta(minutes=110))
    parts = [sent[k : k + 60] for k in range(0, len(sent), 60)]
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        put = lambda part: spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for part in parts[:3]:
            put(part)
        run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/c")
        for part in parts[3:]:
            put(part)
        put([(900 + k, f"u{k}", end, True) for k in range(4)] + [(990, "z", end + dt.timedelta(days=3), True)])  # moves the watermark past all readings
        run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/c")
        put([(999, "u1", START + dt.timedelta(minutes=1), True)])  # days too late
        last = run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/c")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert states.late_rows(last) == 1
    batch = tm.next_state(spark.createDataFrame(rows + [(900 + k, f"u{k}", end, True) for k in range(4)], SCHEMA), "user", "ts", ["high"], 90.0, ["id"])
    want = sorted(((r.user, r.ts, str(r.high), r.gap_minutes, str(r.next_high)) for r in batch.where("id < 900").collect()), key=str)
    got = spark.read.parquet(f"{tmp_path}/out").where("ts < timestamp '" + str(end) + "'")
    got = sorted(((r.user, r.ts, str(r.state), r.gap_minutes, str(r.label)) for r in got.collect()), key=str)
    assert len(got) == len(want) == len(rows)
    for g, w in zip(got, want):
        # A successor past the tolerance may not have come when the row is settled.
        assert g[:3] == w[:3] and g[4] == w[4] and (g[3] == w[3] or (g[3] is None and w[3] > 90))


def test_each_key_is_delivered_once_across_failures_and_a_lost_checkpoint(spark, tmp_path):
    folder, told = f"{tmp_path}/outbox", []
    put = lambda ids, hour: spark.createDataFrame([(k, "u", START + dt.timedelta(hours=hour), True) for k in ids], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run(checkpoint, then):
        states.deliver(states.file_stream(spark, f"{tmp_path}/in", SCHEMA, per_batch=1), "id", "ts", folder, f"{tmp_path}/{checkpoint}", "2 days", then).awaitTermination()

    def fails(rows, part):
        told.append((part, sorted(r.id for r in rows.collect())))
        if told[-1][1] == [4, 5]:
            raise RuntimeError("killed after the batch is put, before it is recorded")

    sent = lambda: Counter(r.id for r in spark.read.parquet(folder).collect())
    put([1, 2, 3], 0)
    run("c", fails)
    put([3, 4, 5, 4], 1)
    with pytest.raises(Exception, match="killed"):
        run("c", fails)
    assert sent() == Counter([1, 2, 3, 4, 5])
    again = []
    run("c", lambda rows, part: again.append((part, sorted(r.id for r in rows.collect()))))
    assert again[0] == told[-1] and sent() == Counter([1, 2, 3, 4, 5])
    put([5, 6], 2)
    run("another", None)  # reads all of the input anew
    assert sent() == Counter([1, 2, 3, 4, 5, 6])


def test_a_failure_between_the_log_and_the_pointer_loses_nothing(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "shared")
    frame = lambda n: spark.createDataFrame([(k, 0.5 * k) for k in range(n)], "id int, v double")
    with pytest.raises(FileNotFoundError):
        sinks.published(spark, folder)
    sinks.publish(frame(3), folder, "20260101_001500")
    swap = sinks._swapped
    monkeypatch.setattr(sinks, "_swapped", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        sinks.publish(frame(4), folder, "20260101_011500")
    assert sinks.published(spark, folder).count() == 3
    monkeypatch.setattr(sinks, "_swapped", swap)
    sinks.publish(frame(4), folder, "20260101_011500")
    assert sinks.published(spark, folder).count() == 4 and sinks.published(spark, folder).columns == ["id", "v"]
    sinks.publish(frame(5), folder, "20251231_231500")  # late: the log has it, the latest stays
    assert sinks.published(spark, folder).count() == 4
    assert Counter(r.captured_stamp for r in sinks.published(spark, folder, stamps=True).collect()) == {"20260101_001500": 3, "20260101_011500": 4, "20251231_231500": 5}
