from __future__ import annotations

import datetime as dt
import json
import zipfile

from pyspark.sql import functions as F

from tidegauge.operators import temporal as tm
from tidegauge.sources import readers, sinks
from tidegauge.streaming import states

SF = "/root/testdata/sf0.001"


def test_city_payload_with_numbers_as_text(spark, tmp_path):
    row = {"rackTotCnt": "3", "stationName": "A", "parkingBikeTotCnt": 5, "shared": "166", "stationLatitude": "37.5", "stationLongitude": 126.9, "stationId": "ST-1"}
    body = {"rentBikeStatus": {"list_total_count": 1, "RESULT": {"CODE": "INFO-000", "MESSAGE": "ok"}, "row": [row, row | {"stationId": "ST-2", "rackTotCnt": "many"}]}}
    (tmp_path / "p1.json").write_text(json.dumps(body))
    pages = readers.city_pages(spark, str(tmp_path))
    got = {r.station_id: (r.capacity, r.bikes_available, r.docks_available) for r in readers.city_inventory(pages, "2026-01-01T00:00:00+09:00").collect()}
    assert got == {"ST-1": (3, 5, 0), "ST-2": (None, 5, None)}
    assert [(r.page, r.rows, r.ok) for r in readers.page_results(pages).collect()] == [("p1.json", 2, True)]


def test_station_weather_and_trip_files(spark, tmp_path):
    for name, body in (
        ("info", {"data": {"stations": [{"station_id": "g1", "short_name": "6879.04", "name": "A", "lat": 40.7, "lon": -74.0, "capacity": 14}]}}),
        ("status", {"data": {"stations": [{"station_id": "g1", "num_bikes_available": 3, "num_docks_available": 11, "is_installed": 1, "is_renting": 1, "is_returning": 1, "last_reported": 1_700_000_000}]}}),
        ("weather", {"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "temperature_2m": [1.0, None], "relative_humidity_2m": [80, 81], "precipitation": [0, 0], "wind_speed_10m": [3, 4]}}),
    ):
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    assert readers.station_information(spark, f"{tmp_path}/info.json").first().station_short_name == "6879.04"
    assert readers.station_status(spark, f"{tmp_path}/status.json").first().num_docks_available == 11
    assert [r.hour.hour for r in readers.hourly_weather(spark, f"{tmp_path}/weather.json").orderBy("hour").collect()] == [0, 1]
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("__MACOSX/x.csv", "")
        z.writestr("rides.csv", "ride_id,started_at,ended_at,start_station_name,start_station_id,end_station_name,end_station_id,start_lat,start_lng,end_lat,end_lng,member_casual\n"
                   "1,2024-01-01 00:10:00,2024-01-01 00:20:00,A,5.10,B,6.20,1,2,3,4,member\n2,bad,2024-01-01 00:20:00,A,5.10,B,6.20,1,2,3,4,casual\n")  # fmt: skip
    rides = readers.trips(spark, readers.unzipped_csv(str(tmp_path / "t.zip"), str(tmp_path))).collect()
    assert [(r.ride_id, r.start_station_id) for r in rides] == [("1", "5.10")]


def test_synthetic_tables_repeat(spark):
    a, b = (readers.synthetic_trips(spark, 3, 4, 7) for _ in range(2))
    assert a.count() > 50 and a.exceptAll(b).count() == 0
    demand = readers.synthetic_demand(spark, 45)
    assert demand.count() == 45 * 24 and demand.where("casual + registered <> cnt").count() == 0


def test_missing_files(spark, tmp_path):
    schema = "station_short_name string, n int"
    assert readers.label_panel(spark, f"{tmp_path}/none.csv", schema).collect() == []
    assert readers.read_json_object(f"{tmp_path}/none.json") == {}
    assert readers.first_existing(f"{tmp_path}/none.json", str(tmp_path)) == str(tmp_path)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, None), (2, float("nan"), "x")], "a int, b double, c string")
    sinks.to_csv(df, f"{tmp_path}/csv", ["c", "a"])
    assert spark.read.csv(f"{tmp_path}/csv", header=True).columns == ["c", "a"]
    assert sinks.summary_json(df.where("a = 2"), f"{tmp_path}/s.json") == {"a": 2, "b": None, "c": "x"}
    for _ in range(2):
        sinks.latest_and_log(df, f"{tmp_path}/latest", f"{tmp_path}/log", "20260101_001500")
    assert spark.read.parquet(f"{tmp_path}/latest").count() == 2 and spark.read.parquet(f"{tmp_path}/log").count() == 4
    assert "nan" not in sinks.markdown_table(df).lower()


def drained(stream, name, mode, spark, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_streams_agree_with_batches(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", F.col("user_id").cast("string").alias("user"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") > 50).alias("high"))
    events.orderBy("ts").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: states.file_stream(spark, f"{tmp_path}/in", events.schema)
    latest = drained(states.latest_state(stream(), "user", "ts", ["event_id"]), "latest", "complete", spark, tmp_path)
    assert {(r.user, r.ts) for r in latest.collect()} == {(r.user, r.ts) for r in events.groupBy("user").agg(F.max("ts").alias("ts")).collect()}
    once = drained(states.once_only(stream(), "user", "ts", "40 days"), "once", "append", spark, tmp_path)
    assert once.count() == events.select("user").distinct().count()
    batch = {(r.user, r.hour): r.n for r in events.groupBy("user", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n")).collect()}
    hours = {(r.user, r.hour): r.n for r in drained(states.hourly_counts(stream(), "user", "ts"), "hours", "append", spark, tmp_path).collect()}
    assert hours and all(batch[k] == n for k, n in hours.items()) and len(batch) - len(hours) <= 4 * 15
    want = {(r.user, r.ts): (r.gap_minutes, r.next_high) for r in tm.next_state(events, "user", "ts", ["high"], 90.0, ["event_id"]).collect()}
    labels = drained(states.next_state_labels(stream(), "user", "ts", "high"), "labels", "append", spark, tmp_path).collect()
    assert len(labels) >= 0.9 * len(want)
    for r in labels:
        gap, label = want[(r.user, r.ts)]
        assert r.label == label and (r.gap_minutes is None or abs(r.gap_minutes - gap) < 1e-6)
    assert max(r.ts for r in labels) <= dt.datetime.max
