"""The paged source against a local server: pages side by side, retries, short and empty last pages, gaps, and captures that publish all or nothing."""

from __future__ import annotations

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from tidegauge.sources import paged, sinks


class Server:
    """Serves `rows`; `fails` maps a first row number to how many requests for it get an error; `threads` sees who asks."""

    def __init__(self, rows):
        self.rows, self.fails, self.asked, self.broken = rows, {}, Counter(), {}
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                _, token, start, end = self.path.split("/")
                start, end = int(start), int(end)
                outer.asked[start] += 1
                if outer.asked[start] <= outer.fails.get(start, 0):
                    self.send_error(503)
                    return
                part = outer.rows[start - 1 : end]
                body = {"rentBikeStatus": {"list_total_count": len(outer.rows), "RESULT": {"CODE": "INFO-000"}, "row": part}} if part else {"RESULT": {"CODE": "INFO-200"}}
                text = outer.broken.get(start) or json.dumps(body)
                self.send_response(200)
                self.end_headers()
                self.wfile.write(text.encode())

            def log_message(self, *a):
                pass

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.http.server_port}/{{token}}/{{start}}/{{end}}"


def stations(n):
    return [{"stationId": f"ST-{k:03d}", "stationName": f"N{k}", "rackTotCnt": "20", "parkingBikeTotCnt": str(k % 25), "shared": "50", "stationLatitude": "37.5", "stationLongitude": "126.9"} for k in range(n)]


@pytest.fixture
def server():
    s = Server(stations(23))
    yield s
    s.http.shutdown()


def test_pages_are_read_in_parts_until_a_short_one(spark, server):
    server.fails = {6: 2, 16: 1}
    got = {r.page: r for r in paged.pages(spark, server.url, size=5, most=9, per=2, wait=0.01, token="k").collect()}
    assert paged.pages(spark, server.url, size=5, most=9, per=2).rdd.getNumPartitions() == 5
    assert {p: (r.rows, r.ok) for p, r in got.items()} == {1: (5, True), 2: (5, True), 3: (5, True), 4: (5, True), 5: (3, True), 7: (0, True), 9: (0, True)}
    assert got[2].tries == 3 and got[4].tries == 2 and got[1].tries == 1
    one = paged.completeness(spark.createDataFrame(list(got.values()), paged.PAGE), 5).first()
    assert (one.pages, one.rows, one.stopped_by, one.failed) == (5, 23, "last_page", "")


def test_an_exact_last_page_a_limit_a_gap_and_an_error(spark, server):
    server.rows = stations(20)
    end = lambda **o: paged.completeness(paged.pages(spark, server.url, size=5, wait=0.01, token="k", **o), 5).first()
    assert (end(most=9, per=3).stopped_by, end(most=4, per=3).stopped_by) == ("last_page", "page_limit")
    server.fails = {11: 99}
    found = end(most=9, per=2, tries=2)
    assert (found.stopped_by, found.failed) == ("error", "HTTP 503")
    gap = spark.createDataFrame([(1, 5, True, "INFO-000", 1, ""), (3, 2, True, "INFO-000", 1, "")], paged.PAGE)
    assert paged.completeness(gap, 5).first().stopped_by == "gap"


def test_a_capture_publishes_all_or_nothing(spark, server, tmp_path):
    take = lambda stamp: paged.capture(spark, server.url, str(tmp_path), stamp, "2026-01-01T00:15:00+09:00", size=5, top=4, most=9, per=2, wait=0.01, token="secret-token")
    about = take("20260101_001500")
    assert (about["rows"], about["pages"], about["ok"], about["priorities"], about["stamp"]) == (23, 5, True, 4, "20260101_001500")
    rows = sinks.published(spark, f"{tmp_path}/priority").orderBy("rank").collect()
    assert [(r.station_id, r.issue, r.delta, r.severity) for r in rows] == [("ST-022", "space_shortage", -6, 2.0), ("ST-021", "space_shortage", -5, 2.0), ("ST-000", "stock_shortage", 4, 2.0), ("ST-020", "space_shortage", -4, 2.0)]
    for name, broken in (("schema", json.dumps({"rentBikeStatus": {"RESULT": {"CODE": "INFO-000"}, "row": [{"stationId": {"x": [1]}}] * 5}})[:-4]), ("json", "<html>"), ("contract", None)):
        server.asked.clear()
        server.broken = {6: broken} if broken else {}
        if name == "contract":
            server.rows = stations(23)
            server.rows[7]["rackTotCnt"] = "many"
        with pytest.raises(Exception) as e:
            take("20260101_011500")
        assert "secret-token" not in str(e.value)
        assert sinks.published(spark, f"{tmp_path}/inventory").count() == 23
        assert set(r.captured_stamp for r in sinks.published(spark, f"{tmp_path}/priority", stamps=True).collect()) == {"20260101_001500"}
    server.rows, server.broken = stations(12), {}
    assert take("20260101_011500")["rows"] == 12 and sinks.published(spark, f"{tmp_path}/inventory").count() == 12
