"""Paged HTTP captures as a Python data source: ranges of pages are read side by side by tasks, and nothing passes through the driver.

`capture` composes the rest: raw pages kept by stamp, completeness, the contract, inventory, priorities and the published snapshot.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators import gates
from ..operators import inventory as inv
from . import sinks
from .readers import CITY, city_inventory

PAGE = "page int, rows int, ok boolean, code string, tries int, body string"
#: Result codes of a page with rows, and of one past the last row.
FOUND, NONE = "INFO-000", "INFO-200"


class PageRange(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class CityPages(DataSource):
    """Format `city_pages`. Options: url with {token}, {start} and {end} in it (row numbers from 1), token, size (rows a page, 1000), most (pages, 100), per (pages a task, 10), tries (3), timeout (seconds, 15), wait (seconds before a second try, doubled each time, 0.5).

    A row a page that has been asked for. A task goes through its pages until one is short, as no page follows that; tasks of later pages
    find theirs empty. A page that can't be had after all tries, or whose result code isn't that of success, is a row that is not ok, named by its
    code or its error's class alone: the url holds a token.
    """

    @classmethod
    def name(cls) -> str:
        return "city_pages"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema) -> DataSourceReader:
        return PageReader(dict(self.options))


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = {k.lower(): v for k, v in options.items()}

    def _int(self, name: str, default: int) -> int:
        return int(self.options.get(name, default))

    def partitions(self) -> list[PageRange]:
        most, per = self._int("most", 100), self._int("per", 10)
        return [PageRange(k, min(k + per, most + 1) - 1) for k in range(1, most + 1, per)]

    def read(self, partition: PageRange) -> Iterator[tuple]:
        size = self._int("size", 1000)
        for page in range(partition.first, partition.last + 1):
            body, tries, error = self._fetched(page, size)
            rows, code = 0, error
            if body is not None:
                rows, code = self._about(body)
            yield page, rows, code in (FOUND, NONE), code, tries, body
            if rows < size:
                return

    def _fetched(self, page: int, size: int) -> tuple[str | None, int, str | None]:
        url = self.options["url"].format(token=self.options.get("token", ""), start=(page - 1) * size + 1, end=page * size)
        wait, error = float(self.options.get("wait", 0.5)), None
        for k in range(self._int("tries", 3)):
            if k:
                time.sleep(wait * 2 ** (k - 1))
            try:
                with urllib.request.urlopen(url, timeout=float(self.options.get("timeout", 15))) as r:
                    return r.read().decode("utf-8"), k + 1, None
            except urllib.error.HTTPError as e:
                error = f"HTTP {e.code}"
                if e.code < 500:
                    break
            except (OSError, ValueError) as e:
                error = type(e).__name__
        return None, k + 1, error

    @staticmethod
    def _about(body: str) -> tuple[int, str]:
        try:
            found = json.loads(body)
            found = found.get("rentBikeStatus") or found
            return len(found.get("row") or []), str((found.get("RESULT") or {}).get("CODE"))
        except (ValueError, AttributeError):
            return 0, "not JSON"


def pages(spark: SparkSession, url: str, **options) -> DataFrame:
    """The pages of a paged service, as CityPages reads them."""
    spark.dataSource.register(CityPages)
    return spark.read.format("city_pages").options(url=url, **{k: str(v) for k, v in options.items()}).load()


def completeness(got: DataFrame, size: int) -> DataFrame:
    """One row: pages, rows, all_ok, stopped_by (last_page, page_limit, error or gap) and the codes of failed pages.

    Whole is what reaches from page 1 to a short page without a gap; pages asked for past that one are empty and don't count.
    """
    end = got.agg(F.min(F.when(F.col("rows") < size, F.col("page"))).alias("_end"))
    upto = got.crossJoin(F.broadcast(end)).where(F.col("_end").isNull() | (F.col("page") <= F.col("_end")))
    one = gates.page_summary(upto.withColumn("page_size", F.lit(size)))
    more = upto.agg(F.max("page").alias("_last"), F.array_join(F.sort_array(F.collect_set(F.when(~F.col("ok"), F.col("code")))), ",").alias("failed"))
    out = one.crossJoin(F.broadcast(more))
    return out.withColumn("stopped_by", F.when((F.col("stopped_by") != "error") & (F.col("_last") != F.col("pages")), "gap").otherwise(F.col("stopped_by"))).drop("_last")


#: What each station's row must have.
CONTRACT = [gates.FieldRule("stationId", "str"), gates.FieldRule("rackTotCnt", "int", 0, 10_000), gates.FieldRule("parkingBikeTotCnt", "int", 0, 10_000)]


def capture(spark: SparkSession, url: str, folder: str, stamp: str, captured_at: str, size: int = 1000, top: int = 50, **options) -> dict:
    """One capture, whole or not at all: its summary as a dictionary, once inventory and priorities are published under `stamp`.

    The pages are kept as they came in raw/stamp=<stamp>, of which all else is made, so no page is asked for twice. Pages that are not
    complete, a body that isn't of the schema, and rows that break the contract are errors, and then the latest snapshot stays what it was.
    """
    raw = f"{folder}/raw/stamp={stamp}"
    pages(spark, url, size=size, **options).write.mode("overwrite").parquet(raw)
    got = spark.read.schema(PAGE).parquet(raw)
    whole = completeness(got, size).first()
    if whole is None or whole["stopped_by"] != "last_page":
        raise ValueError(f"pages are not complete: {whole['stopped_by']} {whole['failed']}".rstrip())
    payloads = got.where(F.col("code") == FOUND).select(F.from_json("body", CITY, {"mode": "FAILFAST"}).alias("b")).select("b.*")
    rows = payloads.select(F.inline("rentBikeStatus.row"))
    issues = gates.contract_issues(rows, F.coalesce("stationId", F.lit("")), CONTRACT)
    counted = {f"{r['field']} {r['issue']}": r["n"] for r in issues.groupBy("field", "issue").agg(F.count("*").alias("n")).collect()}
    if counted:
        raise ValueError(f"rows break the contract: {counted}")
    inventory = city_inventory(payloads, captured_at)
    sinks.publish(inventory, f"{folder}/inventory", stamp)
    stock = sinks.published(spark, f"{folder}/inventory")
    ruled = inv.rebalancing(stock, "capacity", "bikes_available", "docks_available")
    sinks.publish(inv.top_global(ruled, top, "station_id"), f"{folder}/priority", stamp)
    about = gates.inventory_summary(stock, "station_id", ["capacity", "bikes_available"]).crossJoin(F.broadcast(sinks.published(spark, f"{folder}/priority").agg(F.count("*").alias("priorities"))))
    return sinks.summary_json(about.withColumns({"stamp": F.lit(stamp), "pages": F.lit(whole["pages"])}), f"{folder}/summary.json")
