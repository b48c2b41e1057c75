"""Typed scans: snapshot logs, nested and column-oriented JSON, trips, and synthetic tables."""

from __future__ import annotations

import csv
import json
import shutil
import urllib.request
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clean import flag, safe_float, safe_int, safe_str

STAMP = r"(\d{8}_\d{6})_inventory_snapshot\.csv$"

SNAPSHOT = (
    "station_short_name string, station_name string, gbfs_station_id string, capacity string, num_bikes_available string, "
    "num_docks_available string, current_bike_shortage string, current_dock_shortage string, inventory_pressure string"
)
TRIPS = (
    "ride_id string, started_at string, ended_at string, start_station_name string, start_station_id string, end_station_name string, "
    "end_station_id string, start_lat double, start_lng double, end_lat double, end_lng double, member_casual string"
)
CITY = (
    "rentBikeStatus struct<list_total_count:int, RESULT:struct<CODE:string,MESSAGE:string>, row:array<struct<rackTotCnt:string,"
    "stationName:string,parkingBikeTotCnt:string,shared:string,stationLatitude:string,stationLongitude:string,stationId:string>>>"
)
STATIONS = ("data struct<stations:array<struct<station_id:string,short_name:string,name:string,lat:double,lon:double,capacity:int>>>")
STATUS = (
    "data struct<stations:array<struct<station_id:string,num_bikes_available:int,num_docks_available:int,is_installed:int,is_renting:int,is_returning:int,last_reported:bigint>>>"
)
WEATHER = ("hourly struct<time:array<string>,temperature_2m:array<double>,relative_humidity_2m:array<double>,precipitation:array<double>,wind_speed_10m:array<double>>")


def _taken(stamp: str, until: str | None) -> Column:
    """Whether a file's name has a stamp, up to `until`; as this is on file metadata, other files are not opened."""
    found = F.regexp_extract(F.col("_metadata.file_name"), stamp, 1)
    return found != "" if until is None else (found != "") & (found <= until)


def file_headers(spark: SparkSession, folder: str, glob: str, stamp: str, until: str | None = None) -> DataFrame:
    """(path, head): the first line of each file whose name has a stamp (up to `until`)."""
    lines = spark.read.option("pathGlobFilter", glob).text(folder).where(_taken(stamp, until)).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    return lines.where("block = 0 and value <> ''").withColumn("at", F.monotonically_increasing_id()).groupBy("path").agg(F.min_by("value", "at").alias("head"))


def snapshot_log(spark: SparkSession, folder: str, schema: str | T.StructType = SNAPSHOT, until: str | None = None, stamp: str = STAMP, glob: str = "*_inventory_snapshot.csv") -> DataFrame:
    """All snapshot files of a folder, with captured_at read from each file's name.

    Files whose name has no stamp, and those after `until` (yyyyMMdd_HHmmss, included), are not opened. All files are read in one scan by
    Spark's own CSV reader, by place, and each file's header, joined to its rows, says which place is which column; so files may lack columns,
    have more, or have them in another order, and a quoted field may hold commas, doubled quotes and line breaks. Columns that a file lacks are
    null, as are empty fields, quoted ones too; of columns of one name the first counts; a row that is too short ends in nulls.
    What reaches the driver, and goes from it to the tasks, is each file's path and the number of its header; headers are read once.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    heads = [(r["path"], r["head"]) for r in file_headers(spark, folder, glob, stamp, until).collect()]
    if not heads:
        return spark.createDataFrame([], T.StructType([*[T.StructField(f.name, T.StringType()) for f in fields], T.StructField("snapshot_path", T.StringType()), T.StructField("captured_at", T.TimestampNTZType())]))
    named = {head: (k, [x.strip() for x in next(csv.reader([head.removeprefix("\ufeff")]))]) for k, head in enumerate(sorted({h for _, h in heads}))}
    places = spark.createDataFrame([(k, [names.index(f.name) if f.name in names else None for f in fields]) for k, names in named.values()], "kind int, place array<int>")
    of_file = spark.createDataFrame([(path, named[head][0]) for path, head in heads], "snapshot_path string, kind int").join(F.broadcast(places), "kind")
    own = [f"_{i}" for i in range(max(len(names) for _, names in named.values()))]
    raw = spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in own])).option("pathGlobFilter", glob).csv(folder, header=True, multiLine=True, quote='"', escape='"')
    at = F.try_to_timestamp(F.regexp_extract(F.col("_metadata.file_name"), stamp, 1), F.lit("yyyyMMdd_HHmmss")).cast("timestamp_ntz")
    rows = raw.where(_taken(stamp, until)).select(F.array(*own).alias("cells"), F.col("_metadata.file_path").alias("snapshot_path"), at.alias("captured_at"))
    cells = [F.nullif(F.get("cells", F.get("place", F.lit(i))), F.lit("")).alias(f.name) for i, f in enumerate(fields)]
    return rows.join(F.broadcast(of_file), "snapshot_path").select(*cells, "snapshot_path", "captured_at")


def excluded_snapshots(spark: SparkSession, folder: str, history: DataFrame, stamp: str = STAMP, glob: str = "*_inventory_snapshot.csv") -> DataFrame:
    """One row: stamped files of a folder, distinct capture times of the history made of them, and the files that gave none.

    A file counts as excluded whether a cutoff left it out or it has no row that the history keeps. Files are listed, not read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).where(F.regexp_extract(F.element_at(F.split("path", "/"), -1), stamp, 1) != "")
    counts = files.agg(F.count("path").alias("source_snapshots")).crossJoin(F.broadcast(history.agg(F.count_distinct("captured_at").alias("snapshots"))))
    return counts.withColumn("excluded_snapshots", F.greatest(F.col("source_snapshots") - F.col("snapshots"), F.lit(0)))


def snapshot_history(raw: DataFrame, key: str = "gbfs_station_id", fallback: str = "station_short_name") -> DataFrame:
    """Numbers, flags and keys of a snapshot log; rows without a key or time go."""
    numbers = {c: safe_int(c) for c in ("capacity", "num_bikes_available", "num_docks_available")} | {"inventory_pressure": safe_float("inventory_pressure")}
    flags = {c: flag(c) for c in ("current_bike_shortage", "current_dock_shortage")}
    out = raw.withColumns(numbers | flags | {key: F.coalesce(safe_str(key), safe_str(fallback))})
    return out.dropna(subset=[key, "captured_at"])


def city_inventory(payloads: DataFrame, captured_at: str) -> DataFrame:
    """The normalised inventory rows of city payloads (schema CITY): docks are capacity less bikes, 0 at least, null if either is."""
    rows = payloads.select(F.explode("rentBikeStatus.row").alias("r"))
    capacity, bikes = safe_int("r.rackTotCnt"), safe_int("r.parkingBikeTotCnt")
    return rows.select(
        safe_str("r.stationId").alias("station_id"), safe_str("r.stationName").alias("station_name"), capacity.alias("capacity"), bikes.alias("bikes_available"),
        F.when(capacity.isNotNull() & bikes.isNotNull(), F.greatest(capacity - bikes, F.lit(0))).alias("docks_available"), safe_float("r.shared").alias("shared_rate"),
        safe_float("r.stationLatitude").alias("station_lat"), safe_float("r.stationLongitude").alias("station_lon"), F.lit(captured_at).alias("captured_at_kst"),
        F.lit("city_api").alias("source"),
    )


def city_pages(spark: SparkSession, path: str) -> DataFrame:
    """City payload files, one a page, as read."""
    return spark.read.schema(CITY).json(path, multiLine=True)


def page_results(payloads: DataFrame, page_size: int = 1000) -> DataFrame:
    """(page, rows, ok, page_size) of payload files, in order of file name."""
    rows = payloads.select(F.col("_metadata.file_name").alias("page"), F.coalesce(F.size("rentBikeStatus.row"), F.lit(0)).alias("rows"), F.coalesce(F.col("rentBikeStatus.RESULT.CODE") == "INFO-000", F.lit(False)).alias("ok"))
    return rows.withColumn("page_size", F.lit(page_size))


def landed_pages(page: Callable[[int, int], dict], folder: str, size: int = 1000, most: int = 100) -> dict:
    """Pages first to last, numbered from 1, saved as JSON files: {"pages", "complete"}. `page` gets the first and last row number; a page of fewer rows is the last.

    A page whose result code isn't that of success is an error, named by its code alone.
    """
    Path(folder).mkdir(parents=True, exist_ok=True)
    for k in range(most):
        body = page(k * size + 1, (k + 1) * size)
        found = body.get("rentBikeStatus") or {}
        code = (found.get("RESULT") or {}).get("CODE")
        if code != "INFO-000":
            raise ValueError(f"page {k + 1}: {code}")
        (Path(folder) / f"page_{k:05d}.json").write_text(json.dumps(body, ensure_ascii=False), encoding="utf-8")
        if len(found.get("row") or []) < size:
            return {"pages": k + 1, "complete": True}
    return {"pages": most, "complete": False}


def captured(spark: SparkSession, folder: str, captured_at: str, size: int = 1000) -> DataFrame:
    """The inventory of landed pages; an error if they are not complete."""
    from ..operators.gates import page_summary

    pages = city_pages(spark, folder)
    summary = page_summary(page_results(pages, size)).first()
    if summary.stopped_by != "last_page":
        raise ValueError(f"pages are not complete: {summary.stopped_by}")
    return city_inventory(pages, captured_at)


def demand(spark: SparkSession, path: str) -> DataFrame:
    """Hourly demand from a CSV file, without its row number and with datetime."""
    at = F.col("dteday").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("hr"))
    return spark.read.csv(path, header=True, inferSchema=True).drop("instant").withColumn("datetime", at)


def acquired(spark: SparkSession, find: Callable[[], str], otherwise: Callable[[], DataFrame], read: Callable[[SparkSession, str], DataFrame] = demand) -> tuple[DataFrame, dict]:
    """What `read` makes of the file that `find` gives; if that fails, the frame of `otherwise`. Says which, and why."""
    try:
        return read(spark, find()), {"source": "file", "reason": None}
    except Exception as e:  # any failure leads to the other source, with its reason
        return otherwise(), {"source": "synthetic", "reason": f"{type(e).__name__}: {e}"}


def stamped_copy(path: str, folder: str, stamp: str) -> str:
    """A raw file kept twice: under its own name, in place of the last one, and under its stamp and name, which is given back."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    kept = Path(folder) / f"{stamp}_{Path(path).name}"
    shutil.copyfile(path, kept)
    shutil.copyfile(path, put := Path(folder) / f".{stamp}_{Path(path).name}")
    put.replace(Path(folder) / Path(path).name)
    return str(kept)


def station_information(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(STATIONS).json(path, multiLine=True).select(F.explode("data.stations").alias("s"))
    return rows.select(F.col("s.short_name").alias("station_short_name"), F.col("s.name").alias("station_name"), F.col("s.station_id").alias("gbfs_station_id"), F.col("s.lat").alias("station_lat"), F.col("s.lon").alias("station_lon"), F.col("s.capacity").alias("capacity"))


def station_status(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(STATUS).json(path, multiLine=True).select(F.inline("data.stations"))
    return rows.withColumnRenamed("station_id", "gbfs_station_id").withColumn("last_reported", F.timestamp_seconds("last_reported"))


def hourly_weather(spark: SparkSession, path: str) -> DataFrame:
    """Column-oriented arrays as a row an hour."""
    names = ["temperature_2m", "relative_humidity_2m", "precipitation", "wind_speed_10m"]
    raw = spark.read.schema(WEATHER).json(path, multiLine=True)
    zipped = raw.select(F.explode(F.arrays_zip("hourly.time", *[f"hourly.{n}" for n in names])).alias("z"))
    return zipped.select(F.to_timestamp_ntz(F.col("z.time"), F.lit("yyyy-MM-dd'T'HH:mm")).alias("hour"), *[F.col(f"z.{n}").alias(n) for n in names])


def trips(spark: SparkSession, path: str) -> DataFrame:
    """Rides with parsed times; rows whose times don't parse go."""
    raw = spark.read.schema(TRIPS).csv(path, header=True)
    times = {c: F.try_to_timestamp(c).cast("timestamp_ntz") for c in ("started_at", "ended_at")}
    return raw.withColumns(times).dropna(subset=["started_at", "ended_at"])


def label_panel(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A label panel saved as CSV, ids as text by the schema; an empty frame if nothing is there."""
    try:
        return spark.read.schema(schema).csv(path, header=True)
    except Exception as e:  # the reader says which path is missing by its error class alone
        if getattr(e, "getCondition", lambda: "")() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def head(spark: SparkSession, path: str, rows: int) -> DataFrame:
    return spark.read.csv(path, header=True).limit(rows)


def read_json_object(path: str) -> dict:
    """A small JSON object on the driver; {} if missing or not an object."""
    try:
        found = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def fetched(url: str, target: str, timeout: float = 45.0) -> str:
    """The path of a download, made once, piece by piece; one that breaks off leaves nothing under that path."""
    if not Path(target).exists():
        Path(target).parent.mkdir(parents=True, exist_ok=True)
        put = Path(f"{target}.part")
        with urllib.request.urlopen(url, timeout=timeout) as r, put.open("wb") as f:
            shutil.copyfileobj(r, f)
        put.replace(target)
    return target


def unzipped_csv(archive: str, folder: str) -> str:
    """The first CSV of a zip archive, extracted so that Spark can split it."""
    with zipfile.ZipFile(archive) as z:
        names = [n for n in z.namelist() if n.endswith(".csv") and not n.startswith("__MACOSX/")]
        if not names:
            raise ValueError("no CSV in the archive")
        return z.extract(names[0], folder)


def settings(path: str) -> dict[str, str]:
    """KEY=VALUE lines; comments and blank lines are skipped, quotes around values dropped."""
    out = {}
    if Path(path).exists():
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            name, eq, value = line.strip().partition("=")
            if eq and not name.startswith("#"):
                out[name.removeprefix("export ").strip()] = value.strip().strip("'\"")
    return out


def first_existing(*paths: str) -> str | None:
    return next((p for p in paths if Path(p).exists()), None)


def synthetic_demand(spark: SparkSession, days: int = 730, seed: int = 42) -> DataFrame:
    """Hourly demand with weather and calendar: casual + registered = cnt on every row."""
    base = spark.range(days * 24).select((F.expr("timestamp_ntz '2011-01-01 00:00:00'") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("datetime"))
    hr, wd = F.hour("datetime"), F.weekday("datetime")
    df = base.withColumns({"hr": hr, "weekday": wd, "mnth": F.month("datetime"), "yr": F.year("datetime") - 2011, "season": (F.floor((F.month("datetime") % 12) / 3) + 1).cast("int")})
    df = df.withColumns({"temp": F.least(F.lit(1.0), F.greatest(F.lit(0.02), 0.5 - 0.3 * F.cos(2 * 3.14159265 * F.dayofyear("datetime") / 365) + 0.08 * F.randn(seed)))})
    df = df.withColumns({"hum": F.least(F.lit(1.0), F.greatest(F.lit(0.1), 0.6 + 0.15 * F.randn(seed + 1))), "windspeed": F.abs(0.19 + 0.1 * F.randn(seed + 2)), "workingday": (wd < 5).cast("int"), "holiday": F.lit(0)})
    df = df.withColumns({"weathersit": F.when(F.rand(seed + 3) < 0.65, 1).when(F.rand(seed + 4) < 0.75, 2).otherwise(3), "atemp": F.col("temp") * 0.95})
    peak = F.when((F.col("workingday") == 1) & (hr.between(7, 9) | hr.between(17, 19)), 220).when(hr.between(10, 16), 120).when((hr >= 22) | (hr <= 5), 20).otherwise(80)
    level = peak * (0.5 + F.col("temp")) * F.when(F.col("weathersit") == 3, 0.6).otherwise(1.0)
    df = df.withColumn("registered", F.greatest(F.lit(0), F.round(level * 0.8 + 12 * F.randn(seed + 5)).cast("int")))
    df = df.withColumn("casual", F.greatest(F.lit(0), F.round(level * 0.2 + 6 * F.randn(seed + 6)).cast("int")))
    return df.withColumns({"cnt": F.col("casual") + F.col("registered"), "dteday": F.date_format("datetime", "yyyy-MM-dd")})


def synthetic_trips(spark: SparkSession, days: int = 42, stations: int = 12, seed: int = 42) -> DataFrame:
    """Rides by Poisson arrivals for each station and hour; counts invert the distribution, so no Python runs."""
    hours = spark.range(days * 24).select(F.col("id").cast("int").alias("h"))
    grid = hours.crossJoin(spark.range(stations).select(F.col("id").cast("int").alias("s")))
    start = F.expr("timestamp_ntz '2024-01-01 00:00:00'") + F.make_dt_interval(hours=F.col("h"))
    grid = grid.withColumn("hour", start)
    commute = (F.hour("hour").between(7, 9) | F.hour("hour").between(17, 19)) & (F.weekday("hour") < 5)
    rate = 0.6 + 1.8 * commute.cast("int") + 0.7 * (F.weekday("hour") >= 5).cast("int") + 0.05 * F.col("s")
    grid = grid.withColumns({"rate": rate, "u": F.rand(seed)})
    term = lambda k: F.exp(-F.col("rate")) * F.pow("rate", F.lit(k)) / F.factorial(F.lit(k))
    cdf, total = [], F.lit(0.0)
    for k in range(16):
        total = total + term(k)
        cdf.append(total)
    grid = grid.withColumn("n", F.size(F.filter(F.array(*cdf), lambda c: c < F.col("u"))))
    rides = grid.where("n > 0").withColumn("k", F.explode(F.sequence(F.lit(1), "n")))
    name = F.concat(F.lit("S"), F.lpad(F.col("s").cast("string"), 3, "0"))
    other = F.concat(F.lit("S"), F.lpad(F.pmod(F.xxhash64("h", "s", "k"), F.lit(stations)).cast("string"), 3, "0"))
    began = F.col("hour") + F.make_dt_interval(mins=F.pmod(F.xxhash64("k", "h", "s"), F.lit(60)).cast("int"))
    return rides.select(F.concat_ws("-", "h", "s", "k").alias("ride_id"), began.alias("started_at"), (began + F.expr("interval 11 minutes")).alias("ended_at"), name.alias("start_station_id"), other.alias("end_station_id"))


def synthetic_stations(spark: SparkSession, stations: int = 12) -> DataFrame:
    s = F.col("id").cast("int")
    name = F.concat(F.lit("S"), F.lpad(s.cast("string"), 3, "0"))
    return spark.range(stations).select(name.alias("station_short_name"), F.concat(F.lit("g"), s.cast("string")).alias("gbfs_station_id"), (40.7 + 0.01 * s).alias("station_lat"), (-74.0 + 0.01 * s).alias("station_lon"), (14 + s).alias("capacity"))
