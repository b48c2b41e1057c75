"""Sinks: tables, one-row summaries, latest-and-log pairs, and small text tables."""

from __future__ import annotations

import json
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Threads that move snapshots to their names.
MOVERS = 8


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below the one that the session names in spark.checkpoint.dir; a temporary one only where that is unset and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tidegauge-")
    return f"{named.rstrip('/')}/tidegauge-{uuid.uuid4().hex}"


def kept_rows(df: DataFrame) -> DataFrame:
    """df written to a shared folder and read again, so that what comes after doesn't make it anew."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def to_snapshots(df: DataFrame, folder: str, stamp: str, suffix: str = "_inventory_snapshot.csv") -> int:
    """A CSV file with a header for each value of the column `stamp`, named by it, beside what the folder has; nulls are empty. Gives the number of files.

    A snapshot is one capture and goes through one task; snapshots are written side by side, in as many tasks as the session shuffles
    to or has cores, however few their bytes, and moved to their names by several threads.
    """
    spark = df.sparkSession
    put = f"{folder.rstrip('/')}/_put-{uuid.uuid4().hex}"
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # The second commit algorithm moves files in the tasks; nobody reads below `put`, so it needn't appear at once.
    out = df.repartition(tasks, stamp).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    out.partitionBy(stamp).csv(put, header=True, quote='"', escape='"', emptyValue="", nullValue="")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path
    fs = path(put).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = hadoop.FileUtil.stat2Paths(fs.globStatus(path(f"{put}/{stamp}=*/part-*")))

    def moved(k: int) -> None:
        name = parts[k].toString().rsplit("/", 2)[1].partition("=")[2]
        fs.rename(parts[k], path(f"{folder.rstrip('/')}/{name}{suffix}"))

    with ThreadPoolExecutor(MOVERS) as pool:
        made = sum(1 for _ in pool.map(moved, range(len(parts))))
    fs.delete(path(put), True)
    return made


def to_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    df.write.mode("overwrite").partitionBy(*(by or [])).parquet(path)


def to_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """A header and the given columns in order; nulls are empty."""
    (df.select(*columns) if columns else df).write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="")


def sample_to_csv(df: DataFrame, path: str, order: list, rows: int = 200) -> None:
    to_csv(df.orderBy(*order).limit(rows), path)


def summary_json(one_row: DataFrame, path: str) -> dict:
    """A one-row frame as a JSON object in a file; NaN and infinities become null."""
    found = json.loads(one_row.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0])
    found = {k: None if v in ("NaN", "Infinity", "-Infinity") else v for k, v in found.items()}
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(found, ensure_ascii=False, indent=2), encoding="utf-8")
    return found


def latest_and_log(df: DataFrame, latest: str, log: str, stamp: str) -> None:
    """The same snapshot in place of the latest and added to the log, by its date. For readers that may come in between, or runs that may end there, see `publish`."""
    df.write.mode("overwrite").parquet(latest)
    day = f"{stamp[:4]}-{stamp[4:6]}-{stamp[6:8]}"
    df.withColumns({"captured_stamp": F.lit(stamp), "captured_date": F.lit(day)}).write.mode("append").partitionBy("captured_date").parquet(log)


def _swapped(spark: SparkSession, path: str, text: str) -> None:
    """The text in place of a file's, at once: readers see the old text or the new."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, put = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.{uuid.uuid4().hex}"))
    out = put.getFileSystem(conf).create(put)
    out.write(bytearray(text, "utf-8"))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(put.toUri(), conf).rename(put, target, over)


def _current(spark: SparkSession, folder: str) -> str | None:
    found = spark.read.option("wholetext", True).text(f"{folder}/latest").collect() if exists(spark, f"{folder}/latest") else []
    return found[0][0] if found else None


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def publish(df: DataFrame, folder: str, stamp: str) -> None:
    """A snapshot into the log, by its date and stamp, and then as the latest: a pointer is swapped once the snapshot is whole.

    A run that ends before the swap leaves the old latest readable, and a run again takes its own snapshot's place. A stamp
    before the latest one joins the log alone.
    """
    spark, day = df.sparkSession, f"{stamp[:4]}-{stamp[4:6]}-{stamp[6:8]}"
    df.write.mode("overwrite").parquet(f"{folder}/log/captured_date={day}/captured_stamp={stamp}")
    now = _current(spark, folder)
    if now is None or now <= stamp:
        _swapped(spark, f"{folder}/latest", stamp)


def published(spark: SparkSession, folder: str, stamps: bool = False) -> DataFrame:
    """The latest snapshot of `publish`; with `stamps` the whole log, with captured_date and captured_stamp as text."""
    log = spark.read.option("basePath", f"{folder}/log")
    if stamps:
        return spark.read.parquet(f"{folder}/log").withColumns({c: F.col(c).cast("string") for c in ("captured_date", "captured_stamp")})
    now = _current(spark, folder)
    if now is None:
        raise FileNotFoundError(f"nothing is published in {folder}")
    return log.parquet(f"{folder}/log/captured_date={now[:4]}-{now[4:6]}-{now[6:8]}/captured_stamp={now}").drop("captured_date", "captured_stamp")


def markdown_table(df: DataFrame, digits: int = 4, rows: int = 100) -> str:
    """An aligned text table of the first rows; nulls and NaN are blank."""

    def text(v) -> str:
        if v is None or v != v:
            return ""
        return f"{v:.{digits}f}" if isinstance(v, float) else str(v)

    cells = [df.columns, *[[text(v) for v in r] for r in df.limit(rows).collect()]]
    widths = [max(3, *(len(r[i]) for r in cells)) for i in range(len(df.columns))]
    line = lambda r: "| " + " | ".join(c.ljust(w) for c, w in zip(r, widths)) + " |"
    return "\n".join([line(cells[0]), "|" + "|".join("-" * (w + 2) for w in widths) + "|", *map(line, cells[1:])])


def report(path: str, title: str, values: dict, tables: dict[str, DataFrame], rows: int = 100) -> None:
    """A text report: a title, a line for each value, and the first rows of each table."""
    parts = [f"# {title}", "\n".join(f"- {k}: {'' if v is None else v}" for k, v in values.items())]
    parts += [f"## {name}\n\n{markdown_table(df, rows=rows)}" for name, df in tables.items()]
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text("\n\n".join(p for p in parts if p) + "\n", encoding="utf-8")
