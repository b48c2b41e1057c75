"""Operators over one order of all rows, without a task that sees all of them.

Rows are dealt out by ranges of the order key. What one range needs of the others is small and goes to it by itself: the
number of rows before it (two passes: counts by range, then numbers inside each), sums and last values before it, and the few
rows next to its borders, of which copies are sent along (halo rows) so that lags and trailing windows reach over them.
The borders come from a sample of keys. They steer only how even the ranges are: whatever they are, results are the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

#: Sampled keys for each range.
SAMPLED = 20
#: Rows for each range under which fewer ranges are made.
LEAST_ROWS = 1_000


class Ordered:
    """The rows of `df` in ascending order of the columns `order`, nulls first, in at most `parts` ranges.

    `df` is read more than once and must give the same rows each time. Rows that tie in `order` stay in one range, in any order
    among themselves: give columns that tell rows apart. An empty frame has no ranges and gives no rows.
    """

    def __init__(self, df: DataFrame, order: list[str], parts: int | None = None):
        self.df, self.order = df, order
        self.parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    @cached_property
    def total(self) -> int:
        return self.df.count()

    def _keys(self) -> list[tuple[Column, str]]:
        """The order's columns in a form whose text can be read back exactly, and its type."""
        kinds = {f.name: f.dataType for f in self.df.schema}
        out = []
        for c in self.order:
            if isinstance(kinds[c], T.TimestampType):
                out.append((F.unix_micros(c), "bigint"))
            elif isinstance(kinds[c], T.BinaryType):
                out.append((F.hex(c), "string"))
            else:
                out.append((F.col(c), kinds[c].simpleString()))
        return out

    @cached_property
    def _borders(self) -> list[Column]:
        keys = self._keys()
        parts = min(self.parts, math.ceil(self.total / LEAST_ROWS)) if self.parts > 1 else 1
        if parts < 2:
            return []
        share = min(1.0, SAMPLED * parts / self.total)
        names = [f"k{i}" for i in range(len(keys))]
        some = self.df.select(*[k.alias(n) for n, (k, _) in zip(names, keys)])
        some = (some.sample(share, seed=11) if share < 1 else some).orderBy(*names)
        found = [tuple(r) for r in some.select(*[F.col(n).cast("string") for n in names]).collect()]
        picked = list(dict.fromkeys(found[len(found) * i // parts] for i in range(1, parts) if found))
        value = lambda row: [F.lit(v).cast(kind) for v, (_, kind) in zip(row, keys)]
        return [F.struct(*[v.alias(n) for n, v in zip(names, value(row))]) for row in picked]

    @cached_property
    def rows(self) -> DataFrame:
        """df with _range, found by binary search among the borders."""
        borders = self._borders
        key = F.struct(*[k.alias(f"k{i}") for i, (k, _) in enumerate(self._keys())])

        def search(low: int, high: int) -> Column:
            if low == high:
                return F.lit(low)
            mid = (low + high) // 2
            return F.when(key < borders[mid], search(low, mid)).otherwise(search(mid + 1, high))

        return self.df.withColumn("_range", search(0, len(borders)))

    @property
    def _window(self) -> WindowSpec:
        return Window.partitionBy("_range").orderBy(*self.order)

    @cached_property
    def spans(self) -> list[tuple[int, int, int]]:
        """(range, rows before it, rows up to its end) of each range that has rows."""
        out, before = [], 0
        for r, n in sorted(tuple(x) for x in self.rows.groupBy("_range").agg(F.count("*")).collect()):
            out.append((r, before, before + n))
            before += n
        return out

    def _by_range(self, values: dict[int, object], kind: str) -> Column:
        """Of each row the value of its range."""
        each = [F.lit(values.get(r)).cast(kind) for r in range(len(self._borders) + 1)]
        return F.get(F.array(*each), F.col("_range"))

    def _numbered(self, name: str) -> DataFrame:
        before = self._by_range({r: a for r, a, _ in self.spans}, "long")
        return self.rows.withColumn(name, F.row_number().over(self._window) + before)

    def numbered(self, name: str = "row") -> DataFrame:
        """df with each row's number from 1."""
        return self._numbered(name).drop("_range")

    def running(self, sums: dict[str, str]) -> DataFrame:
        """df with, for each (name, column), the column's sum up to each row, the row included; null counts as 0."""
        kinds = dict(self.rows.agg(*[F.sum(c).alias(name) for name, c in sums.items()]).dtypes)
        found = sorted(self.rows.groupBy("_range").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast(kinds[n]).alias(n) for n, c in sums.items()]).collect(), key=lambda r: r["_range"])
        before = {name: {} for name in sums}
        for name in sums:
            total = None
            for r in found:
                before[name][r["_range"]] = total if total is not None else 0
                total = r[name] if total is None else total + r[name]
        upto = self._window.rowsBetween(Window.unboundedPreceding, 0)
        own = {name: (F.sum(F.coalesce(F.col(c), F.lit(0))).over(upto) + self._by_range(before[name], kinds[name])).cast(kinds[name]) for name, c in sums.items()}
        return self.rows.withColumns(own).drop("_range")

    def windowed(self, columns: dict[str, Callable[[WindowSpec], Column]], before: int = 0, after: int = 0) -> DataFrame:
        """df with columns over windows in this order that reach back over `before` rows and on over `after` rows at most.

        Each function gets the ordered window specification. A row is copied to each range that its number is within reach of, so
        windows are whole even where many ranges are shorter than they are.
        """
        numbered = self._numbered("_row")
        span = [F.struct(F.lit(r).alias("r"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for r, a, b in self.spans]
        if len(span) > 1:
            row, own = F.col("_row"), F.col("_range")
            start, end = (self._by_range({s[0]: s[k] for s in self.spans}, "long") for k in (1, 2))
            near = (row > end - before) | (row <= start + after)
            behind = lambda s: (row <= s["a"]) & (row > s["a"] - before)
            ahead = lambda s: (row > s["b"]) & (row <= s["b"] + after)
            others = F.transform(F.filter(F.array(*span), lambda s: (s["r"] != own) & (behind(s) | ahead(s))), lambda s: s["r"])
            numbered = numbered.withColumn("_to", F.explode(F.when(near, F.concat(F.array("_range"), others)).otherwise(F.array("_range"))))
        else:
            numbered = numbered.withColumn("_to", F.col("_range"))
        w = Window.partitionBy("_to").orderBy("_row")
        out = numbered.withColumns({name: make(w) for name, make in columns.items()})
        return out.where(F.col("_to") == F.col("_range")).drop("_to", "_range", "_row")

    def filled(self, columns: list[str]) -> DataFrame:
        """df with nulls of the columns replaced by the last value before them, or else the first after."""
        key = F.struct(*self.order)
        ends = [f(F.struct(c), F.when(F.col(c).isNotNull(), key)).alias(f"{k}_{i}") for i, c in enumerate(columns) for k, f in (("last", F.max_by), ("first", F.min_by))]
        found = {r["_range"]: r for r in self.rows.groupBy("_range").agg(*ends).collect()}
        carried = []
        for i, c in enumerate(columns):
            back, ahead = {}, {}
            for keys, side, out in ((sorted(found), "last", back), (sorted(found, reverse=True), "first", ahead)):
                kept = None
                for r in keys:
                    out[r] = kept
                    value = found[r][f"{side}_{i}"]
                    kept = kept if value is None else value[0]
            carried.append((back, ahead))
        kinds = {f.name: f.dataType for f in self.df.schema}
        schema = T.StructType([T.StructField("_range", T.IntegerType())] + [T.StructField(f"_{k}_{i}", kinds[c]) for i, c in enumerate(columns) for k in ("back", "ahead")])
        data = [(r, *[x for back, ahead in carried for x in (back[r], ahead[r])]) for r in found]
        rows = self.rows.join(F.broadcast(self.df.sparkSession.createDataFrame(data, schema)), "_range")
        back, on = self._window.rowsBetween(Window.unboundedPreceding, 0), self._window.rowsBetween(0, Window.unboundedFollowing)
        new = {c: F.coalesce(F.last(c, True).over(back), F.col(f"_back_{i}"), F.first(c, True).over(on), F.col(f"_ahead_{i}")) for i, c in enumerate(columns)}
        return rows.withColumns(new).select(*self.df.columns)
