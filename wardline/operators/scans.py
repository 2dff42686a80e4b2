"""Scans along the rows of a key in order, composed of cells.

A window over a whole key puts all its rows into one task. Here a key's time is cut into cells of fixed width. Every
cell is scanned by itself; what it does to the scan is summed up in one row; the rows of a key's cells, one a cell
whatever its number of records, are scanned in turn; and what a cell is entered with is joined to its rows. So the largest
group is a cell of a key. Rows without a time are a cell before all others; a null key is a key.

Cells cost a second pass and a join, so keys of bounded size are scanned whole: ``split_keys`` parts them from the large
ones, and without ``seconds`` ``numbered_runs`` and ``recent_counts`` are plain windows.

Every function takes ``rows`` with the columns ``by`` (the key), ``time`` and ``order``, which must tell rows of a key apart, and
starts with ``time``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.scalars import flag
from wardline.storage import materialise

WHOLE = 100_000  # rows of a key that one task scans at once
KEY, CELL = "_scan_key", "_scan_cell"


def split_keys(rows: DataFrame, by: list[str], most: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the keys of at most ``most`` rows (WHOLE), and those of the others; None where there are no others."""
    large = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > (most or WHOLE))
    large = materialise(large.select(F.struct(*by).alias("_large")), "large-keys")  # few: each has more than ``most`` rows
    if large.isEmpty():
        return rows, None
    x = rows.withColumn(KEY, F.struct(*by))
    few, many = (x.join(large, F.col(KEY) == F.col("_large"), how).drop(KEY) for how in ("left_anti", "left_semi"))
    return few, many


def over_cells():
    """Window over the cells of a key."""
    return Window.partitionBy(KEY).orderBy(CELL)


def before():
    """The cells before a cell."""
    return over_cells().rowsBetween(Window.unboundedPreceding, -1)


def in_cells(rows: DataFrame, by: list[str], time: str, seconds: float) -> DataFrame:
    """Add the key as a struct (never null, so that it joins by equality) and the number of the cell."""
    cell = F.floor(F.unix_micros(time) / int(seconds * 1_000_000)).cast("long")
    return rows.withColumns({KEY: F.struct(*by), CELL: F.coalesce(cell, F.lit(-(1 << 62)))})


def in_order(order: list[str], backwards: bool = False):
    """Window over the rows of a cell."""
    return Window.partitionBy(KEY, CELL).orderBy(*(F.desc(c) if backwards else F.asc(c) for c in order))


def entered(x: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows with what their cells are entered with."""
    return x.join(cells, [KEY, CELL])


def done(x: DataFrame, *also: str) -> DataFrame:
    return x.drop(KEY, CELL, *also)


def numbered_runs(rows: DataFrame, by: list[str], order: list[str], carry: list[str], cut: Callable[[Column, Column], Column], name: str, seconds: float | None, start_of: str | None = None) -> DataFrame:
    """Add ``name``: the number, from 0, of the run a row is in, and ``_prev``: the columns ``carry`` of the row before (null for the key's first).

    A row starts a run where ``cut(row before, row)``, given both as structs of ``carry``, is true. With ``start_of`` (a column of
    ``carry``) also ``name``_start: that column of the run's first row. Without ``seconds`` a key is scanned whole.
    """
    here = F.struct(*carry)
    if seconds is None:
        whole = Window.partitionBy(*by).orderBy(*order)
        upto = whole.rowsBetween(Window.unboundedPreceding, 0)
        x = rows.withColumns({"_prev": F.lag(here).over(whole), "_here": here})
        x = x.withColumn("_cut", F.when(F.col("_prev").isNotNull(), flag(cut(F.col("_prev"), F.col("_here")))).otherwise(0))
        x = x.withColumn(name, F.sum("_cut").over(upto))
        if start_of:
            first = F.when((F.col("_cut") == 1) | F.col("_prev").isNull(), F.col(f"_here.{start_of}"))
            x = x.withColumn(f"{name}_start", F.last(first, True).over(upto))
        return x.drop("_here", "_cut")
    w = in_order(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    x = in_cells(rows, by, order[0], seconds).withColumns({"_inner": F.lag(here).over(w), "_here": here})
    x = x.withColumn("_cut", F.when(F.col("_inner").isNotNull(), flag(cut(F.col("_inner"), F.col("_here")))).otherwise(0))
    at = F.struct(*order)
    new = F.when(F.col("_cut") == 1, F.col(f"_here.{start_of}")) if start_of else F.lit(None)
    cells = x.groupBy(KEY, CELL).agg(
        F.min_by("_here", at).alias("_first"), F.max_by("_here", at).alias("_last"), F.sum("_cut").alias("_cuts"), F.max_by(new, F.when(F.col("_cut") == 1, at)).alias("_start"),
    )
    cells = cells.withColumn("_outer", F.lag("_last").over(over_cells()))
    cells = cells.withColumn("_enter", F.when(F.col("_outer").isNotNull(), flag(cut(F.col("_outer"), F.col("_first")))).otherwise(0))
    if start_of:
        cells = cells.withColumn("_opened", F.when((F.col("_enter") == 1) | F.col("_outer").isNull(), F.col(f"_first.{start_of}")))
        cells = cells.withColumn("_open", F.coalesce("_opened", F.last(F.coalesce("_start", "_opened"), True).over(before())))
    base = F.coalesce(F.sum(F.col("_cuts") + F.col("_enter")).over(before()), F.lit(0)) + F.col("_enter")
    cells = cells.select(KEY, CELL, "_outer", base.cast("long").alias("_base"), *(["_open"] if start_of else []))
    x = entered(x, cells).withColumns({name: F.col("_base") + F.sum("_cut").over(upto), "_prev": F.coalesce("_inner", "_outer")})
    if start_of:
        x = x.withColumn(f"{name}_start", F.coalesce(F.last(new, True).over(upto), F.col("_open")))
    return done(x, "_inner", "_outer", "_here", "_cut", "_base", "_open")


def filled(rows: DataFrame, by: list[str], order: list[str], value: str, name: str, seconds: float, backwards: bool = False) -> DataFrame:
    """Add ``name``: the last non-null ``value`` up to the row, the row included; ``backwards``: the next one from the row on."""
    x, at = in_cells(rows, by, order[0], seconds), F.when(F.col(value).isNotNull(), F.struct(*order))
    over = Window.partitionBy(KEY).orderBy(F.desc(CELL)).rowsBetween(Window.unboundedPreceding, -1) if backwards else before()
    cells = x.groupBy(KEY, CELL).agg((F.min_by if backwards else F.max_by)(value, at).alias("_v"))
    cells = cells.select(KEY, CELL, F.last("_v", True).over(over).alias("_carried"))
    near = F.last(value, True).over(in_order(order, backwards).rowsBetween(Window.unboundedPreceding, 0))
    return done(entered(x, cells).withColumn(name, F.coalesce(near, "_carried")), "_carried")


def counted(rows: DataFrame, by: list[str], order: list[str], name: str, seconds: float) -> DataFrame:
    """Add ``name``: the number of the key's rows before the row."""
    x = in_cells(rows, by, order[0], seconds)
    cells = x.groupBy(KEY, CELL).agg(F.count(F.lit(1)).alias("_n"))
    cells = cells.select(KEY, CELL, F.coalesce(F.sum("_n").over(before()), F.lit(0)).alias("_carried"))
    return done(entered(x, cells).withColumn(name, F.col("_carried") + F.row_number().over(in_order(order)) - 1), "_carried")


def last_rows(rows: DataFrame, by: list[str], order: list[str], value: Column, n: int, name: str, seconds: float) -> DataFrame:
    """Add ``name``: the structs ``value`` of the ``n`` rows before the row, oldest first. At most n rows of a cell are carried."""
    x = in_cells(rows, by, order[0], seconds).withColumn("_v", value)
    tail = x.withColumn("_r", F.row_number().over(in_order(order, backwards=True))).filter(F.col("_r") <= n)
    cells = tail.groupBy(KEY, CELL).agg(F.sort_array(F.collect_list(F.struct((-F.col("_r")).alias("r"), "_v"))).alias("_t"))
    cells = cells.select(KEY, CELL, F.flatten(F.collect_list("_t").over(over_cells().rowsBetween(-n, -1))).alias("_t"))
    cells = cells.select(KEY, CELL, F.transform(F.slice(F.reverse("_t"), 1, n), lambda t: t["_v"]).alias("_carried"))  # the newest first
    near = F.collect_list("_v").over(in_order(order).rowsBetween(-n, -1))
    x = entered(x, cells).withColumn("_near", near)
    return done(x.withColumn(name, F.reverse(F.slice(F.concat(F.reverse("_near"), "_carried"), 1, n))), "_v", "_near", "_carried")


def recent_counts(rows: DataFrame, by: list[str], time: str, spans: dict[str, float], seconds: float | None) -> DataFrame:
    """Add for each name of ``spans`` the key's rows in the closed stretch of so many seconds that ends at the row.

    A cell gets a copy of the rows of the end of the cell before, as far back as the longest span. Rows must have a time.
    Without ``seconds`` a key is scanned whole.
    """
    if seconds is None:
        over = f"OVER (PARTITION BY {', '.join(by)} ORDER BY {time} RANGE BETWEEN INTERVAL '%d' MICROSECONDS PRECEDING AND CURRENT ROW)"
        return rows.withColumns({c: F.expr(f"count(1) {over % int(s * 1_000_000)}") for c, s in spans.items()})
    cell = max(seconds, *spans.values())
    us, reach = F.unix_micros(time), int(max(spans.values()) * 1_000_000)
    x = in_cells(rows, by, time, cell).withColumns({"_us": us, "_own": F.lit(True)})
    near = (F.col(CELL) + 1) * int(cell * 1_000_000) - F.col("_us") <= reach
    copies = x.filter(near).select(KEY, (F.col(CELL) + 1).alias(CELL), "_us", F.lit(False).alias("_own"))
    both = x.unionByName(copies, allowMissingColumns=True)
    w = Window.partitionBy(KEY, CELL).orderBy("_us")
    both = both.withColumns({c: F.count(F.lit(1)).over(w.rangeBetween(-int(s * 1_000_000), 0)) for c, s in spans.items()})
    return done(both.filter("_own"), "_us", "_own")
