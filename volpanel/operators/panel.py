"""Row numbers, chunks and running sums over a panel of any shape.

Row position inside a series is the time index (horizons, embargoes and lags
count rows). No window here runs over a whole series: rows are numbered in two
levels (inside a year, plus the counts of earlier years), and bounded windows
run over chunks of ``CHUNK_ROWS`` rows that carry a copy of the neighbouring
rows they need. A series that holds a third of the panel is therefore spread
over as many tasks as it has chunks, and results stay exact.
"""

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK_ROWS = 8192


def number_rows(df: DataFrame, keys=("series_id",), time="obs_date") -> DataFrame:
    """Add ``year`` and the zero-based ``row_no`` of each row in its series."""
    keys = list(keys)
    rows = df.withColumn("year", F.year(time))
    before = Window.partitionBy(*keys).orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy(*keys, "year").agg(F.count(F.lit(1)).alias("_n"))
               .select(*keys, "year", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    in_year = Window.partitionBy(*keys, "year").orderBy(time)
    return (rows.join(offsets, [*keys, "year"])
            .withColumn("row_no", (F.col("_before") + F.row_number().over(in_year) - 1).cast("long"))
            .drop("_before"))


def add_chunks(df: DataFrame, back: int, ahead: int = 0, rows: int | None = None) -> DataFrame:
    """Give each row its chunk and copy it to the neighbours whose windows reach it.

    ``back`` and ``ahead`` are the rows a window may look behind and ahead. The
    copies have ``_core = false`` and are dropped by :func:`core_rows`. The chunk
    is never shorter than the reach, so one neighbour on each side is enough.
    """
    rows = max(rows or CHUNK_ROWS, back, ahead, 1)
    own = F.floor(F.col("row_no") / rows).cast("long")
    pos = F.col("row_no") % rows
    homes = [own]
    if back:
        homes.append(F.when(pos >= rows - back, own + 1))
    if ahead:
        homes.append(F.when(pos < ahead, own - 1))
    return (df.withColumn("_chunk", F.explode(F.array_compact(F.array(*homes))))
            .withColumn("_core", F.col("_chunk") == own))


def chunk_window(keys=("series_id",)) -> WindowSpec:
    """The ordered window all bounded-frame features share: one exchange, one sort."""
    return Window.partitionBy(*keys, "_chunk").orderBy("row_no")


def core_rows(df: DataFrame) -> DataFrame:
    return df.filter("_core").drop("_chunk", "_core")


def full_frame(agg: Column, counted: Column, w: WindowSpec, size: int) -> Column:
    """``agg`` over ``w``, NULL unless all ``size`` values of the frame are present."""
    return F.when(F.count(counted).over(w) == size, agg.over(w))


def decay_block(decay: float) -> int:
    """Rows after which a weight ``decay**n`` is below the rounding of a double."""
    return max(2, math.ceil(40.0 / -math.log(decay)))


def decayed_sums(df: DataFrame, inputs: dict[str, tuple[Column, float]], keys=("series_id",)) -> DataFrame:
    """Add ``out_t = sum_i decay**i * x_(t-i)`` for each ``out: (x, decay)``.

    The linear recursion ``out_t = x_t + decay*out_(t-1)`` without a row loop: a
    running sum of ``x * decay**-position`` inside blocks, plus the end value of
    the block before. One block length, set by the slowest decay, serves all, so
    any number of sums costs one extra sort. Whatever lies further back weighs
    less than 4e-18. Needs chunks with ``back >= 2*decay_block(slowest)``.
    """
    size = max(decay_block(d) for _, d in inputs.values())
    if size * -math.log(min(d for _, d in inputs.values())) > 600:
        raise ValueError("decays lie too far apart for one block length; sum them in two calls")
    pos = F.col("row_no") % size
    local = Window.partitionBy(*keys, "_chunk", "_blk").orderBy("row_no").rowsBetween(
        Window.unboundedPreceding, 0)
    past = chunk_window(keys).rowsBetween(Window.unboundedPreceding, -1)
    decays = sorted({d for _, d in inputs.values()})
    up = {d: f"_u{i}" for i, d in enumerate(decays)}
    down = {d: f"_d{i}" for i, d in enumerate(decays)}
    df = df.withColumns({
        "_blk": F.floor(F.col("row_no") / size),
        **{up[d]: F.exp(-math.log(d) * pos) for d in decays},
        **{down[d]: F.exp(math.log(d) * pos) for d in decays}})
    df = df.withColumns({f"_l_{n}": F.sum(x * F.col(up[d])).over(local) * F.col(down[d])
                         for n, (x, d) in inputs.items()})
    ends = F.struct(*[F.col(f"_l_{n}").alias(n) for n in inputs])
    df = df.withColumn("_end", F.last(F.when(pos == size - 1, ends), ignorenulls=True).over(past))
    df = df.withColumns({
        n: F.col(f"_l_{n}") + float(d) * F.col(down[d]) * F.coalesce(F.col(f"_end.{n}"), F.lit(0.0))
        for n, (_, d) in inputs.items()})
    return df.drop("_blk", "_end", *up.values(), *down.values(), *[f"_l_{n}" for n in inputs])


def running_sum(df: DataFrame, inputs: dict[str, str], keys, order="row_no",
                rows: int | None = None) -> DataFrame:
    """Running total of each input from the first row of the key, in two levels.

    Sums run inside blocks of ``order`` values; block totals are few and carry
    the total of all earlier blocks.
    """
    keys = list(keys)
    rows = rows or CHUNK_ROWS
    df = df.withColumn("_blk", F.floor(F.col(order) / rows))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, "_blk").agg(*[F.sum(x).alias(f"_t_{n}") for n, x in inputs.items()])
    carry = totals.select(*keys, "_blk", *[
        F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in inputs])
    local = Window.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.join(carry, [*keys, "_blk"])
    return df.withColumns({
        n: F.coalesce(F.sum(x).over(local), F.lit(0)) + F.col(f"_c_{n}") for n, x in inputs.items()
    }).drop("_blk", *[f"_c_{n}" for n in inputs])


def running_min(df: DataFrame, column: str, out: str, keys, order: str, block: Column,
                suffix: bool = False) -> DataFrame:
    """Prefix (or suffix) minimum in two levels; ``block`` must be monotone in ``order``."""
    keys = list(keys)
    df = df.withColumn("_blk", block)
    span = (1, Window.unboundedFollowing) if suffix else (Window.unboundedPreceding, -1)
    own = (0, Window.unboundedFollowing) if suffix else (Window.unboundedPreceding, 0)
    others = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(*span)
    carry = (df.groupBy(*keys, "_blk").agg(F.min(column).alias("_m"))
             .select(*keys, "_blk", F.min("_m").over(others).alias("_c")))
    local = Window.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(*own)
    return (df.join(carry, [*keys, "_blk"])
            .withColumn(out, F.least(F.min(column).over(local), F.col("_c")))
            .drop("_blk", "_c"))
