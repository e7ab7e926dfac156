"""Mixing sources to target weights by weighted fair queueing; DataFrame functions only.

* **Targets.** Sources in code-point order (null last) take the weights in turn and
  share ``share`` of all sizes; a target stops at ``repeat`` times its source's size
  and the rest is shared again by weight until no target is above.
* **Finish times.** Documents of a source stand in the order of a hash of their id.
  A document's virtual finish time is the cumulative size of its source up to and
  with it, divided by the source's target; its second copy comes one source size
  later. Sources that hold a third of all rows are cut into ranges of the hash
  whose sums are added up first, so no window meets more than a range.
* **Mix.** All copies sorted by finish time, cut where their sizes reach the budget.
  The cut is found on sums per range of finish time, narrowed until the one range
  that it falls into is small enough for a window.

Defined results: null or wordless texts have size 0 and are never taken; null sources
are one source; a null id hashes like an empty one. Documents of equal hash follow
by id and size. Rows that repeat an id are documents of their own. Empty table or only
empty texts: targets 0, nothing taken. Other columns are ignored.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volpanel.sources.stage import stage

WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a window over a range of a source or of finish times meets, ranges per narrowing step, and
#: hex digits of the hash that can cut a source's order.
RANGE_ROWS, WINDOW_ROWS, FAN, DIGITS = 1_000, 20_000, 1024, 7


def sizes(docs: DataFrame, key: str, source: str, text: str, seed: str) -> DataFrame:
    """key, source, size and the hash that shuffles a source."""
    return docs.select(F.col(key).alias("key"), F.col(source).alias("source"),
                       F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                       F.md5(F.concat(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary")).alias("h"))


def ranked(df: DataFrame) -> DataFrame:
    """``df`` (column source) with its position from 0 in code-point order, null last: row numbers inside the
    partitions of a range sort, plus the rows of the partitions before."""
    low = (1 << 33) - 1
    rows = stage(df.orderBy(F.col("source").asc_nulls_last()).withColumn("i", F.monotonically_increasing_id())
                 .withColumns({"part": F.shiftright("i", 33), "inside": F.col("i").bitwiseAND(low)}), "ranked")
    parts = rows.groupBy("part").agg(F.count("*").alias("n"))  # one row per partition
    before = parts.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "before")
    return rows.join(before, "part").withColumn("position", F.col("before") + F.col("inside")).drop("i", "part", "inside", "before")


def targets(rows: DataFrame, weights: tuple[int, ...], share: float, repeat: int) -> DataFrame:
    """One row per source: source, position, source_size, n, target."""
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("position") % len(weights) + 1).cast("int"))
    table = stage(ranked(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))).withColumn("w", w), "sources")
    total = table.agg(F.sum("source_size"), F.sum("w")).first()
    level, capped = (share * total[0] / total[1] if total[1] else 0.0), 0
    while total[1]:
        above = F.lit(level) * F.col("w") > repeat * F.col("source_size")
        c = table.agg(F.coalesce(F.sum(F.when(above, F.col("source_size"))), F.lit(0)), F.sum(F.when(~above, F.col("w"))), F.count(F.when(above, 1))).first()
        if c[2] == capped or not c[1]:
            break
        level, capped = (share * total[0] - repeat * c[0]) / c[1], c[2]
    return table.withColumn("target", F.least(F.lit(level) * F.col("w"), (repeat * F.col("source_size")).cast("double"))).drop("w")


def finish_times(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows of positive size with ``done``: cumulative size of the source's order, themselves included."""
    most = sources.agg(F.max("n")).first()[0] or 1
    ranges = min(16 ** DIGITS, -(-most // RANGE_ROWS))
    cut = F.floor(F.conv(F.substring("h", 1, DIGITS), 16, 10).cast("long") * ranges / 16 ** DIGITS)
    rows = (rows.where("size > 0").join(sources.select(F.col("source").alias("s"), "position", "source_size", "target"), F.col("source").eqNullSafe(F.col("s")))
            .drop("s").withColumn("cut", cut))
    sums = rows.groupBy("position", "cut").agg(F.sum("size").alias("sum"))
    before = sums.withColumn("before", F.sum("sum").over(Window.partitionBy("position").orderBy("cut")) - F.col("sum")).drop("sum")
    inside = F.sum("size").over(Window.partitionBy("position", "cut").orderBy("h", "key", "size").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("inside", inside).join(before, ["position", "cut"]).withColumn("done", F.col("before") + F.col("inside")).drop("inside", "before", "cut")


def copies(rows: DataFrame, repeat: int) -> DataFrame:
    """One row per possible copy: its number and finish time."""
    return (rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1))))
            .withColumn("finish", (F.col("done") + F.col("copy") * F.col("source_size")) / F.col("target")))


def cut_point(rows: DataFrame, budget: float, repeat: int):
    """(finish, position, copy) of the last copy inside the budget, in the global order; None if there is none."""
    all_ = copies(rows.select("position", "source_size", "target", "size", "done"), repeat)
    lo, hi = 0.0, all_.agg(F.max("finish")).first()[0]
    if hi is None:
        return None
    hi, spent = hi * (1 + 1e-9), 0
    while True:
        step = (hi - lo) / FAN
        inside = (F.col("finish") >= lo) & (F.col("finish") < hi)
        place = F.least(F.floor((F.col("finish") - lo) / step), F.lit(FAN - 1))
        sums = {r["b"]: (r["s"], r["n"], r["lo"], r["hi"]) for r in all_.where(inside).groupBy(place.alias("b"))
                .agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.min("finish").alias("lo"), F.max("finish").alias("hi")).collect()}
        for b in sorted(sums):
            if spent + sums[b][0] > budget:
                break
            spent += sums[b][0]
        else:
            return float("inf"), 0, 0
        s, n, first, last = sums[b]
        if n <= WINDOW_ROWS or first == last or (lo, hi) == (first, last):
            order = Window.orderBy("finish", "position", "copy", "done")  # at most WINDOW_ROWS rows, or one per source and copy
            fits = (all_.where((F.col("finish") >= first) & (F.col("finish") <= last))
                    .withColumn("sum", F.lit(spent) + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("sum") <= budget)
                    .agg(F.max(F.struct("finish", "position", "copy"))).first()[0])
            return tuple(fits) if fits else (first, -1, -1)
        lo, hi = first, last * (1 + 1e-15) if last else last
        hi = max(hi, last + step * 1e-6)


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = (3, 1, 2),
        share: float = 1.5, repeat: int = 2, seed: str = "mix") -> DataFrame:
    """One row per document: ``key``, ``size``, ``source_size``, ``target``, ``copies`` taken, ``taken`` words and
    ``finish`` (virtual time of its first copy; null for size 0)."""
    rows = stage(sizes(docs, key, source, text, seed), "sizes")
    sources = stage(targets(rows, weights, share, repeat), "targets")
    timed = stage(finish_times(rows, sources), "timed")
    budget = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    cut = cut_point(timed, budget, repeat)

    def taken(n: int) -> Column:
        f, at = (F.col("done") + n * F.col("source_size")) / F.col("target"), F.lit(n)
        return F.when(F.struct(f.alias("f"), F.col("position").alias("p"), at.alias("c")) <=
                      F.struct(F.lit(cut[0]).alias("f"), F.lit(cut[1]).cast("long").alias("p"), F.lit(cut[2]).alias("c")), 1).otherwise(0)

    number = sum((taken(n) for n in range(repeat)), F.lit(0)) if cut else F.lit(0)
    used = timed.select("key", "size", "source_size", "target", number.alias("copies"), (F.col("done") / F.col("target")).alias("finish"))
    idle = (rows.where("size = 0").join(sources.select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s")))
            .select("key", "size", "source_size", "target", F.lit(0).alias("copies"), F.lit(None).cast("double").alias("finish")))
    return used.union(idle).select(F.col("key").alias(key), "size", "source_size", "target", "copies",
                                   (F.col("copies") * F.col("size")).alias("taken"), "finish")
