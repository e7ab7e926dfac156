"""N-gram Jaccard join: size-aware heavy-light set join, the classes it links and each set's number of links.

A document's set holds its distinct word shingles. Two sets link when
``100 * intersection >= percent * union``. Identical sets are one class from the
start; the join works on one row per distinct set.

* **Light sets** (at most ``boundary`` shingles) enumerate subsets. Sets of sizes
  a <= b link exactly when they share a subset of c(a, b) shingles, the overlap
  they need, so each set emits its c(a, b)-subsets for every partner size.
* **Heavy sets** scan inverted lists. Shingles are ordered by rarity (frequent
  ones by count, then by hash); a partner must share SHARED of the first
  ``n - ceil(percent * n) + SHARED``, and length and position bound the overlap.
* The **boundary** minimises the summed cost over the histogram of set sizes.

Classes come first. In each list every set is compared with the one whose rare part
is shortest; verified links are contracted to components. Only sets that are still
in different components are then compared with each other, those outside a list's
largest component against the whole list. A pair that both steps leave out lies
inside one component already, so no class is lost.

Links come second. All of them lie inside components, so all pairs of a component's
sets are compared: the sets are read once more and dealt over blocks of bounded size,
and of each two blocks (and within each) overlaps are counted by scanning inverted
lists. Pairs are counted, not written.

Sets are named by a 64-bit hash of their content; two different sets share a
name with probability below (number of sets)^2 / 2^65.

Defined results: null text or no words: no shingles, linked with nothing, its own
class. Fewer words than ``width``: the whole sequence is the one shingle. Repeated
rows each keep their row. A null id gets the smallest id of its class. Empty
table: no rows. Other columns are ignored.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volpanel.llm.common import as_batch, binaries, components, mix, most_frequent, per_batch, shingle_set, slices
from volpanel.sources.stage import stage

#: Shingles kept in the table of frequent ones; it decides the order only, never the result.
FREQUENT = 1 << 19
#: Shingles that a task counts at a time to find frequent ones.
RUN_SHINGLES = 4_000_000
#: Relative costs: a row of a list or subset, and reading a candidate's set for the check, per shingle.
ROW_COST, READ_COST = 1, 2
#: Common shingles that a pair must show in its lists (fewer where so few suffice to link): the
#: first SHARED common ones of a linked pair lie in both prefixes, so a chance meeting is no candidate.
SHARED = 3
#: Ids, of eight bytes each, that may be broadcast to pick the candidates' texts.
BROADCAST_IDS = 4_000_000
#: Shingles of the sets that are compared with each other, or with as many others, in one group.
BLOCK_SHINGLES = 1 << 19
#: Sizes up to which subsets are considered at all.
LIGHT_LIMIT = 24


def needed(a, b, percent: int):
    """Least overlap of linked sets of sizes ``a`` and ``b`` (numbers or columns)."""
    if isinstance(a, int):
        return -(-percent * (a + b) // (100 + percent))
    return F.ceil(percent * (a + b) / F.lit(100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return min(n, n - -(-percent * n // 100) + SHARED)


def partners(n: int, percent: int) -> range:
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def subset_keys(n: int, limit: int, percent: int) -> list[tuple[int, int, int]]:
    """(smaller size, larger size, subset size) for partners of at most ``limit``; equal sets need none."""
    out = []
    for p in partners(n, percent):
        lo, hi = min(n, p), max(n, p)
        c = needed(lo, hi, percent)
        if hi <= limit and not (lo == hi == c):
            out.append((lo, hi, c))
    return out


def choose_boundary(histogram: dict[int, int], percent: int) -> int:
    """The light limit of least total cost; ``histogram``: sets by size, up to LIGHT_LIMIT."""
    from math import comb

    def cost(limit: int) -> int:
        total = 0
        for n, count in histogram.items():
            if n <= limit:
                total += count * sum(comb(n, c) * ROW_COST for _, _, c in subset_keys(n, limit, percent))
            if n > limit or partners(n, percent)[-1] > limit:
                total += count * (prefix_length(n, percent) * ROW_COST + n * READ_COST)
        return total

    return min(range(LIGHT_LIMIT + 1), key=cost)


def set_name(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def profile(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """Rows of kind 0: id, set name and size; of kind 1: shingles that different sets of a run of texts share."""
    schema = T.StructType([T.StructField("kind", T.ByteType()), T.StructField("id", docs.schema[key].dataType),
                           T.StructField("sid", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        new, held, seen = [], 0, set()

        def counts():
            token, count = np.unique(np.concatenate(new), return_counts=True)
            token, count = token[count > 1], count[count > 1]
            return as_batch({"kind": np.ones(len(token), np.int8), "id": [None] * len(token), "sid": token.view(np.int64), "n": count}, target)

        for batch in (part for whole in batches for part in slices(whole)):
            names, sizes = [], []
            for b in binaries(batch.column(1)):
                s = shingle_set(b, width)
                name = set_name(s)
                names.append(name)
                sizes.append(len(s))
                if len(s) and name not in seen:
                    seen.add(name)
                    new.append(s)
                    held += len(s)
                if held > RUN_SHINGLES:
                    yield counts()
                    new, held, seen = [], 0, set()
            yield as_batch({"kind": np.zeros(len(names), np.int8), "id": batch.column(0), "sid": np.array(names, np.int64), "n": sizes}, target)
        if new:
            yield counts()

    return docs.select(key, text).mapInArrow(run, schema)


def ordered(s: np.ndarray, often: np.ndarray, count: np.ndarray, p: int) -> np.ndarray:
    """The first ``p`` shingles by (count among the frequent, hash)."""
    if len(often) == 0:
        return s[:p]
    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
    c = np.where(often[at] == s, count[at], 0)
    rare = s[c == 0]
    if len(rare) >= p:
        return rare[:p]
    return s[np.lexsort((s, c))][:p]


def list_rows(docs: DataFrame, text: str, width: int, percent: int, boundary: int, frequent) -> DataFrame:
    """Rows (token, sid, n, pos): inverted-list rows with pos >= 0; subset rows with pos = -(larger size)
    and n the set's size, plus lo, the smaller size of the pair."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("token", "sid", "n", "pos", "lo")])

    def run(batch):
        often, count = frequent.value
        seen, cols = set(), ([], [], [], [], [])

        def add(token, name, n, pos, lo):
            k = len(token)
            for c, v in zip(cols, (token, np.full(k, name), np.full(k, n), pos, np.full(k, lo)), strict=True):
                c.append(np.asarray(v, dtype=np.int64))

        for b in binaries(batch.column(0)):
            s = shingle_set(b, width)
            n = len(s)
            name = set_name(s)
            if not n or name in seen:
                continue
            seen.add(name)
            if n <= boundary:
                for lo, hi, c in subset_keys(n, boundary, percent):
                    keys = np.zeros(1, np.uint64) + np.uint64(lo * 1000 + hi)
                    picks = np.array(list(combinations(range(n), c)), dtype=np.int64).reshape(-1, c)
                    keys = np.repeat(keys, len(picks))
                    for j in range(c):
                        keys = mix(keys + s[picks[:, j]])
                    add(keys.view(np.int64), name, n, np.full(len(keys), -hi), lo)
            if n > boundary or partners(n, percent)[-1] > boundary:
                first = ordered(s, often, count, prefix_length(n, percent))
                add(first.view(np.int64), name, n, np.arange(len(first)), 0)
        if cols[0]:
            yield dict(zip(("token", "sid", "n", "pos", "lo"), map(np.concatenate, cols), strict=True))

    return per_batch(docs.select(text), run, schema)


def met(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) from meetings (x, y) in lists: length and positional bounds, then the count of meetings."""
    xn, yn, xp, yp = (F.col(f"{t}.{c}") for c in ("n", "pos") for t in ("x", "y"))
    fits = ((percent * xn <= 100 * yn) & (percent * yn <= 100 * xn)
            & (SHARED + F.least(xn - xp - 1, yn - yp - 1) >= needed(xn, yn, percent)))
    pair = [F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b"), needed(xn, yn, percent).alias("c")]
    return (rows.where(fits).select(*pair, "token").distinct().groupBy("a", "b", "c").agg(F.count("*").alias("k"))
            .where(F.col("k") >= F.least(F.col("c"), F.lit(SHARED))).select("a", "b"))


def read_sets(docs: DataFrame, ids: DataFrame, wanted: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """Rows (sid, tokens) of the sets named in ``wanted``, read again from one text each. Others come along,
    and a set that several texts of one id carry may come more than once."""
    carriers = ids.join(wanted, "sid", "left_semi").groupBy("sid").agg(F.min("id").alias("id")).select("id").distinct()
    schema = T.StructType([T.StructField("sid", T.LongType()), T.StructField("tokens", T.BinaryType())])

    def run(batch):
        found = {set_name(s): s.tobytes() for s in (shingle_set(b, width) for b in binaries(batch.column(0)))}
        yield {"sid": list(found), "tokens": list(found.values())}

    # ids meet by hash: a chance meeting only reads one text more
    carriers = stage(carriers.select(F.xxhash64("id").alias("h")), "carriers")
    if carriers.count() <= BROADCAST_IDS:  # else the texts are shuffled by id
        carriers = F.broadcast(carriers)
    own = docs.select(F.xxhash64(key).alias("h"), F.col(text).alias("text"))
    return per_batch(own.join(carriers, "h", "left_semi").select("text"), run, schema)


def verify(docs: DataFrame, ids: DataFrame, pairs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of set names whose sets link."""
    wanted = stage(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "wanted")
    sets = stage(read_sets(docs, ids, wanted, key, text, width), "sets")

    def check(batch):
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        keep = np.array(keep, dtype=bool)
        yield {"a": batch.column(0).to_numpy()[keep], "b": batch.column(1).to_numpy()[keep]}

    full = (pairs.join(sets.select(F.col("sid").alias("a"), F.col("tokens").alias("x")), "a")
            .join(sets.select(F.col("sid").alias("b"), F.col("tokens").alias("y")), "b").select("a", "b", "x", "y"))
    # a set that several texts of one id carry is met more than once
    return per_batch(full, check, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])).distinct()


def linked(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> Iterator[np.ndarray]:
    """For each set of ``left``, which of ``right`` it links with; overlaps are counted along the inverted lists of ``right``."""
    sizes = np.array([len(s) for s in right])
    flat = np.concatenate(right)
    order = np.argsort(flat, kind="stable")
    carrier = np.repeat(np.arange(len(right)), sizes)[order]
    token, start = np.unique(flat[order], return_index=True)
    end = np.append(start[1:], len(flat))
    for s in left:
        at = np.minimum(np.searchsorted(token, s), len(token) - 1)
        lists = [carrier[start[t]:end[t]] for t in at[token[at] == s]]
        both = np.bincount(np.concatenate(lists), minlength=len(right)) if lists else np.zeros(len(right), np.int64)
        yield 100 * both >= percent * (len(s) + sizes - both)


def count_links(docs: DataFrame, ids: DataFrame, members: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """Rows (sid, d): with how many other sets each set of ``members`` (sid, comp, n) links; sets alone in their component are left out.

    A component above BLOCK_SHINGLES has its sets dealt over blocks by hash, and each two blocks meet
    in a group of their own. Smaller ones are bundled: sets of different components do not link."""
    sizes = stage(members.groupBy("comp").agg(F.count("*").alias("m"), F.sum("n").alias("total")).where("m > 1")
                  .select("comp", "total", F.ceil(F.col("total") / BLOCK_SHINGLES).alias("k")), "sizes")
    bundles = -(-(sizes.where("k = 1").agg(F.sum("total")).first()[0] or 1) // BLOCK_SHINGLES)
    bundled = F.col("k") == 1
    dealt = stage(members.join(sizes, "comp").select(
        "sid", "k", bundled.alias("bundled"), F.when(bundled, F.pmod(F.xxhash64("comp"), F.lit(bundles))).otherwise(F.col("comp")).alias("g"),
        F.pmod(F.xxhash64("sid"), "k").alias("block")), "dealt")
    sets = read_sets(docs, ids, dealt.select("sid"), key, text, width).groupBy("sid").agg(F.first("tokens").alias("tokens"))
    met_blocks = (dealt.join(sets, "sid").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("other"))
                  .select("bundled", "g", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "sid", "tokens"))

    def run(group):
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        sid, block = group["sid"].to_numpy(), group["block"].to_numpy()
        sets = [np.frombuffer(t, np.uint64) for t in group["tokens"].to_pylist()]
        here, there = np.flatnonzero(block == i), np.flatnonzero(block == j)
        d = np.zeros(len(sid), np.int64)
        if len(here) and len(there):
            for x, hits in zip(here, linked([sets[x] for x in here], [sets[y] for y in there], percent), strict=True):
                hits = there[hits]
                d[x] += np.count_nonzero(hits != x)
                if i != j:
                    d[hits] += 1
        return pa.table({"sid": sid, "d": d})

    return (met_blocks.groupBy("bundled", "g", "i", "j").applyInArrow(run, T.StructType([T.StructField("sid", T.LongType()), T.StructField("d", T.LongType())]))
            .groupBy("sid").agg(F.sum("d").alias("d")))


def jaccard_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``key``, ``n_shingles``, ``component_id`` (smallest id reachable by
    links), ``set_id`` (name of its set) and ``n_linked_sets`` (how many other sets its set links
    with; 0 for a set linked with no other, copies of one set are one)."""
    spark = docs.sparkSession
    seen = stage(profile(docs, key, text, width), "profile")
    ids = seen.where("kind = 0").select("id", "sid", "n")
    counts = stage(seen.where("kind = 1").groupBy("sid").agg(F.sum("n").alias("c")).where("c >= 5"), "counts")
    top = most_frequent(counts, "c", FREQUENT).toPandas()
    token, count = top["sid"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)
    order = np.argsort(token)
    frequent = spark.sparkContext.broadcast((token[order], count[order]))
    small = ids.where(f"n between 1 and {LIGHT_LIMIT}").groupBy("n").agg(F.count("*").alias("c")).collect()
    boundary = choose_boundary({r["n"]: r["c"] for r in small}, percent)

    rows = list_rows(docs, text, width, percent, boundary, frequent)
    by = Window.partitionBy("token")
    inside = by.orderBy("pos", "sid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = [F.first(c).over(inside).alias(f"l_{c}") for c in ("sid", "n", "pos")]
    lists = stage(rows.select("*", *first, F.last("sid").over(inside).alias("end"))
                  .where("l_sid <> end").drop("end").distinct(), "lists")
    heavy = lists.where("pos >= 0")
    one = F.struct("sid", "n", "pos").alias("y")
    leaders = met(heavy.select(F.struct(F.col("l_sid").alias("sid"), F.col("l_n").alias("n"), F.col("l_pos").alias("pos")).alias("x"), one, "token")
                  .where("x.sid <> y.sid"), percent)
    light = lists.where("pos < 0")
    centre = (light.groupBy("token").agg(F.min(F.when(F.col("n") == F.col("lo"), F.col("sid"))).alias("m"),
                                         F.max("n").alias("hi"), F.max(-F.col("pos")).alias("want"))
              .where("m is not null and hi = want").select("token", "m"))
    stars = (light.join(centre, "token").where("sid <> m")
             .select(F.least("sid", "m").alias("a"), F.greatest("sid", "m").alias("b")))
    first_pairs = stage(leaders.union(stars).distinct(), "pairs")
    links = stage(verify(docs, ids, first_pairs, key, text, width, percent), "links")

    comp = components(links)
    labelled = stage(heavy.join(comp, F.col("sid") == F.col("node"), "left")
                     .select("token", "sid", "n", "pos", F.coalesce("comp", "sid").alias("comp")), "labelled")
    largest = (labelled.groupBy("token", "comp").agg(F.count("*").alias("c")).groupBy("token")
               .agg(F.max_by("comp", F.struct("c", "comp")).alias("largest"), F.count("*").alias("k")).where("k > 1"))
    open_lists = stage(labelled.join(largest.drop("k"), "token"), "open_lists")
    one = F.struct("sid", "n", "pos", "comp")
    cross = met(open_lists.where("comp <> largest").select("token", one.alias("x")).join(open_lists.select("token", one.alias("y")), "token")
                .where("x.comp <> y.comp"), percent)
    rest = stage(cross.join(first_pairs, ["a", "b"], "left_anti"), "rest")
    all_links = stage(links.union(verify(docs, ids, rest, key, text, width, percent)), "all_links")

    comp = components(all_links)
    names = (ids.where("n > 0").groupBy("sid").agg(F.min("id").alias("own"), F.max("n").alias("n"))
             .join(comp, F.col("sid") == F.col("node"), "left").select("sid", "own", "n", F.coalesce("comp", "sid").alias("comp")))
    names = stage(names, "names")
    degree = stage(count_links(docs, ids, names.select("sid", "comp", "n"), key, text, width, percent), "degree")
    smallest = names.groupBy("comp").agg(F.min("own").alias("least_id"))
    classes = stage(names.join(smallest, "comp").join(degree, "sid", "left").select("sid", "least_id", "d"), "classes")
    return (ids.join(classes, "sid", "left")
            .select(F.col("id").alias(key), F.col("n").alias("n_shingles"),
                    F.coalesce("least_id", "id").alias("component_id"),
                    F.col("sid").alias("set_id"), F.coalesce("d", F.lit(0)).alias("n_linked_sets")))
