"""Benchmark decontamination: a prefix-filtered containment join of item windows with documents.

A window is ``size`` consecutive words of an item (a shorter item is one window).
A document contains it if the same words stand there in the same order.

* **Rarity.** The shingles of a window (``gram`` words, or the whole window if it
  is shorter) are ordered by how often they occur over all documents. Full
  containment needs every shingle, so the necessary prefix is one: the rarest.
* **Join.** Windows are indexed by that shingle and its offset. A shingle
  occurrence in a document fetches only its windows.
* **Bounds.** The offset fixes where the window starts; it must lie inside the
  document. The words are then compared one by one over the item-sized window.

The benchmark is taken in slices of at most ``slice_words`` words; only a slice's
index is sent to the tasks, so its size is bounded whatever the benchmark's. Each
slice is one narrow pass over the documents that adds to their hits: nothing of
the documents is shuffled, so no source, text or passage can be a hot key.

Defined results: null, empty or wordless text: 0 words, not contaminated. Null or
wordless items have no window. Repeated items or ids each count as one item id;
items without id are searched for hits, but not listed. Empty benchmark: nothing is hit. Repeated
documents keep their rows. Other columns are ignored.
"""

from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volpanel.llm.common import LOWER, binaries, per_batch, whole_row
from volpanel.sources.stage import stage

#: Lower case; every ASCII character that is no letter or digit parts words.
_WORD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in LOWER)
SLICE_WORDS = 1 << 20


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD).split()


class Windows:
    """The windows of one slice of items, over word numbers (0: a word of no item)."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], size: int, gram: int):
        self.size, self.gram, self.number = size, gram, {}
        self.names, self.windows = [], {}  # window (tuple of numbers) -> positions in names
        for name, w in items:
            n = [self.number.setdefault(x, len(self.number) + 1) for x in w]
            k = len(self.names)
            self.names.append(name)
            for i in range(max(1, len(n) - size + 1) if n else 0):
                self.windows.setdefault(tuple(n[i:i + size]), set()).add(k)
        self.base = len(self.number) + 1
        codes: dict[int, set[int]] = {}
        for w in self.windows:
            width = min(gram, len(w))
            codes.setdefault(width, set()).update(self.grams(np.array(w), width).tolist())
        self.own = {width: np.array(sorted(c), np.int64) for width, c in codes.items()}

    def numbers(self, w: list[bytes]) -> np.ndarray:
        get = self.number.get
        return np.fromiter((get(x, 0) for x in w), np.int64, len(w))

    def grams(self, numbers: np.ndarray, width: int) -> np.ndarray:
        """One code per position; -1 where a word of no item takes part."""
        n = len(numbers) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        code, known = np.zeros(n, np.int64), np.ones(n, bool)
        for i in range(width):
            part = numbers[i:n + i]
            code = code * self.base + part
            known &= part > 0
        return np.where(known, code, -1)

    def index(self, count: dict[tuple[int, int], int]) -> None:
        """Put each window under its rarest shingle."""
        lists: dict[tuple[int, int], list] = {}
        for k, (w, items) in enumerate(self.windows.items()):
            width = min(self.gram, len(w))
            codes = self.grams(np.array(w), width).tolist()
            i = min(range(len(codes)), key=lambda j: (count.get((width, codes[j]), 0), codes[j], j))
            lists.setdefault((width, codes[i]), []).append((i, np.array(w), tuple(items)))
        self.lists = lists
        self.keys = {width: np.array(sorted(c for v, c in lists if v == width), np.int64) for width in self.own}

    def found(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of contained windows, and the items that they belong to."""
        numbers = self.numbers(w)
        spans, items = [], set()
        if not numbers.any():
            return spans, items
        for width, keys in self.keys.items():
            codes = self.grams(numbers, width)
            if not len(codes) or not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
            for p in np.flatnonzero(keys[at] == codes).tolist():
                for offset, window, owners in self.lists[width, int(codes[p])]:
                    a = p - offset
                    if a >= 0 and a + len(window) <= len(numbers) and np.array_equal(numbers[a:a + len(window)], window):
                        spans.append((a, a + len(window)))
                        items.update(owners)
        return spans, items


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def slices(benchmark: DataFrame, key: str, text: str, limit: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Items in runs of at most ``limit`` words (one longer item is a run of its own)."""
    run, held = [], 0
    for r in benchmark.select(F.col(key).cast("string"), text).distinct().toLocalIterator():
        w = words(None if r[1] is None else r[1].encode())
        if run and held + len(w) > limit:
            yield run
            run, held = [], 0
        run.append((r[0], w))
        held += len(w)
    if run:
        yield run


def shingle_counts(docs: DataFrame, text: str, index) -> dict[tuple[int, int], int]:
    """How often each shingle of the slice occurs over all documents."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("width", "code", "n")])

    def run(batch):
        w, total = index.value, Counter()
        for b in binaries(batch.column(0)):
            numbers = w.numbers(words(b))
            for width, own in w.own.items():
                codes = w.grams(numbers, width)
                codes = codes[codes >= 0]
                at = np.minimum(np.searchsorted(own, codes), len(own) - 1)
                total.update((width, c) for c in codes[own[at] == codes].tolist())
        rows = [(width, c, n) for (width, c), n in total.items()]
        if rows:
            yield dict(zip(("width", "code", "n"), map(list, zip(*rows, strict=True)), strict=True))

    found = per_batch(docs.select(text), run, schema).groupBy("width", "code").agg(F.sum("n").alias("n"))
    return {(r["width"], r["code"]): r["n"] for r in found.toLocalIterator()}  # at most the slice's shingles


def find_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                      item_text: str = "text", size: int = 10, gram: int = 3, slice_words: int = SLICE_WORDS,
                      whole_rows: bool = False) -> DataFrame:
    """One row per document: ``key``, ``n_words``, ``hits`` (array of merged [start, end) word
    ranges) and ``items`` (ids of items with a window in it, as strings, sorted). With ``whole_rows``
    the first column is ``row``, a struct of all columns of ``docs``, in place of the key."""
    spark = docs.sparkSession
    first = whole_row(docs).alias("row") if whole_rows else F.col(key).alias("key")
    schema = T.StructType([docs.select(first).schema[0], T.StructField("text", T.StringType()),
                           T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.ArrayType(T.LongType()))),
                           T.StructField("items", T.ArrayType(T.StringType()))])

    def search(df, index, last):
        target = T.StructType([f for f in schema if not (last and f.name == "text")])

        def run(batch):
            w, n, hits, items = index.value, [], [], []
            for b, h, old in zip(binaries(batch.column(1)), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                own = words(b)
                spans, found = w.found(own)
                n.append(len(own))
                hits.append([list(x) for x in merged([*map(tuple, h), *spans])])
                items.append(sorted({*old, *(w.names[k] for k in found if w.names[k] is not None)}))
            out = {first_name: batch.column(0), "n_words": n, "hits": hits, "items": items}
            yield out if last else out | {"text": batch.column(1)}

        return per_batch(df, run, target)

    first_name = schema[0].name
    state = docs.select(first, F.col(text).alias("text"), F.lit(0).cast("long").alias("n_words"),
                        F.array().cast("array<array<bigint>>").alias("hits"), F.array().cast("array<string>").alias("items"))
    ahead = slices(benchmark, item_key, item_text, slice_words)
    now = next(ahead, [])
    while True:
        after = next(ahead, None)
        w = Windows(now, size, gram)
        w.index(shingle_counts(docs, text, spark.sparkContext.broadcast(w)) if w.windows else {})
        index = spark.sparkContext.broadcast(w)
        state = search(state, index, after is None)
        if after is None:
            return state if whole_rows else state.withColumnRenamed("key", key)
        state = stage(state, "searched")
        now = after


def digest(result: DataFrame) -> DataFrame:
    """The columns of query op7 from the operator's rows."""
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, r: a + r[1] - r[0])
    return (result.withColumn("n_hit", hit).withColumn("n_items", F.size("items").cast("long"))
            .withColumn("items_sha256", F.sha2(F.concat_ws(",", "items").cast("binary"), 256))
            .withColumn("contaminated", F.col("n_hit") > 0).drop("hits", "items"))
