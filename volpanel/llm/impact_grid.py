"""Ranked lexical search: K2-treaps over the term-document grid, row paths of a query descended jointly, best first.

Terms are runs of digits, letters and characters from U+0080 on, A-Z in lower case. A posting's impact is
``1000000000*tf div (1000*tf + 8*m)``, a document's score the sum of weight times impact over the item's terms.

1. **Totals.** N (documents with a term) and L (all terms) are counted first, as impacts need them.
2. **Index.** A task cuts its documents into shards of about SHARD bytes of text and builds a K2-treap for each:
   rows are the shard's terms, common ones first, columns its documents by ascending id. A cell of the quadtree
   holds the greatest impact inside it and a four-bit mask of its quarters; empty quarters do not exist. Masks stand
   level by level, so a cell's quarters are found by counting bits; maxima are kept as differences from the cell
   above: a bit each, and the values that differ, fewer than postings. The index is a stage table, one row per shard, and covers every term of every row; building it needs no shuffle.
3. **Items** are dealt into blocks of about BLOCK_TERMS terms; a block is sent to all tasks. Their document frequencies
   are summed over the shards, which gives the weights.
4. **Search.** In a shard the paths of all terms of an item start at the root. A frontier of document ranges is kept
   with the sum of weight times cell maximum as bound; the best ranges are split, all paths at once, until
   no bound can still reach the first ``k``. A range of one document has its exact score. A task carries an item's
   k-th score from shard to shard, and sends k rows an item at most; those meet in one ranking per item.

Nothing is approximate: pruning drops only ranges whose bound is below the k-th score, or equal to it behind its id.
Terms are named by 64-bit hashes; 10,000 item terms meet a strange one among 1e9 with probability below 1e-6.

Defined results: null text, or one without terms, is no document and no item. Repeated documents are ranked each; equal
scores by ascending id, null ids last. Equal rows of items are answered once; an id with several texts has one
ranking for each. Empty tables: no rows. Other columns are ignored.
"""

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volpanel.llm.common import LOWER, as_batch, binaries, chunks, per_batch, slices, word_hashes
from volpanel.sources.stage import stage

#: Digits, letters and bytes from 0x80 on; all else ends a term.
TERM = bytes(LOWER[c] if c >= 0x80 or bytes([c]).isalnum() else 32 for c in range(256))
#: Bytes of text and postings a shard; bytes of a long text looked at in one go; terms a block of items; ranges split at once.
SHARD, POSTINGS, CHUNK, BLOCK_TERMS, WIDE = 8 << 20, 1 << 20, 4 << 20, 1 << 20, 256
_BITS = np.array([bin(i).count("1") for i in range(16)], np.uint8)


def term_counts(text: bytes | None) -> Counter:
    c = Counter()
    for part in chunks((text or b"").translate(TERM), CHUNK):
        c.update(part.split())
    return c


def totals(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, all their terms)."""
    def run(batch):
        n = [sum(len(p.split()) for p in chunks((b or b"").translate(TERM), CHUNK)) for b in binaries(batch.column(0))]
        yield {"docs": [sum(x > 0 for x in n)], "terms": [sum(n)]}

    schema = T.StructType([T.StructField("docs", T.LongType()), T.StructField("terms", T.LongType())])
    row = per_batch(docs.select("text"), run, schema).agg(F.sum("docs"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = 100 - 90 + (90 * n * n_docs) // max(1, n_terms)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def spread(x: np.ndarray) -> np.ndarray:
    """The lower 31 bits, each followed by a zero."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << shift)) & mask
    return x


def build(rows: np.ndarray, cols: np.ndarray, values: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(height, masks of the inner cells, differences of the maxima of all cells), from the root level by level."""
    height = max(1, int(max(rows.max(), cols.max())).bit_length())
    code = spread(rows) << 1 | spread(cols)
    order = np.argsort(code)
    code, top = code[order], values[order]
    masks, drops = [], []
    for _ in range(height):
        up = code >> 2
        first = np.flatnonzero(np.append(True, up[1:] != up[:-1]))
        masks.append(np.bitwise_or.reduceat((1 << (code & 3)).astype(np.uint8), first))
        above = np.maximum.reduceat(top, first)
        drops.append((np.repeat(above, np.diff(np.append(first, len(code)))) - top).astype(np.int32))
        code, top = up[first], above
    drops.append(-top.astype(np.int32))  # the root differs from zero
    return height, np.concatenate(masks[::-1]), np.concatenate(drops[::-1])


def pack(masks: np.ndarray, drops: np.ndarray) -> dict[str, bytes]:
    """Two masks a byte; of the differences a bit each, and those that are not 0 (fewer than the leaves)."""
    even = np.append(masks, np.uint8(0)) if len(masks) % 2 else masks
    return {"masks": (even[::2] | even[1::2] << 4).tobytes(), "changes": np.packbits(drops != 0).tobytes(),
            "drops": drops[drops != 0].tobytes(), "cells": len(drops)}


def unpack(masks: np.ndarray, changes: np.ndarray, drops: np.ndarray, cells: int, leaves: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.empty(2 * len(masks), np.uint8)
    both[::2], both[1::2] = masks & 15, masks >> 4
    every = np.zeros(cells, np.int32)
    every[np.unpackbits(changes, count=cells).view(bool)] = drops
    return both[:cells - leaves], every


class Treap:
    """A K2-treap read back: maxima, masks and the place of each cell's first quarter; one cell more stands for none."""

    def __init__(self, height: int, masks: np.ndarray, drops: np.ndarray):
        self.height, inner, total = height, len(masks), len(drops)
        quarters = _BITS[masks]
        self.first = np.zeros(total + 1, np.int32)
        self.first[:inner] = 1 + np.cumsum(quarters, dtype=np.int32) - quarters
        self.masks = np.zeros(total + 1, np.uint8)
        self.masks[:inner] = masks
        self.top = np.zeros(total + 1, np.int32)
        self.top[0] = -drops[0]
        start, end = 0, 1
        for _ in range(height):
            below = end + int(quarters[start:end].sum(dtype=np.int64))
            self.top[end:below] = np.repeat(self.top[start:end], quarters[start:end]) - drops[end:below]
            start, end = end, below
        self.none = total

    def quarter(self, cells: np.ndarray, which: np.ndarray) -> np.ndarray:
        mask = self.masks[cells].astype(np.int64)
        bit = np.left_shift(1, which)
        return np.where(mask & bit, self.first[cells] + _BITS[mask & (bit - 1)].astype(np.int64), self.none)

    def search(self, rows: np.ndarray, weights: np.ndarray, k: int, least: int, wide: int = WIDE) -> tuple[np.ndarray, np.ndarray]:
        """(scores, columns) of the ``k`` best columns, greatest first, ties by column; none below ``least``."""
        best, at = np.zeros(0, np.int64), np.zeros(0, np.int64)
        cells, level, col = np.zeros((1, len(rows)), np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound = (weights * np.int64(self.top[0])).sum(keepdims=True)
        while True:
            full = len(best) == k
            last, last_at = (best[-1], at[-1]) if full else (0, 0)
            alive = bound >= max(1, least)
            if full:
                alive &= (bound > last) | ((bound == last) & ((col << (self.height - level)) < last_at))
            if not alive.all():
                cells, level, col, bound = cells[alive], level[alive], col[alive], bound[alive]
            if not len(bound):
                return best, at
            if len(bound) > wide:
                order = np.argpartition(-bound, wide)
                now, later = order[:wide], order[wide:]
            else:
                now, later = np.arange(len(bound)), np.zeros(0, np.int64)
            down = level[now] + 1
            row_bit = (rows[None, :] >> (self.height - down)[:, None] & 1) << 1
            halves = [self.quarter(cells[now], row_bit | side) for side in (0, 1)]
            new, new_level = np.concatenate(halves), np.concatenate([down, down])
            new_col = np.concatenate([col[now] * 2, col[now] * 2 + 1])
            new_bound = (weights * self.top[new]).sum(1)
            done = (new_level == self.height) & (new_bound > 0)
            if done.any():
                best, at = np.concatenate([best, new_bound[done]]), np.concatenate([at, new_col[done]])
                order = np.lexsort((at, -best))[:k]
                best, at = best[order], at[order]
            go = (new_level < self.height) & (new_bound > 0)
            cells, level = np.concatenate([cells[later], new[go]]), np.concatenate([level[later], new_level[go]])
            col, bound = np.concatenate([col[later], new_col[go]]), np.concatenate([bound[later], new_bound[go]])


class Shard:
    """Documents gathered by a task until there are enough for an index row."""

    def __init__(self):
        self.ids, self.n, self.rows, self.tf, self.size, self.postings = [], [], [], [], 0, 0
        self.words = defaultdict()
        self.words.default_factory = self.words.__len__

    def add(self, doc_id, counts: Counter, size: int) -> None:
        self.ids.append(doc_id)
        self.n.append(counts.total())
        self.rows.append(np.fromiter(map(self.words.__getitem__, counts), np.int64, len(counts)))
        self.tf.append(np.fromiter(counts.values(), np.int64, len(counts)))
        self.size += size
        self.postings += len(counts)

    def index(self, n_docs: int, n_terms: int) -> dict:
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] if self.ids[i] is not None else 0))
        column = np.empty(len(order), np.int64)
        column[order] = np.arange(len(order))
        each = [len(x) for x in self.rows]
        rows, tf, n = np.concatenate(self.rows), np.concatenate(self.tf), np.repeat(np.array(self.n, np.int64), each)
        terms, df = word_hashes(list(self.words)), np.bincount(rows, minlength=len(self.words))
        by_df = np.lexsort((terms, -df))
        row = np.empty(len(df), np.int64)
        row[by_df] = np.arange(len(df))
        height, masks, drops = build(row[rows], np.repeat(column, each), impacts(tf, n, n_docs, n_terms))
        by_term, packed = np.argsort(terms), pack(masks, drops)
        return {"ids": [[self.ids[i] for i in order]], "height": [height], "leaves": [len(rows)], "terms": [terms[by_term].tobytes()],
                "row_of": [row[by_term].astype(np.int32).tobytes()], "df": [df[by_term].astype(np.int32).tobytes()],
                **{name: [v] for name, v in packed.items()}}


def build_index(docs: DataFrame, shard: int = SHARD) -> tuple[DataFrame, int]:
    """(stage table with one row per shard, N) over all rows of ``docs`` that have a term."""
    n_docs, n_terms = totals(docs)
    number = [T.StructField(c, T.IntegerType()) for c in ("height", "leaves", "cells")]
    binary = [T.StructField(c, T.BinaryType()) for c in ("terms", "row_of", "df", "masks", "changes", "drops")]
    schema = T.StructType([T.StructField("ids", T.ArrayType(docs.schema["doc_id"].dataType)), *number, *binary])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target, held = to_arrow_schema(schema), Shard()
        for batch in (piece for whole in batches for piece in slices(whole)):
            for doc_id, text in zip(batch.column(0).to_pylist(), binaries(batch.column(1)), strict=True):
                if counts := term_counts(text):
                    held.add(doc_id, counts, len(text))
                if held.size >= shard or held.postings >= POSTINGS:
                    yield as_batch(held.index(n_docs, n_terms), target)
                    held = Shard()
        if held.ids:
            yield as_batch(held.index(n_docs, n_terms), target)

    return stage(docs.select("doc_id", "text").mapInArrow(run, schema), "impact_index"), n_docs


def item_terms(items: DataFrame) -> DataFrame:
    """(key, item_id, n_terms, terms): the distinct terms of each item, as hashes; items without terms are left out."""
    def run(batch):
        found = [np.unique(word_hashes(list(term_counts(b)))) for b in binaries(batch.column(2))]
        yield {"key": batch.column(0), "item_id": batch.column(1), "n_terms": [len(x) for x in found], "terms": [x.tobytes() for x in found]}

    schema = T.StructType([T.StructField("key", T.StringType()), items.schema["item_id"], T.StructField("n_terms", T.LongType()),
                           T.StructField("terms", T.BinaryType())])
    key = F.sha2(F.concat_ws("\n", F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.col("item_id").isNull().cast("string"), "text"), 256)
    rows = items.select(key.alias("key"), "item_id", "text").dropDuplicates(["key"])
    return per_batch(rows, run, schema).where("n_terms > 0")


def frequencies(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """Documents that hold each of ``terms`` (sorted hashes)."""
    wanted = index.sparkSession.sparkContext.broadcast(terms)

    def run(batch):
        w = wanted.value
        total = np.zeros(len(w), np.int64)
        for held, df in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held, df = np.frombuffer(held, np.uint64), np.frombuffer(df, np.int32)
            at = np.minimum(np.searchsorted(held, w), len(held) - 1)
            total += np.where(held[at] == w, df[at], 0)
        hit = np.flatnonzero(total)
        yield {"at": hit, "df": total[hit]}

    schema = T.StructType([T.StructField("at", T.LongType()), T.StructField("df", T.LongType())])
    got = per_batch(index.select("terms", "df"), run, schema).groupBy("at").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(len(terms), np.int64)
    out[got["at"].to_numpy()] = got["df"].to_numpy()
    return out


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def search_block(index: DataFrame, block: list, n_docs: int, k: int, out: T.StructType) -> DataFrame:
    """(key, item_id, doc_id, score): at most ``k`` rows an item from each task."""
    each = [np.frombuffer(r["terms"], np.uint64) for r in block]
    terms = np.unique(np.concatenate(each))
    weights = np.array([weight(n_docs, df) for df in frequencies(index, terms).tolist()], np.int64)
    sent = index.sparkSession.sparkContext.broadcast(
        (terms, weights, [(r["key"], r["item_id"], np.searchsorted(terms, t).astype(np.int32)) for r, t in zip(block, each, strict=True)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        terms, weights, items = sent.value
        best: list[list] = [[] for _ in items]  # (-score, id is null, id) by item
        for batch in batches:
            for r in range(batch.num_rows):
                def view(name, kind, r=r, batch=batch):
                    return np.frombuffer(batch.column(name)[r].as_buffer(), kind)

                ids, height, leaves, n_cells = (batch.column(c)[r].as_py() for c in ("ids", "height", "leaves", "cells"))
                held, row_of = view("terms", np.uint64), view("row_of", np.int32)
                treap = Treap(height, *unpack(view("masks", np.uint8), view("changes", np.uint8), view("drops", np.int32), n_cells, leaves))
                at = np.minimum(np.searchsorted(held, terms), len(held) - 1)
                rows = np.where((held[at] == terms) & (weights > 0), row_of[at], -1).astype(np.int64)
                for i, (_, _, own) in enumerate(items):
                    here = rows[own]
                    hit = here >= 0
                    if hit.any():
                        least = -best[i][-1][0] if len(best[i]) == k else 0
                        scores, cols = treap.search(here[hit], weights[own][hit], k, least)
                        new = [(-s, ids[c] is None, ids[c] if ids[c] is not None else 0) for s, c in zip(scores.tolist(), cols.tolist(), strict=True)]
                        best[i] = sorted(best[i] + new)[:k]
        rows = [(key, item, None if null else d, -s) for (key, item, _), found in zip(items, best, strict=True) for s, null, d in found]
        if rows:
            yield as_batch(dict(zip(("key", "item_id", "doc_id", "score"), map(list, zip(*rows)), strict=True)), to_arrow_schema(out))

    return index.drop("df").mapInArrow(run, out)


def search(index: DataFrame, n_docs: int, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item."""
    doc_id = index.schema["ids"].dataType.elementType
    out = T.StructType([T.StructField("key", T.StringType()), items.schema["item_id"], T.StructField("doc_id", doc_id), T.StructField("score", T.LongType())])
    queries = stage(item_terms(items), "item_terms")
    n_blocks = -(-(queries.agg(F.sum("n_terms")).first()[0] or 0) // block_terms)
    found = index.sparkSession.createDataFrame([], out)
    for b in range(n_blocks):
        block = queries.where(F.pmod(F.xxhash64("key"), F.lit(n_blocks)) == b).collect()
        if block:
            found = found.unionByName(search_block(index, block, n_docs, k, out))
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = 10, shard: int = SHARD, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Index all of ``docs`` and rank them for each of ``items``."""
    index, n_docs = build_index(docs, shard)
    return search(index, n_docs, items, k, block_terms)
