"""Shared pieces: words and shingles of texts in Arrow batches, components of a graph."""

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volpanel.sources.stage import stage

#: A-Z to a-z, every other byte as it is.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SLICE_BYTES = 8 << 20
# Odd multipliers of the shingle hash (fixed values).
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def binaries(column: pa.Array) -> list[bytes | None]:
    """The texts of an Arrow column as UTF-8 bytes."""
    wide = pa.types.is_large_string(column.type)
    return column.cast(pa.large_binary() if wide else pa.binary()).to_pylist()


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * _ODD[0]
    h = (h ^ (h >> np.uint64(29))) * _ODD[1]
    return h ^ (h >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def gram_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """One hash per window of ``width`` words; the whole sequence if it is shorter."""
    k = min(width, len(h))
    if k == 0:
        return h
    out = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out = (out + h[i: len(h) - k + 1 + i]) * _ODD[2]
        out ^= out >> np.uint64(31)
    return mix(out)


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; words are split at ASCII white space."""
    words = (text or b"").translate(LOWER).split()
    return np.unique(gram_hashes(word_hashes(words), width))


def whole_row(df: DataFrame):
    """All columns as one struct, whatever their names."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in df.columns))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while stem in taken:
        stem += "_"
    return stem


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about SLICE_BYTES, so that a task's memory does not depend on text lengths."""
    rows = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def chunks(text: bytes, size: int) -> Iterator[bytes]:
    """A text in parts of about ``size`` bytes, cut at blanks or line ends; a longer word stays whole."""
    at = 0
    while len(text) - at > size:
        ends = [i for i in (text.find(b" ", at + size), text.find(b"\n", at + size)) if i >= 0]
        if not ends:
            break
        yield text[at:min(ends)]
        at = min(ends)
    yield text[at:]


def per_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[dict]], schema: T.StructType) -> DataFrame:
    """Map Arrow batches; ``fn`` yields dicts of column values (lists, arrays) per output batch."""
    from pyspark.sql.pandas.types import to_arrow_schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(schema)
        for batch in batches:
            for part in slices(batch):
                for out in fn(part):
                    yield as_batch(out, target)

    return df.mapInArrow(run, schema)


def as_batch(columns: dict, target: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for field in target:
        v = columns[field.name]
        if isinstance(v, pa.ChunkedArray):
            v = v.combine_chunks()
        arrays.append(v.cast(field.type) if isinstance(v, pa.Array) else pa.array(v, type=field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=target)


def most_frequent(counts: DataFrame, count: str, limit: int) -> DataFrame:
    """The rows of ``counts`` above a count that at most ``limit`` rows reach.

    The cut is found on a histogram with eight bands per doubling, a few hundred rows whatever the input;
    a sort would bring ``limit`` rows of every task to the driver."""
    band = F.floor(F.log2(F.col(count)) * 8)
    bands = {r["band"]: r["n"] for r in counts.groupBy(band.alias("band")).agg(F.count("*").alias("n")).collect()}
    least, held = None, 0
    for b in sorted(bands, reverse=True):
        held += bands[b]
        if held > limit:
            break
        least = b
    return counts.where(band >= least) if least is not None else counts.where("false")


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links(a, b)``: rows ``(node, comp)`` for every linked node but
    the smallest of its component, which is ``comp``.

    Large-star and small-star steps, each a minimum per node (combined before the
    shuffle) and a join; every round ends in a stage table. No links: no rows.
    """
    def edges(df):
        return df.where("hi <> lo").distinct()

    def mark(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()

    e = stage(edges(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))), "edges")
    before = mark(e)
    while before[0]:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = stage(edges(both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
                            .union(least.select("u", "m"))), "large")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        e = stage(edges(large.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
                        .union(least.select("hi", "m"))), "edges")
        after = mark(e)
        if after == before:
            break
        before = after
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("comp"))
