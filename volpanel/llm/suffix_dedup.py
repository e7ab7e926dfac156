"""Suffix-array deduplication: bytes covered by a long string that also starts earlier.

A byte goes when some ``length``-byte string over it also starts earlier (in a
document of smaller id, or earlier in the same one). Strings are judged on the
input and never cross documents.

1. **Anchors.** Every window of ``length`` bytes has an anchor, the GRAM-byte
   string of least hash in it, so equal windows have equal anchors at equal
   offsets. Neighbouring windows with one anchor make a segment, the unit that is
   shuffled (by anchor), about 35 window starts each.
2. **Copies of a segment** that are byte for byte equal keep the earliest; the
   others are marked at once, first inside an Arrow batch, then in each anchor's
   sorted stream. A segment repeated in a third of all documents thus costs one
   row per batch, and no task holds an anchor's rows together.
3. **Suffix arrays.** Anchors with several different segments are read again; segments
   that agree with no other next to the anchor cannot share a window and drop out.
   Each run of anchors is suffix-sorted: groups by Lyndon prefix in descending
   order, found with previous-smaller pointers, then one pass that emits the order
   of every group. Neighbours in that order with ``length`` equal bytes mark all
   but the earliest start. Blocks of an anchor with very many different segments
   are sorted one by one, and the earliest of each block meet in another round.
4. The marks of a document are merged and cut from its bytes.

Defined results: null text counts as empty; texts shorter than ``length`` lose
nothing. A null id comes after all others. Rows that share an id and text are
judged alike and do not remove each other; with different texts (told apart by a
64-bit hash) they are separate documents of one rank, of which the earlier start
counts. Marks are joined by id and that hash, so rows without an id spread. Empty
table: no rows. Other columns are ignored.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volpanel.llm.common import as_batch, binaries, mix, per_batch, slices, whole_row
from volpanel.sources.stage import stage

#: Bytes of an anchor string (a power of two) and of one numpy pass over texts.
GRAM, PIECE = 32, 1 << 20
#: Bytes of segments that one suffix array takes.
BLOCK = 1 << 16
NULL_ID = (1 << 63) - 1
#: Stands for an anchor's offset in a row that is a mark.
MARK = 127
IS_MARK = f"(spot & {MARK << 7}) = {MARK << 7}"
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_STEP = (mix(np.arange(1, 64, dtype=np.uint64)) | np.uint64(1))
MARKS = T.StructType([T.StructField(c, T.LongType()) for c in ("anchor", "doc", "tag", "spot")])


def suffix_array(text: bytes) -> list[int]:
    """Order of all suffixes, by groups of equal Lyndon prefix."""
    n = len(text)
    sa = np.argsort(np.frombuffer(text, np.uint8), kind="stable").tolist()
    rank, start, end, prev = [0] * n, [0] * n, [0] * (n + 1), [-1] * n
    first = 0
    for i, s in enumerate(sa):
        if text[s] != text[sa[first]]:
            first = i
        rank[s], start[s] = i, first
        end[first] = i + 1
    high = n
    while high:
        s = sa[high - 1]
        low = start[s]
        if high - low == 1:  # one suffix: at most one other moves
            p = s - 1
            while p >= 0 and start[p] >= low:
                p = prev[p]
            prev[s] = p
            high = low
            if p >= 0:
                g = start[p]
                e = end[g] - 1
                if e > g:
                    i, q = rank[p], sa[e]
                    sa[e], sa[i], rank[p], rank[q] = p, q, e, i
                    start[p], end[g], end[e] = e, e, e + 1
            continue
        count: dict[int, int] = {}
        for s in sorted(sa[low:high]):
            p = s - 1
            while p >= 0 and start[p] >= low:  # a group not below this one: its pointer is known
                p = prev[p]
            prev[s] = p
            if p >= 0:
                count[p] = count.get(p, 0) + 1
        high = low
        by_count: dict[int, list[int]] = {}
        for p, k in count.items():
            if end[start[p]] - start[p] > 1:
                by_count.setdefault(k, []).append(p)
        for k in sorted(by_count, reverse=True):  # the more copies of this prefix follow, the higher
            was: dict[int, int] = {}
            for p in by_count[k]:
                g = start[p]
                e = end[g]
                was.setdefault(g, e)
                end[g] = e = e - 1
                i, q = rank[p], sa[e]
                sa[e], sa[i], rank[p], rank[q] = p, q, e, i
            new = {g: end[g] for g in was}
            for p in by_count[k]:
                start[p] = new[start[p]]
            for g, e in was.items():
                end[new[g]] = e
    free, out, done = list(range(n)), [0] * n, bytearray(n)
    i, s = 0, n - 1
    while True:
        while s >= 0 and not done[s]:
            done[s] = 1
            g = start[s]
            out[free[g]] = s
            free[g] += 1
            s = prev[s]
        if i == n:
            return out
        s = out[i] - 1
        i += 1


def segments(buffers: list[bytes], length: int):
    """Arrays (buffer number, start, window starts, anchor's offset, anchor hash, content hash) of all segments."""
    window = length - GRAM + 1
    batch, held = [], 0
    for k, b in enumerate(buffers):
        for at in range(0, max(1, len(b) - length + 1), PIECE):
            piece = b[at: at + PIECE + length - 1]
            if len(piece) >= length:
                batch.append((k, at, piece))
                held += len(piece)
            if held >= PIECE:
                yield _segments(batch, length, window)
                batch, held = [], 0
    if batch:
        yield _segments(batch, length, window)


def _segments(batch, length, window):
    text = b"".join(p for _, _, p in batch)
    sizes = np.array([len(p) for _, _, p in batch])
    begins = np.cumsum(sizes) - sizes
    h = _BYTE[np.frombuffer(text, np.uint8)]
    width = 1
    for step in range(GRAM.bit_length() - 1):
        h = h[:-width] * _STEP[step] + h[width:]
        width *= 2
    h = mix(h)
    low = np.uint64(0xFFFFFF)
    best = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    reach = 1
    while reach < window:
        step = min(reach, window - reach)
        best = np.minimum(best[:-step], best[step:])
        reach += step
    spot = (best & low).astype(np.int64)
    valid = np.ones(len(spot), bool)
    for b in begins[1:]:
        valid[max(0, b - length + 1): b] = False
    new = np.empty(len(spot), bool)
    new[0] = True
    np.not_equal(spot[1:], spot[:-1], out=new[1:])
    new[1:] |= valid[1:] & ~valid[:-1]
    heads = np.flatnonzero(new & valid)
    # a segment ends where the next begins or its text has no more windows
    ends = np.minimum(np.append(np.flatnonzero(new)[1:], len(spot))[np.searchsorted(np.flatnonzero(new), heads)],
                      (begins + sizes - length + 1)[np.searchsorted(begins, heads, side="right") - 1])
    view, digest = memoryview(text), xxhash.xxh3_64_intdigest
    content = np.fromiter((digest(view[a: b + length - 1]) for a, b in zip(heads.tolist(), ends.tolist(), strict=True)),
                          np.uint64, len(heads))
    which = np.searchsorted(begins, heads, side="right") - 1
    number = np.array([k for k, _, _ in batch])[which]
    offset = np.array([at for _, at, _ in batch])[which] - begins[which]
    return number, heads + offset, ends - heads, spot[heads] - heads, h[spot[heads]], content


def pack(start, n, at=MARK):
    """Start, anchor's offset and number of window starts of a segment in one long that sorts by start."""
    return (start << 14) | (at << 7) | n


def anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """Rows (anchor, content, doc, tag, spot): the earliest segment of its content in this batch, and those of other
    texts that start level with it; or a mark."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("anchor", "content", "doc", "tag", "spot")])

    def run(batch):
        ids, tags = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        parts = list(segments([b or b"" for b in binaries(batch.column(2))], length))
        if not parts:
            return
        number, start, n, at, anchor, content = map(np.concatenate, zip(*parts, strict=True))
        doc, tag = ids[number], tags[number]
        spot = pack(start, n, at)
        order = np.lexsort((tag, spot, doc, content))
        content, doc, tag, spot, anchor = content[order], doc[order], tag[order], spot[order], anchor[order]
        same = np.zeros(len(content), bool)
        same[1:] = content[1:] == content[:-1]
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
        level = same & (doc == doc[first]) & (spot >> 14 == spot[first] >> 14)
        copy, again = same & ~level, level.copy()
        again[1:] &= tag[1:] == tag[:-1]
        # marks go anywhere: spread them by document
        key = np.where(copy, mix((doc ^ tag).view(np.uint64)), anchor).view(np.int64)
        spot = np.where(copy, spot | (MARK << 7), spot)
        yield {name: v[~again] for name, v in zip(schema.names, (key, content.view(np.int64), doc, tag, spot), strict=True)}

    return per_batch(docs, run, schema)


def mark_copies(rows: DataFrame) -> DataFrame:
    """From each anchor's sorted stream: marks of later copies, and the segments of anchors that have more than
    one content, or one content level in several texts of an id."""
    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(MARKS)
        last, waiting = None, None  # the row before; the first segment of its anchor, until a second comes
        for batch in batches:
            if not batch.num_rows:
                continue
            a, c, d, g, s = (batch.column(i).to_numpy() for i in range(5))
            ready = (s >> 7) & 127 == MARK
            pa_, pc, pg = (np.concatenate(([0 if last is None else last[i]], v[:-1])) for i, v in enumerate((a, c, g)))
            same_a, same_c = (pa_ == a) & ~ready, (pa_ == a) & (pc == c) & ~ready
            if last is None:
                same_a[0] = same_c[0] = False
            # of copies, the first row decides; one that is level with it is no later one
            head = ~same_c & ~ready
            at = np.maximum.accumulate(np.where(head, np.arange(len(a)), -1))
            fd = np.where(at < 0, 0 if last is None else last[3], d[at])
            fs = np.where(at < 0, 0 if last is None else last[4], s[at])
            level = same_c & (d == fd) & (s >> 14 == fs >> 14)
            copy = same_c & ~level
            opens = head & ~same_a
            other = (head & same_a) | (level & (pg != g))
            group = np.cumsum(opens)
            several = np.zeros(group[-1] + 1, bool)
            several[group[other]] = True
            out = [np.flatnonzero(ready | copy), np.flatnonzero(other | (opens & several[group]))]
            k = np.concatenate(out)
            cols = {"anchor": a[k], "doc": d[k], "tag": g[k], "spot": np.append(s[out[0]] | (MARK << 7), s[out[1]])}
            if waiting is not None and several[0]:
                cols = {n: np.append(v, w) for (n, v), w in zip(cols.items(), waiting, strict=True)}
                waiting = None
            yield as_batch(cols, target)
            if opens.any():
                i = np.flatnonzero(opens)[-1]
                waiting = None if several[group[i]] else (a[i], d[i], g[i], s[i])
            last = (a[-1], c[-1], g[-1], fd[-1], fs[-1])

    order = (F.expr(IS_MARK), "anchor", "content", "doc", "spot", "tag")
    return rows.repartition("anchor").sortWithinPartitions(*order).mapInArrow(run, MARKS)


def segment_texts(docs: DataFrame, marks: DataFrame, length: int) -> DataFrame:
    """The bytes of the segments to be sorted, read again from their documents."""
    wanted = marks.where(f"not ({IS_MARK})").groupBy("doc", "tag").agg(F.collect_list(F.struct("anchor", "spot")).alias("spots"))
    schema = T.StructType([*MARKS.fields, T.StructField("bytes", T.BinaryType())])

    def run(batch):
        out = ([], [], [], [], [])
        seen = set()
        for doc, tag, b, spots in zip(*(batch.column(i).to_pylist() for i in range(2)), binaries(batch.column(2)), batch.column(3), strict=True):
            if (doc, tag) in seen:
                continue
            seen.add((doc, tag))
            for a, s in zip(*(spots.values.field(i).to_pylist() for i in range(2)), strict=True):
                start = s >> 14
                for o, v in zip(out, (a, doc, tag, s, b[start: start + (s & 127) + length - 1]), strict=True):
                    o.append(v)
        yield dict(zip(schema.names, out, strict=True))

    return per_batch(docs.join(wanted, ["doc", "tag"]).select("doc", "tag", "text", "spots"), run, schema)


def sort_block(rows: list[tuple[int, int, int, bytes]], length: int, split: bool = True):
    """Marks (doc, tag, spot) of one block of segments (doc, tag, spot, bytes), and, if the block is one of several
    (``split``), the earliest starts of its strings."""
    text = b"\xff".join(b for *_, b in rows) + b"\xff"
    owner, begin, at = [], [], 0
    for k, (_, _, s, b) in enumerate(rows):
        owner += [k] * (s & 127) + [-1] * (len(b) + 1 - (s & 127))
        begin.append(at)
        at += len(b) + 1
    marks, firsts = [], []

    def close(group):
        found = sorted((rows[owner[p]][0], (rows[owner[p]][2] >> 14) + p - begin[owner[p]], owner[p]) for p in group)
        for doc, start, k in found:
            if (doc, start) != found[0][:2]:
                marks.append((doc, rows[k][1], pack(start, 1)))
            elif split:
                firsts.append((doc, start, k))

    least = 0 if split else 1  # a string that starts once marks nothing
    group, before = [], None
    for p in suffix_array(text):
        if owner[p] < 0:
            continue
        string = text[p: p + length]
        if string == before:
            group.append(p)
            continue
        if len(group) > least:
            close(group)
        group, before = [p], string
    if len(group) > least:
        close(group)
    return marks, [(doc, rows[k][1], pack(start, 1, 0), rows[k][3][start - (rows[k][2] >> 14):][:length]) for doc, start, k in firsts]


def related(group: list[tuple[int, int, int, bytes]], length: int) -> list[tuple[int, int, int, bytes]]:
    """The segments (doc, tag, spot, bytes) of one anchor that may share a window with another. A shared window
    holds the anchor and, on one side of it at least, half of its other bytes."""
    side = -(-(length - GRAM) // 2)
    places = [((s >> 7) & 127, b) for _, _, s, b in group]
    left = [b[at - side:at] if at >= side else None for at, b in places]
    right = [b[at + GRAM:at + GRAM + side] if len(b) >= at + GRAM + side else None for at, b in places]
    count = (Counter(left), Counter(right))
    return [r for r, x, y in zip(group, left, right, strict=True)
            if (x is not None and count[0][x] > 1) or (y is not None and count[1][y] > 1)]


def sort_suffixes(texts: DataFrame, length: int) -> DataFrame:
    """Marks from suffix arrays over runs of anchors; with bytes: the earliest strings of one block of an anchor
    that needs several."""
    schema = texts.schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)

        def flush(block, split):
            marks, firsts = sort_block(block, length, split) if block else ((), ())
            rows = [(0, *m, None) for m in marks]
            if split:
                rows += [(xxhash.xxh3_64_intdigest(f[3]) - (1 << 63), *f) for f in firsts]
            if rows:
                yield as_batch(dict(zip(target.names, map(list, zip(*rows, strict=True)), strict=True)), target)

        block, held = [], 0  # whole anchors
        group, size, anchor, cut = [], 0, None, False  # the current anchor; cut: a block of it is done

        for batch in batches:
            for a, *row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if a != anchor:
                    if cut:
                        yield from flush(group, True)
                    else:
                        kept = related(group, length)
                        block += kept
                        held += sum(len(r[3]) for r in kept)
                    if held >= BLOCK // 4:
                        yield from flush(block, False)
                        block, held = [], 0
                    group, size, anchor, cut = [], 0, a, False
                elif size >= BLOCK:
                    yield from flush(group, True)
                    group, size, cut = [], 0, True
                group.append(tuple(row))
                size += len(row[3])
        if cut:
            yield from flush(group, True)
        else:
            block += related(group, length)
        yield from flush(block, False)

    return texts.repartition("anchor").sortWithinPartitions("anchor", "doc", "spot").mapInArrow(run, schema)


def later_strings(firsts: DataFrame) -> DataFrame:
    """Marks of strings that the blocks of one anchor found separately."""
    start = F.shiftright("spot", 14)
    least = firsts.groupBy("anchor", "bytes").agg(F.min(F.struct("doc", start.alias("start"))).alias("f"))
    return firsts.join(least, ["anchor", "bytes"]).where(F.struct("doc", start.alias("start")) > F.col("f")).select("doc", "tag", "spot")


def runs(spots: np.ndarray, size: int, length: int) -> list[tuple[int, int]]:
    """Maximal removed byte ranges of one text."""
    own = np.sort(spots)
    if not len(own):
        return []
    start = own >> 14
    end = np.minimum(np.maximum.accumulate(start + (own & 127) + length - 1), size)
    new = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
    return list(zip(start[new].tolist(), end[np.append(new[1:] - 1, len(end) - 1)].tolist(), strict=True))


def find_repeats(docs: DataFrame, key: str, text: str, length: int) -> DataFrame:
    """Rows (doc, tag, spots): what goes from each text of an id (NULL_ID stands for null)."""
    assert GRAM < length < 128 + GRAM - 1
    own = docs.select(rank(key), text_tag(text), F.col(text).alias("text"))
    marks = stage(mark_copies(anchor_rows(own, length)), "marks")
    sorted_ = stage(sort_suffixes(segment_texts(own, marks, length), length), "suffixes")
    found = (marks.where(IS_MARK).union(sorted_.where("bytes is null").drop("bytes")).select("doc", "tag", "spot")
             .union(later_strings(sorted_.where("bytes is not null"))))
    return stage(found.groupBy("doc", "tag").agg(F.collect_set("spot").alias("spots")), "spots")


def rank(key: str):
    return F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("doc")


def text_tag(text: str):
    """Tells apart the texts under one id; rows without one spread by it."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tag")


def cut(b: bytes, spots, length: int) -> tuple[list[tuple[int, int]], bytes]:
    """Removed ranges and remaining bytes of one text; ``spots``: an Arrow list or null."""
    found = runs(spots.values.to_numpy(), len(b), length) if spots.is_valid else []
    edges = [0, *(e for r in found for e in r), len(b)]
    return found, b"".join(b[edges[i]: edges[i + 1]] for i in range(0, len(edges), 2))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100) -> DataFrame:
    """One row per document: ``key``, ``n_bytes``, ``removed`` (array of [start, end) byte ranges) and
    ``kept`` (the remaining bytes)."""
    spots = find_repeats(docs, key, text, length)
    own = docs.select(rank(key), text_tag(text), F.col(text).alias("text"), F.col(key).alias("key"))
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n_bytes", T.LongType()),
                           T.StructField("removed", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("kept", T.BinaryType())])

    def run(batch):
        sizes, removed, kept = [], [], []
        for b, s in zip(binaries(batch.column(1)), batch.column(2), strict=True):
            found, rest = cut(b or b"", s, length)
            sizes.append(len(b or b""))
            removed.append([list(r) for r in found])
            kept.append(rest)
        yield {key: batch.column(0), "n_bytes": sizes, "removed": removed, "kept": pa.array(kept, pa.binary())}

    return per_batch(own.join(spots, ["doc", "tag"], "left").select("key", "text", "spots"), run, schema)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100) -> DataFrame:
    """The rows of ``docs`` with the remaining text. A character that an edge cuts in half goes whole; a text
    of which nothing is left goes with its row."""
    spots = find_repeats(docs, key, text, length)
    row = docs.select(rank(key), text_tag(text), whole_row(docs).alias("row")).join(spots, ["doc", "tag"], "left").select("row", "spots")
    at, names, schema = docs.columns.index(text), docs.columns, docs.schema

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            columns, texts, keep = batch.column(0).flatten(), [], []
            for b, s in zip(binaries(columns[at]), batch.column(1), strict=True):
                found, rest = cut(b or b"", s, length)
                rest = rest.decode("utf-8", "ignore") if found else None if b is None else b.decode()
                keep.append(not found or bool(rest))
                texts.append(rest)
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    return row.mapInArrow(run, schema)


def digest(result: DataFrame) -> DataFrame:
    """The columns of query op6 from the operator's rows."""
    return (result.withColumn("n_removed", F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r[1] - r[0]))
            .withColumn("n_spans", F.size("removed").cast("long"))
            .withColumn("kept_sha256", F.sha2("kept", 256)).drop("removed", "kept"))


