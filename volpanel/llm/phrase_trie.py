"""Phrase collocations: phrases counted in HAT-tries whose subtrees spill as sorted runs, scored by their weakest cut.

Per lang (null: ``und``), A-Z in lower case: texts are cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into
words at blanks and tabs; f(phrase) counts all contiguous occurrences inside pieces.

1. **Levels.** Pass k counts phrases of k words. A phrase with f >= least has only parts with f >= least, so pass k
   skips whatever the Bloom filter of pass k - 1 rules out. A filter never rules out a frequent part: counts are exact
   at every size, and a full filter only saves less work. It has at most FILTER_BITS bits.
2. **Trie.** Each task keeps, per lang, a trie over its own word ids: a child per first word with a hash container
   of the rest. A container above BURST entries bursts into a node with a container per second word. Above
   ENTRIES entries in all, the largest subtrees leave whole, as sorted runs, until half is left. A task's memory is
   bounded by ENTRIES, WORDS (its word ids) and CHUNK, whatever the texts.
3. **Merge.** Runs are dealt by (lang, first two words) and summed there, so a common first word is spread over its
   second words. The empty phrase counts all words of a lang. What is left (f >= least) is a stage table per pass.
4. **Scores.** The parts of every cut meet their counts in one join, salted, as a common word begins a good share
   of the candidates. Scores are exact integers. A candidate inside a longer one with enough of its occurrences
   is dropped; the first ``top`` of a lang come from a top per salt, then of those.

Defined results: null, empty or blank text: no words. A word may hold any other character, control characters too.
Repeated rows count again. A null lang and the lang ``und`` are one. Empty table, or no candidate: no rows. Other
columns are ignored.
"""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volpanel.llm.common import LOWER, as_batch, binaries, chunks, mix, per_batch, slices
from volpanel.sources.stage import stage

#: A piece's ends become line ends, tabs become blanks.
PLAIN = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else LOWER[c] for c in range(256))
#: Bits of a word id in a code; the longest phrase that a code holds.
ID_BITS, LONGEST = 21, 3
#: Entries of a task's tries before subtrees spill; entries of a container before it bursts; words before ids start anew; bytes a chunk;
#: rows of a run sent at once.
ENTRIES, BURST, WORDS, CHUNK, RUN = 1 << 20, 1 << 10, 1 << 19, 4 << 20, 1 << 15
#: Bits a phrase and most bits of a filter (16 MB).
BITS_EACH, FILTER_BITS = 12, 1 << 27
SALTS = 16
_ID = (1 << ID_BITS) - 1
_PAIR = np.uint64(0x9E3779B97F4A7C15)  # fixed value, odd
_RUN = T.StructType([T.StructField("lang", T.StringType()), T.StructField("phrase", T.StringType()), T.StructField("f", T.LongType())])


def split(text: bytes) -> list[bytes]:
    """Words and line ends of a text in PLAIN characters."""
    return list(filter(None, text.replace(b"\n", b" \n ").split(b" ")))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a phrase from the hashes of its first part and its last word."""
    return mix(a * _PAIR + b)


class Filter:
    """A Bloom filter with one position per phrase; without bits everything passes."""

    def __init__(self, words: np.ndarray | None = None):
        self.words, self.mask = words, None if words is None else np.uint64(len(words) * 64 - 1)
        self.raw = None if words is None else words.astype("<u8").tobytes()

    def one(self, h: int) -> bool:
        if self.raw is None:
            return True
        at = h & (len(self.raw) * 8 - 1)
        return bool(self.raw[at >> 3] >> (at & 7) & 1)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if self.words is None:
            return np.ones(len(h), bool)
        at = h & self.mask
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


class Ids(dict):
    """Word to id of one lang. Line ends, and words the filter rules out, are 0: they end a piece."""

    def __init__(self, lang: str, filtered: Filter):
        super().__init__({b"\n": 0})
        self.seed, self.filtered, self.words, self.hashes = seed(lang), filtered, [b""], [0]

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word, self.seed)
        self[word] = i = len(self.words) if self.filtered.one(h) else 0
        if i:
            self.words.append(word)
            self.hashes.append(h)
        return i


def seed(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode())


class HatTrie:
    """Counts of codes: child by first id, then a container {rest: count}, or a node {second id: container} once burst."""

    def __init__(self, width: int, burst: int = BURST):
        self.rest = ID_BITS * (width - 1)
        self.burst, self.children, self.size = burst if width == LONGEST else None, {}, {}

    def add(self, codes: np.ndarray, counts: np.ndarray) -> None:
        """``codes`` ascend, so a subtree is met once."""
        first = codes >> self.rest
        starts = np.flatnonzero(np.append(True, first[1:] != first[:-1])) if len(codes) else []
        rests, counts = (codes & ((1 << self.rest) - 1)).tolist(), counts.tolist()
        for a, i, j in zip(first[starts].tolist(), starts, [*starts[1:], len(codes)], strict=True):
            node, held = self.children.get(a), self.size.get(a, 0)
            if node is None:
                node = self.children[a] = {}
            if isinstance(node, Burst):
                held += node.add(rests[i:j], counts[i:j])
            else:
                for r, n in zip(rests[i:j], counts[i:j], strict=True):
                    node[r] = node.get(r, 0) + n
                held = len(node)
                if self.burst and held > self.burst:
                    self.children[a] = Burst(node)
            self.size[a] = held

    def __len__(self) -> int:
        return sum(self.size.values())

    def spill(self, left: int) -> Iterator[tuple[int, dict]]:
        """Take the largest subtrees out, whole, until at most ``left`` entries stay."""
        held = len(self)
        for a in sorted(self.size, key=self.size.get, reverse=True):
            if held <= left:
                return
            held -= self.size.pop(a)
            node = self.children.pop(a)
            yield a, node.flat() if isinstance(node, Burst) else node


class Burst(dict):
    """A burst container: {second id: {third id: count}}."""

    def __init__(self, container: dict):
        super().__init__()
        self.add(list(container), list(container.values()))

    def add(self, rests: list[int], counts: list[int]) -> int:
        new = 0
        for r, n in zip(rests, counts, strict=True):
            c = self.setdefault(r >> ID_BITS, {})
            k = r & _ID
            if k in c:
                c[k] += n
            else:
                c[k] = n
                new += 1
        return new

    def flat(self) -> dict:
        return {b << ID_BITS | c: n for b, rest in self.items() for c, n in rest.items()}


def sorted_run(codes: np.ndarray, counts: np.ndarray, width: int, words: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The phrases of ``codes`` in the order of their words, and their counts."""
    place = np.empty(len(words), np.int64)
    place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    ids = [codes >> ID_BITS * i & _ID for i in range(width - 1, -1, -1)]
    order = np.lexsort([place[x] for x in reversed(ids)])
    named = pa.array(words, pa.binary()).cast(pa.string())
    return pc.binary_join_element_wise(*[named.take(pa.array(x[order])) for x in ids], " "), counts[order]


class Counting:
    """One task's tries for phrases of ``width`` words."""

    def __init__(self, width: int, words: Filter, parts: Filter, entries: int = ENTRIES, burst: int = BURST, ids: int = WORDS):
        self.width, self.word_filter, self.part_filter = width, words, parts
        self.entries, self.burst, self.most_ids = entries, burst, ids
        self.ids, self.tries = {}, {}

    def add(self, lang: str, text: bytes, size: int = CHUNK) -> None:
        if lang not in self.ids:
            self.ids[lang], self.tries[lang] = Ids(lang, self.word_filter), HatTrie(self.width, self.burst)
        ids, trie = self.ids[lang], self.tries[lang]
        before = np.zeros(0, np.int64)
        for part in chunks(text, size):
            tokens = split(part)
            seq = np.concatenate([before, np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens))])
            before = seq[max(0, len(seq) - self.width + 1):]
            codes = self.codes(seq, ids)
            if len(codes):
                trie.add(*np.unique(codes, return_counts=True))

    def codes(self, seq: np.ndarray, ids: Ids) -> np.ndarray:
        k, n = self.width, len(seq) - self.width + 1
        if n < 1:
            return seq[:0]
        code, ok = seq[:n].copy(), seq[:n] > 0
        for i in range(1, k):
            code = code << ID_BITS | seq[i:i + n]
            ok &= seq[i:i + n] > 0
        if k > 2:
            h = np.array(ids.hashes, np.uint64)[seq]
            part = h[:n + 1]
            for i in range(1, k - 1):
                part = pair_hash(part, h[i:i + n + 1])
            passes = self.part_filter(part)
            ok &= passes[:-1] & passes[1:]
        return code[ok]

    def runs(self, last: bool) -> Iterator[dict]:
        """Sorted runs of the subtrees that leave: the largest if there are too many entries, all at the end or when ids start anew."""
        for lang in list(self.tries):
            full = last or len(self.ids[lang]) > self.most_ids
            left = -1 if full else self.entries // 2 if sum(map(len, self.tries.values())) > self.entries else None
            if left is None:
                continue
            codes, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, subtree in self.tries[lang].spill(left):
                codes.append(np.fromiter(subtree.keys(), np.int64, len(subtree)) | a << ID_BITS * (self.width - 1))
                counts.append(np.fromiter(subtree.values(), np.int64, len(subtree)))
            phrases, f = sorted_run(np.concatenate(codes), np.concatenate(counts), self.width, self.ids[lang].words)
            for i in range(0, len(f), RUN):
                yield {"lang": pa.repeat(lang, len(f[i:i + RUN])), "phrase": phrases[i:i + RUN], "f": f[i:i + RUN]}
            if full:
                del self.tries[lang], self.ids[lang]


class Words:
    """One task's counts of single words (a trie of one container per lang); the empty phrase counts them all."""

    def __init__(self, entries: int = ENTRIES):
        self.entries, self.tries = entries, {}

    def add(self, lang: str, text: bytes, size: int = CHUNK) -> None:
        c = self.tries.setdefault(lang, Counter())
        for part in chunks(text, size):
            tokens = part.split()  # of bytes: at blanks and line ends alone
            c.update(tokens)
            c[b""] += len(tokens)

    def runs(self, last: bool) -> Iterator[dict]:
        for lang in list(self.tries):
            if last or sum(map(len, self.tries.values())) > self.entries:
                held = self.tries.pop(lang)
                words = sorted(held)
                for i in range(0, len(words), RUN):
                    part = words[i:i + RUN]
                    yield {"lang": pa.repeat(lang, len(part)), "phrase": pa.array(part, pa.binary()).cast(pa.string()), "f": [held[w] for w in part]}


def counted(texts: DataFrame, width: int, filters: dict, limits: dict) -> DataFrame:
    """(lang, phrase, f) of all phrases of ``width`` words that the filters let pass."""
    shared = texts.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target, sent = to_arrow_schema(_RUN), shared.value
        if width == 1:
            held = Words(limits.get("entries", ENTRIES))
        else:
            held = Counting(width, sent.get(1, Filter()), sent.get(width - 1, Filter()), **limits)
        for batch in (piece for whole in batches for piece in slices(whole)):
            by = {}
            for lang, b in zip(batch.column(0).to_pylist(), binaries(batch.column(1)), strict=True):
                by.setdefault(lang, []).append((b or b"").translate(PLAIN))
            for lang, several in by.items():
                held.add(lang, b"\n".join(several))
            for out in held.runs(False):
                yield as_batch(out, target)
        for out in held.runs(True):
            yield as_batch(out, target)

    prefix = F.substring_index("phrase", " ", 2)
    runs = texts.mapInArrow(run, _RUN).withColumn("prefix", prefix).repartition("lang", "prefix")
    return runs.groupBy("lang", "prefix", "phrase").agg(F.sum("f").alias("f")).drop("prefix")


def filter_of(counts: DataFrame) -> Filter:
    """The Bloom filter over all phrases of ``counts``; its size follows their number up to FILTER_BITS."""
    n = counts.count()
    bits = 64
    while bits < min(FILTER_BITS, n * BITS_EACH):
        bits *= 2

    def run(batch):
        h = []
        for lang, phrase in zip(batch.column(0).to_pylist(), binaries(batch.column(1)), strict=True):
            s, (first, *rest) = seed(lang), phrase.split(b" ")
            x = np.array([xxhash.xxh3_64_intdigest(first, s)], np.uint64)
            for w in rest:
                x = pair_hash(x, np.array([xxhash.xxh3_64_intdigest(w, s)], np.uint64))
            h.append(x[0])
        at = np.array(h, np.uint64) & np.uint64(bits - 1)
        yield {"at": at.astype(np.int64)}

    at = per_batch(counts.select("lang", "phrase"), run, T.StructType([T.StructField("at", T.LongType())]))
    sums = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    got = sums.toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return Filter(words)


def count_phrases(docs: DataFrame, longest: int = LONGEST, least: int = 10, **limits) -> list[DataFrame]:
    """Stage tables (lang, phrase, f) of the phrases of 1, 2, ... ``longest`` words with f >= ``least``; the first also
    holds the empty phrase of each lang, whose f counts all its words."""
    if not 2 <= longest <= LONGEST:
        raise ValueError(f"phrases have 2 to {LONGEST} words")
    texts = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.col("text"))
    out, filters = [], {}
    for k in range(1, longest + 1):
        got = counted(texts, k, filters, limits)
        out.append(stage(got.where((F.col("f") >= least) | (F.col("phrase") == "")), f"phrases_{k}"))
        if k < longest:
            filters[k] = filter_of(out[-1].where("phrase <> ''"))
    return out


def cuts(candidates: DataFrame) -> DataFrame:
    """(lang, phrase, a, k, first, part): the two parts of every cut."""
    words = F.split("phrase", " ", -1)
    size = F.size("w")
    k = F.sequence(F.lit(1), size - 1)
    at = candidates.withColumn("w", words).select("lang", "phrase", "f", "w", F.explode(k).alias("k"))
    part = F.array(F.struct(F.lit(True).alias("first"), F.array_join(F.slice("w", 1, F.col("k")), " ").alias("part")),
                   F.struct(F.lit(False).alias("first"), F.array_join(F.slice("w", F.col("k") + 1, size - F.col("k")), " ").alias("part")))
    return at.select("lang", "phrase", F.col("f").alias("a"), "k", F.inline(part))


def weakest(batch):
    """Exact scores: the lowest over the cuts, ties to the first."""
    rows = batch.to_pydict()
    l, r, score = [], [], []
    for a, parts in zip(rows["a"], rows["parts"], strict=True):
        best = min((1_000_000 * a * a // (p["l"] * p["r"]), p["k"], p["l"], p["r"]) for p in parts)
        l.append(best[2]), r.append(best[3]), score.append(best[0])
    yield {"lang": batch.column("lang"), "phrase": batch.column("phrase"), "a": batch.column("a"), "l": l, "r": r, "score": score}


def scored(counts: list[DataFrame]) -> DataFrame:
    """(lang, phrase, a, l, r, score) of all candidates: phrases of two words or more in ``counts``."""
    every = counts[0].where("phrase <> ''")
    candidates = counts[1]
    for c in counts[2:]:
        candidates = candidates.union(c)
    for c in counts[1:-1]:
        every = every.union(c)
    # a common word is part of a good share of the candidates: their rows are dealt by salt, its count is sent to each salt
    parts = cuts(candidates).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    known = every.select("lang", F.col("phrase").alias("part"), "f", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = parts.join(known, ["lang", "part", "salt"])
    by_cut = met.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("first"), F.col("f"))).alias("l"),
                                                         F.max(F.when(~F.col("first"), F.col("f"))).alias("r"))
    rows = by_cut.groupBy("lang", "phrase", "a").agg(F.collect_list(F.struct("k", "l", "r")).alias("parts"))
    return per_batch(rows, weakest, T.StructType([*_RUN.fields[:2], *[T.StructField(c, T.LongType()) for c in ("a", "l", "r", "score")]]))


def mine(docs: DataFrame, longest: int = LONGEST, least: int = 10, inside_percent: int = 50, top: int = 2000, **limits) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` collocations of each lang."""
    counts = count_phrases(docs, longest, least, **limits)
    found = scored(counts)
    for longer in counts[2:]:
        words = F.split("phrase", " ", -1)
        inner = longer.withColumn("w", words).withColumn("size", F.size("w"))
        spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(
            F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
        most = inner.select("lang", "f", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("most"))
        found = found.join(most, ["lang", "phrase"], "left").where(
            F.col("most").isNull() | (F.lit(100).cast("decimal(20,0)") * F.col("most") < F.lit(inside_percent).cast("decimal(20,0)") * F.col("a"))).drop("most")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    first = found.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    sizes = counts[0].where("phrase = ''").select("lang", F.col("f").alias("n"))
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
