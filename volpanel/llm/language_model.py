"""LM scoring: a log-bilinear model trained with noise-contrastive estimation, over whole texts.

Tokens are words (A-Z in lower case) and one end per text. Training texts are all those
whose crc32 of the id is not 2 modulo 7.

1. **Counts** of all training tokens, combined per batch and summed by a shuffle: they
   grow with the corpus and stay a table.
2. **Vocabulary**: all tokens with at least sqrt(training tokens) / SPREAD occurrences; it grows with
   the corpus, without a cap. All others share one class, scored by an add-one unigram inside it.
   Every task holds the model, about 210 bytes a class.
3. **Training**: score(next | word) = (C q_word) . r_next + b_next, by noise-contrastive estimation
   with AdaGrad. EPOCHS passes over all training pairs, so steps grow with them. The classes of each text
   are stored as runs; a hash of its id and text names the round of a pass and the shard it is learned in. Shards
   grow with the root of the training tokens, as the model does. In each of ROUNDS rounds every shard learns its
   runs, in order of hash and place, from common parameters, and the rows touched are averaged. So the model does
   not depend on files, partitions or cores. Equal pairs of a portion of runs are learned as one with a weight, and a
   step holds each class before against each noise class once. A round's shuffle files go when it ends.
4. **Normalisers**: exact, over all classes for each class before, in tasks by blocks of classes.
5. **Scores**: one pass over the texts (``walk``) leaves their base scores, runs and rare tokens. Frequent tokens are
   looked up in the batch; the rare ones of a text are rows (text, token, times) that meet their counts in a join. Common
   tokens never are, so no hot token is shuffled. The steps of a text are summed over its runs.

``base`` is the add-one unigram score of the text over all training tokens.

Defined results: null or empty text: its end alone. A null id hashes like an empty one.
Repeated rows are scored alike, and each trains; those with equal id and text do so in one shard, as a
stream. No training text: the base is log10 of 1
per token (V = 0), the model one class. Empty table: no rows. Other columns are ignored.
"""

import pickle
from contextlib import contextmanager
from functools import cached_property
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volpanel.llm.common import LOWER, as_batch, binaries, mix, most_frequent, per_batch, slices, word_hashes
from volpanel.sources.stage import stage

END = int(word_hashes([b""])[0])
#: Tokens whose counts are sent to every task (twelve bytes each).
COMMON = 1 << 18
#: A token of the vocabulary has at least sqrt(training tokens) / SPREAD of them (two at least): the vocabulary grows about
#: with the root of the corpus, and the work for all normalisers, its square, with the corpus.
SPREAD = 100
#: Width of the vectors; passes over all pairs; rounds a pass; pairs a run; classes a block; most times of a pair in one row.
WIDTH, EPOCHS, ROUNDS, RUN, BLOCK, HEAVY = 24, 1, 4, 512, 256, 16
#: Pairs, rows and classes of a block of scores, a quarter and half a megabyte.
PART, ROWS, COLUMNS = 256, 128, 1024
#: Spark's switch for dropping the shuffle files of a finished query.
DROP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Pairs whose vectors are looked up at a time.
SOME = 1 << 14
#: sqrt(training tokens) a shard; pairs that are learned at a time.
SHARD, PORTION = 512, 1 << 21


def tokens(b: bytes | None) -> np.ndarray:
    """Hashes of the words and the end."""
    return word_hashes([*(b or b"").translate(LOWER).split(), b""])


def held_out(key: str):
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def count_tokens(texts: DataFrame) -> DataFrame:
    """(h, c) over all texts (column text)."""
    def run(batch):
        h, c = np.unique(np.concatenate([tokens(b) for b in binaries(batch.column(0))]), return_counts=True)
        yield {"h": signed(h), "c": c}

    schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("c", T.LongType())])
    return per_batch(texts, run, schema).groupBy("h").agg(F.sum("c").alias("c"))


class Lookup:
    """Counts and classes of the common tokens; class k - 1 is shared, k stands before the first token."""

    def __init__(self, h: np.ndarray, c: np.ndarray, vocabulary: int):
        order = np.argsort(h)
        rank = np.arange(len(h))
        self.h, self.c = h[order], c[order]
        self.known = min(vocabulary, len(h))
        self.k = self.known + 1
        self.cls = np.minimum(rank, self.known)[order].astype(np.int32)

    @cached_property
    def index(self):
        """A hash table of the common tokens, made once in each worker."""
        import pandas as pd

        return pd.Index(self.h)

    def find(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(is common, count, class) of each token."""
        if not len(self.h):
            return np.zeros(len(t), bool), np.zeros(len(t), np.int64), np.full(len(t), self.known, np.int32)
        at = self.index.get_indexer(t)
        hit = at >= 0
        return hit, np.where(hit, self.c[at], 0), np.where(hit, self.cls[at], self.known)


def joined(batch_texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of a batch and the index of each text's end."""
    parts = [tokens(b) for b in batch_texts]
    return np.concatenate(parts), np.cumsum([len(p) for p in parts]) - 1


def walk(texts: DataFrame, lookup, shards: int, base_norm: float, rest_norm: float, all_common: bool) -> DataFrame:
    """The rows of all texts (key, text, held_out, hash), in one pass over them: one of each text (``base`` and ``rest``, its base score
    and its tokens' scores inside the shared class, both without rare tokens), its runs, and its rare tokens (``rare``, ``times``).

    A run holds the classes of RUN pairs, k before the first of a text; runs overlap by one class. Those of training texts
    have a ``turn`` and a ``shard``."""
    schema = T.StructType([T.StructField("row", T.LongType()), texts.schema["key"], T.StructField("held_out", T.BooleanType()),
                           *(T.StructField(c, t()) for c, t in (
                               ("n_tokens", T.LongType), ("n_known", T.LongType), ("base", T.DoubleType), ("rest", T.DoubleType),
                               ("turn", T.IntegerType), ("shard", T.IntegerType), ("hash", T.LongType), ("place", T.IntegerType), ("run", T.BinaryType),
                               ("rare", T.LongType), ("times", T.LongType)))])

    def run(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        target, w = to_arrow_schema(schema), lookup.value
        part = lambda row, **found: as_batch({x.name: pa.nulls(len(row), x.type) for x in target} | {"row": row} | found, target)
        row = TaskContext.get().partitionId() << 33
        for batch in (x for whole in batches for x in slices(whole)):
            t, ends = joined(binaries(batch.column(1)))
            common, c, cls = w.find(t)
            log_c = np.log10(c + 1.0)
            begins = np.append(0, ends[:-1] + 1)
            rows, size = row + np.arange(len(ends)), ends - begins + 1
            yield part(rows, key=batch.column(0), held_out=batch.column(2), n_tokens=size, n_known=np.add.reduceat((c > 0).astype(np.int64), begins),
                       base=np.add.reduceat(log_c, begins) - size * base_norm, rest=np.add.reduceat(np.where(cls == w.known, log_c - rest_norm, 0.0), begins))
            owner, place, found = [], [], []
            for k, (a, b) in enumerate(zip(begins.tolist(), (ends + 1).tolist(), strict=True)):
                seq = np.append(np.int32(w.k), cls[a:b])
                for i in range(0, len(seq) - 1, RUN):
                    owner.append(k)
                    place.append(i // RUN)
                    found.append(seq[i:i + RUN + 1].tobytes())
            h = mix(batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64))[owner]
            held = batch.column(2).to_numpy(zero_copy_only=False)[owner]
            yield part(rows[owner], turn=pa.array((h % ROUNDS).astype(np.int32), mask=held), shard=pa.array((h // ROUNDS % shards).astype(np.int32), mask=held),
                       hash=signed(h), place=place, run=found)
            if not all_common:
                which = np.flatnonzero(~common)
                owner = np.searchsorted(ends, which)
                order = np.lexsort((t[which], owner))
                o, h = owner[order], t[which][order]
                new = np.flatnonzero(np.append(True, (o[1:] != o[:-1]) | (h[1:] != h[:-1]))) if len(o) else o
                yield part(rows[o[new]], rare=signed(h[new]), times=np.diff(np.append(new, len(o))))
            row += len(rows)

    return texts.select("key", "text", "held_out", "hash").mapInArrow(run, schema)


def portions(batches):
    """(shard, runs) of sorted batches (shard, run), PORTION pairs at a time, wherever the batches end."""
    shard, held, size = None, [], 0
    for batch in batches:
        for s, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and (s != shard or size >= PORTION):
                yield shard, held
                held, size = [], 0
            shard = s
            held.append(x)
            size += len(x) // 4 - 1
    if held:
        yield shard, held


def unrolled(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class before, class) of all pairs and the number of each run's."""
    flat, size = np.frombuffer(b"".join(runs), np.int32), np.array([len(x) // 4 for x in runs])
    first = np.zeros(len(flat), bool)
    first[np.cumsum(size) - size] = True
    return flat[:-1][~first[1:]], flat[~first], size - 1


def pairs_of(runs: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class before, class, times) of all pairs; frequent ones in several rows of at most HEAVY times."""
    before, after, _ = unrolled(runs)
    code, n = np.unique(before.astype(np.int64) * k + after, return_counts=True)
    rows = -(-n // HEAVY)
    first = np.repeat(np.cumsum(rows) - rows, rows)
    code, n, rows = np.repeat(code, rows), np.repeat(n, rows), np.repeat(rows, rows)
    times = n // rows + (np.arange(len(code)) - first < n % rows)
    return code // k, code % k, times.astype(np.float32)


class Model:
    """score(next | word) = (C q_word) . r_next + b_next, and what AdaGrad sums up for each row."""

    def __init__(self, unigram: np.ndarray, width: int = WIDTH, seed: int = 7):
        k, r = len(unigram), np.random.default_rng(seed)
        self.k, self.cum, self.log_unigram = k, np.cumsum(unigram), np.log(unigram).astype(np.float32)
        f = lambda *shape: r.normal(0, 0.1, shape).astype(np.float32)
        # a row of rows: q, its sum, its steps; of out: r, b, the sums of both, their steps
        self.rows = np.concatenate([f(k + 1, width), np.zeros((k + 1, 2), np.float32)], 1)
        self.out = np.concatenate([f(k, width), self.log_unigram[:, None], np.zeros((k, 3), np.float32)], 1)
        self.c = np.concatenate([np.eye(width, dtype=np.float32), np.zeros((width, 2), np.float32)], 1)

    def step(self, before, after, times, r, noise: int, rate: float) -> None:
        """Noise-contrastive estimation: tells pairs from shared noise classes drawn by frequency. A class before and a noise
        class that come several times are held against each other once, with their weights."""
        d = self.c.shape[0]
        wrong, drawn = np.unique(np.minimum(np.searchsorted(self.cum, r.random(noise) * self.cum[-1], side="right"), self.k - 1), return_counts=True)
        drawn = drawn.astype(np.float32)[:, None]
        log_noise = np.float32(np.log(noise))
        before, order, first = grouped(before)
        after, times, owner = after[order], times[order], np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        weight = times / times.mean() / len(times)
        c, q = self.c[:, :d], self.rows[before][:, :d]
        h = with_one(q @ c.T)
        right, false_r = self.out[after][:, :d + 1], self.out[wrong][:, :d + 1]
        right[:, d] -= self.log_unigram[after] + log_noise
        false_r[:, d] -= self.log_unigram[wrong] + log_noise
        own = h[owner]
        dt = (weight / (1 + np.exp(np.minimum(np.einsum("ij,ij->i", own, right), 60))))[:, None]  # ascent: d log-likelihood
        dh, g_wrong = np.add.reduceat(dt * right[:, :d], first), np.zeros_like(false_r)
        negative, vectors, share = np.ascontiguousarray(-false_r.T), drawn * false_r[:, :d], np.add.reduceat(weight, first)[:, None]
        for i in range(0, len(h), PART):  # classes before by noise classes, as many as stay in the cache
            x = h[i:i + PART] @ negative
            with np.errstate(over="ignore"):  # 1 / inf is the 0 it should be
                np.exp(x, out=x)
            x += 1
            np.reciprocal(x, out=x)
            dh[i:i + PART] -= share[i:i + PART] * (x @ vectors)
            g_wrong -= x.T @ (share[i:i + PART] * h[i:i + PART])
        self._add(self.c, slice(None), dh.T @ q, d, rate)
        self._add(self.rows, before, dh @ c, d, rate)
        at, order, first = grouped(np.concatenate([after, wrong]))
        self._add(self.out, at, np.add.reduceat(np.concatenate([dt * own, drawn * g_wrong])[order], first), d, rate)

    @staticmethod
    def _add(table, at, g, d, rate) -> None:
        width, rows = g.shape[1], table[at]
        for a, b, s in ((0, d, width), (d, width, width + 1)):  # vectors, then biases
            if b > a:
                rows[:, s] += np.einsum("ij,ij->i", g[:, a:b], g[:, a:b]) / np.float32(b - a)
                rows[:, a:b] += g[:, a:b] * (np.float32(rate) / np.sqrt(rows[:, s] + np.float32(1e-12)))[:, None]
        rows[:, -1] += 1
        table[at] = rows

    def learn(self, before, after, times, r, noise: int = 256, batch: int = 4096, rate: float = 0.1) -> None:
        order = r.permutation(len(before))
        for i in range(0, len(order), batch):
            o = order[i:i + batch]
            self.step(before[o], after[o], times[o], r, noise, rate)

    def tables(self) -> dict[str, np.ndarray]:
        return {"c": self.c, "out": self.out, "rows": self.rows}

    def hidden(self) -> np.ndarray:
        d = self.c.shape[0]
        return self.rows[:, :d] @ self.c[:, :d].T

    def scores(self, hidden: np.ndarray) -> np.ndarray:
        d = self.c.shape[0]
        return hidden @ self.out[:, :d].T + self.out[:, d]


def grouped(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, the stable order that sorts ``at``, and where each value begins in it."""
    at, order = np.divmod(np.sort(at * len(at) + np.arange(len(at))), len(at))
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return at[first], order, first


def with_one(x: np.ndarray) -> np.ndarray:
    """A column of ones behind ``x``, for the bias."""
    return np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1)


def log_sum(score: np.ndarray) -> np.ndarray:
    top = score.max(1)
    return top + np.log(np.exp(score - top[:, None]).sum(1, dtype=np.float64))


def log_sums(hidden: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``log_sum`` of the scores of ``hidden`` with all classes (columns of vector, bias and one), by parts of the classes that
    stay in the cache. Scores are taken less a shift, at first the best of the first part, raised where a score is far above."""
    h = np.concatenate([with_one(hidden), np.zeros((len(hidden), 1), np.float32)], 1)
    h[:, -1] = -(h @ right[:, :COLUMNS]).max(1)
    total = np.zeros(len(h))
    for i in range(0, right.shape[1], COLUMNS):
        x = h @ right[:, i:i + COLUMNS]
        if x.max() > 40:
            more = np.maximum(x.max(1), 0)
            x -= more[:, None]
            h[:, -1] -= more
            total *= np.exp(-more.astype(np.float64))
        np.exp(x, out=x)
        total += x @ np.ones(x.shape[1], np.float32)
    return np.log(total) - h[:, -1]


@contextmanager
def shuffles_dropped(spark):
    """The shuffle files of a query that is built and run inside go when it ends, not when its plan is collected as garbage."""
    before = spark.conf.get(DROP, None)
    spark.conf.set(DROP, "true")
    try:
        yield
    finally:
        spark.conf.unset(DROP) if before is None else spark.conf.set(DROP, before)


def train_everywhere(runs: DataFrame, model: Model, epochs: int) -> Model:
    """The model after ``epochs`` passes over all pairs of ``runs``, ROUNDS rounds each.

    In a round every shard learns a ROUNDS-th of its runs from the common parameters; blocks of rows it has touched
    meet in a shuffle, where a row becomes the mean over its steps and the sums add up."""
    import pandas as pd

    spark = runs.sparkSession
    schema = "name string, block long, part int, body binary"
    for turn in range(epochs * ROUNDS):
        shared = spark.sparkContext.broadcast(model)

        def learn(batches):
            for shard, found in groupby(portions(batches), key=lambda p: p[0]):
                own, r = pickle.loads(pickle.dumps(shared.value)), np.random.default_rng([turn, shard])
                for x in own.tables().values():
                    x[:, -1] = 0
                for _, portion in found:
                    own.learn(*pairs_of(portion, own.k), r)
                for name, x in own.tables().items():
                    for b in range(0, len(x), BLOCK):
                        if x[b:b + BLOCK, -1].any():
                            yield pa.RecordBatch.from_pydict({"name": [name], "block": [b], "part": pa.array([shard], pa.int32()),
                                                              "body": [x[b:b + BLOCK].tobytes()]})

        def mean(key, found):
            old = shared.value.tables()[key[0]][key[1]:key[1] + BLOCK].astype(np.float64)
            change, steps = np.zeros_like(old), np.zeros(len(old))
            d, last = shared.value.c.shape[0], old.shape[1] - 1
            sums = np.arange(last - (2 if key[0] == "out" else 1), last)
            for body in found.sort_values("part")["body"]:
                x = np.frombuffer(body, np.float32).reshape(old.shape)
                moved = (x - old) * x[:, -1:]
                moved[:, sums] = x[:, sums] - old[:, sums]
                change += moved
                steps += x[:, -1]
            scale = np.where(steps, steps, 1)[:, None] * np.ones(old.shape)
            scale[:, sums] = 1
            new = (old + change / scale).astype(np.float32)
            new[:, -1] = 0
            return pd.DataFrame({"name": [key[0]], "block": [key[1]], "part": [0], "body": [new.tobytes()]})

        with shuffles_dropped(spark):
            done = (runs.where(F.col("turn") == turn % ROUNDS).repartition("shard").sortWithinPartitions("shard", "hash", "place")
                    .select("shard", "run").mapInArrow(learn, schema)
                    .groupBy("name", "block").applyInPandas(mean, schema).toPandas())  # as large as the model, which every task holds
        model = pickle.loads(pickle.dumps(model))
        for name, b, body in zip(done["name"], done["block"], done["body"], strict=True):
            x = model.tables()[name]
            x[b:b + BLOCK] = np.frombuffer(body, np.float32).reshape(-1, x.shape[1])
        shared.destroy()  # each is a file in every worker
    return model


def normalisers(spark, model: Model) -> np.ndarray:
    """log of the sum of exp(score) over all classes, for each class before."""
    blocks = -(-(model.k + 1) // ROWS)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        hidden = m.hidden()
        right = np.ascontiguousarray(with_one(m.out[:, :hidden.shape[1] + 1]).T)
        for batch in batches:
            for at in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict({"at": [at], "z": [log_sums(hidden[at * ROWS:(at + 1) * ROWS], right).tobytes()]})

    found = spark.range(0, blocks, 1, min(blocks, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(run, "at long, z binary").toPandas()
    return np.concatenate([np.frombuffer(z) for z in found.sort_values("at")["z"]])


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: int | None = None) -> DataFrame:
    """One row per document: ``key``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``
    and ``score``, the model's log10 probability of the text. ``vocabulary``: at most so many tokens; None: all above the count."""
    spark = docs.sparkSession
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), held_out(key).alias("held_out"))
    training = own.where("not held_out")
    counts = stage(count_tokens(training.select("text")), "counts")
    n, v = (x or 0 for x in counts.agg(F.sum("c"), F.count("*")).first())
    least = max(2.0, n ** 0.5 / SPREAD)
    top = most_frequent(counts, "c", COMMON)
    if vocabulary is None:
        top = top.union(counts.where(F.col("c") >= least)).distinct()
    top = top.toPandas().sort_values(["c", "h"], ascending=[False, True])
    all_common = len(top) == v
    w = Lookup(top["h"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64), int((top["c"] >= least).sum()) if vocabulary is None else vocabulary)
    n_rest = n - int(top["c"].iloc[:w.known].sum())
    v_rest = v - w.known
    lookup = spark.sparkContext.broadcast(w)
    unigram = np.append(top["c"].to_numpy(np.float64)[:w.known], n_rest) + 1
    base_norm, rest_norm = float(np.log10(n + v + 1)), float(np.log10(n_rest + v_rest + 1))
    hashed = own.withColumn("hash", F.xxhash64(F.col("key").cast("string"), "text"))
    seen = stage(walk(hashed, lookup, max(1, int(n ** 0.5 / SHARD)), base_norm, rest_norm, all_common), "seen")
    runs = seen.where("turn is not null").select("turn", "shard", "hash", "place", "run")
    model = train_everywhere(runs, Model(unigram / unigram.sum()), EPOCHS)
    d = model.c.shape[0]
    fitted = spark.sparkContext.broadcast((model.hidden(), model.out[:, :d].copy(), model.out[:, d].copy(), normalisers(spark, model)))

    def steps(batches):
        hidden, right, bias, z = fitted.value
        for batch in (part for whole in batches for part in slices(whole)):
            before, after, size = unrolled(batch.column(1).to_pylist())
            step = np.concatenate([np.einsum("ij,ij->i", hidden[b], right[a], dtype=np.float64) + bias[a] - z[b]
                                   for b, a in ((before[i:i + SOME], after[i:i + SOME]) for i in range(0, len(before), SOME))])
            yield pa.RecordBatch.from_pydict({"row": batch.column(0), "step": np.add.reduceat(step, np.cumsum(size) - size) / np.log(10)})

    scored = stage(seen.where("run is not null").select("row", "run").mapInArrow(steps, "row long, step double").groupBy("row").agg(F.sum("step").alias("steps")), "scored")
    rare = (seen.where("rare is not null").select("row", F.col("rare").alias("h"), "times").join(counts, "h").groupBy("row")
            .agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("log_c")))
    rows = seen.where("n_tokens is not null").join(scored, "row").join(rare, "row", "left")
    more = F.coalesce("log_c", F.lit(0.0))
    return rows.select(F.col("key").alias(key), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
                       F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("steps") + F.col("rest") + more).alias("score"))
