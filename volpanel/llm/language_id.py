"""Language ID: blended-spectrum presence kernels, Nyström landmarks, one-versus-rest kernel ridge regression.

A text is the set of its character n-grams, n = 1 to LONGEST_GRAM, in lower case, where each run of anything but letters
is one blank and blanks stand at both ends. k(x, z) = |X and Z| / sqrt(|X| |Z|).

1. **Sample.** Texts to learn from are chosen by a hash of the text: about SAMPLE in all, the same number for each
   language (all, if it has fewer distinct texts), copies once, none above SAMPLE_BYTES. These three bound the fit; the
   counts behind them are over all rows. Only the n-gram sets of the sample reach the driver.
2. **Landmarks.** LANDMARKS of the sample, equally many a language, by the same hash. With the kernel matrix K_zz = U S U'
   the features of a text are k(x, Z) U S^-1/2; one ridge regression per language against all others is solved there.
3. **Scores.** k(x, Z) is a product of the batch's n-gram presence matrix B with that of the landmarks, L, so the scores
   (B L) A are B (L A): one sparse product per batch with a table of n-grams by languages, which is sent to all tasks.
   Its size is bounded by LANDMARKS x SAMPLE_BYTES and the number of languages. Whole texts are scored, in one pass, without a shuffle.

``score`` is the regression value of the winner, from [-1, 1] to [0, 1], clipped. Equal values: the smaller lang.

Defined results: null text, or one without a letter: ``und`` with score 0; so does everything if nothing can be learned.
Rows whose lang is null are not learned from; the empty lang is a language. Repeated rows are judged alike and learned
once. A null id hashes like an empty one. Empty table: no rows. Other columns are ignored.
"""

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volpanel.llm.common import mix, per_batch

#: Longest n-gram; texts learned from; fewest of a language; bytes of such a text; landmarks; weight of the ridge.
LONGEST_GRAM, SAMPLE, LEAST, SAMPLE_BYTES, LANDMARKS, RIDGE = 4, 2048, 16, 1 << 16, 256, 1.0
#: Characters of a long text looked at in one go.
CHUNK = 1 << 20
UNKNOWN = "und"
_NO_LETTERS = re.compile(r"[\W\d_]+")
_NEXT = np.uint64(0x9E3779B97F4A7C15)  # fixed value, odd


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def grams(text: str) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of a text."""
    plain = f" {_NO_LETTERS.sub(' ', text.lower()).strip()} "
    out = np.zeros(0, np.uint64)
    for at in range(0, len(plain), CHUNK):
        c = np.frombuffer(plain[at:at + CHUNK + LONGEST_GRAM - 1].encode("utf-32-le"), np.uint32).astype(np.uint64)
        h, parts = mix(c + _NEXT), []
        parts.append(h)
        for n in range(2, min(LONGEST_GRAM, len(c)) + 1):
            h = mix(h[:-1] * _NEXT + c[n - 1:])
            parts.append(h)
        found = np.unique(np.concatenate(parts))
        out = np.union1d(out, found) if at else found
    return out


@dataclass
class Classifier:
    """A table of n-grams by languages; ``names`` ascend."""

    names: list
    grams: np.ndarray
    weights: np.ndarray

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        """Regression values, one row per n-gram set."""
        out = np.zeros((len(sets), len(self.names)))
        sizes = np.array([len(s) for s in sets])
        if not len(self.grams) or not len(sets):
            return out
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        at = np.minimum(np.searchsorted(self.grams, flat), len(self.grams) - 1)
        hit = self.grams[at] == flat
        at, owner = at[hit], owner[hit]
        if len(at):  # owners ascend
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            out[owner[first]] = np.add.reduceat(self.weights[at], first, axis=0)
        return out / np.sqrt(np.maximum(sizes, 1))[:, None]

    def judge(self, texts: list) -> tuple[list, list]:
        lettered = [i for i, t in enumerate(texts) if has_letter(t)] if self.names else []
        pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        values = self.scores([grams(texts[i]) for i in lettered])
        for i, v in zip(lettered, values, strict=True):
            best = int(v.argmax())
            pred[i], score[i] = self.names[best], float(np.clip((v[best] + 1) / 2, 0, 1))
        return pred, score


def presence(sets: list[np.ndarray], vocabulary: np.ndarray) -> np.ndarray:
    """Rows: n-grams of the vocabulary; columns: sets; each column over the root of its set's size."""
    out = np.zeros((len(vocabulary), len(sets)), np.float32)
    for j, s in enumerate(sets):
        at = np.minimum(np.searchsorted(vocabulary, s), len(vocabulary) - 1)
        out[at[vocabulary[at] == s], j] = 1 / np.sqrt(len(s))
    return out


def solve(sets: list[np.ndarray], langs: list[str], landmarks: list[int], ridge: float = RIDGE) -> Classifier:
    """Kernel ridge regression on the Nyström features of ``sets``."""
    names = sorted(set(langs))
    if not names:
        return Classifier([], np.zeros(0, np.uint64), np.zeros((0, 0)))
    chosen = [sets[i] for i in landmarks]
    vocabulary = np.unique(np.concatenate(chosen))
    table = presence(chosen, vocabulary)
    kernel = np.concatenate([presence(sets[i:i + 64], vocabulary).T @ table for i in range(0, len(sets), 64)]).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel[landmarks])
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    x = kernel @ root
    y = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    w = np.linalg.solve(x.T @ x + ridge * np.eye(x.shape[1]), x.T @ y)
    return Classifier(names, vocabulary, table.astype(np.float64) @ (root @ w))


def sample(labelled: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(lang, key, text): about ``size`` distinct texts, equally many of each language."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.octet_length("text") <= SAMPLE_BYTES)).select(
        "lang", "text", F.pmod(F.xxhash64("text"), F.lit(1 << 40)).alias("key"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("key").alias("n"))
    langs = sizes.agg(F.count("*")).first()[0]
    quota = max(LEAST, size // max(1, langs))
    limits = sizes.select("lang", (F.least(F.lit(1.0), 1.2 * quota / F.col("n")) * float(1 << 40)).alias("limit"))
    return rows.join(limits, "lang").where("key < limit").drop("limit").dropDuplicates(["lang", "key"])


def fit(labelled: DataFrame, size: int = SAMPLE, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Classifier:
    """A classifier from ``labelled`` (text, lang)."""
    def run(batch):
        found = [grams(t) if has_letter(t) else np.zeros(0, np.uint64) for t in batch.column(2).to_pylist()]
        yield {"lang": batch.column(0), "key": batch.column(1), "grams": [g.tobytes() for g in found]}

    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("key", T.LongType()), T.StructField("grams", T.BinaryType())])
    rows = per_batch(sample(labelled, size).select("lang", "key", "text"), run, schema).toArrow().to_pylist()
    rows = sorted((r["lang"], r["key"], r["grams"]) for r in rows if r["grams"])
    each = max(4, landmarks // max(1, len({r[0] for r in rows})))
    chosen, seen = [], {}
    for i, (lang, _, _) in enumerate(rows):
        seen[lang] = seen.get(lang, 0) + 1
        if seen[lang] <= each:
            chosen.append(i)
    return solve([np.frombuffer(r[2], np.uint64) for r in rows], [r[0] for r in rows], chosen, ridge)


def held_out(key: str = "doc_id") -> Column:
    """Rows that nothing is learned from."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify(docs: DataFrame, model: Classifier | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; without a model, one is learned from the rows not held out."""
    if model is None:
        model = fit(docs.where(~held_out()).select("text", "lang"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        pred, score = shared.value.judge(batch.column(2).to_pylist())
        yield {"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": pred, "score": score}

    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    return per_batch(docs.select("doc_id", held_out().alias("held_out"), "text"), run, schema)
