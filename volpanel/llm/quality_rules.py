"""Quality rules by weak supervision: rules vote or abstain, EM estimates how far to trust each.

1. One narrow pass measures every whole text and lets each rule of RULES vote
   good, bad or abstain.
2. Votes are counted by pattern over all documents (combined before the shuffle;
   at most 3 ** len(RULES) patterns, whatever the input).
3. Expectation-maximisation on the pattern counts: classes good and bad, and for
   each rule its rate of bad, abstain and good votes in either class. Priors worth
   WEIGHT texts, whatever the corpus, hold the estimates where there are few texts;
   beyond, the texts decide how far each rule is to be trusted, and a rule that fires
   in good texts too loses its say. What the classes mean is held by bounds, not by
   priors: no rule is worse than chance, and bad texts have LEAST_DEFECTS defects on
   average at least. Texts that fail the base limits are decided and take no part.
4. Each pattern's posterior probability of good replaces all-must-pass filtering:
   a text goes if it is below ``least``, or fails the two base limits.

Defined results: null, empty or wordless text: all counts 0, base_failed. Repeated rows
each get the same verdict. Empty table: no rows. Other columns are ignored.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volpanel.llm.common import LOWER, binaries, gram_hashes, per_batch, slices, whole_row, word_hashes
from volpanel.sources.stage import stage

BAD, NONE, GOOD = 0, 1, 2
#: Texts that a prior is worth; defects of a bad text on average, at least.
WEIGHT, LEAST_DEFECTS = 50, 0.5
#: Frequent function words of English, German, French and Spanish (fixed values).
STOP_WORDS = frozenset(
    "a and are as at be by for from have in is it not of on or that the this to was were which will with you "
    "als am auch auf aus bei das dass dem den der des die ein eine einen er es für hat ich im ist mit nach nicht sich sie sind so und von war wie zu zum "
    "au aux avec ce dans de des du elle en est et il la le les mais ne ou par pas plus pour que qui sa se son sur un une "
    "al como con del el las lo los más no o para pero por se sin su una y ya".encode().split())
_PUNCTUATION = b".,;:!?\"'()[]"
_LINE_END = (b".", b"!", b"?", b"\"", b":", b";", b"\xc2\xbb", b"\xe2\x80\x9d", b"\xe3\x80\x82")
_SPACE = np.array([c in b"\x20\x09\x0a\x0b\x0c\x0d" for c in range(256)])
_FOLLOWS = np.array([0x80 <= c < 0xC0 for c in range(256)])
_SYMBOL = np.array([c in b"#*$%&|<>" for c in range(256)])


@dataclass
class Measures:
    n_words: int
    word_chars: int
    n_symbols: int
    n_lines: int
    n_dup_lines: int
    n_repeat_words: int
    n_upper_words: int
    n_stop_words: int
    n_closed_lines: int
    n_exclaims: int
    n_echoes: int


def measure(b: bytes) -> Measures:
    words = b.split()
    n = len(words)
    bytes_ = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    lines, seen, dup, closed = 0, set(), 0, 0
    for line in b.split(b"\n"):
        s = line.strip()
        if s:
            lines += 1
            dup += line in seen
            seen.add(line)
            closed += s.endswith(_LINE_END)
    repeat = echoes = 0
    if n > 1:
        h = word_hashes(words)
        echoes = int((h[1:] == h[:-1]).sum())
        if n > 5:
            g = gram_hashes(h, 5)
            s = np.sort(g)
            twice = s[1:][s[1:] == s[:-1]]
            if len(twice):
                at = np.minimum(np.searchsorted(twice, g), len(twice) - 1)
                cover = np.zeros(n + 1, np.int64)
                hit = np.flatnonzero(twice[at] == g)
                np.add.at(cover, hit, 1)
                np.add.at(cover, hit + 5, -1)
                repeat = int((np.cumsum(cover)[:n] > 0).sum())
    return Measures(n, int(bytes_.sum() - bytes_[_SPACE].sum() - bytes_[_FOLLOWS].sum()), int(bytes_[_SYMBOL].sum()), lines, dup,
                    repeat, sum(map(bytes.isupper, words)), sum(map(STOP_WORDS.__contains__, b.translate(LOWER, _PUNCTUATION).split())),
                    closed, int(bytes_[33]), echoes)


def _defect(found: bool) -> int:
    return BAD if found else NONE


def _merit(found: bool) -> int:
    return GOOD if found else NONE


#: Name, vote and prior of each rule. A defect says bad or nothing: that a text lacks one defect does not make it
#: good. A merit says good or nothing. Priors: rates of (bad, abstain, good) in bad and in good texts.
_DEFECT, _MERIT = [[0.199, 0.800, 0.001], [0.003, 0.996, 0.001]], [[0.001, 0.499, 0.500], [0.001, 0.199, 0.800]]
RULES = {
    "symbols": (lambda m: _defect(m.n_symbols > 0.1 * m.n_words), _DEFECT),
    "shouting": (lambda m: _defect(m.n_upper_words > 0.3 * m.n_words), _DEFECT),
    "exclamation": (lambda m: _defect(m.n_exclaims > 0.2 * m.n_words), _DEFECT),
    "echo": (lambda m: _defect(m.n_echoes > 0.1 * m.n_words), _DEFECT),
    "line copies": (lambda m: _defect(m.n_dup_lines > 0.4 * m.n_lines), _DEFECT),
    "word length": (lambda m: _defect(not 2 * m.n_words <= m.word_chars <= 15 * m.n_words), _DEFECT),
    "stop words": (lambda m: _merit(m.n_stop_words >= 0.08 * m.n_words), _MERIT),
    "line ends": (lambda m: _merit(m.n_closed_lines >= 0.7 * m.n_lines), _MERIT),
}


def votes(m: Measures) -> int:
    """The pattern of all votes as one number in base 3; wordless texts: all abstain."""
    out = 0
    for rule, _ in RULES.values():
        out = out * 3 + (rule(m) if m.n_words else NONE)
    return out


def bounded(rates: np.ndarray) -> np.ndarray:
    """The rates with every rule at chance or better and enough defects in bad texts; rates[class][rule][vote], class 1 is good."""
    out = rates.copy()
    for vote, better in ((BAD, 0), (GOOD, 1)):
        worse = out[better, :, vote] < out[1 - better, :, vote]
        out[:, worse, vote] = out[:, worse, vote].mean(0)
    defects = np.array([r is _DEFECT for _, r in RULES.values()])
    short = LEAST_DEFECTS - out[0, defects, BAD].sum()
    if short > 0:
        out[0, defects, BAD] += short / defects.sum()
    out[:, :, NONE] = np.maximum(1 - out[:, :, BAD] - out[:, :, GOOD], 1e-9)
    return out / out.sum(2, keepdims=True)


def fit(counts: dict[int, int], rounds: int = 500) -> tuple[dict[int, float], np.ndarray]:
    """Posterior probability of good per pattern, and rates[class][rule][vote] (class 1: good)."""
    k = len(RULES)
    patterns = sorted(counts)
    if not patterns:
        return {}, np.zeros((2, k, 3))
    n = np.array([counts[p] for p in patterns], float)
    v = np.array([[p // 3 ** (k - 1 - j) % 3 for j in range(k)] for p in patterns])
    one = np.eye(3)[v]  # pattern x rule x vote
    rates, share = np.array([rates for _, rates in RULES.values()]).transpose(1, 0, 2), 0.8
    prior = rates * WEIGHT
    for _ in range(rounds):
        log = np.array([(one * np.log(rates[c])).sum((1, 2)) for c in (0, 1)])
        good = 1 / (1 + np.exp(np.clip(log[0] - log[1] + np.log(1 - share) - np.log(share), -700, 700)))
        weight = np.array([n * (1 - good), n * good])
        rates = prior + np.einsum("cp,prv->crv", weight, one)
        rates = bounded(rates / rates.sum(2, keepdims=True))
        before, share = share, (weight[1].sum() + 0.8 * WEIGHT) / (n.sum() + WEIGHT)
        if abs(share - before) < 1e-12:
            break
    return dict(zip(patterns, good.tolist(), strict=True)), rates


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def posteriors(seen: DataFrame, min_words: int, max_repeat: int) -> dict[int, float]:
    """Probability of good per vote pattern, from the counts over all of ``seen`` that is not decided."""
    counted = seen.where(~base_failed(F.col("n_words"), F.col("n_repeat_words"), min_words, max_repeat)).groupBy("pattern").agg(F.count("*").alias("n")).collect()  # at most 3 ** len(RULES) rows
    return fit({r["pattern"]: r["n"] for r in counted})[0]


def measures(docs: DataFrame, key: str, text: str) -> DataFrame:
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType),
                           *(T.StructField(c, T.LongType()) for c in (*BASE, "pattern"))])

    def run(batch):
        found = [measure(b or b"") for b in binaries(batch.column(1))]
        yield {"key": batch.column(0), "pattern": [votes(m) for m in found]} | {
            c: pa.array([getattr(m, c) for m in found], pa.int64()) for c in BASE}

    return per_batch(docs.select(key, text), run, schema)


def base_failed(n_words, n_repeat_words, min_words: int, max_repeat: int):
    return (n_words < min_words) | (100 * n_repeat_words > max_repeat * n_words)


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.5, min_words: int = 10,
          max_repeat: int = 20) -> DataFrame:
    """One row per document: ``key``, the base counts, ``base_failed``, ``p_good`` and ``kept``."""
    seen = stage(measures(docs, key, text), "measures")
    table = docs.sparkSession.createDataFrame(list(posteriors(seen, min_words, max_repeat).items()), "pattern long, p_good double")
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"), min_words, max_repeat)
    return (seen.join(F.broadcast(table), "pattern", "left")  # at most 3 ** len(RULES) rows
            .select(F.col("key").alias(key), *BASE, failed.alias("base_failed"), F.coalesce("p_good", F.lit(0.0)).alias("p_good"))
            .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= least)))


def keep_good(docs: DataFrame, text: str = "text", least: float = 0.5, min_words: int = 10, max_repeat: int = 20) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns: two narrow passes, no shuffle."""
    seen = measures(docs.select(F.lit(0).alias("key"), F.col(text).alias("text")), "key", "text")
    good = posteriors(seen, min_words, max_repeat)
    at, names = docs.columns.index(text), docs.columns

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            columns, keep = batch.column(0).flatten(), []
            for b in binaries(columns[at]):
                m = measure(b or b"")
                keep.append(not base_failed(m.n_words, m.n_repeat_words, min_words, max_repeat) and good[votes(m)] >= least)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    return docs.select(whole_row(docs).alias("row")).mapInArrow(run, docs.schema)
