"""Toxicity by class-conditional Kneser-Ney models over the characters of words.

Each class has its own counts of the longest n-grams; both classes back off to one shared model of continuation counts (in how
many different ways a shorter n-gram is extended), so that rare expressions are smoothed alike and differ only where
a class has evidence. A text is judged by log-likelihoods per word, toxic against ordinary: over the whole text, in its
most toxic window, and in its most toxic word. A logistic curve, fitted on labelled rows that the counts have not
seen, turns these into a score from 0 to 1.

The models are trained on at most ``CLASS_ROWS`` labelled rows of each class, those first by a hash of their id. Words
are counted on the executors; what is collected is bounded by the n-grams of that sample.
"""
from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.common import top_k
from .common import fold, utf8, with_results
from .decontamination import words_of

ORDER = 5
DISCOUNT = 0.75
WINDOW = 64
CLASS_ROWS = 3000         # labelled rows of each class that are learnt from, at most
CALIBRATION_PART = 4      # one in so many of them fits the curve, the rest the counts
MEMO_ENTRIES = 400_000
THRESHOLD = 0.7


def grams(word: str, order: int = ORDER):
    """Longest n-gram at each character of a word; ``^`` and ``$`` mark its ends."""
    s = f"^{word}$"
    return [s[max(0, i + 1 - order):i + 1] for i in range(1, len(s))]


class KneserNey:
    """Two class models with shared lower orders, from {n-gram: (count in ordinary, count in toxic texts)}."""

    def __init__(self, counts: dict[str, tuple[int, int]], discount: float = DISCOUNT):
        self.counts, self.discount = counts, discount
        self.memo: dict[str, float] = {}
        self.total: dict[str, list[int]] = defaultdict(lambda: [0, 0])   # of a context, by class
        self.kinds: dict[str, list[int]] = defaultdict(lambda: [0, 0])   # different next characters of a context, by class
        for g, pair in counts.items():
            for c in (0, 1):
                if pair[c]:
                    self.total[g[:-1]][c] += pair[c]
                    self.kinds[g[:-1]][c] += 1
        self.cont: Counter = Counter()       # in how many ways an n-gram is extended to the left
        level = set(counts)
        while level:
            shorter = [g[1:] for g in level if len(g) > 1]
            self.cont.update(shorter)
            level = set(shorter)
        self.cont_total, self.cont_kinds = Counter(), Counter()
        for g, n in self.cont.items():
            self.cont_total[g[:-1]] += n
            self.cont_kinds[g[:-1]] += 1
        self.floor = 1 / (self.cont_kinds[""] + 1)

    def shared(self, g: str) -> float:
        """Probability of the last character after the others, by continuation counts."""
        whole = self.cont_total.get(g[:-1], 0)
        lower = self.shared(g[1:]) if len(g) > 1 else self.floor
        if not whole:
            return lower
        return (max(self.cont.get(g, 0) - self.discount, 0) + self.discount * self.cont_kinds[g[:-1]] * lower) / whole

    def gram_ratio(self, g: str) -> float:
        """Log-likelihood of an n-gram's last character in toxic texts less that in ordinary ones."""
        total, kinds, d = self.total.get(g[:-1]), self.kinds.get(g[:-1]), self.discount
        if total is None:
            return 0.0
        own, lower = self.counts.get(g, (0, 0)), self.shared(g[1:])
        p = [(max(own[c] - d, 0) + d * kinds[c] * lower) / total[c] if total[c] else lower for c in (0, 1)]
        return math.log(p[1]) - math.log(p[0])

    def ratio(self, word: str) -> float:
        """Log-likelihood of a word in toxic texts less that in ordinary ones."""
        memo, out = self.memo, 0.0
        for g in grams(word):
            r = memo.get(g)
            if r is None:
                if len(memo) >= MEMO_ENTRIES:
                    memo.clear()
                r = memo[g] = self.gram_ratio(g)
            out += r
        return out


class Scorer:
    """Features of texts from the log-likelihood ratios of words: mean, best window, best word.

    Each word of a text counts once, where it first stands. Lengths are raised by (mean) or to (window) one window, so that a few words alone are weak evidence.
    """

    def __init__(self, model: KneserNey, window: int = WINDOW):
        self.model, self.window = model, window
        self.memo: dict[bytes, float] = {}

    def features(self, raw: bytes) -> tuple[float, float, float]:
        words = list(dict.fromkeys(words_of(raw)))
        if not words:
            return 0.0, 0.0, 0.0
        memo = self.memo
        missing = set(words).difference(memo)
        if missing:
            if len(memo) > MEMO_ENTRIES:
                memo.clear()
                missing = set(words)
            for w in missing:
                memo[w] = self.model.ratio(w.decode("utf-8", "replace"))
        values = np.fromiter(map(memo.__getitem__, words), np.float64, len(words))
        sums = np.concatenate([[0.0], np.cumsum(values)])
        width = min(self.window, len(words))
        return float(sums[-1] / (len(words) + self.window)), float((sums[width:] - sums[:-width]).max() / self.window), float(values.max())


def fit_curve(features: np.ndarray, labels: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression with intercept by Newton steps, on features scaled by their spread."""
    x = np.column_stack([np.ones(len(features)), features])
    w, pull = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * features.shape[1]) * len(x)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (labels - p) - pull @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


class Model:
    """Counts, curve and scale; scores texts."""

    def __init__(self, counts: dict, curve: np.ndarray | None, scale: np.ndarray | None, base: float):
        self.counts, self.curve, self.scale, self.base = counts, curve, scale, base

    def scorer(self):
        if self.curve is None:
            return lambda raw: self.base
        features, curve, scale = Scorer(KneserNey(self.counts)).features, self.curve, self.scale
        return lambda raw: float(1 / (1 + np.exp(-np.clip(curve[0] + (np.array(features(raw)) / scale) @ curve[1:], -30, 30))))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learn=None, class_rows: int = CLASS_ROWS) -> Model:
    """Model from the labelled rows for which ``learn`` (a column over the id; default all) holds.

    Null ids, and labels other than 0 and 1, are left out, an id with several labels takes the largest. With one class or none to learn from, every text gets the
    share of label 1 (0 without labels) as its score.
    """
    spark = docs.sparkSession
    rows = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    rows = (rows if learn is None else rows.filter(learn)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    # Labels of documents that are not there must not take up the sample.
    rows = rows.join(docs.select(id_col).distinct(), id_col, "left_semi").withColumn("h", F.xxhash64(id_col))
    # Hashes beyond four times the needed share can't be among the first; so few rows are ranked, however many there are.
    counts_of = dict(rows.groupBy("label").count().collect())
    bound = F.lit(2**63 - 1)
    for label, n in counts_of.items():
        bound = F.when(F.col("label") == label, F.lit(2**63 - 1 if n <= 4 * class_rows else int(-2**63 + 4 * class_rows / n * 2**64))).otherwise(bound)
    chosen = top_k(rows.filter(F.col("h") <= bound), ["label"], ["h", id_col], class_rows)
    chosen = chosen.select(F.col(id_col).alias("__id"), "label", (F.pmod(F.xxhash64(F.col("h")), F.lit(CALIBRATION_PART)) == 0).alias("curve"))
    # At most class_rows ids of each label.
    sample = docs.select(F.col(id_col).alias("__id"), utf8(text_col).alias("text")).join(F.broadcast(chosen), "__id").select("label", "curve", "text")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")

    def count(batches):
        words = [Counter(), Counter()]
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words[label].update(words_of(text))
        found = [Counter(), Counter()]
        for label in (0, 1):
            for w, n in words[label].items():
                for g in grams(w.decode("utf-8", "replace")):
                    found[label][g] += n
        keys = list(found[0].keys() | found[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([found[0][k] for k in keys], pa.int64()), pa.array([found[1][k] for k in keys], pa.int64())], names=["gram", "n0", "n1"])

    counted = sample.filter(~F.col("curve")).select("label", "text").mapInArrow(count, "gram string, n0 long, n1 long")
    counts = {g: (a, b) for g, a, b in counted.groupBy("gram").agg(F.sum("n0"), F.sum("n1")).collect()}

    def measure():
        scorer = Scorer(KneserNey(counts))
        return lambda columns: [list(c) for c in zip(*map(scorer.features, columns["text"]))]

    held = with_results(sample.filter("curve"), {"text": F.col("text")}, measure, {"a": "double", "b": "double", "c": "double"}, keep=["label"]).collect()
    got = Counter(r["label"] for r in held)
    classes = [any(n[c] for n in counts.values()) for c in (0, 1)]
    if not (got[0] and got[1] and all(classes)):
        share = rows.agg(F.avg("label")).first()[0]
        return Model({}, None, None, float(share or 0.0))
    x, y = np.array([[r["a"], r["b"], r["c"]] for r in held]), np.array([r["label"] for r in held], float)
    scale = np.maximum(x.std(axis=0), 1e-9)
    return Model(counts, fit_curve(x / scale, y, ridge=1e-4), scale, 0.0)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from ``threshold`` on). Null and empty texts have no evidence and are scored by the curve alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        judge = shared.value.scorer()

        def work(columns):
            scores = [judge(t) for t in columns["text"]]
            return [scores, [int(s >= threshold) for s in scores]]

        return work

    return with_results(docs, {"text": utf8(text_col)}, start, {"score": "double", "predicted": "int"}, keep)


def learnable(id_col: str = "doc_id"):
    """Rows whose labels may be learnt from: crc32 of the id modulo 3 is not 1."""
    return fold(id_col, 3) != 1


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` scored below the threshold, with their own columns."""
    model = train(docs, labels, learn=learnable(), **options)
    named = docs.withColumns({f"__own_{c}": F.col(c) for c in ("score", "predicted") if c in docs.columns})
    return score(named, model).filter("predicted = 0").select(*[F.col(f"__own_{c}" if f"__own_{c}" in named.columns else f"`{c}`").alias(c) for c in docs.columns])
