"""Quality classifier: a sparse ensemble of tree-path rules over text statistics.

Shallow trees are grown on bootstrap samples of labelled rows; every path from a root
becomes a conjunctive rule; a lasso logistic fit keeps few of them; the kept rules are
compiled into one Spark column expression over the statistics of a text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import texts_of

STATISTICS = [
    "log_bytes", "upper", "digit", "punct", "space", "high", "line_share", "word_len", "distinct_words",
    "top_word", "repeat_next", "distinct_lines", "punct_tail", "lone_punct", "upper_words", "entropy", "punct_run", "stop_share",
]
STATS_TYPE = T.StructType([T.StructField(x, T.DoubleType(), False) for x in STATISTICS])
#: Labelled rows that a model is fitted on, at most: those with the smallest hashed ids.
SAMPLE = 20_000

_PUNCT = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_TO_CLASS = bytes(1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 3 if c in _PUNCT else 4 if c in b" \t\r\x0b\x0c" else 5 if c == 10 else 6 if c >= 128 else 0 for c in range(256))


def statistics(text: bytes) -> list[float]:
    """The statistics of one whole text; all zero for an empty one."""
    n = len(text)
    words = text.split()
    if not words:
        return [math.log1p(n), *[0.0] * (len(STATISTICS) - 1)]
    raw = np.frombuffer(text, np.uint8)
    hist = np.bincount(raw, minlength=256)
    kinds = np.frombuffer(_TO_CLASS, np.uint8)
    upper, digit, punct, blank, line, high = (int(hist[kinds == k].sum()) for k in range(1, 7))
    p = hist[hist > 0] / n
    marks = kinds[raw] == 3
    w = len(words)
    counts: dict[bytes, int] = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    tails = sum(x[-1] in _PUNCT and x[-1] not in b".,;:" for x in words)
    lone = sum(c for x, c in counts.items() if not x.strip(_PUNCT))
    shouted = sum(c for x, c in counts.items() if len(x.strip(_PUNCT)) > 1 and x.upper() == x and x.lower() != x)
    short = sum(c for x, c in counts.items() if len(x) <= 3)
    return [
        math.log1p(n), upper / n, digit / n, punct / n, (blank + line) / n, high / n, line / w, (n - blank - line) / w, len(counts) / w,
        max(counts.values()) / w, sum(map(bytes.__eq__, words, words[1:])) / w, len(set(lines)) / len(lines), tails / w, lone / w, shouted / w,
        float(-(p * np.log2(p)).sum()), float((marks[1:] & marks[:-1]).sum()) / w, short / w,
    ]


@F.arrow_udf(returnType=STATS_TYPE)
def statistics_of(text: pa.Array) -> pa.Array:
    rows = np.array([statistics(x) for x in texts_of(text)], float).reshape(-1, len(STATISTICS))
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(len(STATISTICS))], STATISTICS)


@dataclass
class RuleModel:
    """score = sigmoid(intercept + sum of the weights of the rules that hold)."""

    intercept: float = 0.0
    rules: list[tuple[tuple[tuple[str, str, float], ...], float]] = field(default_factory=list)

    def column(self, stats: str) -> Column:
        total = F.lit(float(self.intercept))
        for terms, weight in self.rules:
            holds = F.lit(True)
            for name, op, cut in terms:
                value = F.col(f"{stats}.{name}")
                holds = holds & (value <= F.lit(cut) if op == "<=" else value > F.lit(cut))
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _grow(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], depth: int, rng: np.random.Generator, path: tuple, out: set) -> None:
    """Greedy Gini splits over candidate cuts; every node but the root gives a rule."""
    if path:
        out.add(path)
    if len(path) >= depth or len(y) < 20 or y.min() == y.max():
        return
    best, base = None, len(y) * y.mean() * (1 - y.mean())
    for j in rng.choice(x.shape[1], max(1, int(x.shape[1] * 0.6)), replace=False):
        if not len(cuts[j]):
            continue
        side = np.searchsorted(cuts[j], x[:, j], side="left")
        n = np.bincount(side, minlength=len(cuts[j]) + 1).cumsum()[:-1]
        k = np.bincount(side, weights=y, minlength=len(cuts[j]) + 1).cumsum()[:-1]
        m, q = len(y) - n, y.sum() - k
        ok = (n >= 5) & (m >= 5)
        if not ok.any():
            continue
        cost = np.where(ok, k * (1 - k / np.maximum(n, 1)) + q * (1 - q / np.maximum(m, 1)), np.inf)
        at = int(cost.argmin())
        if best is None or cost[at] < best[0]:
            best = (cost[at], j, cuts[j][at])
    if best is None or best[0] > base - 1e-9:
        return
    _, j, cut = best
    low = x[:, j] <= cut
    for op, part in (("<=", low), (">", ~low)):
        _grow(x[part], y[part], cuts, depth, rng, (*path, (int(j), op, float(cut))), out)


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 2e-3, steps: int = 600, seed: int = 7) -> RuleModel:
    """Rules of bootstrap trees, weighted by an L1-penalised logistic fit (proximal gradient).

    Without rows the score is one half; with one class only it is that class's smoothed rate.
    """
    n = len(y)
    rate = (y.sum() + 0.5) / (n + 1.0)
    if n == 0 or y.min() == y.max():
        return RuleModel(math.log(rate / (1 - rate)))
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 33))) for j in range(x.shape[1])]
    found: set = set()
    for _ in range(trees):
        rows = rng.integers(0, n, n)
        _grow(x[rows], y[rows], cuts, depth, rng, (), found)
    paths, columns, seen = [], [], set()
    for path in sorted(found, key=lambda p: (len(p), p)):
        hold = np.ones(n, bool)
        for j, op, cut in path:
            hold &= (x[:, j] <= cut) if op == "<=" else (x[:, j] > cut)
        key = hold.tobytes()
        if 0.002 < hold.mean() < 0.998 and key not in seen:
            seen.add(key)
            paths.append(path)
            columns.append(hold)
    if not paths:
        return RuleModel(math.log(rate / (1 - rate)))
    a = np.stack(columns, 1).astype(np.float32)
    scale = np.maximum(a.std(0), 0.05)
    a = a / scale
    step = 4.0 * n / (np.linalg.norm(a.T @ a, 2) + n)
    w, b = np.zeros(a.shape[1]), math.log(rate / (1 - rate))
    v, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        err = 1 / (1 + np.exp(-(a @ v + c))) - y
        w2 = v - step * (a.T @ err) / n
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * penalty, 0)
        b2 = c - step * err.mean()
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    kept = [(tuple((STATISTICS[j], op, cut) for j, op, cut in paths[k]), float(w[k] / scale[k])) for k in np.nonzero(np.abs(w) > 1e-6)[0]]
    return RuleModel(float(b), kept)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """doc_id, text and the label of at most ``sample`` labelled rows outside the held-out third.

    Those with the smallest hashed ids; their ids, a table of at most ``sample`` rows, are
    broadcast. Null labels and ids, and labels without a document, are left out; of several
    labels of an id the largest counts, of several texts the one with the smallest hash.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias(label))
        .filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(label).alias(label))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    few = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return few.groupBy("doc_id", label).agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> RuleModel:
    """Fit on at most ``sample`` labelled rows; the driver sees their statistics only."""
    few = labelled(docs, labels, "quality", sample)
    rows = few.select("doc_id", statistics_of("text").alias("s"), "quality").select("doc_id", "s.*", "quality").toPandas().sort_values("doc_id", ignore_index=True)
    return fit_rules(rows[STATISTICS].to_numpy(float), rows["quality"].to_numpy(float))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every input row, repeated rows included.

    Scores come from the text alone. A null text counts as empty; a row without an id is
    scored and not held out. Extra columns are ignored; an empty table gives no rows.
    """
    model = fit(docs, labels, sample)
    stats = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), statistics_of(F.col("text").cast("string")).alias("s"))
    scored = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.column("s").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that the classifier accepts, with their columns.

    Null texts count as empty, repeated rows are judged each, rows without an id like any
    other, and an empty table stays empty.
    """
    model = fit(docs, labels, sample)
    taken = "s"
    while taken in docs.columns:
        taken += "_"
    stats = docs.withColumn(taken, statistics_of(F.col("text").cast("string")))
    return stats.filter(model.column(taken) >= 0.5).select(docs.columns)
