"""Toxicity by a classifier chain of sparse linear models.

Categories are predicted one after the other; a later model sees the probabilities of the
earlier ones. In training these are out-of-fold predictions, so that a later model learns
from what an earlier one will really tell it. The labels only say whether a text is toxic:
the earlier categories, themes, are clusters of the toxic training rows by the telling words
that they hold together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, texts_of
from .quality import held_out, labelled

#: Labelled rows that a chain is fitted on, at most; feature buckets; features that the models may use; folds; bytes of a word's stem; themes.
SAMPLE, BUCKETS, WORDS, FOLDS, STEM, THEMES = 12_000, 1 << 20, 600, 3, 6, 2
#: Share of the toxic rows that a theme has at least.
LEAST = 0.1
#: Words that a Python worker remembers while it scores.
REMEMBERED = 50_000
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def bucket(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 9) % BUCKETS


def buckets(word: bytes) -> tuple[int, ...]:
    """A word's own bucket, and its stem's if it is longer than that."""
    return (bucket(word), bucket(word[:STEM] + b"*")) if len(word) > STEM else (bucket(word),)


@F.arrow_udf(returnType=T.ArrayType(T.IntegerType()))
def word_buckets(text: pa.Array) -> pa.Array:
    return pa.array([sorted({b for w in set(x.translate(_WORDS).split()) for b in buckets(w)}) for x in texts_of(text)], pa.list_(pa.int32()))


@dataclass
class Linear:
    """intercept, weights of word buckets, weights of earlier categories' probabilities."""

    intercept: float
    words: dict[int, float]
    earlier: list[float]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(x: np.ndarray, y: np.ndarray, told: np.ndarray, penalty: float = 2e-4, steps: int = 160) -> tuple[float, np.ndarray]:
    """Intercept and weights of an L1-penalised logistic model on the rows that ``told`` marks.

    Rows are left out by weight, so that no fold needs a copy of ``x``. Without both classes
    the model is the smoothed rate.
    """
    n, mine = int(told.sum()), y[told]
    rate = (mine.sum() + 0.5) / (n + 1.0)
    base = math.log(rate / (1 - rate))
    w, b = np.zeros(x.shape[1], np.float32), base
    if n == 0 or mine.min() == mine.max():
        return base, w
    step = 4.0 * n / (np.linalg.norm(x.T @ x, 2) + n)
    weight = told.astype(np.float32)
    v, c, t = w, b, 1.0
    for _ in range(steps):
        err = ((_sigmoid(x @ v + c) - y) * weight).astype(np.float32)
        w2 = v - step * (x.T @ err) / n
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * penalty, 0)
        b2 = c - step * float(err.sum()) / n
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return float(b), w


def fit_chain(words: np.ndarray, y: np.ndarray, names: list[int], folds: int = FOLDS, chained: bool = True) -> list[Linear]:
    """One model for each column of ``y``, in order, on words and out-of-fold earlier probabilities.

    ``words`` has a row for each text and a 0/1 column for each bucket of ``names``.
    """
    n, k = y.shape
    fold = np.arange(n) % folds
    x = np.zeros((n, len(names) + (k - 1 if chained else 0)), np.float32)
    x[:, : len(names)] = words
    chain = []
    for j in range(k):
        width = len(names) + (j if chained else 0)
        part = x[:, :width]
        b, w = fit_linear(part, y[:, j], np.ones(n, bool))
        chain.append(Linear(b, {names[i]: float(w[i]) for i in np.flatnonzero(w[: len(names)])}, [float(z) for z in w[len(names) :]]))
        if chained and j + 1 < k:
            for f in range(folds):
                asked = fold == f
                b, w = fit_linear(part, y[:, j], ~asked)
                x[asked, width] = _sigmoid(part[asked] @ w + b)
    return chain


def apply_chain(chain: list[Linear], words: np.ndarray, names: list[int]) -> np.ndarray:
    """Probabilities (a row for each text, a column for each category)."""
    at = {b: i for i, b in enumerate(names)}
    out = np.zeros((len(words), 0))
    for m in chain:
        w = np.zeros(len(names))
        for b, z in m.words.items():
            w[at[b]] = z
        z = m.intercept + words @ w + (out @ np.array(m.earlier, float) if m.earlier else 0)
        out = np.column_stack([out, _sigmoid(z)])
    return out


def _cuts(x: np.ndarray, themes: int, rounds: int = 50) -> np.ndarray:
    """Equal parts of the rows by their place along the direction in which they differ most."""
    centred = x - x.mean(0)
    way = centred.var(0) + 1e-9 * np.arange(1, x.shape[1] + 1)
    for _ in range(rounds):
        way = centred.T @ (centred @ way)
        size = np.linalg.norm(way)
        if size < 1e-12:
            break
        way /= size
    order = np.argsort(centred @ way, kind="stable")
    own = np.zeros(len(x), int)
    own[order] = np.arange(len(x)) * themes // len(x)
    return own


def themes_of(words: np.ndarray, toxic: np.ndarray, themes: int = THEMES, rounds: int = 20, least: float = LEAST) -> np.ndarray:
    """For each text its theme from 0, -1 if it is not toxic or holds no telling word.

    Telling are words at least twice as frequent in toxic texts as in others. Toxic rows are
    clustered by the telling words that they hold, weighed by rarity: spherical k-means from
    equal parts along the direction in which the rows differ most. A theme of under ``least`` of
    the rows would be no category to learn: then the equal parts themselves are the themes.
    """
    out = np.full(len(toxic), -1)
    rows = np.flatnonzero(toxic > 0)
    if not len(rows) or len(rows) == len(toxic):
        return out
    hit, miss = words[rows].mean(0), words[toxic == 0].mean(0)
    telling = np.flatnonzero((hit > 2 * miss) & (hit > 0))
    x = words[np.ix_(rows, telling)] * np.log(1 / np.maximum(hit[telling], 1e-9))
    size = np.sqrt((x * x).sum(1))
    rows, x = rows[size > 0], x[size > 0] / size[size > 0][:, None]
    if not len(rows):
        return out
    parts = own = _cuts(x, themes)
    for _ in range(rounds):
        c = np.stack([x[own == k].mean(0) if (own == k).any() else np.zeros(x.shape[1]) for k in range(themes)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        own = (x @ c.T).argmax(1)
    out[rows] = own if np.bincount(own, minlength=themes).min() >= least * len(rows) else parts
    return out


def fit(docs: DataFrame, labels: DataFrame, themes: int = THEMES, sample: int = SAMPLE) -> list[Linear]:
    """Fit on at most ``sample`` labelled rows outside the held-out third.

    Spark counts how often each bucket stands in toxic and in other rows; the driver sees the
    WORDS buckets that chi-square ranks first, and for each sampled row which of those it has.
    """
    few = labelled(docs, labels, "toxic", sample)
    held = materialize(few.select("doc_id", "toxic", word_buckets("text").alias("words")))
    n, bad = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    seen = held.select("toxic", F.explode("words").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("seen"), F.sum("toxic").alias("hit")).filter("seen >= 3")
    expect = F.col("seen") * F.lit(bad / max(n, 1))
    chi = (F.col("hit") - expect) ** 2 / F.greatest(expect * (1 - F.col("seen") / F.lit(max(n, 1))), F.lit(1e-9))
    names = sorted(r["bucket"] for r in seen.orderBy(chi.desc(), "bucket").limit(WORDS).collect()) if 0 < bad < n else []
    got = held.select("doc_id", "toxic", F.array_intersect("words", F.lit(names).cast("array<int>")).alias("words")).toArrow().sort_by("doc_id")
    discard(held)
    lists = got.column("words").combine_chunks()
    owner = np.repeat(np.arange(n), np.asarray(lists.value_lengths()))
    words = np.zeros((n, len(names)), np.float32)
    words[owner, np.searchsorted(names, np.asarray(lists.flatten()))] = 1
    toxic = np.asarray(got.column("toxic"), float)
    theme = themes_of(words, toxic, themes)
    return fit_chain(words, np.column_stack([*[theme == k for k in range(themes)], toxic]).astype(float), names)


def _scorer(chain: list[Linear]):
    table: dict[int, list[float]] = {}
    for k, model in enumerate(chain):
        for b, w in model.words.items():
            table.setdefault(b, [0.0] * len(chain))[k] = w

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[int, ...]] = {}
        for batch in batches:
            out = []
            for text in texts_of(batch.column(1)):
                found = set()
                for w in set(text.translate(_WORDS).split()):
                    own = known.get(w)
                    if own is None:
                        own = tuple(b for b in buckets(w) if b in table)
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[w] = own
                    found.update(own)
                z = [m.intercept for m in chain]
                for b in sorted(found):
                    for k, w in enumerate(table[b]):
                        z[k] += w
                p: list[float] = []
                for k, m in enumerate(chain):
                    total = z[k] + sum(w * q for w, q in zip(m.earlier, p, strict=True))
                    p.append(1 / (1 + math.exp(-max(-30.0, min(30.0, total)))))
                out.append(p)
            flat = np.array(out, float).reshape(-1, len(chain))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(flat[:, k])) for k in range(len(chain))]], ["doc_id", *[f"p{k}" for k in range(len(chain))]])

    return run


def score(docs: DataFrame, labels: DataFrame, themes: int = THEMES, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, p_theme_1, ..., p_toxic in the chain's order, predicted (1 if p_toxic >= 0.5).

    One row for each input row, repeated ones included. Null and empty texts score as texts
    without words; a row without an id is not held out. Labels that are null or of no
    document are left out; a doc_id with both labels counts as toxic. Other columns are
    ignored; an empty table gives no rows.
    """
    chain = fit(docs, labels, themes, sample)
    names = [*(f"theme_{k}" for k in range(1, themes + 1)), "toxic"]
    schema = "doc_id bigint, " + ", ".join(f"p{k} double" for k in range(len(names)))
    scored = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scorer(chain), schema)
    renamed: list[Column] = [F.col(f"p{k}").alias(f"p_{c}") for k, c in enumerate(names)]
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), *renamed, (F.col(f"p{len(names) - 1}") >= 0.5).cast("int").alias("predicted"))
