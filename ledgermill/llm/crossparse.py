"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of a bounded sample of its labelled text. A text is cut
into phrases, each the longest match from its place that occurs anywhere in the sample; it
needs fewest phrases in its own language. A phrase costs the logarithms of the places where
it can start and of the symbols that can end it, so samples of different lengths compare.

A suffix automaton read from its root follows exactly the substrings of its text, so a parse
is one walk: where no edge leads on, a phrase ends and the next one starts at the root.
Automata are dense tables over the symbols of the samples, and many stretches of text walk
through all languages' tables side by side.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import texts_of
from .quality import held_out

#: Bytes of text in a language's automaton, characters of a piece of it, labelled rows of a language from
#: which pieces are drawn, and languages learned (those with most labelled rows), all at most.
SAMPLE_BYTES, PIECE, ROWS, LANGUAGES = 32_768, 256, 512, 64
#: Bytes of a stretch, which is parsed on its own, and of the stretches that walk together.
STRETCH, CELLS = 2048, 1 << 22
UNKNOWN = "und"

_BLANKED = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_LETTER = re.compile(r"[^\W\d_]")


def plain(text: bytes) -> bytes:
    """Lower-case UTF-8 words between single blanks: whatever else is ASCII parts words."""
    if not text.isascii():
        text = text.decode("utf-8", "replace").lower().encode()
    return b" ".join(text.translate(_BLANKED).split())


def has_letter(text: bytes) -> bool:
    """Whether any character is a letter, in any script."""
    return bool(re.search(rb"[A-Za-z]", text)) or (not text.isascii() and bool(_LETTER.search(text.decode("utf-8", "replace"))))


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Edges of every state by byte; state 0 is the root."""
    edges: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at != -1 and c not in edges[at]:
            edges[at][c] = new
            at = link[at]
        if at != -1:
            to = edges[at][c]
            if length[at] + 1 == length[to]:
                link[new] = to
            else:
                twin = len(edges)
                edges.append(dict(edges[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                while at != -1 and edges[at].get(c) == to:
                    edges[at][c] = twin
                    at = link[at]
                link[to] = link[new] = twin
        last = new
    return edges


class CrossParser:
    """Phrase counts of texts against several samples at a time."""

    def __init__(self, samples: list[bytes]) -> None:
        seen = sorted(set(b"".join(samples)))
        self.symbol = np.zeros(256, np.uint8)  # 0: in no sample; UTF-8 has fewer than 256 different bytes
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        width = len(seen) + 1
        tables, self.starts, offset = [], [], 0
        for sample in samples:
            edges = suffix_automaton(sample)
            # One state more, before any phrase and after a symbol that the sample lacks.
            gone = len(edges)
            table = np.full((gone + 1, width), gone, np.int64)
            for c, to in edges[0].items():
                table[:, self.symbol[c]] = to
            value = ((table + offset) * width << 1) | 1  # odd: a phrase starts here
            for state, out in enumerate(edges):
                for c, to in out.items():
                    value[state, self.symbol[c]] = (to + offset) * width << 1
            tables.append(value)
            self.starts.append((gone + offset) * width)
            offset += gone + 1
        largest = offset * width << 1
        kind = np.int32 if largest < 1 << 31 else np.int64
        self.table = np.concatenate([t.ravel() for t in tables]).astype(kind)
        self.starts = np.array(self.starts, kind)

    def _walk(self, stretches: list[np.ndarray]) -> np.ndarray:
        """(stretches, samples) numbers of phrases; stretches go by falling length."""
        size = np.array([len(s) for s in stretches])
        steps = np.zeros((len(stretches), int(size[0])), np.uint8)
        for k, s in enumerate(stretches):
            steps[k, : len(s)] = s
        steps = np.ascontiguousarray(self.symbol[steps].T)
        count = np.zeros((len(self.starts), len(stretches)), np.int32)
        state = np.repeat(self.starts[:, None], len(stretches), axis=1)
        live = np.searchsorted(-size, -np.arange(len(steps)), side="left")
        for t, n in enumerate(live.tolist()):
            if n < state.shape[1]:
                state = state[:, :n].copy()
            value = self.table.take(state + steps[t, :n])
            count[:, :n] += value & 1
            state = value >> 1
        return count.T

    def phrases(self, texts: list[bytes], stretch: int = STRETCH, cells: int = CELLS) -> np.ndarray:
        """(texts, samples) numbers of phrases of plain texts, each stretch of them parsed on its own."""
        raw = [np.frombuffer(t, np.uint8) for t in texts]
        cuts = [(min(stretch, len(r) - at), k, at) for k, r in enumerate(raw) for at in range(0, len(r), stretch)]
        cuts.sort(key=lambda c: -c[0])
        out, done = np.zeros((len(texts), len(self.starts)), np.int64), 0
        while done < len(cuts):
            some = cuts[done : done + max(1, cells // cuts[done][0])]
            np.add.at(out, [k for _, k, _ in some], self._walk([raw[k][at : at + n] for n, k, at in some]))
            done += len(some)
        return out


@lru_cache(4)
def parser_of(samples: tuple[bytes, ...]) -> CrossParser:
    """Kept by a Python worker from task to task."""
    return CrossParser(list(samples))


class LanguageModel:
    """Languages in the order of their names, with their samples."""

    def __init__(self, samples: dict[str, bytes]) -> None:
        self.names = sorted(samples)
        self.samples = tuple(samples[n] for n in self.names)
        symbols = len(set(b"".join(self.samples)))
        self.bits = np.array([np.log2((len(s) + 1.0) * (symbols + 1.0)) for s in self.samples])

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """Names and scores: one less the share of the best cost in the second best."""
        told = np.array([bool(self.names) and has_letter(t) for t in texts], bool)
        names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        at = np.flatnonzero(told)
        if len(at):
            counts = parser_of(self.samples).phrases([plain(texts[k]) for k in at])
            cost = counts * self.bits
            best = cost.argmin(1)
            least = cost[np.arange(len(at)), best]
            cost[np.arange(len(at)), best] = np.inf
            second = cost.min(1)
            score[at] = np.where(np.isinf(second), 1.0, 1.0 - least / np.maximum(second, 1e-9))
            for k, b in zip(at, best, strict=True):
                names[k] = self.names[b]
        return names, score


def fit(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES, piece: int = PIECE, rows: int = ROWS, languages: int = LANGUAGES) -> LanguageModel:
    """A sample of each language's labelled text outside the held-out third.

    Of each of the ``languages`` with most labelled rows (ties by name), about ``rows`` rows with the
    smallest hashes of id and text are drawn, cut into pieces of ``piece`` characters, and
    different pieces are taken by their hash up to ``sample_bytes``. Only these reach the driver.
    """
    known = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    # The hash of a row is even: this share of a language's rows is about twice as many as are drawn.
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)
    few = known.join(F.broadcast(sizes), "lang").withColumn("place", place).filter(F.col("place") * F.col("n") <= 2.0 * rows)
    first = few.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))).filter(F.col("k") <= rows)
    starts = F.sequence(F.lit(0), F.floor(F.length("text") / piece).cast("int"))
    pieces = first.select("lang", F.explode(F.transform(starts, lambda k: F.substr(F.col("text"), k * piece + 1, F.lit(piece)))).alias("piece"))
    hashed = pieces.filter(F.col("piece").rlike(r"\p{L}")).distinct().withColumn("h", F.xxhash64("piece"))
    # A piece of plain text has a letter and a blank at least.
    best = hashed.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "piece"))).filter(F.col("k") <= max(1, 4 * sample_bytes // piece))
    found: dict[str, list[bytes]] = {}
    for lang, _, _, text in best.select("lang", "h", "k", "piece").orderBy("lang", "k").toLocalIterator():
        found.setdefault(lang, []).append(plain(text.encode()))
    return LanguageModel({n: b" ".join(p)[:sample_bytes] for n, p in found.items()})


_PREDICTION = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def predictor(model: LanguageModel):
    """Function from a text column to (lang_pred, score); the model, of bounded size, goes to every task once."""

    @F.arrow_udf(returnType=_PREDICTION)
    def predict(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in parts:
            names, score = model.predict(texts_of(text))
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score)], ["lang_pred", "score"])

    return predict


def identify(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every input row, repeated rows included.

    The prediction comes from the whole text alone; of equally cheap languages the smaller
    name wins. A text that is null or has no letter is "und" with score 0, as is every text
    where no language was learned; with one language learned all others are it, with score
    1. A row without an id isn't held out. Extra columns are ignored; an empty table gives none.
    """
    predict = predictor(model or fit(docs))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), predict(F.col("text").cast("string")).alias("p"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "p.lang_pred", "p.score")

