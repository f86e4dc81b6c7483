"""Quality scores by random Fourier features of document statistics.

A text becomes a few statistics of its bytes, words and lines.  Standardised,
they go through random Fourier features, whose dot products approximate a
Gaussian kernel; each partition of the labelled rows adds up its part of the
normal equations, their sums are solved for ridge weights, and an isotonic fit
of the labels on the ridge scores turns scores into probabilities.

What reaches the driver is bounded by the number of features, not of rows: two
moments of each statistic, the normal equations, and counts by score rounded to
1/1000.  Null and empty texts have all statistics 0 and are scored like any
text.  Without labelled rows the score is 0.5, with labels of one kind only it
is near that kind.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trophos.llm import words as W
from trophos.llm.labelled import MAX_LABELLED, held_out, training_rows
from trophos.plans.scratch import Scratch

FEATURES = 256
RIDGE = 1e-3
SEED = 20_240_229
STATISTICS = (
    "log_words", "word_bytes", "upper", "digits", "symbols", "bangs", "other_marks", "high_bytes",
    "words_with_symbol", "ends_with_mark", "same_as_before", "pair_repeats", "distinct_words",
    "line_words", "repeated_lines",
)


def _class(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


UPPER, LETTER = _class(bytes(range(65, 91))), _class(bytes([*range(65, 91), *range(97, 123)]))
DIGIT, SYMBOL, BANG = _class(b"0123456789"), _class(b"#*$%&|<>"), _class(b"!?")
MARK, END, HIGH = _class(b".,;:\"'()[]{}=+_/\\~^`@-"), _class(b".,;:!?"), _class(bytes(range(128, 256)))


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeats(texts: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Per text, how many keys occurred earlier in it."""
    if not len(keys):
        return np.zeros(n)
    order = np.lexsort((keys, texts))
    same = (keys[order][1:] == keys[order][:-1]) & (texts[order][1:] == texts[order][:-1])
    return np.bincount(texts[order][1:][same], minlength=n)


def statistics(column) -> np.ndarray:
    """One row of STATISTICS per text."""
    parts = [_slice_statistics(s) for s in W.slices(column)]
    return np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))


def _slice_statistics(s: W.Words) -> np.ndarray:
    n, data = s.texts, s.data
    of = lambda table: _per_text(table[data], s.bounds)
    count = np.bincount(s.text, minlength=n)
    sized = np.bincount(s.text, weights=s.length, minlength=n)
    share = lambda x, y: x / np.maximum(y, 1)
    h = W.hashes(s)
    follows = s.text[1:] == s.text[:-1] if len(h) else np.zeros(0, bool)
    pairs = W.pair_hash(h[:-1], h[1:])[follows] if len(h) else h
    last = data[s.start + s.length - 1] if len(h) else data[:0]
    marked = SYMBOL[last]
    # lines: the word before a newline ends a line
    newline = np.concatenate([[0], np.cumsum(data == 10)])
    line = newline[s.start] if len(h) else np.zeros(0, int)
    starts = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | ~follows])) if len(h) else np.zeros(0, int)
    lines_of = s.text[starts]
    lines = np.bincount(lines_of, minlength=n)
    keys = np.add.reduceat(W.mix(h + (np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))).astype(np.uint64)), starts) if len(h) else h
    chars = np.diff(s.bounds)
    return np.column_stack([
        np.log1p(count), np.minimum(share(sized, count), 40.0), share(of(UPPER), of(LETTER)), share(of(DIGIT), chars),
        share(of(SYMBOL), chars), share(of(BANG), chars), share(of(MARK), chars), share(of(HIGH), chars),
        share(np.bincount(s.text, weights=marked, minlength=n), count),
        share(np.bincount(s.text, weights=END[last], minlength=n), count),
        share(np.bincount(s.text[1:], weights=(h[1:] == h[:-1]) & follows, minlength=n) if len(h) else np.zeros(n), count),
        share(_repeats(s.text[1:][follows] if len(h) else s.text, pairs, n), count),
        share(count - _repeats(s.text, h, n), count),
        np.log1p(share(count, lines)), share(_repeats(lines_of, keys, n), lines),
    ])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    at: np.ndarray  # ridge scores, rising
    share: np.ndarray  # of label 1 there, rising

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features and a constant."""
        rng, d = np.random.default_rng(SEED), x.shape[1]
        frequency = rng.normal(size=(d, FEATURES)) / np.sqrt(d)
        phase = rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.cos(z @ frequency + phase) * np.sqrt(2 / FEATURES), np.ones(len(x))])

    def ridge(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.share[0])
        return np.interp(self.ridge(x), self.at, self.share)


def _isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Rising step function nearest to ``value``: adjacent violators are pooled."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def learn(rows: DataFrame) -> Model:
    """Model from (text, label); the statistics are computed once and written."""
    n_stats = len(STATISTICS)

    def to_statistics(texts: pa.Array) -> pa.Array:
        x = statistics(texts)
        return pa.ListArray.from_arrays(np.arange(len(x) + 1) * n_stats, pa.array(x.ravel()))

    stats = rows.select(
        F.arrow_udf(to_statistics, "array<double>")("text").alias("x"), (F.col("label") > 0).cast("double").alias("y")
    )
    stats = Scratch(rows.sparkSession).keep(stats, "statistics")
    moments = (
        stats.select(F.posexplode("x").alias("i", "v"))
        .groupBy("i")
        .agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
        .orderBy("i")
        .collect()
    )
    total = stats.agg(F.count("*").alias("n"), F.sum("y").alias("good")).first()
    prior = (0.5 + (total["good"] or 0)) / (1 + total["n"])
    model = Model(
        np.array([m["mean"] for m in moments]),
        np.array([max(m["sd"], 1e-3) for m in moments]),
        None,
        np.zeros(1),
        np.array([prior]),
    )
    if total["good"] in (None, 0.0, float(total["n"])):
        return model

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for batch in batches:
            x = np.asarray(batch["x"].flatten()).reshape(-1, n_stats)
            z = model.features(x)
            left += z.T @ z
            right += z.T @ np.asarray(batch["y"])
        cells = np.column_stack([left, right])
        i, j = np.indices(cells.shape)
        columns = [pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(cells.ravel())]
        yield pa.RecordBatch.from_arrays(columns, ["i", "j", "v"])

    sums = stats.mapInArrow(normal, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    cells = np.zeros((FEATURES + 1, FEATURES + 2))
    cells[sums["i"], sums["j"]] = sums["v"]
    penalty = RIDGE * total["n"] / FEATURES * np.eye(FEATURES + 1)
    penalty[-1, -1] = 0
    model.weights = np.linalg.solve(cells[:, :-1] + penalty, cells[:, -1])

    def ridge(x: pa.Array) -> pa.Array:
        return pa.array(np.clip(np.round(model.ridge(np.asarray(x.flatten()).reshape(-1, n_stats)), 3), -2, 3))

    seen = (
        stats.select(F.arrow_udf(ridge, "double")("x").alias("at"), "y")
        .groupBy("at")
        .agg(F.avg("y").alias("share"), F.count("*").alias("n"))
        .orderBy("at")
        .toPandas()
    )
    model.at = seen["at"].to_numpy()
    model.share = np.clip(_isotonic(seen["share"].to_numpy(), seen["n"].to_numpy()), 0.0, 1.0)
    return model


def score(documents: DataFrame, model: Model, text: str = "text") -> Column:
    """Probability of label 1 of each text, as a column of ``documents``."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(statistics(texts)))

    return F.arrow_udf(run, "double")(documents[text])


def fit(documents: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Model:
    """Model from at most ``limit`` labelled documents outside the held-out fold."""
    rows = training_rows(documents, labels, "quality", limit=limit)
    return learn(rows)


def score_documents(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row per row of ``documents``: doc_id, held_out, score, predicted."""
    scored = documents.select("doc_id", score(documents, fit(documents, labels)).alias("score"))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id"), 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def reject_poor(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents, all columns, whose score is ``threshold`` or more."""
    return documents.where(score(documents, fit(documents, labels)) >= threshold)
