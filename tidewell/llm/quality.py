"""Quality classifier: regularised quadratic discriminant analysis.

Each document becomes a vector of transformed statistics. Each class has a mean
and a covariance that is shrunk towards the pooled one and towards a multiple of
the identity; a score is the difference of the two Gaussian log-densities, by
Mahalanobis distances from Cholesky factors that are made once, and a logistic
function of it.

Means and covariances are sums over all learnable labelled documents, made by
Spark; only one number for each class and pair of statistics reaches the driver.

Defined results: a null or empty text has the statistics of an empty text and a
score like any other; repeated rows give repeated rows; ids may be of any type, a
null one stays null, matches no label and counts as empty text in the hold-out rule; an empty table
gives an empty table; without both classes among the labels every score is 0.5;
columns other than those named are neither read nor returned.
"""

from __future__ import annotations

import operator
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import dotted, is_held_out, map_arrow, materialise, slices, utf8

STATISTICS = ("log_chars", "word_length", "letters", "capitals", "digits", "marks", "shouts", "stops", "lines", "distinct", "adjacent", "top_word", "short_words", "line_repeats", "longest", "entropy")
#: Shrinkage towards the pooled covariance, and towards the identity.
TO_POOLED, TO_IDENTITY = 0.1, 0.02
#: The score from which a document is predicted to be of label 1.
CUT = 0.7
#: Log-density differences are divided by this before the logistic function: statistics are not independent.
TEMPERATURE = 4.0
_D = len(STATISTICS)
#: Bytes or characters of a text that are handled at once.
CHUNK = 1 << 20

# Classes of bytes: continuation, small, capital, digit, stop, shout, line end, blank, other mark, lead of a wide letter.
_CLASS = np.full(256, 8, np.int64)
_CLASS[0x80:0xC0] = 0
_CLASS[0x61:0x7B] = 1
_CLASS[0x41:0x5B] = 2
_CLASS[0x30:0x3A] = 3
for _c in b".,;:'\"-()":
    _CLASS[_c] = 4
for _c in b"!?":
    _CLASS[_c] = 5
_CLASS[0x0A] = 6
for _c in b" \t\r":
    _CLASS[_c] = 7
_CLASS[0xC0:] = 9


def statistics(batch: pa.RecordBatch) -> np.ndarray:
    """The transformed statistics of each text of a batch."""
    data, at = utf8(batch)
    n = batch.num_rows
    by_class = np.zeros(n * 10)
    for low in range(0, len(data), CHUNK):
        part = data[low : low + CHUNK]
        row = np.searchsorted(at, np.arange(low, low + len(part)), "right") - 1 if n > 1 else 0
        by_class += np.bincount(row * 10 + _CLASS[part], minlength=n * 10)
    by_class = by_class.reshape(n, 10)
    chars = by_class.sum(axis=1) - by_class[:, 0]
    some = np.maximum(chars, 1)
    letters = by_class[:, 1] + by_class[:, 2] + by_class[:, 9]
    out = np.zeros((n, _D))
    rate = lambda x: np.log(x + 0.002)
    out[:, 0] = np.log1p(chars)
    out[:, 2] = letters / some
    out[:, 3] = rate(by_class[:, 2] / np.maximum(letters, 1))
    out[:, 4] = rate(by_class[:, 3] / some)
    out[:, 5] = rate(by_class[:, 8] / some)
    out[:, 6] = rate(by_class[:, 5] / some)
    out[:, 7] = rate(by_class[:, 4] / some)
    out[:, 8] = rate(by_class[:, 6] / some)
    for k, text in enumerate(batch.column("text").to_pylist()):
        if text and not text.isspace():
            out[k, [1, 9, 10, 11, 12, 13, 14, 15]] = _words(text) if len(text) <= CHUNK else _words_of_long(text)
    return out


def _rate(x: float) -> float:
    return float(np.log(x + 0.002))


def _word_statistics(m: int, total: int, longest: int, short: int, adjacent: int, frequent: np.ndarray, lines: int, kinds: int) -> list[float]:
    share = frequent / m
    return [np.log(total / m), np.log((len(frequent) + 1) / (m + 1)) / np.log(m + 2), _rate(adjacent / m), _rate(frequent.max() / m), short / m, _rate(1 - kinds / lines), np.log(longest), -(share * np.log(share)).sum() / np.log(m + 1)]


def _words(text: str) -> list[float]:
    """The statistics of words and lines, of a text that has a word."""
    words = text.split()
    counts, lengths, lines = Counter(words), list(map(len, words)), text.split("\n")
    frequent = np.fromiter(counts.values(), float, len(counts))
    return _word_statistics(len(words), sum(lengths), max(lengths), sum(x < 4 for x in lengths), sum(map(operator.eq, words[1:], words)), frequent, len(lines), len(set(lines)))


def _chunks(text: str, blank: re.Pattern) -> Iterator[str]:
    """A text in pieces of CHUNK characters or a little more, cut at a blank; the blanks at the cuts are left out."""
    at = 0
    while at <= len(text):
        cut = blank.search(text, at + CHUNK)
        yield text[at : cut.start()] if cut else text[at:]
        at = cut.end() if cut else len(text) + 1


def _words_of_long(text: str) -> list[float]:
    """The same for a long text, in pieces: words and lines are counted by 64-bit hashes."""
    m = total = longest = short = adjacent = 0
    last, words_seen, lines_seen = None, [], []
    for part in _chunks(text, re.compile(r"\s")):
        words = part.split()
        if not words:
            continue
        lengths = list(map(len, words))
        m, total, longest, short = m + len(words), total + sum(lengths), max(longest, *lengths), short + sum(x < 4 for x in lengths)
        adjacent += sum(map(operator.eq, words[1:], words)) + (words[0] == last)
        last = words[-1]
        words_seen.append(np.fromiter(map(hash, words), np.int64, len(words)))
    for part in _chunks(text, re.compile("\n")):
        lines = part.split("\n")
        lines_seen.append(np.fromiter(map(hash, lines), np.int64, len(lines)))
    every = np.concatenate(lines_seen)
    frequent = np.unique(np.concatenate(words_seen), return_counts=True)[1].astype(float)
    return _word_statistics(m, total, longest, short, adjacent, frequent, len(every), len(np.unique(every)))


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        x = statistics(batch)
        values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), _D).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), values], ["doc_id", "x"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros((2, 1 + _D + _D * _D))
    for batch in batches:
        if not batch.num_rows:
            continue
        x, label = np.asarray(batch.column("x").flatten()).reshape(-1, _D), np.asarray(batch.column("label"))
        for c in (0, 1):
            own = x[label == c]
            sums[c] += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
    k = sums.shape[1]
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], k)), pa.array(np.tile(np.arange(k), 2)), pa.array(sums.ravel())], ["label", "i", "v"])


class Discriminant:
    """Two shrunk Gaussians and their Cholesky factors."""

    def __init__(self, sums: np.ndarray):
        """sums: for either class the count, the sums, and the sums of products."""
        n = sums[:, 0]
        mean = sums[:, 1 : 1 + _D] / n[:, None]
        scatter = np.stack([sums[c, 1 + _D :].reshape(_D, _D) - n[c] * np.outer(mean[c], mean[c]) for c in (0, 1)])
        pooled = scatter.sum(axis=0) / max(1, n.sum() - 2)
        self.scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
        unit = np.outer(self.scale, self.scale)
        self.mean, self.root, self.log_det = mean / self.scale, [], []
        for c in (0, 1):
            own = scatter[c] / max(1, n[c] - 1)
            cov = ((1 - TO_POOLED) * own + TO_POOLED * pooled) / unit
            cov = (1 - TO_IDENTITY) * cov + TO_IDENTITY * max(np.trace(cov) / _D, 1e-3) * np.eye(_D)
            root = np.linalg.cholesky(cov)
            self.root.append(np.linalg.inv(root))
            self.log_det.append(2 * np.log(np.diag(root)).sum())
        self.prior = float(np.log(n[1] / n[0]))

    def score(self, x: np.ndarray) -> np.ndarray:
        """How likely label 1 is, 0 to 1."""
        density = []
        for c in (0, 1):
            z = (x / self.scale - self.mean[c]) @ self.root[c].T
            density.append(-0.5 * ((z * z).sum(axis=1) + self.log_det[c]))
        d = (density[1] - density[0]) / TEMPERATURE + self.prior
        return 1 / (1 + np.exp(-np.clip(d, -500, 500)))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(-1, _D)
            score = np.full(len(x), 0.5) if model is None else model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def classify(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> DataFrame:
    """Score and prediction of each document; learns from labels outside the hold-out."""
    spark = docs.sparkSession
    rows = docs.select(dotted(id_column).alias("doc_id"), dotted(text_column).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    stored = materialise(map_arrow(rows, _statistics, f"doc_id {kind}, x array<double>"), "statistics")
    known = labels.select(dotted(id_column).cast(kind).alias("doc_id"), dotted(label_column).cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~is_held_out())
    learn = stored.join(known, "doc_id").select("label", "x")
    sums = np.zeros((2, 1 + _D + _D * _D))
    for r in map_arrow(learn, _moments, "label long, i long, v double").groupBy("label", "i").agg(F.sum("v").alias("v")).collect():
        sums[r["label"], r["i"]] = r["v"]
    shared = spark.sparkContext.broadcast(Discriminant(sums) if sums[:, 0].min() > 1 else None)
    scored = stored.select("doc_id", is_held_out().alias("held_out"), "x")
    return map_arrow(scored, _score(shared), f"doc_id {kind}, held_out boolean, score double, predicted int")
