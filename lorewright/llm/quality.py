"""Quality by hierarchical empirical Bayes: a document classifier's evidence with host and path posteriors.

A logistic classifier over dense features of the text (shares of signs, capitals, digits, bars; word and line shape; repeats)
is fitted on SAMPLE labelled documents at most, those of the smallest hashes of doc_id. Its probabilities are then summed by
path and by host in grouped aggregates. A host's posterior mean shrinks its documents' mean towards the global one, a path's
towards its host's, each with a prior weight estimated by the method of moments from how much hosts (paths) differ beyond
what their sizes explain; a site of few documents so stays near the prior. The path's posterior without the document itself
moves the document's log-odds by its distance from the global mean, damped by WEIGHT.

In `documents` the host is source and the path is (source, lang); both column names are parameters.

Defined results: null and empty texts have an empty text's features and a score; a null host or path is a group of its own;
labels that are null or of unknown documents are not used, repeated labels count as their largest; without labels of both
kinds a fixed rule on the share of signs takes the classifier's place; rows keep their ids, null or repeated; an empty table
gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import _LOWER, _WORD, cut, distinct, flat, light, pieces, words

SAMPLE, WEIGHT, THRESHOLD = 12_000, 0.5, 0.5
_SIGNS = ~_WORD
_SIGNS[[*b" \n\t\r.,;:!?'\"()-", *range(65, 91)]] = False
NAMES = ["signs", "bars", "capitals", "digits", "exclaimed", "word_length", "log_words", "log_line", "distinct_words", "repeated_lines", "marked_words", "empty"]


def _within(groups: np.ndarray) -> np.ndarray:
    """The place of each element in its run of equal numbers."""
    if not len(groups):
        return np.zeros(0, np.uint64)
    first = np.concatenate([[True], groups[1:] != groups[:-1]])
    return (np.arange(len(groups)) - np.flatnonzero(first)[np.cumsum(first) - 1]).astype(np.uint64)


def features(column: pa.Array) -> np.ndarray:
    """One row of NAMES for each text."""
    data, offsets = flat(column)
    n, sizes = len(column), np.diff(offsets)
    rows_of = np.repeat(np.arange(n), sizes)
    at = lambda mask: np.bincount(rows_of[mask], minlength=n)
    hashes, rows, starts, ends = words(data, offsets)
    chars, n_words = np.maximum(sizes, 1), np.maximum(np.bincount(rows, minlength=n), 1)
    low = _LOWER[data]
    alpha = np.maximum(at(((low >= 97) & (low <= 122)) | (data >= 128)), 1)
    signs = _SIGNS[low]
    bars = data == 124
    pairs = distinct(hashes, rows)[1]
    edge = np.concatenate([data[1:], [32]]) if len(data) else data
    marked = signs & (np.concatenate([[32], edge[:-1]])[: len(data)] != 32) if len(data) else signs
    # lines: hashes of what stands between line feeds
    breaks = np.flatnonzero(data == 10)
    n_lines = np.bincount(rows_of[breaks], minlength=n) + 1
    line_of = np.cumsum(data == 10) + rows_of if len(data) else rows_of
    line_hash = np.zeros(int(line_of[-1]) + 1 if len(data) else 0, np.uint64)
    word_line = line_of[starts]
    np.add.at(line_hash, word_line, hashes * (np.uint64(2) * _within(word_line) + np.uint64(1)))
    where = np.flatnonzero(np.diff(word_line, prepend=-1))
    used = word_line[where]
    line_rows = rows[where]
    whole = distinct(line_hash[used], line_rows)[1]
    full, own = np.maximum(np.bincount(line_rows, minlength=n), 1), np.maximum(np.bincount(whole, minlength=n), 1)
    columns = [at(signs & ~bars) / chars, at(bars) / n_words, at((data >= 65) & (data <= 90)) / alpha, at((data >= 48) & (data <= 57)) / chars, at(data == 33) / n_words]
    columns += [np.bincount(rows, ends - starts, n) / n_words, np.log1p(n_words), np.log1p(n_words / n_lines), np.bincount(pairs, minlength=n) / n_words, 1 - own / full, at(marked) / n_words, (sizes == 0) * 1.0]
    return np.stack(columns, 1).astype(float) if n else np.zeros((0, len(NAMES)))


class Logistic:
    """Ridge logistic regression on standardised, clipped features, by Newton steps."""

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Logistic:
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        z = self._design(x)
        self.w = np.zeros(z.shape[1])
        penalty = ridge * np.diag([0.0, *np.ones(z.shape[1] - 1)])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(len(self.w)), z.T @ (y - p) - penalty @ self.w)
            self.w = self.w + np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-6:
                break
        return self

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.ones((len(z), 1)), z, np.sqrt(np.abs(z))], 1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._design(x) @ self.w, -8, 8)


class Rule:
    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.where((x[:, 0] > 0.1) | (x[:, 1] > 0.3) | (x[:, 11] > 0), -2.0, 2.0)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Logistic | Rule:
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("quality") > 0).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(13)), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            x = pa.FixedSizeListArray.from_arrays(pa.array(features(batch.column("text")).ravel()), len(NAMES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), x], ["doc_id", "y", "x"])

    picked = light(docs).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most sample rows of two numbers
    rows = sorted(picked.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y int, x array<double>").limit(2 * sample).collect())
    y = np.array([r[1] for r in rows], float)
    if len(rows) < 30 or not 0 < y.sum() < len(y):
        return Rule()
    return Logistic().fit(np.array([r[2] for r in rows]), y)


def _strength(groups: DataFrame, total: str, n: str, prior: str) -> float:
    """Prior weight m(1 - m)/v - 1, v being the spread of group means about their priors beyond what group sizes explain."""
    d = (F.col(total) / F.col(n) - F.col(prior)) ** 2
    noise = F.col(prior) * (1 - F.col(prior)) / F.col(n)
    own = groups.agg(F.sum(F.col(n) * (d - noise)) / F.sum(n), F.sum(F.col(n) * F.col(prior)) / F.sum(n)).first()
    if own[0] is None or own[0] <= 1e-6:
        return 1e4
    return float(min(max(own[1] * (1 - own[1]) / own[0] - 1, 1.0), 1e4))


def score(docs: DataFrame, labels: DataFrame, host: str = "source", path: tuple[str, ...] = ("source", "lang"), sample: int = SAMPLE) -> DataFrame:
    """doc_id, doc_score, host_score, path_score, score, keep."""
    model = fit(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            logit = model(features(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), batch.column("path"), pa.array(logit), pa.array(1 / (1 + np.exp(-logit)))], ["doc_id", "host", "path", "logit", "p"])

    key = lambda names: F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in names])
    rows = docs.select("doc_id", key([host]).alias("host"), key(path).alias("path"), "text")
    scored = cut(rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, host string, path string, logit double, p double"))
    paths = cut(scored.groupBy("host", "path").agg(F.sum("p").alias("sp"), F.count("*").alias("np")))
    hosts = paths.groupBy("host").agg(F.sum("sp").alias("sh"), F.sum("np").alias("nh"))
    overall = hosts.agg(F.sum("sh") / F.sum("nh")).first()[0]
    mean = min(max(overall if overall is not None else 0.5, 1e-3), 1 - 1e-3)
    hosts = hosts.withColumn("m", F.lit(mean))
    k = _strength(hosts, "sh", "nh", "m")
    hosts = cut(hosts.select("host", ((F.col("sh") + k * mean) / (F.col("nh") + k)).alias("host_score")))
    paths = paths.join(hosts, "host")
    q = _strength(paths, "sp", "np", "host_score")
    joined = scored.join(paths.select("path", "sp", "np", "host_score"), "path")
    others = (F.col("sp") - F.col("p") + q * F.col("host_score")) / (F.col("np") - 1 + q)
    others = F.least(F.greatest(others, F.lit(1e-3)), F.lit(1 - 1e-3))
    moved = F.col("logit") + WEIGHT * (F.log(others / (1 - others)) - float(np.log(mean / (1 - mean))))
    final = joined.select("doc_id", F.round("p", 6).alias("doc_score"), F.round("host_score", 6).alias("host_score"), F.round(others, 6).alias("path_score"), F.round(1 / (1 + F.exp(-moved)), 6).alias("score"))
    return final.withColumn("keep", F.col("score") >= THRESHOLD)
