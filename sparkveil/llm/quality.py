"""Operator 1: quality classifier.

Histogram gradient-boosted trees over document statistics. The statistics of
every whole text are computed inside tasks from the raw UTF-8 bytes; the trees
are grown on a bounded, documented sample of labelled rows and flattened into
plain arrays, so scoring is a fixed number of vectorised gathers per tree level.

Defined cases: a null text counts as empty; empty texts get the score the trees
give to all-zero statistics; very long texts are read whole, in segments; an
empty table gives no rows; of the rows of a sampled id one is learned from; without labelled rows every score is 0.5; rows are
scored one by one, so repeated rows get equal scores and ties cannot arise;
columns of ``documents`` other than ``doc_id`` and ``text`` are never read, so
extra columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SHINGLE_WORDS, batch_word_hashes, text_buffers

#: The most labelled rows the trees are fitted on (the documented bound).
MAX_TRAINING_ROWS = 20_000
#: ``predicted`` is 1 from this score on.
KEEP_SCORE = 0.3

FEATURES = (
    "log_bytes", "log_words", "mean_word_bytes", "upper_share", "digit_share", "mark_share", "bang_share",
    "pipe_share", "odd_mark_share", "comma_stop_share", "wide_share", "space_share", "distinct_word_share",
    "repeat_next_share", "top_word_share", "log_lines", "mean_line_words", "repeat_line_share", "letter_share",
    "repeat_pair_share",
)

_CLASSES = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": bytes(range(48, 58)),
    "bang": b"!?", "pipe": b"|", "odd": b"#$%&*~^@<>{}\\=+_", "stop": b".,;:", "space": b" \t\n\r",
    "line": b"\n",
}


def _class_tables() -> np.ndarray:
    tables = np.zeros((len(_CLASSES) + 2, 256), dtype=bool)
    for i, chars in enumerate(_CLASSES.values()):
        tables[i, list(chars)] = True
    tables[-2, 128:] = True  # wide
    tables[-1, 33:127] = True  # marks: printable ASCII that is no letter and no digit
    for i in (0, 1, 2):
        tables[-1] &= ~tables[i]
    return tables


def document_statistics(array) -> np.ndarray:
    """One row of :data:`FEATURES` for each text of an Arrow string array."""
    data, offsets = text_buffers(array)
    rows = len(offsets) - 1
    out = np.zeros((rows, len(FEATURES)))
    tables = _class_tables()
    for first, cuts, words in batch_word_hashes(data, offsets, SHINGLE_WORDS):
        last = first + len(cuts) - 1
        base = offsets[first]
        piece = data[base: offsets[last]]
        bounds = (offsets[first: last + 1] - base).astype(np.int64)
        n = np.diff(bounds).astype(float)
        per = np.maximum(n, 1)
        # counts by byte value and document, then by class: one pass over the bytes
        doc_of = np.repeat(np.arange(last - first), np.diff(bounds))
        hist = np.bincount(doc_of * 256 + piece, minlength=(last - first) * 256).reshape(-1, 256)
        upper, lower, digit, bang, pipe, odd, stop, space, line, wide, mark = (hist @ tables.T.astype(np.int64)).T
        nw = np.diff(cuts).astype(float)
        pw = np.maximum(nw, 1)
        same_next, same_pair = np.zeros(last - first), np.zeros(last - first)
        if len(words) > 1:
            word_doc = np.repeat(np.arange(last - first), np.diff(cuts))
            inside = word_doc[1:] == word_doc[:-1]
            same_next = np.bincount(word_doc[1:], (words[1:] == words[:-1]) & inside, minlength=last - first)
        distinct, top, line_rep = np.zeros(last - first), np.zeros(last - first), np.zeros(last - first)
        text = piece.tobytes()
        for i in range(last - first):
            w = words[cuts[i]: cuts[i + 1]]
            if len(w):
                s = np.sort(w)
                new = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1], [True])))
                distinct[i] = len(new) - 1
                top[i] = np.diff(new).max()
                if len(w) > 2:
                    with np.errstate(over="ignore"):
                        pair = np.sort(w[1:] * np.uint64(3) + w[:-1])
                    same_pair[i] = np.count_nonzero(pair[1:] == pair[:-1])
            lines = text[bounds[i]: bounds[i + 1]].split(b"\n")
            line_rep[i] = 1 - len(set(lines)) / len(lines)
        out[first:last] = np.stack([
            np.log1p(n), np.log1p(nw), (n - space) / pw, upper / np.maximum(upper + lower, 1), digit / per, mark / per,
            bang / per, pipe / per, odd / per, stop / per, wide / per, space / per, distinct / pw, same_next / pw,
            top / pw, np.log1p(line), nw / (line + 1), line_rep, (upper + lower + wide) / per, same_pair / pw], axis=1)
    return out


@dataclass(frozen=True)
class TreeArrays:
    """Boosted trees as arrays: node i of a tree has children ``left`` and ``left + 1``; a leaf is its own child."""

    bias: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                child = self.left[at]
                go_right = x[rows, self.feature[at]] > self.threshold[at]
                at = np.where(child == at, at, child + go_right)
            total += self.value[at]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15,
              least: int = 20, ridge: float = 1.0) -> TreeArrays:
    """Grow histogram gradient-boosted trees on logistic loss.

    Each feature is cut at up to ``bins`` quantiles once; every node's split is
    then read off cumulated gradient and hessian histograms.
    """
    feature, threshold, left, value, roots = [], [], [], [], []
    share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    bias = float(np.log(share / (1 - share))) if len(y) else 0.0
    if len(y) < 2 * least or y.min() == y.max():
        none = np.zeros(0, dtype=np.int64)
        return TreeArrays(bias, none, np.zeros(0), none, np.zeros(0), none, depth)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    width, nf = bins, x.shape[1]
    flat = code + np.arange(nf) * width
    total = np.full(len(y), bias)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        roots.append(len(feature))
        todo = [(len(feature), np.arange(len(y)), 0)]
        feature.append(0), threshold.append(0.0), left.append(len(left)), value.append(0.0)
        while todo:
            node, idx, level = todo.pop()
            gs, hs = g[idx].sum(), h[idx].sum()
            value[node] = rate * gs / (hs + ridge)
            best = None
            if level < depth and len(idx) >= 2 * least:
                cells = flat[idx].ravel()
                hist = [np.bincount(cells, np.repeat(v[idx], nf) if v is not None else None, minlength=nf * width)
                        .reshape(nf, width).cumsum(axis=1)[:, :-1] for v in (g, h, None)]
                gl, hl, nl = hist
                gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                gain[(nl < least) | (len(idx) - nl < least)] = -1
                f, b = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[f, b] > 1e-6 and b < len(edges[f]):
                    best = f, b
            if best is None:
                total[idx] += value[node]
                continue
            f, b = best
            right = code[idx, f] > b
            child = len(feature)
            feature[node], threshold[node], left[node] = int(f), float(edges[f][b]), child
            for part in (idx[~right], idx[right]):
                todo.append((len(feature), part, level + 1))
                feature.append(0), threshold.append(0.0), left.append(len(left)), value.append(0.0)
    return TreeArrays(bias, np.array(feature), np.array(threshold), np.array(left), np.array(value), np.array(roots), depth)


def _statistics_frame(docs: DataFrame) -> DataFrame:
    names = list(FEATURES)

    def run(batches):
        for batch in batches:
            x = document_statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x[:, i]) for i in range(len(names)))], ["doc_id", *names])

    return docs.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in names))


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, **options) -> TreeArrays:
    """Fit the trees on ``labels`` (``doc_id``, ``label``), on ``max_rows`` rows at most.

    If there are more, those with the smallest hashes of ``doc_id`` are taken.
    Only their statistics, a bounded number of small rows, reach the driver.
    """
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = _statistics_frame(texts).join(F.broadcast(known), "doc_id").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    return fit_trees(rows[list(FEATURES)].to_numpy(float), rows["label"].to_numpy(float), **options)


def score_quality(docs: DataFrame, model: TreeArrays) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) of every row of ``docs``; rows are independent, there is no shuffle."""

    def run(batches):
        for batch in batches:
            score = model.score(document_statistics(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def keep_quality(docs: DataFrame, model: TreeArrays, threshold: float = KEEP_SCORE) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is ``threshold`` or more."""
    columns, at = docs.schema, docs.columns.index("text")

    def run(batches):
        for batch in batches:
            keep = model.score(document_statistics(batch.column(at))) >= threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, columns)


def training_labels(labels: DataFrame, column: str, modulus: int, held_out: int) -> DataFrame:
    """(``doc_id``, ``label``) of the labelled rows that are not held out."""
    fold = F.crc32(F.col("doc_id").cast("string")) % modulus
    return labels.where(fold != held_out).select("doc_id", F.col(column).alias("label"))
