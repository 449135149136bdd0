"""A name tagger: averaged structured perceptron with Viterbi decoding over Arrow batches.

Texts become sentences of tokens, tokens become hashed features (own form, shape
and affixes, forms and shapes of two neighbours to each side), labels are begin
and inside of each type, or outside. Weights are learned by iterative parameter
mixing: each epoch every shard of the labelled texts trains from the same
weights, and the weights of the shards are averaged. Shards are rows of a
partitioned table and weights have a fixed size, so the data never meets in one
place; the number of shards is a parameter, so a result does not depend on the
cluster. Every third time a sentence is learned from with its capitalised words
hidden, lest names be learned by heart.

Decoding takes a step for all sentences of a batch at once. Sentences end at a
line break, at a full stop behind a longer word, or after ``LONGEST`` tokens;
texts of any length are read whole. A null or empty text has no spans.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkveil.operators.detect import MODEL_TYPES, SPANS, TYPES

LABELS = ("O", *(f"{p}-{t}" for t in MODEL_TYPES for p in "BI"))
#: Rows of the weight table, a power of two; features are hashed to them.
WEIGHTS = 1 << 17
#: Tokens of a sentence at most, and passes over the labelled texts.
LONGEST, EPOCHS, SHARDS = 128, 5, 8
#: Labelled texts that are learned from at most.
MOST_TEXTS = 4000
#: Tokens whose sentences are judged together.
TOGETHER = 50_000
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
_OFFSETS = (-2, -1, 0, 1, 2)


def tokens(text: str) -> list[tuple[int, int]]:
    """(start, end) of words, numbers and signs."""
    return [m.span() for m in _TOKEN.finditer(text)]


def sentences(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(first, last + 1) tokens of each sentence."""
    out, first = [], 0
    for i in range(1, len(spans) + 1):
        if i < len(spans) and i - first < LONGEST:
            gap = text[spans[i - 1][1]: spans[i][0]]
            stop = text[spans[i - 1][0]] in ".!?" and gap and i > 1 and spans[i - 2][1] - spans[i - 2][0] > 2
            if not stop and "\n" not in gap:
                continue
        out.append((first, i))
        first = i
    return out


def _shape(word: str) -> str:
    """Kinds of the characters, equal neighbours once: Xx, XX, d, a sign."""
    kinds = "".join("X" if c.isupper() else "x" if c.isalpha() else "d" if c.isdigit() else c for c in word[:6])
    return re.sub(r"(.)\1+", r"\1\1", kinds)


_KNOWN: dict[str, tuple[int, ...]] = {}


def _word_features(word: str) -> tuple[int, ...]:
    """Hashes of form, shape, beginning and endings of a word; remembered, within bounds."""
    found = _KNOWN.get(word)
    if found is None:
        if len(_KNOWN) > 200_000:
            _KNOWN.clear()
        low = word.lower()
        found = _KNOWN[word] = tuple(zlib.crc32(x.encode("utf-8", "replace")) for x in (f"w{low[:40]}", f"s{_shape(word)}", f"p{low[:3]}", f"e{low[-3:]}", f"f{low[-2:]}"))
    return found


#: Stands before the first and behind the last token of a sentence.
_EDGE = tuple(zlib.crc32(x) for x in (b"edge-w", b"edge-s", b"edge-p", b"edge-e", b"edge-f"))
#: Stands for the form and affixes of a hidden word.
_HIDDEN = zlib.crc32(b"hidden")


def features(words: list[str], hidden: bool = False) -> np.ndarray:
    """(token, feature) rows of the weight table for one sentence; ``hidden`` shows capitalised words by their shape only."""
    said = [_word_features(w) for w in words]
    if hidden:
        said = [(_HIDDEN, f[1], _HIDDEN, _HIDDEN, _HIDDEN) if w[:1].isupper() else f for w, f in zip(words, said)]
    return _rows_of([said])


def _rows_of(sentences: list[list[tuple[int, ...]]]) -> np.ndarray:
    """Rows of the weight table for the tokens of some sentences, one below the other, from the hashes of their words."""
    pad = [_EDGE] * 2
    own = np.array([f for said in sentences for part in (pad, said, pad) for f in part], dtype=np.uint64)
    sizes = np.array([len(said) for said in sentences])
    n, out = int(sizes.sum()), []
    here = np.arange(n) + np.repeat(2 + 4 * np.arange(len(sizes)), sizes)

    def mixed(salt: int, *columns: np.ndarray) -> None:
        h = np.full(n, salt * 0x9E3779B97F4A7C15 % 2**64, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for c in columns:
                h = (h ^ c) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(32)
        out.append((h % np.uint64(WEIGHTS)).astype(np.int64))

    at = lambda column, offset: own[here + offset, column]
    for i, offset in enumerate(_OFFSETS):
        mixed(10 + i, at(0, offset))
        mixed(20 + i, at(1, offset))
    for i in (2, 3, 4):
        mixed(30 + i, at(i, 0))
    mixed(40, at(1, -1), at(1, 0))
    mixed(41, at(1, 0), at(1, 1))
    mixed(42, at(0, -1), at(1, 0))
    mixed(43, at(1, 0), at(0, 1))
    mixed(44, at(0, -2), at(0, -1), at(1, 0))
    mixed(45, at(1, -1), at(1, 0), at(1, 1))
    return np.stack(out, axis=1)


def _all_features(sentences: list[list[str]]) -> list[np.ndarray]:
    """:func:`features` of each sentence; a sentence has a few words, so they are hashed together."""
    if not sentences:
        return []
    rows = _rows_of([[_word_features(w) for w in words] for words in sentences])
    return np.split(rows, np.cumsum([len(words) for words in sentences])[:-1])


def _allowed() -> np.ndarray:
    """Inside a type only behind its begin or inside."""
    out = np.zeros((len(LABELS), len(LABELS)), dtype=np.float32)
    for j, label in enumerate(LABELS):
        if label[0] == "I":
            for i, before in enumerate(LABELS):
                if before[2:] != label[2:]:
                    out[i, j] = -np.inf
    return out


_ALLOWED = _allowed()
_BEGIN = np.array([-np.inf if x[0] == "I" else 0.0 for x in LABELS], dtype=np.float32)


def viterbi(emitted: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best label sequences of padded sentences: ``emitted`` is (sentence, token, label)."""
    n, longest, _ = emitted.shape
    best, back = emitted[:, 0] + _BEGIN, np.zeros(emitted.shape, dtype=np.int8)
    for t in range(1, longest):
        options = best[:, :, None] + (moves + _ALLOWED)[None]
        from_, here = options.argmax(axis=1), options.max(axis=1) + emitted[:, t]
        live = (t < lengths)[:, None]
        back[:, t] = np.where(live, from_, np.arange(emitted.shape[2]))  # a sentence that has ended keeps its label
        best = np.where(live, here, best)
    out = np.zeros((n, longest), dtype=np.int8)
    out[:, -1] = best.argmax(axis=1)
    for t in range(longest - 1, 0, -1):
        out[:, t - 1] = np.take_along_axis(back[:, t], out[:, t][:, None].astype(np.int64), axis=1)[:, 0]
    return out


@dataclass(frozen=True)
class Tagger:
    """Weights of features and of neighbouring labels."""

    weights: np.ndarray
    moves: np.ndarray

    def labels(self, sentence_features: list[np.ndarray]) -> list[np.ndarray]:
        """Label numbers of each sentence, decoded in groups of like lengths."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int8)] * len(sentence_features)
        order = sorted(range(len(out)), key=lambda i: len(sentence_features[i]))
        for a in range(0, len(order), 512):
            group = order[a: a + 512]
            lengths = np.array([len(sentence_features[i]) for i in group])
            emitted = np.zeros((len(group), lengths.max(), len(LABELS)), dtype=np.float32)
            flat = np.concatenate([sentence_features[i] for i in group])
            emitted[np.arange(emitted.shape[1]) < lengths[:, None]] = self.weights[flat].sum(axis=1)
            for i, row, n in zip(group, viterbi(emitted, lengths, self.moves), lengths):
                out[i] = row[:n]
        return out

    def find(self, texts: Iterable[str | None]) -> list[list[tuple[int, int, str]]]:
        """(start, end, type) of the names of each text."""
        found, whole, where, held = [], [], [], 0

        def judge() -> None:
            for (n, spans), labels in zip(where, self.labels(_all_features(whole))):
                for (start, end), label in zip(spans, labels.tolist()):
                    name = LABELS[label]
                    if name[0] == "B":
                        found[n].append((start, end, name[2:]))
                    elif name[0] == "I":
                        found[n][-1] = (found[n][-1][0], end, name[2:])
            whole.clear()
            where.clear()

        for n, text in enumerate(texts):
            found.append([])
            spans = tokens(text) if text else []
            for a, b in sentences(text, spans) if spans else []:
                if held + b - a > TOGETHER:
                    judge()
                    held = 0
                held += b - a
                whole.append([text[s:e] for s, e in spans[a:b]])
                where.append((n, spans[a:b]))
        judge()
        return found


def gold_labels(spans: list[tuple[int, int]], gold: Iterable[tuple[int, int, str]]) -> np.ndarray:
    """Label numbers of tokens under spans of the model's types."""
    out = np.zeros(len(spans), dtype=np.int8)
    for start, end, kind in gold:
        if kind in MODEL_TYPES:
            inside = [i for i, (a, b) in enumerate(spans) if a < end and b > start]
            for n, i in enumerate(inside):
                out[i] = LABELS.index(f"{'I' if n else 'B'}-{kind}")
    return out


class _Learner:
    """Perceptron updates of one shard, and the running sums that average them."""

    def __init__(self, start: Tagger):
        self.w, self.m = start.weights.copy(), start.moves.copy()
        self.sum_w, self.sum_m, self.n = np.zeros_like(self.w), np.zeros_like(self.m), 1

    def learn(self, rows: np.ndarray, gold: np.ndarray) -> None:
        said = viterbi(self.w[rows].sum(axis=1)[None], np.array([len(rows)]), self.m)[0]
        for t in np.flatnonzero(said != gold):
            for label, by in ((gold[t], 1.0), (said[t], -1.0)):
                self.w[rows[t], label] += by
                self.sum_w[rows[t], label] += by * self.n
        for t in range(1, len(rows)):
            for labels, by in (((gold[t - 1], gold[t]), 1.0), ((said[t - 1], said[t]), -1.0)):
                self.m[labels] += by
                self.sum_m[labels] += by * self.n
        self.n += 1

    def average(self) -> Tagger:
        return Tagger(self.w - self.sum_w / self.n, self.m - self.sum_m / self.n)


def fit_tagger(labelled: DataFrame, epochs: int = EPOCHS, shards: int = SHARDS, most: int = MOST_TEXTS) -> Tagger:
    """A tagger from (text_id, text, gold), ``gold`` an array of (start, end, entity_type).

    It learns from ``most`` labelled rows, those of the smallest hash of text_id, or all if there are fewer.
    """
    sample = labelled.select("text_id", "text", "gold").orderBy(F.xxhash64("text_id"), "text_id").limit(most)
    dealt = sample.repartition(shards, "text_id").sortWithinPartitions("text_id").persist()
    size = WEIGHTS * len(LABELS)
    model = Tagger(np.zeros((WEIGHTS, len(LABELS)), dtype=np.float32), np.zeros((len(LABELS),) * 2, dtype=np.float32))
    total = np.zeros(size + len(LABELS) ** 2)

    def trained(start: Tagger, epoch: int) -> Callable:
        def run(frames):
            learner = _Learner(start)
            for rows in frames:
                for text, gold in zip(rows["text"], rows["gold"]):
                    spans = tokens(text or "")
                    marks = gold_labels(spans, [(g["start"], g["end"], g["entity_type"]) for g in gold]) if spans else []
                    for a, b in sentences(text, spans) if spans else []:
                        hidden = (learner.n + epoch) % 3 == 0  # names must be told by what stands around them, too
                        learner.learn(features([text[s:e] for s, e in spans[a:b]], hidden), marks[a:b])
            if learner.n > 1:  # a shard without rows has nothing to say
                mean = learner.average()
                for last, tagger in ((True, Tagger(learner.w, learner.m)), (False, mean)):
                    flat = np.concatenate((tagger.weights.ravel(), tagger.moves.ravel()))
                    at = np.flatnonzero(flat)
                    yield pd.DataFrame({"last": last, "at": at, "value": flat[at].astype(float)})
                yield pd.DataFrame({"last": [True], "at": [-1], "value": [1.0]})
        return run

    try:
        for epoch in range(epochs):
            mixed = dealt.mapInPandas(trained(model, epoch), "last boolean, at long, value double").groupBy("last", "at").agg(F.sum("value").alias("value")).toPandas()  # of the size of the model
            count = mixed.loc[mixed["at"] == -1, "value"].sum()
            if not count:
                break
            values = {last: np.zeros(size + len(LABELS) ** 2) for last in (True, False)}
            for last, rows in mixed[mixed["at"] >= 0].groupby("last"):
                values[bool(last)][rows["at"].to_numpy()] = rows["value"].to_numpy() / count
            model = Tagger(*_shaped(values[True]))
            total += values[False] / epochs
    finally:
        dealt.unpersist()
    return Tagger(*_shaped(total))


def _shaped(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = WEIGHTS * len(LABELS)
    return flat[:size].reshape(WEIGHTS, len(LABELS)).astype(np.float32), flat[size:].reshape(len(LABELS), len(LABELS)).astype(np.float32)


def tagger_spans(model: Tagger, text: Column, fail_mode: str) -> Column:
    """struct<spans, error> of a text, as :func:`detect.model_spans` has it, decoded batch by batch.

    ``closed`` reports a batch that fails as the error of its rows, ``open`` goes on without spans.
    """
    if fail_mode not in ("open", "closed"):
        raise ValueError("fail_mode must be open or closed")

    def run(texts: pd.Series) -> pd.DataFrame:
        error = None
        try:
            found = model.find(texts)
        except Exception as problem:  # errors never carry texts
            found, error = [[] for _ in texts], type(problem).__name__ if fail_mode == "closed" else None
        rows = []
        for spans in found:
            placed, count = [], dict.fromkeys(MODEL_TYPES, 0)
            for start, end, kind in spans:
                placed.append({"start": start, "end": end, "entity_type": kind, "tier": 2, "det_idx": TYPES.index(kind), "emit_pos": count[kind]})
                count[kind] += 1
            rows.append(placed)
        return pd.DataFrame({"spans": rows, "error": [error] * len(rows)})

    return F.pandas_udf(run, f"spans {SPANS}, error string")(text)
