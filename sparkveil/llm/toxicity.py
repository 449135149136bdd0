"""Operator 6: toxicity by nearest labelled examples.

A bounded sample of labelled examples becomes a block-max inverted index over
all its terms. Like examples stand in blocks of two, and for every widespread
term and block the index knows the largest weight there. A document is scored by
the exact TF-IDF cosine to its nearest examples: the short lists of its rarer
terms are read whole; to these sums the bound of a block adds the block maxima
of its widespread terms; and the postings of widespread terms, most of all, are
read only for examples whose bound can still enter the nearest ``k``.

The neighbours vote: each by the part of its similarity that comes from terms
which depend on the label in the sample, against all similarity there is. The
vote is calibrated on the examples themselves, each scored without itself. The
neighbours are returned as evidence.

Terms are words and four-byte word beginnings. Document frequencies are counted
over all documents of the table, not over the sample.

Defined cases: null and empty texts, and texts without any known term, have no
neighbours and get the calibrated score of such examples; equal similarities
are broken by the smaller example id; repeated rows score alike, and equal texts
or rows of one id among the examples count once; very long texts are read whole,
in segments; an empty table gives no rows; without labelled rows every score is
0; columns besides ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, batch_word_hashes, mix64, save, text_buffers, word_table

#: The most labelled examples in the index: positive and other ones (the documented bound).
MAX_POSITIVE, MAX_OTHER = 1_000, 2_500
#: When a term depends on the label: how far from chance (standard errors of its log odds), how many positive examples, and its odds ratio.
MIN_Z, MIN_EXAMPLES, MIN_ODDS = 3.0, 3, 20
NEIGHBOURS = 15
#: Examples of a block; examples whose similarities are completed first; the share of the examples from which a term is widespread; axes of the projection that finds like examples.
BLOCK, FIRST, WIDE, PROJECTED = 2, 48, 1 / 8, 32
#: Documents whose bounds are one matrix product.
TOGETHER = 64
#: Texts whose scores a task remembers.
REMEMBERED = 2_000
#: ``predicted`` is 1 from this score on.
TOXIC_SCORE = 0.7

#: ASCII letters and digits and everything beyond ASCII.
_WORDS = word_table(word=b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_PREFIX_SALT = np.uint64(0xA0761D6478BD642F)


def _beginnings(piece: np.ndarray, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the word beginnings ``piece[at[i]:stop[i]]``, four bytes at most: unlike ones are never equal."""
    packed = (stop - at).astype(np.uint64) << np.uint64(32)
    for j in range(4):
        byte = LOWER[piece[np.minimum(at + j, len(piece) - 1)]].astype(np.uint64)
        packed |= np.where(at + j < stop, byte, np.uint64(0)) << np.uint64(8 * j)
    return mix64(packed ^ _PREFIX_SALT)


def term_batches(array):
    """Yield (first row, row starts, term hashes) over the texts of an Arrow array: every word and its beginning."""
    data, offsets = text_buffers(array)
    for first, cuts, words in batch_word_hashes(data, offsets, _WORDS):
        last = first + len(cuts) - 1
        piece = data[offsets[first]: offsets[last]]
        word = _WORDS[piece]
        start = word.copy()
        start[1:] &= ~word[:-1]
        inner = (offsets[first:last] - offsets[first]).astype(np.int64)
        inner = inner[inner < len(piece)]
        start[inner] = word[inner]
        at = np.flatnonzero(start)
        final = word.copy()
        final[:-1] &= ~(word[1:] & ~start[1:])
        stop = np.minimum(at + 4, np.flatnonzero(final) + 1)
        both = np.empty(2 * len(words), dtype=np.uint64)
        both[::2], both[1::2] = words, _beginnings(piece, at, stop)
        yield first, cuts * 2, both


class Places:
    """Finds hashes among sorted ones: their leading bits lead to the first that can be equal, a few steps at most to the last."""

    def __init__(self, terms: np.ndarray):
        self.terms, bits = terms, min(22, max(1, 4 * len(terms)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(terms, np.arange(2**bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.after = np.append(terms, np.uint64(2**64 - 1))

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the hashes are known, their places among the terms)."""
        at = self.first[hashes >> self.shift]
        low = np.flatnonzero(self.after[at] < hashes)
        while len(low):
            at[low] += 1
            low = low[self.after[at[low]] < hashes[low]]
        known = np.flatnonzero((self.after[at] == hashes) & (at < len(self.terms)))
        return known, at[known].astype(np.int64)

    def counted(self, cuts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, count) of the known terms of rows ``hashes[cuts[i]:cuts[i + 1]]``, in order."""
        known, at = self.of(hashes)
        row = np.searchsorted(cuts, known, side="right") - 1
        pair, count = np.unique(row * np.int64(len(self.terms) + 1) + at, return_counts=True)
        return *np.divmod(pair, len(self.terms) + 1), count


@dataclass(frozen=True)
class Examples:
    """What an index is made from, and shipped as: term counts of the examples, by term. All arrays are bounded by the sample."""

    terms: np.ndarray  # sorted hashes
    df: np.ndarray  # documents of the table with each term
    documents: int
    ids: np.ndarray
    labels: np.ndarray
    begin: np.ndarray  # postings of term t: begin[t] to begin[t + 1]
    examples: np.ndarray  # ascending within a term
    counts: np.ndarray
    cuts: np.ndarray  # calibration: vote thresholds
    levels: np.ndarray  # and the score of each step
    blank: float  # score without any neighbour


class BlockMaxIndex:
    """Examples by term; like examples stand side by side in small blocks."""

    def __init__(self, of: Examples):
        self.of = of
        self.terms, self.ids, self.labels, self.places = of.terms, of.ids, of.labels, Places(of.terms)
        self.begin, self.examples = of.begin.astype(np.int64), of.examples.astype(np.int64)
        self.idf = np.log((of.documents + 1) / (of.df + 1)) + 1e-3
        n = np.diff(self.begin)
        t = np.repeat(np.arange(len(of.terms)), n)
        w = (1 + np.log(of.counts)) * self.idf[t]
        norm = np.sqrt(np.bincount(self.examples, w**2, minlength=len(of.ids)))
        self.weights = w / norm[self.examples]
        # widespread terms: postings by example, and their maxima by term and block
        blocks = max(1, -(-len(of.ids) // BLOCK))
        wide = np.flatnonzero(n >= max(1, WIDE * len(of.ids)))
        self.slot = np.full(len(of.terms), -1)
        self.slot[wide] = np.arange(len(wide))
        self.rows = np.zeros((blocks * BLOCK, len(wide)))
        held = self.slot[t] >= 0
        self.rows[self.examples[held], self.slot[t[held]]] = self.weights[held]
        self.block_max = self.rows.reshape(blocks, BLOCK, len(wide)).max(axis=1).T
        seen = [np.bincount(t, of.labels[of.examples] == y, minlength=len(of.terms)) for y in (1, 0)]
        self.telling = telling_terms(*seen, int((of.labels == 1).sum()), int((of.labels == 0).sum()))
        self.cuts, self.levels, self.blank = of.cuts, of.levels, of.blank

    def __reduce__(self):
        return BlockMaxIndex, (self.of,)

    def vectors(self, cuts: np.ndarray, hashes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(terms, weights) of documents ``hashes[cuts[i]:cuts[i + 1]]``, unit length over the known terms; empty without any."""
        row, term, count = self.places.counted(cuts, hashes)
        weight = (1 + np.log(count)) * self.idf[term]
        norm = np.sqrt(np.bincount(row, weight**2, minlength=len(cuts) - 1))  # added in order, so equal texts get equal sums
        weight /= norm[row]
        edge = np.searchsorted(row, np.arange(len(cuts))).tolist()
        return [(term[i:j], weight[i:j]) for i, j in zip(edge, edge[1:])]

    def vector(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`vectors` of one document."""
        return self.vectors(np.array([0, len(hashes)]), hashes)[0]

    def _sums(self, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """What the postings of these terms add to every example."""
        if not len(term):
            return np.zeros(len(self.rows))
        n = self.begin[term + 1] - self.begin[term]
        at = np.arange(n.sum())
        at += np.repeat(self.begin[term] - (np.cumsum(n) - n), n)
        own = self.weights[at]
        own *= np.repeat(weight, n)
        return np.bincount(self.examples[at], own, minlength=len(self.rows))

    def wide_bounds(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """(document, block): what the widespread terms of a document add to an example of a block at most; one matrix product."""
        query = np.zeros((len(vectors), self.rows.shape[1]))
        for row, (term, weight) in zip(query, vectors):
            slot = self.slot[term]
            row[slot[slot >= 0]] = weight[slot >= 0]
        return query @ self.block_max

    def searched(self, vectors: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None):
        """Yield :meth:`nearest` of each document; ``without`` has an example that each leaves out."""
        for i in range(0, len(vectors), TOGETHER):
            part = vectors[i: i + TOGETHER]
            for j, (vector, bound) in enumerate(zip(part, self.wide_bounds(part)), i):
                yield self.nearest(*vector, without=-1 if without is None else without[j], bound=bound)

    def candidates(self, term: np.ndarray, weight: np.ndarray, k: int = NEIGHBOURS, without: int = -1, bound: np.ndarray | None = None):
        """(examples, exact similarities) of all that the bounds leave, the ``k`` most similar among them; ``bound`` is the row of :meth:`wide_bounds`."""
        slot = self.slot[term]
        wide, query = slot >= 0, np.zeros(self.rows.shape[1])
        query[slot[wide]] = weight[wide]
        score = self._sums(term[~wide], weight[~wide])
        bounds = score + np.repeat(self.wide_bounds([(term, weight)])[0] if bound is None else bound, BLOCK)
        if without >= 0:
            bounds[without] = -np.inf
        # the highest bounds first, then all that can still be one of the k best
        most = max(FIRST, 2 * k)
        first = np.argpartition(bounds, -most)[-most:] if len(bounds) > most else np.arange(len(bounds))
        score[first] += self.rows[first] @ query
        if without >= 0:
            score[without] = 0
        least = np.partition(score[first], -k)[-k] if len(first) >= k else 0.0
        bounds[first] = -np.inf
        more = np.flatnonzero((bounds > 0) & (bounds >= least - 1e-12))
        score[more] += self.rows[more] @ query
        held = np.concatenate([first, more])
        return held, score[held]

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int = NEIGHBOURS, without: int = -1, bound: np.ndarray | None = None):
        """Exact (examples, similarities, telling parts) of the ``k`` most similar examples, best first."""
        held, score = self.candidates(term, weight, k, without, bound)
        held, score = held[score > 0], score[score > 0]
        if len(held) > k:
            best = score >= np.partition(score, -k)[-k] - 1e-11
            held, score = held[best], score[best]
        order = np.lexsort((self.ids[held], -np.round(score, 12)))[:k]
        names, score = held[order], score[order]
        # what of these similarities comes from telling terms
        tell = self.telling[term] > 0
        return names, score, self._sums(term[tell], weight[tell])[names]

    def vote(self, names: np.ndarray, best: np.ndarray, told: np.ndarray) -> float:
        """Telling similarity of the positive neighbours among all similarity."""
        return float((told * self.labels[names]).sum() / best.sum())

    def score(self, names: np.ndarray, best: np.ndarray, told: np.ndarray) -> float:
        """Calibrated score of a document with these neighbours."""
        if not len(names):
            return self.blank
        return float(self.levels[np.searchsorted(self.cuts, self.vote(names, best, told), side="right") - 1])


def telling_terms(positive: np.ndarray, other: np.ndarray, n: int, m: int) -> np.ndarray:
    """1.0 for the terms that speak for the label, from the examples with each term among ``n`` positive and ``m`` other ones."""
    odds = np.log((positive + 0.5) / (n - positive + 0.5)) - np.log((other + 0.5) / (m - other + 0.5))
    spread = np.sqrt(1 / (positive + 0.5) + 1 / (n - positive + 0.5) + 1 / (other + 0.5) + 1 / (m - other + 0.5))
    return ((positive >= MIN_EXAMPLES) & (odds >= np.log(MIN_ODDS)) & (odds / spread >= MIN_Z)).astype(float)


def _like_order(counted: list[tuple], ids: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The examples such that neighbours are alike: halved along the widest direction of a random projection, down to blocks."""
    by_id = np.argsort(ids, kind="stable")
    place = np.zeros((len(counted), PROJECTED))
    rng = np.random.default_rng(0)
    weights = [(1 + np.log(counted[i][1])) * idf[counted[i][0]] for i in by_id]
    for axis in range(PROJECTED):
        sign = rng.choice((-1.0, 1.0), len(idf))
        place[:, axis] = [w @ sign[counted[i][0]] / (np.sqrt(w @ w) + 1e-12) for i, w in zip(by_id, weights)]

    def halves(members: np.ndarray) -> list[np.ndarray]:
        if len(members) <= BLOCK:
            return [members]
        apart = place[members] - place[members].mean(axis=0)
        way = apart[np.argmax((apart**2).sum(axis=1))]
        for _ in range(8):
            way = apart.T @ (apart @ way)
            way = way / (np.sqrt(way @ way) + 1e-12)
        along = members[np.argsort(apart @ way, kind="stable")]
        cut = -(-len(members) // (2 * BLOCK)) * BLOCK  # the first half is whole blocks
        return halves(along[:cut]) + halves(along[cut:])

    return by_id[np.concatenate(halves(np.arange(len(counted))))] if len(counted) else by_id


def build_index(ids: np.ndarray, labels: np.ndarray, rows: list[np.ndarray], terms: np.ndarray, df: np.ndarray, documents: int) -> BlockMaxIndex:
    """Index of the examples, not calibrated yet; ``df`` counts documents with each of the sorted ``terms`` among ``documents``."""
    counted = [np.unique(np.searchsorted(terms, r), return_counts=True) for r in rows]
    order = _like_order(counted, ids, np.log((documents + 1) / (df + 1)) + 1e-3)
    counted = [counted[i] for i in order]
    none = [np.zeros(0, dtype=np.int64)]
    t, n = np.concatenate([c[0] for c in counted] or none), np.concatenate([c[1] for c in counted] or none)
    e = np.repeat(np.arange(len(counted), dtype=np.int32), [len(c[0]) for c in counted])
    by_term = np.argsort(t, kind="stable")  # examples stay ascending within a term
    begin = np.searchsorted(t[by_term], np.arange(len(terms) + 1)).astype(np.int32)
    return BlockMaxIndex(Examples(terms, df.astype(np.int64), documents, ids[order], labels[order].astype(float), begin, e[by_term],
                                  n[by_term].astype(np.int32), np.array([-np.inf]), np.array([0.0]), 0.0))


def calibrate(index: BlockMaxIndex, votes: np.ndarray, truth: np.ndarray, mass: np.ndarray) -> BlockMaxIndex:
    """``index`` with the scores of votes; the votes (NaN without neighbours) are of the examples, each without itself."""
    lone = np.isnan(votes)
    blank = float((mass * truth)[lone].sum() / (mass[lone].sum() + 1e-9))
    cuts, levels = _isotonic(votes[~lone], truth[~lone], mass[~lone])
    return BlockMaxIndex(replace(index.of, cuts=cuts, levels=levels, blank=blank))


def _isotonic(vote: np.ndarray, truth: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Monotone step function from votes to label shares (pool adjacent violators)."""
    if not len(vote):
        return np.array([-np.inf]), np.array([0.0])
    order = np.argsort(vote, kind="stable")
    steps: list[list[float]] = []
    for v, y, m in zip(vote[order], truth[order], mass[order]):
        if steps and steps[-1][0] == v:
            steps[-1][1] += m * y
            steps[-1][2] += m
        else:
            steps.append([v, m * y, m])
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            last = steps.pop()
            steps[-1][1] += last[1]
            steps[-1][2] += last[2]
    return np.array([-np.inf] + [s[0] for s in steps[1:]]), np.array([s[1] / s[2] for s in steps])


def _term_rows(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``terms`` of each row of (``doc_id``, ``text``)."""
    def run(batches):
        for batch in batches:
            for first, cuts, terms in term_batches(batch.column(1)):
                rows = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(terms.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(cuts) - 1), rows], ["doc_id", "terms"])

    return docs.mapInArrow(run, "doc_id long, terms array<long>")


def count_terms(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many documents of the whole table each of the (bounded) terms occurs, and the number of documents."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        places = Places(shared.value)
        count, rows = np.zeros(len(places.terms) + 1, dtype=np.int64), 0
        for batch in batches:
            for _, cuts, found in term_batches(batch.column(1)):
                count += np.bincount(places.counted(cuts, found)[1], minlength=len(count))
            rows += batch.num_rows
        count[-1] = rows
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], ["term", "n"])

    counted = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "term long, n long")
    counted = counted.groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # as many rows as the sample has terms
    out = np.zeros(len(terms) + 1, dtype=np.int64)
    out[counted["term"].to_numpy()] = counted["n"].to_numpy()
    shared.destroy()
    return out[:-1], int(out[-1])


def _judged(docs: DataFrame, shared, schema: str, made) -> DataFrame:
    """The rows of ``made(index, ids, vectors)``, an Arrow batch for neighbouring rows of (doc_id, text)."""
    def run(batches):
        index = shared.value
        for batch in batches:
            for first, cuts, terms in term_batches(batch.column(1)):
                yield made(index, batch.column(0).slice(first, len(cuts) - 1), index.vectors(cuts, terms))

    return docs.mapInArrow(run, schema)


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_other: int = MAX_OTHER) -> BlockMaxIndex:
    """Index of at most ``max_positive + max_other`` labelled examples (those with the smallest hashes of ``doc_id``)."""
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg((F.max("label") > 0).alias("label"))
    size = {bool(r.label): r["count"] for r in known.groupBy("label").count().collect()}
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    sample = known.where("label").orderBy(*order).limit(max_positive).unionByName(
        known.where("not label").orderBy(*order).limit(max_other))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(sample), "doc_id")
    # rows of one id, and equal texts, count once
    texts = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    one = texts.groupBy("text").agg(F.min(F.struct("doc_id", "label")).alias("first"))
    texts = save(one.select("first.doc_id", "first.label", "text"), "toxic-sample")
    table = _term_rows(texts.select("doc_id", "text")).join(texts.select("doc_id", "label"), "doc_id").toArrow().sort_by("doc_id")
    ids, y = table["doc_id"].to_numpy().astype(np.int64), np.array(table["label"].to_pylist(), dtype=float)
    rows = [r.values.to_numpy().view(np.uint64) if len(r) else np.zeros(0, dtype=np.uint64) for r in table["terms"]]
    del table
    terms = np.unique(np.concatenate(rows or [np.zeros(0, dtype=np.uint64)]))
    df, documents = count_terms(docs, terms)
    index = build_index(ids, y, rows, terms, df, documents)
    del rows
    place = {int(i): n for n, i in enumerate(index.ids)}

    def alone(index, ids, vectors):
        found = index.searched(vectors, [place[i] for i in ids.to_pylist()])
        votes = [index.vote(*f) if len(f[0]) else None for f in found]
        return pa.RecordBatch.from_arrays([ids, pa.array(votes, pa.float64())], ["doc_id", "vote"])

    shared = docs.sparkSession.sparkContext.broadcast(index)
    votes = _judged(texts.select("doc_id", "text"), shared, "doc_id long, vote double", alone).toArrow()
    shared.destroy()
    vote = np.full(len(index.ids), np.nan)
    vote[[place[i] for i in votes["doc_id"].to_pylist()]] = votes["vote"].to_numpy()
    inverse = [1 / min(1.0, most / max(1, size.get(label, 1))) for label, most in ((False, max_other), (True, max_positive))]
    return calibrate(index, vote, index.labels, np.array(inverse)[index.labels.astype(int)])


def score_toxicity(docs: DataFrame, index: BlockMaxIndex) -> DataFrame:
    """``doc_id``, ``score`` and ``evidence`` (nearest examples with label and similarity) of every row; no shuffle."""
    schema = "doc_id long, score double, evidence array<struct<doc_id:long,toxic:boolean,similarity:double>>"

    remembered: dict[bytes, tuple] = {}  # of a task: copies of a text are scored once

    def made(index, ids, vectors):
        names = [t.tobytes() + w.tobytes() for t, w in vectors]
        if len(remembered) >= REMEMBERED:
            remembered.clear()
        new = {name: v for name, v in zip(names, vectors) if name not in remembered}
        for name, found in zip(new, index.searched(list(new.values()))):
            remembered[name] = index.score(*found), *found[:2]
        rows = [remembered[name] for name in names]
        near = np.concatenate([r[1] for r in rows] or [np.zeros(0, dtype=np.int64)])
        evidence = pa.StructArray.from_arrays([pa.array(index.ids[near]), pa.array(index.labels[near] > 0), pa.array(np.concatenate([r[2] for r in rows] or [np.zeros(0)]))],
                                              ["doc_id", "toxic", "similarity"])
        ends = np.cumsum([0] + [len(r[1]) for r in rows])
        return pa.RecordBatch.from_arrays([ids, pa.array([r[0] for r in rows], pa.float64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), evidence)],
                                          ["doc_id", "score", "evidence"])

    shared = docs.sparkSession.sparkContext.broadcast(index)
    return _judged(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), shared, schema, made)
