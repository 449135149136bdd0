"""Operator 4: best-fit packing by the sum-of-squares rule.

Texts become token ids, long ones are cut, and the pieces are packed into
sequences of ``capacity`` tokens. A piece goes where the squared counts of open
sequences per residual gap become smallest; ties prefer the smaller gap.

Pieces are packed in chunks of bounded size, each in one task, longest first.
Of the sequences a chunk could not fill, the emptiest that may dissolve into the
gaps of others, and as many others as can take their pieces, are packed again
with those of other chunks; the rest stay as they are. Rounds end when one chunk
held all of them, or when no sequence can be saved or none was. No task holds
more than a chunk in any round. A chunk should fill many sequences: where even
its shortest pieces fill few, each chunk may leave one open.

Tokenising is exact and word-wise: the pre-tokeniser's pieces are found with
vectorised rules, each distinct one is encoded once by the tokenizer library
and remembered, and the ids of a text are gathered from there.

Defined cases: a null text counts as empty and is the single end-of-text id;
repeated rows are packed separately (``row`` tells them apart); very long texts
are cut after they were tokenised as a whole; an empty table
gives no rows; columns besides ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release_memory, save, span_hashes

CAPACITY = 2048
END_ID = 0
#: Pieces packed in one task at most, and the largest share of a round's pieces that may be packed again.
CHUNK, AGAIN = 60_000, 0.875
#: Bits of a sequence number for the place in its chunk, and for the chunk in its round.
_BIN_BITS, _CHUNK_BITS = 17, 38
#: Code points tokenised at a time, and distinct pre-tokens remembered by a worker.
STRIDE, REMEMBERED = 1 << 20, 600_000

_CLASSES: list[np.ndarray] = []
_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3


def _char_classes() -> np.ndarray:
    """Class of every code point, from the Unicode properties the pre-tokeniser uses."""
    if not _CLASSES:
        import regex

        table = np.zeros(0x110000, dtype=np.uint8)
        for start in range(0, 0x110000, 0x8000):
            chars = "".join(map(chr, (c for c in range(start, min(start + 0x8000, 0x110000)) if not 0xD800 <= c < 0xE000)))
            for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
                for m in regex.finditer(pattern, chars):
                    a, b = ord(chars[m.start()]), ord(chars[m.end() - 1]) + 1
                    table[a:b] = kind
        table[0xD800:0xE000] = _OTHER
        _CLASSES.append(table)
    return _CLASSES[0]


_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def pretoken_starts(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of the texts ``codes[bounds[i]:bounds[i + 1]]``, given as code points.

    Runs of letters, of numbers and of other signs each take one space before
    them; a space run leaves its last character to what follows in its text; an
    apostrophe run of one, not after a space it takes, splits off a contraction.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kind = _char_classes()[codes]
    is_start = np.ones(n + 1, dtype=bool)
    np.not_equal(kind[1:], kind[:-1], out=is_start[1:n])
    is_start[bounds] = True
    run = np.flatnonzero(is_start[:n])
    run_kind = kind[run]
    run_end = np.append(run[1:], n)
    ends_text = np.zeros(n + 1, dtype=bool)
    ends_text[bounds] = True
    joins = ~ends_text[run_end]  # the next run belongs to the same text
    # the last character of a space run that something follows
    followed = np.flatnonzero((run_kind == _SPACE) & joins)
    last = run_end[followed] - 1
    is_start[last] = True
    is_start[run_end[followed][codes[last] == 32]] = False
    # contractions
    after = np.append(run_kind[1:], _SPACE)
    for q in np.flatnonzero((codes[run] == 39) & (run_end - run == 1) & joins & (after == _LETTER)).tolist():
        at, stop = int(run[q]), int(run_end[q + 1])
        if not is_start[at]:
            continue  # the space before took it
        letters = "".join(map(chr, codes[at + 1: min(at + 3, stop)]))
        for c in _CONTRACTIONS:
            if letters.startswith(c):
                is_start[at + 1] = False
                is_start[at + 1 + len(c)] |= at + 1 + len(c) < stop
                break
    return np.flatnonzero(is_start[:n])


def _rank_encoder(tokenizer):
    """Encoder of single pre-tokens by rank, or None if the file's ids aren't its merge ranks.

    In a byte-level vocabulary whose ids follow the order of its merges,
    merging by id is what the tokenizer itself does, and several times faster.
    """
    import json

    from tokenizers import pre_tokenizers

    spec = json.loads(tokenizer.to_str())
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    vocab, merges = model.get("vocab"), model.get("merges")
    plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer")
    if not plain or any(vocab["".join(m)] != 256 + i for i, m in enumerate(m if isinstance(m, list) else m.split(" ") for m in merges)):
        return None
    import tiktoken

    shown = sorted(pre_tokenizers.ByteLevel.alphabet())  # signs that stand for the 256 bytes: printable ones for themselves
    own = [c for c in shown if ord(c) < 256]
    rest = [c for c in shown if ord(c) >= 256]
    byte_of = {c: ord(c) for c in own} | dict(zip(rest, (b for b in range(256) if chr(b) not in set(own))))
    added = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in added}
    return tiktoken.Encoding("by-rank", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class WordTokenizer:
    """Token ids of whole texts, each distinct pre-token encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.by_rank = _rank_encoder(self.tokenizer)
        self.clear()

    def clear(self) -> None:
        """Forget all pre-tokens."""
        self.place: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, dtype=np.int32)
        self.begin = np.zeros(1 << 16, dtype=np.int64)  # of pre-token i; i + 1 has its end

    def _learn(self, words: list[str]) -> None:
        if self.by_rank:
            encode = self.by_rank
            encoded = [encode(w.encode("utf-8", "surrogatepass")) for w in words]
        else:
            encoded = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        known = len(self.place)
        at = self.begin[known]
        flat = np.fromiter(itertools.chain.from_iterable(encoded), dtype=np.int32)
        while at + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while known + len(words) >= len(self.begin):
            self.begin = np.concatenate((self.begin, np.zeros_like(self.begin)))
        self.ids[at: at + len(flat)] = flat
        self.begin[known + 1: known + 1 + len(words)] = at + np.cumsum(np.fromiter(map(len, encoded), dtype=np.int64))
        self.place.update(zip(words, range(known, known + len(words))))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """int32 ids of each text; texts are joined up to :data:`STRIDE` code points for speed."""
        out: list[np.ndarray] = []
        group, size = [], 0
        for text in texts:
            if group and size + len(text) > STRIDE:
                out += self._encode_group(group)
                group, size = [], 0
            group.append(text)
            size += len(text)
        return out + (self._encode_group(group) if group else [])

    def _encode_group(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.place) > REMEMBERED:
            self.clear()
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        bounds = np.cumsum([0, *map(len, texts)])
        starts = pretoken_starts(codes, bounds)
        if not len(starts):
            return [np.zeros(0, dtype=np.int32) for _ in texts]
        ends = np.append(starts[1:], len(codes))
        _, first, inverse = np.unique(span_hashes(codes, starts, ends), return_index=True, return_inverse=True)
        words = [joined[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        if new := [w for w in words if w not in self.place]:
            self._learn(list(dict.fromkeys(new)))
        place = np.fromiter(map(self.place.__getitem__, words), dtype=np.int64, count=len(words))
        begin, stop = self.begin[place], self.begin[place + 1]
        count = (stop - begin)[inverse]
        cum = np.concatenate(([0], np.cumsum(count)))
        at = np.repeat(begin[inverse] - cum[:-1], count)
        at += np.arange(cum[-1])
        ids = self.ids[at]
        cut = cum[np.searchsorted(starts, bounds)].tolist()
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:])]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def piece_bounds(total: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``total`` ids; only the first may be shorter."""
    first = total % capacity or min(capacity, total)
    cuts = [0, *range(first, total + 1, capacity)]
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:])]


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Pieces of every row of ``docs``: doc_id, row, piece, start, length, ids_crc32 and, on demand, ids.

    ``row`` numbers the rows (any distinct numbers). The ids of a text are
    those of the tokenizer file, without special tokens, then :data:`END_ID`.
    """
    fields = [("doc_id", pa.int64()), ("row", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
              ("length", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.list_(pa.int32()))] * keep_ids

    def run(batches):
        tokenizer = _tokenizer(tokenizer_path)
        for batch in batches:
            columns: list[list] = [[] for _ in fields]
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, row, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), tokenizer.encode(texts)):
                ids = np.append(ids, np.int32(END_ID)).astype("<i4")
                for piece, (start, length) in enumerate(piece_bounds(len(ids), capacity)):
                    part = ids[start: start + length]
                    for column, value in zip(columns, (doc_id, row, piece, start, length, zlib.crc32(part.tobytes()), part)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])
        tokenizer.clear()  # the worker lives on and serves other tasks
        release_memory()

    schema = "doc_id long, row long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    numbered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.monotonically_increasing_id().alias("row"))
    return numbered.mapInArrow(run, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, packed in the given order by the sum-of-squares rule.

    With N(g) open bins of gap g, putting a piece of length s into a bin of gap
    g changes the sum of N squared by 2 (N(g - s) - N(g)) + 2, or by one half of
    that where a bin is opened or filled up.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)
    bins_of: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    bins = 0
    for i, s in enumerate(lengths.tolist()):
        gap = -1
        if s < capacity:
            held = count[s:]
            change = 2 * (count[: capacity + 1 - s] - held) + 2
            change[0] = -2 * held[0] + 1  # fills the bin
            change[held == 0] = np.iinfo(np.int64).max
            best = int(change.argmin())
            opening = 2 * count[capacity - s] + 1
            if change[best] <= opening:
                gap = s + best
        if gap < 0:
            name, gap = bins, capacity
            bins += 1
        else:
            name = bins_of[gap].pop()
            count[gap] -= 1
        out[i], offset[i] = name, capacity - gap
        gap -= s
        if gap:
            count[gap] += 1
            bins_of[gap].append(name)
    return out, offset


def _pack_chunks(pieces: DataFrame, chunks: int, level: int, capacity: int) -> DataFrame:
    """``pieces`` dealt to ``chunks`` by a hash and packed there; adds bin, offset, and gap and longest piece of the bin."""
    schema = pieces.schema.add("bin", "long").add("offset", "long").add("gap", "integer").add("longest", "integer")

    def run(key, table):
        lengths = table["length"].to_numpy()
        order = np.lexsort((table["piece"].to_numpy(), table["row"].to_numpy(), -lengths))
        where, offset = np.empty(len(order), dtype=np.int64), np.empty(len(order), dtype=np.int64)
        where[order], offset[order] = sum_of_squares(lengths[order], capacity)
        gap = capacity - np.bincount(where, lengths)
        longest = np.zeros(len(gap))
        np.maximum.at(longest, where, lengths)
        names = pa.array(where + (((level << _CHUNK_BITS) + key[0].as_py()) << _BIN_BITS))
        added = {"bin": names, "offset": pa.array(offset), "gap": pa.array(gap[where].astype(np.int32)), "longest": pa.array(longest[where].astype(np.int32))}
        table = table.drop_columns("chunk")
        for name, column in added.items():
            table = table.append_column(name, column)
        return table

    dealt = pieces.withColumn("chunk", F.pmod(F.xxhash64("row", "piece", F.lit(f"{level}")), F.lit(chunks)).cast("long"))
    return dealt.groupBy("chunk").applyInArrow(run, schema)


def _histogram(df: DataFrame, of: str, capacity: int) -> np.ndarray:
    """Rows of ``df`` by ``of``, which is at most ``capacity``."""
    out = np.zeros(capacity + 1, dtype=np.int64)
    for value, n in df.groupBy(of).count().collect():  # one row a length
        out[value] = n
    return out


def _drawn(wanted: np.ndarray, have: np.ndarray, salt: str) -> Column:
    """Condition that keeps about ``wanted[g]`` of the ``have[g]`` bins of gap g, with near certainty not fewer."""
    share = np.where(wanted > 0, np.minimum(1, (wanted + 6 * np.sqrt(wanted) + 12) / np.maximum(have, 1)), 0)
    return F.pmod(F.xxhash64("bin", F.lit(salt)), F.lit(1 << 30)) < F.get(F.lit((share * (1 << 30)).tolist()), F.col("gap"))


def _worth_packing_again(placed: DataFrame, capacity: int) -> Column | None:
    """Condition on the bins that another round may need, or None if it cannot save a sequence.

    Gaps of ``room`` tokens save ``room // capacity`` sequences at most. Donors
    are so many of the emptiest bins whose pieces all fit some gap. Bins of gap
    up to g can't take more than the donors' pieces of length up to g; twice
    that many receivers are kept for the packer to choose from.
    """
    bins = placed.where("offset = 0 and gap > 0")
    gaps = _histogram(bins, "gap", capacity)
    most = int((gaps * np.arange(capacity + 1)).sum()) // capacity
    if not most:
        return None
    may_go = F.col("longest") <= int(np.flatnonzero(gaps)[-1])
    have = _histogram(bins.where(may_go), "gap", capacity)
    above = np.cumsum(have[::-1])[::-1] - have
    donor = (F.col("gap") > 0) & may_go & _drawn(np.clip(most - above, 0, have), have, "donor")
    takes = 2 * np.cumsum(_histogram(placed.where(donor), "length", capacity))
    if not takes[-1]:
        return None
    have, wanted, used = _histogram(bins.where(~donor), "gap", capacity), np.zeros(capacity + 1, dtype=np.int64), 0
    for g in range(1, capacity):
        wanted[g] = min(have[g], takes[g] - used)
        used += wanted[g]
    return donor | ((F.col("gap") > 0) & _drawn(wanted, have, "receiver"))


def pack(pieces: DataFrame, capacity: int = CAPACITY, chunk: int = CHUNK) -> DataFrame:
    """``pieces`` (row, piece, length, ...) with ``sequence_id`` and ``offset`` added.

    Full pieces are sequences of their own. The others are dealt to chunks of
    at most ``chunk`` rows by a hash and packed; what another round may improve
    is dealt anew, and keeps its places if that saves no sequence. A sequence is
    numbered by its round, chunk and place there, or from -1 down if it is one piece.
    """
    if not 0 < chunk <= 1 << _BIN_BITS:
        raise ValueError(f"a chunk has 1 to {1 << _BIN_BITS} pieces")
    keys = pieces.columns
    full = pieces.where(F.col("length") == capacity).select(
        *keys, (-1 - F.monotonically_increasing_id()).alias("bin"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity)
    done, level, before, n_before = [], 0, None, 0
    todo = rest.count()
    mean = max(1, int(chunk - 6 * chunk ** 0.5))  # chunks are even up to chance
    while True:
        chunks = 1 if todo <= chunk else -(-todo // mean)
        placed = save(_pack_chunks(rest, chunks, level, capacity), "pack")
        if before is not None and placed.where("offset = 0").count() >= n_before:
            done.append(before)
            break
        again = _worth_packing_again(placed, capacity) if chunks > 1 else None
        if again is None:
            done.append(placed)
            break
        before = placed.where(again)
        left = before.count()
        if left > AGAIN * todo:  # chunks are alike, and most of their sequences can't be filled: others do not help
            done.append(placed)
            break
        done.append(placed.where(~again))
        n_before = before.where("offset = 0").count()
        rest, todo, level = before.select(*keys), left, level + 1
    out = full
    for part in done:
        out = out.unionByName(part.drop("gap", "longest"))
    return out.withColumnRenamed("bin", "sequence_id")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Tokenise, cut and pack ``docs``; one row per piece with its sequence and place there."""
    pieces = save(tokenize_pieces(docs, tokenizer_path, capacity, keep_ids), "pieces")
    return pack(pieces, capacity)
