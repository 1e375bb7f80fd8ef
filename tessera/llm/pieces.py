"""SentencePiece encoding and decoding by a batched numpy Viterbi.

A text becomes words: a run of spaces with what follows up to the next space; pieces
never cross words.  Distinct words of one length advance together, a position at a
time.  Hashes of the substrings that end at the position probe the sorted keys of the
pieces; a piece is admissible after the path that ends where it begins; the maximum over
the admissible pieces is stored as the backpointer.

The models that come with this machine are of the BPE type, whose result is not the path
of the greatest sum of scores.  For them a path is admissible if each pair of successive
pieces is what merging its characters by rank would leave apart; by the locality of
merges there is then exactly one path, and it is the encoding that merging gives.  For
unigram models the sum of the scores decides.  Characters without a piece fall back to
their bytes.  Words longer than a window are cut into windows that advance together like
words of equal length, and are joined where their paths agree.

Defined results: a null text has null ids; an empty text has none; decoding returns the
text as it was, but for U+2581, which stands for a space in these models.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkit as tk
from tessera.llm.blocks import lean

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: What an encoder holds at most: words whose ids it keeps, words that wait, characters of a Viterbi.
CACHE_WORDS = 1 << 20
_WAIT = 1 << 17
_CELLS = 1 << 18
_ROWS = 4096
_SLICE = 1 << 18
WINDOW = 128
_BASE = np.uint64(0xD6E8FEB86659FD93)
_NEVER = np.iinfo(np.int64).max


@dataclass
class PieceModel:
    keys: np.ndarray  # sorted hashes of the pieces
    key_ids: np.ndarray
    scores: np.ndarray
    rank: np.ndarray  # merge order; 0 for single characters
    left: np.ndarray  # the halves of the last merge of a piece, or itself
    right: np.ndarray
    pair_keys: np.ndarray  # sorted left * size + right of the pairs that merge
    pair_ids: np.ndarray
    byte_ids: np.ndarray
    out_bytes: np.ndarray  # what each id decodes to
    out_offsets: np.ndarray
    longest: int
    bpe: bool
    seen: np.ndarray  # by the top 20 bits of a hash: whether a piece has them
    pair_seen: np.ndarray | None = None  # the same for the pairs

    @property
    def size(self) -> int:
        return len(self.scores)


def _hash(codes: np.ndarray) -> np.uint64:
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for c in codes:
            h = h * _BASE + tk.mix(np.uint64(c) + np.uint64(1))
    return h


def merge_word(word: str, merges: dict[str, tuple[int, int]]) -> tuple[list[str], tuple[str, str] | None]:
    """(pieces, halves of the last merge) of merging the best pair, leftmost first, until none is left.

    Only the pieces of a model go through it, when its tables are made.
    """
    parts, last = list(word), None
    while True:
        best = min(((merges[a + b][0], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in merges), default=None)
        if best is None:
            return parts, last
        i = best[1]
        last = (parts[i], parts[i + 1])
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@lru_cache(maxsize=2)
def load(path: str = MODEL, bpe: bool = True) -> PieceModel:
    """The tables of a model file; ``bpe`` tells the model's type."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    text = [sp.id_to_piece(i) for i in range(n)]
    scores = np.array([sp.get_score(i) for i in range(n)])
    plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    byte_ids = np.full(256, -1, np.int64)
    for i in range(n):
        if sp.is_byte(i):
            byte_ids[int(text[i][3:5], 16)] = i
    order = sorted((i for i in plain if len(text[i]) > 1), key=lambda i: (-scores[i], i))
    ranks, at, before = {}, 0, None
    for i in order:
        at += scores[i] != before
        before = scores[i]
        ranks[text[i]] = (at, i)
    left, right = np.arange(n), np.arange(n)
    rank = np.zeros(n, np.int64)
    ids = {text[i]: i for i in plain}
    usable, pairs = [], []
    for i in plain:
        p = text[i]
        if len(p) == 1 or not bpe:
            usable.append(i)
            continue
        rank[i] = ranks[p][0]
        parts, last = merge_word(p, ranks)
        if len(parts) == 1 and last is not None and last[0] in ids and last[1] in ids:
            usable.append(i)
            left[i], right[i] = ids[last[0]], ids[last[1]]
        for k in range(1, len(p)):
            if p[:k] in ids and p[k:] in ids:
                pairs.append((ids[p[:k]] * n + ids[p[k:]], i))
    keys = np.array([_hash(np.frombuffer(text[i].encode("utf-32-le"), np.uint32)) for i in usable], np.uint64)
    o = np.argsort(keys)
    pairs.sort()
    out = []
    for i in range(n):
        b = bytes([int(text[i][3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else b" \xe2\x81\x87 " if sp.is_unknown(i) else text[i].replace(MARK, " ").encode()
        out.append(b)
    pair_keys = np.array([k for k, _ in pairs], np.int64)
    pair_seen = np.zeros(1 << 20, bool)
    pair_seen[_slot(pair_keys)] = True
    return PieceModel(keys[o], np.array(usable)[o], scores, rank, left, right, pair_keys, np.array([i for _, i in pairs], np.int64), byte_ids, np.frombuffer(b"".join(out), np.uint8), np.r_[0, np.cumsum([len(b) for b in out])].astype(np.int64), max((len(text[i]) for i in usable), default=1), bpe, _seen(keys), pair_seen)


def _seen(keys: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 20, bool)
    out[(keys >> np.uint64(64 - 20)).astype(np.int64)] = True
    return out


def _slot(pairs: np.ndarray) -> np.ndarray:
    """Where ``pair_seen`` says whether a pair may merge."""
    return (pairs.view(np.uint64) * _BASE) >> np.uint64(64 - 20)


def _find(sorted_keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The value of each wanted key, or -1."""
    if not len(sorted_keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == wanted, values[at], -1)


def apart(model: PieceModel, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether merging leaves each pair of pieces apart; ids from ``size`` on are single unknown characters.

    The merge that would join them is looked for at the pair's seam, undoing the later of
    the two pieces' last merges at each step.
    """
    n = model.size
    result = np.ones(len(a), bool)
    live = np.flatnonzero((a < n) & (b < n))
    x, y = a[live], b[live]
    limit = np.full(len(live), _NEVER)
    while len(live):
        key = x * n + y
        stop = np.zeros(len(live), bool)
        maybe = np.flatnonzero(model.pair_seen[_slot(key)])
        if len(maybe):
            joined = _find(model.pair_keys, model.pair_ids, key[maybe])
            stop[maybe] = (joined >= 0) & (model.rank[joined] < limit[maybe])
            result[live[stop]] = False
        rx, ry = model.rank[x], model.rank[y]
        go = np.flatnonzero(~stop & ((rx | ry) != 0))
        live, x, y, rx, ry = live[go], x[go], y[go], rx[go], ry[go]
        # the piece merged later is undone; at the seam a tie goes to the left pair
        later = rx > ry
        limit = np.where(later, rx, ry + 1)
        x, y = np.where(later, model.right[x], x), np.where(later, y, model.left[y])
    return result


def viterbi(model: PieceModel, codes: np.ndarray, seed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(piece ending, its start) at each end of a piece for words of one length, (words, length + 1).

    Characters without a piece have the id ``size`` plus their code point.  ``seed`` holds
    the pieces that end after the first ``longest`` characters, where these belong to what
    came before; the path then goes on from there (BPE only).
    """
    m, length = codes.shape
    mixed = tk.mix(codes.astype(np.uint64) + np.uint64(1))
    power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(length, _BASE, np.uint64)])
    prefix = np.zeros((m, length + 1), np.uint64)
    for i in range(length):
        prefix[:, i + 1] = prefix[:, i] * _BASE + mixed[:, i]
    piece = np.full((m, length + 1), -1, np.int32)
    back = np.zeros((m, length + 1), np.int32)
    first = 1
    if seed is not None:
        first = seed.shape[1] + 1
        piece[:, 1:first] = seed
    best = None
    if not model.bpe:
        best = np.full((m, length + 1), -np.inf)
        best[:, 0] = 0
    every = np.arange(m)
    for end in range(first, length + 1):
        for size in range(min(model.longest, end - (first > 1)), 0, -1):
            start = end - size
            rows = every[piece[:, end] < 0] if model.bpe else np.flatnonzero(best[:, start] > -np.inf)
            if not len(rows):
                continue
            wanted = prefix[rows, end] - prefix[rows, start] * power[size]
            if size == 1:
                found = _find(model.keys, model.key_ids, wanted)
                found = np.where(found < 0, model.size + codes[rows, start].astype(np.int64), found)
            else:
                maybe = model.seen[(wanted >> np.uint64(64 - 20)).astype(np.int64)]
                rows = rows[maybe]
                if not len(rows):
                    continue
                found = _find(model.keys, model.key_ids, wanted[maybe])
                rows, found = rows[found >= 0], found[found >= 0]
            if not len(rows):
                continue
            if model.bpe:
                if start:
                    fits = apart(model, piece[rows, start].astype(np.int64), found)
                    rows, found = rows[fits], found[fits]
            else:
                known = found < model.size
                value = best[rows, start] + np.where(known, model.scores[np.where(known, found, 0)], model.scores.min() - 10)
                more = value > best[rows, end]
                rows, found = rows[more], found[more]
                best[rows, end] = value[more]
            piece[rows, end], back[rows, end] = found, start
    return piece, back


def _trace(piece: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place from the end, piece) of the paths' pieces."""
    at = np.full(len(piece), piece.shape[1] - 1)
    rows, steps, found = [], [], []
    live, step = np.arange(len(piece)), 0
    while len(live):
        rows.append(live)
        steps.append(np.full(len(live), step))
        found.append(piece[live, at[live]])
        at[live] = back[live, at[live]]
        live = live[at[live] > 0]
        step += 1
    return np.concatenate(rows), np.concatenate(steps), np.concatenate(found)


def windowed(model: PieceModel, word: np.ndarray) -> np.ndarray:
    """The pieces of one word of more than ``WINDOW`` characters, by the Viterbi over its windows.

    Whether a piece may end somewhere depends on the pieces that end at the ``longest``
    characters before alone.  All windows advance together, each from a little before its
    beginning as if a word began there.  Where a window agrees with its predecessor on
    ``longest`` ends in a row, it agrees from there on; where it doesn't, it is done again
    from its predecessor's state.
    """
    n, v = len(word), model.longest
    width, lead = max(WINDOW, 2 * v), v + v // 2
    piece, back = np.full(n + 1, -1, np.int32), np.zeros(n + 1, np.int32)
    head, head_back = viterbi(model, word[None, :width])
    piece[: head.shape[1]], back[: head.shape[1]] = head[0], head_back[0]
    starts = np.arange(width, n, width)
    step = max(1, _CELLS // (lead + width))
    done: dict[tuple[bytes, bytes], tuple[np.ndarray, np.ndarray]] = {}
    for k in range(0, len(starts), step):
        part = starts[k : k + step]
        full = part[part + width <= n]
        tables = list(zip(*viterbi(model, word[full[:, None] - lead + np.arange(lead + width)]))) if len(full) else []
        for i, at in enumerate(part.tolist()):
            end = min(at + width, n)
            if i < len(tables) and (tables[i][0][lead - v + 1 : lead + 1] == piece[at - v + 1 : at + 1]).all():
                piece[at + 1 : end + 1] = tables[i][0][lead + 1 :]
                back[at + 1 : end + 1] = tables[i][1][lead + 1 :] + (at - lead)
            else:
                state = (word[at - v : end].tobytes(), piece[at - v + 1 : at + 1].tobytes())
                if state not in done:  # periodic words come to the same states again
                    done[state] = viterbi(model, word[None, at - v : end], piece[None, at - v + 1 : at + 1])
                again, again_back = done[state]
                piece[at + 1 : end + 1] = again[0, v + 1 :]
                back[at + 1 : end + 1] = again_back[0, v + 1 :] + (at - v)
    out, at, ids, from_ = [], n, piece.tolist(), back.tolist()
    while at:
        out.append(ids[at])
        at = from_[at]
    return np.array(out[::-1], np.int64)


def encode_words(model: PieceModel, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids of each word) of words given as code points one after another; spaces are marks."""
    begin = np.cumsum(lengths) - lengths
    long = (lengths > WINDOW) & model.bpe
    word, place, ids = [], [], []
    for length in np.unique(lengths[~long]):
        rows = np.flatnonzero((lengths == length) & ~long)
        step = max(1, _CELLS // int(length))
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            piece, back = viterbi(model, codes[begin[part][:, None] + np.arange(length)])
            r, s, found = _trace(piece, back)
            word.append(part[r].astype(np.int32))
            place.append((-s).astype(np.int32))
            ids.append(found)
    for w in np.flatnonzero(long):
        out = windowed(model, codes[begin[w] : begin[w] + lengths[w]])
        word.append(np.full(len(out), w, np.int32))
        place.append((np.arange(len(out)) - len(out)).astype(np.int32))
        ids.append(out.astype(np.int32))
    if not word:
        return np.zeros(0, np.int32), np.zeros(len(lengths), np.int64)
    word, place, ids = np.concatenate(word), np.concatenate(place), np.concatenate(ids)
    # by word, then by place: one key sorts faster than two, in less memory
    order = np.argsort(word.astype(np.int64) << 31 | place.astype(np.int64) + (1 << 30))
    del place
    word, ids = word[order], ids[order]
    unknown = np.flatnonzero(ids >= model.size)
    if len(unknown):  # unknown characters become their bytes
        parts = [list(chr(i - model.size).encode()) for i in ids[unknown].tolist()]
        many = np.ones(len(ids), np.int64)
        many[unknown] = [len(p) for p in parts]
        hit = np.repeat(ids >= model.size, many)
        word, ids = np.repeat(word, many), np.repeat(ids, many)
        ids[hit] = model.byte_ids[[b for p in parts for b in p]]
    return ids, np.bincount(word, minlength=len(lengths))


class Encoder:
    """Encodes slices of texts; a bounded store keeps the ids of words already met.

    ``learn`` collects the new words of many small slices, so that the Viterbi gets them
    in large batches while memory stays at that of a slice.
    """

    def __init__(self, model: PieceModel):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.names = np.zeros(0, np.uint64)  # sorted hashes of the words met
        self.slots = np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.int32)
        self.offset = np.zeros(1, np.int64)
        self._wait()

    def _wait(self) -> None:
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.asked: set[int] = set()

    def _slots(self, names: np.ndarray) -> np.ndarray:
        """The slot of each word, or -1."""
        return _find(self.names, self.slots, names)

    @staticmethod
    def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes with a space before each text that isn't empty, row offsets, begin and end of each word)."""
        n = np.diff(offsets)
        grown = np.insert(data, offsets[np.flatnonzero(n > 0)], np.uint8(32))
        offsets = np.r_[0, np.cumsum(n + (n > 0))]
        space = grown == 32
        start = space.copy()
        start[1:] &= ~space[:-1]
        start[offsets[:-1][n > 0]] = True
        begin = np.flatnonzero(start)
        return grown, offsets, begin, np.r_[begin[1:], len(grown)].astype(np.int64)[: len(begin)]

    def learn(self, data: np.ndarray, offsets: np.ndarray) -> None:
        grown, _, begin, end = self._words(data, offsets)
        if not len(begin):
            return
        if len(self.names) > 2 * CACHE_WORDS:
            self._clear()
        distinct, first = np.unique(tk.span_hashes(grown, begin, end), return_index=True)
        new = np.flatnonzero(self._slots(distinct) < 0)
        new = new[[x not in self.asked for x in distinct[new].tolist()]] if len(new) else new
        if len(new):
            self._ask(distinct[new], grown, begin[first[new]], end[first[new]])
        if len(self.asked) > _WAIT:
            self.settle()

    def _ask(self, names: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        size = end - begin
        self.waiting.append((names, size, data[np.repeat(begin, size) + tk.ranges(size)]))
        self.asked.update(names.tolist())

    def settle(self) -> None:
        """Encodes the words that wait."""
        if not self.waiting:
            return
        names, size, raw = (np.concatenate(x) for x in zip(*self.waiting))
        lead = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
        codes = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        codes = np.where(codes == 32, np.uint32(ord(MARK)), codes)
        ids, count = encode_words(self.model, codes, np.diff(lead[np.r_[0, np.cumsum(size)]]))
        made = np.arange(len(self.offset) - 1, len(self.offset) - 1 + len(names), dtype=np.int32)
        order = np.argsort(names)
        at = np.searchsorted(self.names, names[order])
        self.names, self.slots = np.insert(self.names, at, names[order]), np.insert(self.slots, at, made[order])
        self.offset = np.r_[self.offset, self.offset[-1] + np.cumsum(count)]
        self.flat = np.r_[self.flat, ids.astype(np.int32)]
        self._wait()

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids before each row) of a slice."""
        grown, offsets, begin, end = self._words(data, offsets)
        if not len(begin):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        self.settle()
        distinct, first, where = np.unique(tk.span_hashes(grown, begin, end), return_index=True, return_inverse=True)
        slots = self._slots(distinct)
        new = np.flatnonzero(slots < 0)
        if len(new):
            self._ask(distinct[new], grown, begin[first[new]], end[first[new]])
            self.settle()
            slots = self._slots(distinct)
        at = slots[where]
        count = self.offset[at + 1] - self.offset[at]
        ids = self.flat[np.repeat(self.offset[at], count) + tk.ranges(count)]
        before = np.r_[0, np.cumsum(count)]
        return ids, before[np.searchsorted(begin, offsets)]


def decode(model: PieceModel, ids: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of the texts of rows of ids; the space before each text is taken off."""
    size = model.out_offsets[ids + 1] - model.out_offsets[ids]
    data = model.out_bytes[np.repeat(model.out_offsets[ids], size) + tk.ranges(size)]
    offsets = np.r_[0, np.cumsum(size)][before]
    full = np.flatnonzero(np.diff(offsets) > 0)
    lead = full[data[offsets[full]] == 32]
    drop = np.zeros(len(offsets) - 1, np.int64)
    drop[lead] = 1
    return np.delete(data, offsets[lead]), offsets - np.r_[0, np.cumsum(drop)]


def encoded(docs: DataFrame, model: PieceModel, *more: str) -> DataFrame:
    """(doc_id, ids, n_ids, exact): the ids of each text, and whether decoding them gave the text back; then the columns ``more`` of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for batch in tk.parts(batches, _ROWS):
            raw = batch.column("text")
            texts = pc.replace_substring(raw, MARK, " ") if pc.any(pc.match_substring(raw, MARK)).as_py() else raw
            if len(encoder.names) > CACHE_WORDS:
                encoder = Encoder(model)
            for _, _, data, offsets in tk.slices(texts, _SLICE):
                encoder.learn(data, offsets)
            for i, j, data, offsets in tk.slices(texts, _SLICE):
                ids, before = encoder.encode(data, offsets)
                back, ends = decode(model, ids, before)
                same = len(back) == len(data) and bool((back == data).all()) and bool((ends == offsets).all())
                exact = np.full(j - i, True) if same else np.array([back[ends[k] : ends[k + 1]].tobytes() == data[offsets[k] : offsets[k + 1]].tobytes() for k in range(j - i)])
                valid = raw.slice(i, j - i).is_valid().to_numpy(zero_copy_only=False)
                lists = pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(ids, pa.int32()), mask=pa.array(~valid))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), lists, pa.array(np.diff(before), mask=~valid), pa.array(exact, mask=~valid), *[batch.column(c).slice(i, j - i) for c in more]], names=["doc_id", "ids", "n_ids", "exact", *more])

    lean(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
    kept = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in more)
    return rows.mapInArrow(tk.trimmed(run), f"doc_id long, ids array<int>, n_ids long, exact boolean{kept}")


def decoded(rows: DataFrame, model: PieceModel) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            valid = lists.is_valid().to_numpy(zero_copy_only=False)
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            ids = pc.list_flatten(lists).to_numpy()
            data, offsets = decode(model, ids, np.r_[0, np.cumsum(n)])
            raw = data.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") if v else None for a, b, v in zip(offsets[:-1], offsets[1:], valid)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
