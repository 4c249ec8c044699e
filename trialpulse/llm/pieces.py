"""SentencePiece encoding and decoding by Aho-Corasick and Viterbi (operator 6).

An automaton over the model's pieces reads a text once. At each byte the output
links name every piece that ends there, longest first; each relaxes the best
score of the position. Equal scores keep the longer last piece. A character that
no piece covers falls back to its bytes. The result is the segmentation with the
largest sum of piece scores, which is what a unigram model means by encoding; a
model of type BPE defines its own by merge order, so ids differ from that
library call (see README). Models are read that keep text as it is, have byte
fallback and no user-defined pieces; others are refused.

A long run without a space is cut where no piece can reach over: where no end of
the text so far is the beginning of a longer piece. Segments of it run side by
side, each from as many bytes before as the longest piece has, as the automaton's
state depends on no more.

White space never stands inside a piece but as a run or at its start, so texts
fall into units that segment alone; a batch's distinct units run side by side,
one numpy step a byte, and texts are put together from them.

Defined results: null or empty text has no pieces; a literal U+2581 decodes as
a space (round_trip is false).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .shared import frugal

MARK = "▁".encode()
#: A character outside the vocabulary scores this much under the worst piece.
UNKNOWN_PENALTY = 10
NORMAL, USER_DEFINED, BYTE = 1, 4, 6
#: Bytes from which a unit is cut, and of its segments.
LONG, STEP = 512, 256
_loaded: dict[str, Automaton] = {}


class Automaton:
    """Dense transitions over the bytes that pieces use; output links by piece length."""

    def __init__(self, pieces: list[tuple[bytes, int, float]], byte_ids: np.ndarray):
        """pieces: (bytes, id, score)."""
        used = sorted({b for p, _, _ in pieces for b in p})
        self.column = np.zeros(256, np.int64)
        self.column[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        pieces = sorted(pieces)
        length = np.array([len(p) for p, _, _ in pieces])
        text = np.zeros((len(pieces), length.max()), np.uint8)
        for i, (p, _, _) in enumerate(pieces):
            text[i, : len(p)] = np.frombuffer(p, np.uint8)
        state = np.zeros(len(pieces), np.int64)
        parents, bytes_, levels, count = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [0, 1], 1
        for d in range(text.shape[1]):  # a level of the trie at a time: equal prefixes are neighbours
            on = np.flatnonzero(length > d)
            code = state[on] * 256 + text[on, d]
            new, back = np.unique(code, return_inverse=True)
            state[on] = count + back
            parents.append(new // 256)
            bytes_.append(new % 256)
            count += len(new)
            levels.append(count)
        parent, byte = np.concatenate(parents), np.concatenate(bytes_)
        self.go = np.zeros((count, width), np.int32)
        fail = np.zeros(count, np.int64)
        piece = np.full(count, -1, np.int64)
        piece[state] = np.arange(len(pieces))
        self.link = np.zeros(count, np.int64)
        first = np.arange(1, levels[2]) if len(levels) > 2 else np.zeros(0, np.int64)
        self.go[0, self.column[byte[first]]] = first
        for d in range(1, len(levels) - 1):
            here = np.arange(levels[d], levels[d + 1])
            self.go[here] = self.go[fail[here]]
            self.link[here] = np.where(piece[fail[here]] >= 0, fail[here], self.link[fail[here]])
            if d + 2 < len(levels):
                below = np.arange(levels[d + 1], levels[d + 2])
                up, col = parent[below], self.column[byte[below]]
                fail[below] = self.go[fail[up], col]
                self.go[up, col] = below
        self.piece = piece
        # can a longer piece still come of what the state stands for?
        self.open = np.zeros(count, bool)
        inner = np.zeros(count, bool)
        inner[parent[1:]] = True
        for d in range(1, len(levels) - 1):
            here = np.arange(levels[d], levels[d + 1])
            self.open[here] = inner[here] | self.open[fail[here]]
        self.longest = int(length.max())
        self.size = np.append(length, 0)
        self.score = np.array([s for _, _, s in pieces] + [0], np.float64)
        self.id = np.array([i for _, i, _ in pieces] + [0], np.int64)
        self.byte_ids = byte_ids
        self.unknown = float(self.score[:-1].min()) - UNKNOWN_PENALTY

    def segment(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units in turn, where each unit's begin)."""
        if max(map(len, units), default=0) > LONG:
            parts, whole = [], [0]
            for u in units:
                parts += self._parts(u) if len(u) > LONG else [u]
                whole.append(len(parts))
            ids, first = self._segment(parts)
            return ids, first[whole]
        return self._segment(units)

    def _parts(self, unit: bytes) -> list[bytes]:
        """A unit cut where no piece reaches over, into parts of LONG bytes or more."""
        data = np.frombuffer(unit, np.uint8)
        starts = np.arange(0, len(data), STEP)
        state, closed = np.zeros(len(starts), np.int64), np.zeros(len(data), bool)
        for k in range(-self.longest, STEP):
            at = starts + k
            on = np.flatnonzero((at >= 0) & (at < len(data)))
            state[on] = self.go[state[on], self.column[data[at[on]]]]
            if k >= 0:
                closed[at[on]] = ~self.open[state[on]]
        cuts = np.flatnonzero(closed[:-1] & ((data[1:] & 0xC0) != 0x80)) + 1
        chosen, last = [0], 0
        while (i := int(np.searchsorted(cuts, last + LONG))) < len(cuts):
            last = int(cuts[i])
            chosen.append(last)
        return [unit[a:b] for a, b in zip(chosen, [*chosen[1:], len(unit)])]

    def _segment(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        n = np.array([len(u) for u in units], np.int64)
        order = np.argsort(n, kind="stable")
        ids: list = [None] * len(units)
        at = 0
        while at < len(order):
            longest = max(16, int(n[order[at]]))
            end = int(np.searchsorted(n[order], longest * 2, "left"))
            end = max(at + 1, min(end, at + max(1, (2 << 20) // (longest * 2))))
            for i, got in zip(order[at:end], self._batch([units[i] for i in order[at:end]], n[order[at:end]])):
                ids[i] = got
            at = end
        sizes = np.array([len(x) for x in ids], np.int64)
        return (np.concatenate(ids) if ids else np.zeros(0, np.int64)), np.concatenate(([0], np.cumsum(sizes)))

    def _batch(self, units: list[bytes], n: np.ndarray) -> list[np.ndarray]:
        rows, width = len(units), int(n.max(initial=0))
        text = np.zeros((rows, width), np.uint8)
        text[np.arange(width) < n[:, None]] = np.frombuffer(b"".join(units), np.uint8)
        best = np.full((width + 1, rows), -np.inf)
        best[0] = 0
        back = np.full((width + 1, rows), -1, np.int32)  # the last piece, or -2 - bytes of an unknown character
        state = np.zeros(rows, np.int64)
        start = np.zeros(rows, np.int64)  # of the character that the byte belongs to
        for j in range(width):
            byte = text[:, j]
            start[(byte & 0xC0) != 0x80] = j
            state = self.go[state, self.column[byte]].astype(np.int64)
            out = np.where(self.piece[state] >= 0, state, self.link[state])
            whole = np.zeros(rows, bool)  # does a piece equal the character?
            on = np.flatnonzero(out)
            while len(on):
                p = self.piece[out[on]]
                size = self.size[p]
                score = best[j + 1 - size, on] + self.score[p]
                better = score > best[j + 1, on]
                best[j + 1, on[better]] = score[better]
                back[j + 1, on[better]] = p[better]
                whole[on] |= j + 1 - size == start[on]
                out[on] = self.link[out[on]]
                on = on[out[on] > 0]
            last = np.ones(rows, bool) if j + 1 == width else (text[:, j + 1] & 0xC0) != 0x80
            lone = np.flatnonzero(last & ~whole & (j < n))
            if len(lone):
                score = best[start[lone], lone] + self.unknown
                better = score > best[j + 1, lone]
                best[j + 1, lone[better]] = score[better]
                back[j + 1, lone[better]] = -1 - (j + 1 - start[lone[better]])
        found, position, row = [], n.copy(), np.arange(rows)
        live = np.flatnonzero(position > 0)
        while len(live):
            b = back[position[live], live]
            known = b >= 0
            found.append((row[live], np.where(known, self.id[np.maximum(b, 0)], -position[live] - 1), np.where(known, 1, -1 - b)))
            position[live] -= np.where(known, self.size[np.maximum(b, 0)], -1 - b)
            live = live[position[live] > 0]
        if not found:
            return [np.zeros(0, np.int64)] * rows
        who, what, times = (np.concatenate([f[k] for f in found][::-1]) for k in range(3))
        order = np.argsort(who, kind="stable")
        who, what, times = who[order], what[order], times[order]
        flat = np.repeat(what, times)
        owner = np.repeat(who, times)
        gap = np.flatnonzero(flat < 0)
        if len(gap):  # the bytes of unknown characters
            inside = np.arange(len(flat)) - np.repeat(np.cumsum(times) - times, times)
            total = np.repeat(times, times)
            flat[gap] = self.byte_ids[text[owner[gap], -flat[gap] - 1 - total[gap] + inside[gap]]]
        return np.split(flat, np.searchsorted(owner, np.arange(1, rows)))


def load(path: str) -> tuple[Automaton, list[bytes]]:
    """The automaton of a model file, and each id's bytes for decoding."""
    if path not in _loaded:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spell = model.normalizer_spec
        if spell.precompiled_charsmap or not spell.add_dummy_prefix or spell.remove_extra_whitespaces or not spell.escape_whitespaces:
            raise ValueError("only models that keep text as it is, with a space in front, are read here")
        if any(p.type == USER_DEFINED for p in model.pieces) or not any(p.type == BYTE for p in model.pieces):
            raise ValueError("only models with byte fallback and without user-defined pieces are read here")
        pieces = [(p.piece.encode(), i, p.score) for i, p in enumerate(model.pieces) if p.type == NORMAL]
        byte_ids = np.zeros(256, np.int64)
        values = []
        for i, p in enumerate(model.pieces):
            values.append(p.piece.encode() if p.type == NORMAL else b"")
            if p.type == BYTE:
                b = int(p.piece[1:-1], 16)
                byte_ids[b] = i
                values[-1] = bytes([b])
        _loaded[path] = (Automaton(pieces, byte_ids), values)
    return _loaded[path]


def encode_batch(texts: list[str | None], path: str) -> list[np.ndarray]:
    """Ids of every text."""
    return [ids for ids, _ in _encode(texts, path)]


def _encode(texts: list[str | None], path: str):
    auto, values = load(path)
    units: dict[bytes, int] = {}
    rows = []
    for t in texts:
        if not t:
            rows.append([])
            continue
        raw = MARK + t.encode().replace(b" ", MARK)
        # a unit is a run of marks and what follows up to the next mark
        parts, row, lead = raw.split(MARK), [], 0
        if parts[0]:
            row.append(units.setdefault(parts[0], len(units)))
        for x in parts[1:]:
            lead += 1
            if x:
                row.append(units.setdefault(MARK * lead + x, len(units)))
                lead = 0
        if lead:
            row.append(units.setdefault(MARK * lead, len(units)))
        rows.append(row)
    names = list(units)
    flat, first = auto.segment(names)
    same = np.array([decode_ids(flat[first[i] : first[i + 1]], values) == names[i] for i in range(len(names))] + [True])
    for row in rows:
        r = np.array(row, np.int64)
        size = first[r + 1] - first[r]
        at = np.repeat(first[r], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        yield flat[at], bool(same[r].all())


def decode_ids(ids: np.ndarray, values: list[bytes]) -> bytes:
    """The pieces' bytes, marks not yet turned into spaces."""
    return b"".join([values[i] for i in np.asarray(ids).tolist()])


def decode(ids: np.ndarray, path: str) -> str:
    raw = decode_ids(ids, load(path)[1]).replace(MARK, b" ")
    return raw[1:].decode(errors="replace") if raw[:1] == b" " else raw.decode(errors="replace")


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (array<int>), round_trip: do the ids decode to the text?"""

    @K.tidy_batches
    def run(batches):
        for batch in K.regroup(batches, 4 << 20):
            texts = batch.column("text").to_pylist()
            at = 0
            while at < len(texts):  # a few MB at a time
                end, size = at, 0
                while end < len(texts) and (end == at or size < 4 << 20):
                    size += len(texts[end] or "")
                    end += 1
                got = list(_encode(texts[at:end], model))
                counts = np.array([len(i) for i, _ in got], np.int64)
                offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
                values = pa.array(np.concatenate([i for i, _ in got]).astype(np.int32))
                whole = [same and MARK.decode() not in (t or "") for t, (_, same) in zip(texts[at:end], got)]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(at, end - at), "n_tokens": counts, "ids": pa.ListArray.from_arrays(offsets, values), "round_trip": whole})
                at = end

    frugal(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decode_column(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text from doc_id and ids."""

    @K.tidy_batches
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": [None if i is None else decode(np.array(i, np.int64), model) for i in batch.column("ids").to_pylist()]})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
