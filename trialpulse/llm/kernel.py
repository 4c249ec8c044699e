"""Vectorised byte and word primitives that run inside Spark tasks.

Every function works on one slice of texts at a time: one flat ``uint8`` array
and document offsets, as Arrow lays strings out. A hash is a pair of polynomials
modulo two primes just below 2^32, each with a random base of its own, finished
with an avalanche step; the hash of any substring comes from prefix sums. A
second pair of bases (``seed`` 1) gives names of 128 bits. Where the bytes behind
equal hashes lie in one task, told_apart() compares them.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACE = bytes([0x20, *range(0x09, 0x0E)])


def _splitmix(n: int, seed: int) -> np.ndarray:
    z = (np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15)) + U(seed)
    return mix(z)


def mix(z: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (a bijection)."""
    z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
    return z ^ (z >> U(31))


BYTE = _splitmix(256, 12345)
GRAM = U(0xD1342543DE82EF95)
#: The two largest primes below 2^32, and a pair of bases for each seed.
PRIMES = (4294967291, 4294967279)
BASES = tuple(tuple(int(x) % (p - 2) + 2 for x, p in zip(_splitmix(2, seed), PRIMES)) for seed in (2718281828, 3141592653))
_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, p: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo p; kept, and grown by doubling."""
    have = _powers.get((base, p))
    if have is None:
        have = np.ones(1, np.uint32)
    while len(have) < max(n, 1 << 16):
        have = np.concatenate((have, (have.astype(U) * U(pow(base, len(have), p)) % U(p)).astype(np.uint32)))
    _powers[base, p] = have
    return have[:n]


def flat(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays([c.cast(pa.large_string()) for c in texts.chunks]) if texts.num_chunks else pa.array([], pa.large_string())
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    n = len(texts)
    _, offs, data = texts.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def settle() -> None:
    """Give freed memory back to the system: idle Python workers live as long as their executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(f: Callable) -> Callable:
    """A function of a group, or of two that meet, that settles when it is done. Spark counts the parameters."""

    def one(key, table):
        try:
            return f(key, table)
        finally:
            settle()

    def two(key, table, answers):
        try:
            return f(key, table, answers)
        finally:
            settle()

    return one if f.__code__.co_argcount == 2 else two


def tidy_batches(f: Callable) -> Callable:
    @wraps(f)
    def batches(it):
        try:
            yield from f(it)
        finally:
            settle()

    return batches


def regroup(batches: Iterator[pa.RecordBatch], size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches put together to about ``size`` bytes each."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.nbytes
        if total >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, total = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


#: A slice of texts in bytes; a little under a power of two, as tables of powers are rounded up to one.
SLICE = (2 << 20) - 64


def slices(offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes (at least one document each)."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end
        at = end


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def fold(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return _FOLD[data]


def _separators(chars: bytes) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(chars)] = False
    return table


_WORD = _separators(SPACE)


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of every maximal run of word bytes, and words before each document (n+1 entries). Words never cross documents."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
    after = np.concatenate((inside[1:], [False])) & ~edge[1:]
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, offsets)


#: Values of which prefix_hash() adds products up before it takes a remainder: 2^20 products below 2^40 stay below 2^64.
_STRIDE = 1 << 20


def prefix_hash(data: np.ndarray, seed: int = 0) -> np.ndarray:
    """Prefix sums, a row for each prime, from which span_hash() takes any run's hash. ``data``: bytes, or 64-bit names."""
    n = len(data)
    out = np.zeros((2, n + 1), U)
    for row, base, p, half in zip(out, BASES[seed], PRIMES, (U(32), U(0))):
        power, carry = powers(base, p, n), U(0)
        for a in range(0, n, _STRIDE):
            part = data[a : a + _STRIDE]
            if part.dtype == np.uint8:
                part = np.multiply(part, power[a : a + _STRIDE], dtype=U)
            else:
                part = ((part >> half) & U(0xFFFFFFFF)) * power[a : a + _STRIDE] % U(p)
            here = row[a + 1 : a + 1 + len(part)]
            np.cumsum(part, out=here)
            here += carry
            carry = here[-1] % U(p)
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each run; equal values give equal hashes wherever they stand."""
    out = (end - start).astype(U) * U(0x9E3779B97F4A7C15)
    for row, base, p, half in zip(prefix, BASES[seed], PRIMES, (U(32), U(0))):
        gap = row[end] % U(p) + U(p) - row[start] % U(p)
        out += (gap % U(p)) * powers(pow(base, -1, p), p, len(row))[start] % U(p) << half
    return mix(out)


def rolling(data: np.ndarray, k: int) -> np.ndarray:
    """A quick hash of every k consecutive bytes or names, modulo 2^64: to choose places by, or to bring together what is then compared. Nothing else may hang on it."""
    n = max(0, len(data) - k + 1)
    out, have = np.zeros(n, U), 0
    run, width, factor = BYTE[data] if data.dtype == np.uint8 else data, 1, int(GRAM)
    while n and width <= k:
        if k & width:
            out = out * U(factor) + run[have : have + n]
            have += width
        if 2 * width <= k:
            run = run[:-width] * U(factor) + run[width:]
        width, factor = 2 * width, factor * factor % (1 << 64)
    return mix(out)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, zeros after the end."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate((data, np.zeros(8, np.uint8))), 8)


def told_apart(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The hashes of these byte runs, changed where runs of one hash differ: afterwards equal names mean equal bytes."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    new = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
    heads = np.flatnonzero(new)
    odd = []
    windows = _eights(data)
    for at in range(0, len(heads), 1 << 18):
        some = heads[at : at + (1 << 18)]
        stop = heads[at + (1 << 18)] if at + (1 << 18) < len(heads) else len(order)
        for a in range(some[0], stop, 1 << 18):
            place = np.arange(a, min(stop, a + (1 << 18)))
            place = place[~new[place]]
            first = order[heads[np.searchsorted(heads, place, "right") - 1]]
            odd.append(place[_differ(windows, data, start, end, order[place], first)])
    odd = np.concatenate(odd) if odd else heads[:0]
    if not len(odd):
        return hashes
    out = hashes.copy()
    for value in np.unique(h[odd]).tolist():
        names: dict[bytes, int] = {}
        for i in order[np.searchsorted(h, U(value)) : np.searchsorted(h, U(value), "right")].tolist():
            out[i] = mix(np.array([value + names.setdefault(data[start[i] : end[i]].tobytes(), len(names))], U))[0]
    return out


def _differ(windows: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Do the byte runs x[i] and y[i] differ? Eight bytes of all at a time; long runs one by one."""
    size = end[x] - start[x]
    differ = size != end[y] - start[y]
    left = np.flatnonzero(~differ & (size > 0))
    for i in left[size[left] > 64].tolist():
        differ[i] = not np.array_equal(data[start[x[i]] : end[x[i]]], data[start[y[i]] : end[y[i]]])
    left, done = left[size[left] <= 64], 0
    while len(left):
        a, b = (np.ascontiguousarray(windows[start[z[left]] + done]).view("<u8").ravel() for z in (x, y))
        unused = U(8) * (U(8) - np.minimum(size[left] - done, 8).astype(U))
        differ[left] |= (a << unused) != (b << unused)
        done += 8
        left = left[(size[left] > done) & ~differ[left]]
    return differ


#: Bytes up to which a word's name holds the word itself.
SHORT = 7


def word_names(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit names of words: of up to SHORT bytes an invertible mix of bytes and length, of longer ones a hash."""
    size = end - start
    out = np.empty(len(start), U)
    long = size > SHORT
    few = np.flatnonzero(~long)
    value = np.ascontiguousarray(_eights(data)[start[few]]).view("<u8").ravel()
    length = size[few].astype(U)
    out[few] = mix(value & ((U(1) << U(8) * length) - U(1)) | length << U(56))
    if len(few) < len(size):
        out[long] = span_hash(prefix_hash(data, seed), start[long], end[long], seed)
    return out


def exact_names(data: np.ndarray, start: np.ndarray, end: np.ndarray, names: np.ndarray) -> np.ndarray:
    """word_names() of one task's words, told apart by their bytes where they are hashes."""
    long = np.flatnonzero(end - start > SHORT)
    out = names.copy()
    out[long] = told_apart(data, start[long], end[long], names[long])
    return out


def words_of(data: np.ndarray, offsets: np.ndarray, size: int = SLICE, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, start, end) of every word, and words before each document; works slice by slice to bound memory."""
    parts: list[tuple] = [(np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    bounds, done = [np.zeros(1, np.int64)], 0
    for a, b in slices(offsets, size):
        part = data[offsets[a] : offsets[b]]
        start, end, first = word_spans(part, offsets[a : b + 1] - offsets[a])
        parts.append((word_names(part, start, end, seed), start + offsets[a], end + offsets[a]))
        bounds.append(first[1:] + done)
        done += len(start)
    return *(np.concatenate(z) for z in zip(*parts)), np.concatenate(bounds)


def word_hashes(data: np.ndarray, offsets: np.ndarray, size: int = SLICE, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Name of every word, and words before each document."""
    hashes, bounds, done = [np.zeros(0, U)], [np.zeros(1, np.int64)], 0
    for a, b in slices(offsets, size):
        names, _, _, first = words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size, seed)
        hashes.append(names)
        bounds.append(first[1:] + done)
        done += len(names)
    return np.concatenate(hashes), np.concatenate(bounds)


def local_names(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Names of the words of one task, equal exactly where the words are; other tasks' names mean nothing to them. Words of up to 16 bytes come together by both their ends, longer ones by hash, and are then compared."""
    size = end - start
    padded = np.concatenate((np.zeros(8, np.uint8), data))
    out = np.empty(len(start), U)
    for a in range(0, len(start), 1 << 18):
        z = slice(a, a + (1 << 18))
        n = np.minimum(size[z], 8).astype(U)
        unused = U(8) * (U(8) - n)
        head = np.ascontiguousarray(_eights(data[start[a] : end[z][-1]])[start[z] - start[a]]).view("<u8").ravel() << unused
        tail = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[end[z]]).view("<u8").ravel() >> unused
        out[z] = mix(head >> unused ^ size[z].astype(U) << U(56))
        some = np.flatnonzero(size[z] > SHORT)
        out[a + some] = mix(out[a + some] * GRAM + tail[some])
    far = np.flatnonzero(size > 16)
    if len(far):
        cut = np.concatenate(([0], np.cumsum(size[far])))
        alone = data[np.repeat(start[far] - cut[:-1], size[far]) + np.arange(cut[-1])]
        out[far] = span_hash(prefix_hash(alone), cut[:-1], cut[1:])
    long = np.flatnonzero(size > SHORT)
    out[long] = told_apart(data, start[long], end[long], out[long])
    return out


def run_hash(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of every k consecutive values; entry i covers i .. i+k-1 (documents aren't looked at)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    if k <= 8 and not seed:
        out = words[:n].copy()
        for j in range(1, k):
            out = out * GRAM + words[j : n + j]
        return mix(out)
    pre, out = prefix_hash(words, seed), np.empty(n, U)
    for a in range(0, n, 1 << 18):  # bounds the remainders' memory
        at = np.arange(a, min(n, a + (1 << 18)))
        out[at] = span_hash(pre, at, at + k, seed)
    return out


def within(first: np.ndarray, k: int, n: int | None = None) -> np.ndarray:
    """For values dealt to documents by ``first``: is the run of k that starts at i inside one document?"""
    total = int(first[-1])
    n = max(0, total - k + 1) if n is None else n
    ok = np.zeros(total + 1, np.int32)
    a, b = first[:-1], np.maximum(first[:-1], first[1:] - k + 1)
    np.add.at(ok, a, 1)
    np.add.at(ok, b, -1)
    return np.cumsum(ok)[:n] > 0


def owner(first: np.ndarray) -> np.ndarray:
    """The document of every value."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, in log2(w) passes."""
    out, have = values, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Mask of 0..n-1: which are inside any [start, end)."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d)[:n] > 0


def pack(values: np.ndarray) -> bytes:
    """Compressed bytes of an array, wide values by byte planes; unpack() gives it back, with its type from the caller."""
    raw = np.ascontiguousarray(values)
    if raw.itemsize == 8:
        raw = np.ascontiguousarray(raw.view(np.uint8).reshape(-1, 8).T)
    raw = raw.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True) if raw else b""


def unpack(blob: bytes | None, kind) -> np.ndarray:
    if not blob:
        return np.zeros(0, kind)
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    if np.dtype(kind).itemsize == 8:
        return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(kind).ravel()
    return np.frombuffer(raw, kind)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys: the first, then byte planes of the differences."""
    if not len(keys):
        return b""
    d = np.diff(keys)
    width = (int(d.max()).bit_length() + 7) // 8 if len(d) else 0
    planes = np.ascontiguousarray(d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return int(keys[0]).to_bytes(8, "little") + len(keys).to_bytes(8, "little") + bytes([width]) + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def unpack_sorted(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, U)
    n, width = int.from_bytes(blob[8:16], "little"), blob[16]
    out = np.zeros((n, 8), np.uint8)
    if width:
        planes = pa.decompress(blob[17:], width * (n - 1), codec="zstd", asbytes=True)
        out[1:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n - 1).T
    keys = out.view("<u8").ravel()
    keys[0] = int.from_bytes(blob[:8], "little")
    return np.cumsum(keys, dtype=U)


def pack_columns(columns: list[np.ndarray]) -> bytes:
    """Columns of numbers from 0 on, each as byte planes of the width it needs, in one compressed frame."""
    planes, head = [], [len(columns).to_bytes(2, "little")]
    for c in columns:
        width = (int(c.max(initial=0)).bit_length() + 7) // 8
        head.append(len(c).to_bytes(6, "little") + bytes([width]))
        if width == 1:
            planes.append(c.astype(np.uint8).tobytes())
        elif width:
            planes.append(np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    raw = b"".join(planes)
    return b"".join(head) + len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpack_columns(blob: bytes) -> list[np.ndarray]:
    n = int.from_bytes(blob[:2], "little")
    shapes = [(int.from_bytes(blob[2 + 7 * i : 8 + 7 * i], "little"), blob[8 + 7 * i]) for i in range(n)]
    at = 2 + 7 * n
    size = int.from_bytes(blob[at : at + 8], "little")
    raw = np.frombuffer(pa.decompress(blob[at + 8 :], size, codec="zstd", asbytes=True), np.uint8) if size else np.zeros(0, np.uint8)
    out, at = [], 0
    for length, width in shapes:
        full = np.zeros((length, 8), np.uint8)
        if width:
            full[:, :width] = raw[at : at + length * width].reshape(width, length).T
            at += length * width
        out.append(full.view("<i8").ravel())
    return out
