"""Blocks of documents and the exchange of keys between blocks and shards.

Corpus-wide facts (how often does this key occur?) are asked for, not
broadcast: a block of documents sends every distinct key it holds once to the
shard that owns the key; the shard sorts what all blocks sent and answers each
block. A key that a third of all documents hold is one entry per block, so no
shard is hot, and a shard's size follows from the number of shards alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .shared import frugal

BLOCK_BYTES = 4 << 20
MESSAGE = "shard long, block long, keys binary, data binary"
_SCHEMA = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("data", pa.binary())])


def block_count(docs: DataFrame, text: str = "text", size: int = BLOCK_BYTES) -> int:
    """Blocks of about ``size`` bytes of text for the whole table."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, math.ceil(total / size))


def in_blocks(docs: DataFrame, n: int, id_col: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(block, doc_id, text, *keep): a block is a function of the row alone, so a retried task rebuilds the same one. The text counts too: rows of one id, or of none, are spread."""
    frugal(docs.sparkSession)
    return docs.select(F.pmod(F.xxhash64(F.col(id_col), F.col(text)), F.lit(n)).alias("block"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *keep)


def send(block: int, keys: np.ndarray, n: int, *columns: np.ndarray, shift: int = 0, base: int = 0) -> pa.Table:
    """Messages of a block: its sorted keys, dealt by key range to n shards from ``base`` on, with parallel columns of int64. shift: low bits of the keys left out."""
    shard = (keys >> K.U(32)) * K.U(n) >> K.U(32)
    cuts = np.searchsorted(shard, np.arange(n + 1, dtype=K.U))
    rows: dict[str, list] = {"shard": [], "block": [], "keys": [], "data": []}
    for s in np.flatnonzero(np.diff(cuts)):
        a, b = cuts[s], cuts[s + 1]
        rows["shard"].append(base + int(s))
        rows["block"].append(block)
        rows["keys"].append(K.pack_sorted(keys[a:b] >> K.U(shift)))
        rows["data"].append(K.pack(np.concatenate([np.asarray(c[a:b]).astype(np.int64) for c in columns])) if columns else b"")
    return pa.table(rows, schema=_SCHEMA)


def received(table: pa.Table, columns: int = 0) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[int]]:
    """All keys of a shard, the message each came in, its columns, and the blocks of the messages."""
    parts = [K.unpack_sorted(x) for x in table["keys"].to_pylist()]
    sizes = np.array([len(p) for p in parts], np.int64)
    keys = np.concatenate(parts) if parts else np.zeros(0, K.U)
    got = [K.unpack(x, np.int64).reshape(columns, -1) for x in table["data"].to_pylist()] if columns else []
    cols = [np.concatenate([g[i] for g in got]) for i in range(columns)]
    return keys, np.repeat(np.arange(len(parts)), sizes), cols, table["block"].to_pylist()


def answer(table: pa.Table, source: np.ndarray, values: np.ndarray, kind=np.int64) -> pa.Table:
    """The values of a shard's keys, back to the blocks that sent them, in the order sent."""
    cuts = np.searchsorted(source, np.arange(table.num_rows + 1))
    data = [K.pack(values[cuts[i] : cuts[i + 1]].astype(kind)) for i in range(table.num_rows)]
    return pa.table({"shard": table["shard"], "block": table["block"], "keys": pa.array([b""] * table.num_rows, pa.binary()), "data": pa.array(data, pa.binary())}, schema=_SCHEMA)


def replies(table: pa.Table, kind=np.int64) -> np.ndarray:
    """The answers to a block, by the order of its keys."""
    order = np.argsort(np.array(table["shard"].to_pylist(), np.int64), kind="stable")
    data = table["data"].to_pylist()
    return np.concatenate([K.unpack(data[i], kind) for i in order]) if len(order) else np.zeros(0, kind)


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): a stable sort of the keys and where each distinct key begins in it."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
    return order, starts


def ask(blocks: DataFrame, make: Callable, reply: Callable) -> DataFrame:
    """One exchange: make(key, table) -> messages by block, reply(key, table) -> answers by shard."""
    return blocks.groupBy("block").applyInArrow(make, MESSAGE).groupBy("shard").applyInArrow(reply, MESSAGE)
