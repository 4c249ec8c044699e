"""Token counts behind a digest cache (operator 3).

The cache is a Parquet table (tokenizer, digest, n_tokens): the SHA-256 of the
tokenizer file and of the content. A run joins contents to the cache, encodes
one text of each digest that misses, appends those counts, and joins again.

Inside a batch a text is cut where a space follows a byte that certainly ends a
word. The byte-level pre-tokenizer never joins characters over such a place, so
counts add up; equal units of a batch (by hash, then by their bytes) are encoded
once, by the library.

Defined results: null counts as empty and has no tokens; special tokens' strings
in a text are handled as the library does by default; repeated rows and null
doc_ids keep their rows.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .shared import frugal, looked_up, staged

_loaded: dict[str, object] = {}


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _counter(path: str):
    """texts -> token counts, by the file's library."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_padding()
            tok.no_truncation()
            _loaded[path] = lambda texts: [len(e) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = lambda texts: [len(e) for e in sp.encode(texts, num_threads=1)]
    return _loaded[path]


#: Bytes after which a space certainly begins a new pre-token: printable ASCII, and the last byte of a two-byte letter.
_ENDS = np.zeros(256, bool)
_ENDS[0x21:0x7F] = True


def _unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted starts of units; every document starts one."""
    if len(data) < 2:
        return np.unique(offsets[:-1][np.diff(offsets) > 0])
    ends = _ENDS[data[:-1]]
    letter = np.zeros(len(ends), bool)
    letter[1:] = (data[:-2] >= 0xC3) & (data[:-2] <= 0xDF) & (data[1:-1] >= 0x80) & (data[1:-1] < 0xC0)
    cut = np.flatnonzero((data[1:] == 0x20) & (ends | letter)) + 1
    return np.union1d(cut, offsets[:-1][np.diff(offsets) > 0])


def count_batch(texts: pa.Array, path: str, whole: bool = False) -> np.ndarray:
    """Token counts of texts; ``whole`` encodes each text in one piece."""
    count = _counter(path)
    if whole or not path.endswith(".json"):
        return np.array(count(["" if t is None else t for t in texts.to_pylist()]), np.int64)
    data, offsets = K.flat(texts)
    out = []
    for a, b in K.slices(offsets, 8 << 20):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts = _unit_starts(part, at)
        ends = np.append(starts[1:], len(part))
        keys = np.empty(len(starts), K.U)
        for i in range(0, len(part), 2 << 20):  # bounds the hashes' memory
            x, y = np.searchsorted(starts, (i, i + (2 << 20)))
            if x < y:
                lo = starts[x]
                keys[x:y] = K.span_hash(K.prefix_hash(part[lo : ends[y - 1]]), starts[x:y] - lo, ends[x:y] - lo)
        keys = K.told_apart(part, starts, ends, keys)
        _, spot, back = np.unique(keys, return_index=True, return_inverse=True)
        raw = part.tobytes()
        tokens = np.array(count([raw[s:e].decode() for s, e in zip(starts[spot].tolist(), ends[spot].tolist())]), np.int64)
        sums = np.concatenate(([0], np.cumsum(tokens[back]))) if len(starts) else np.zeros(1, np.int64)
        first = np.searchsorted(starts, at)
        out.append(sums[first[1:]] - sums[first[:-1]])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _exists(spark, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. ``cache``: the table's path, made where it is missing and appended to otherwise."""
    spark = docs.sparkSession
    frugal(spark)
    version = tokenizer_digest(tokenizer)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))

    def known() -> DataFrame:
        return spark.read.schema("tokenizer string, digest string, n_tokens long").parquet(cache).where(F.col("tokenizer") == version).select("digest", "n_tokens").dropDuplicates(["digest"])

    misses = keyed.select("digest", "text")
    if _exists(spark, cache):
        misses = misses.join(known(), "digest", "left_anti")
    misses = misses.dropDuplicates(["digest"])

    @K.tidy_batches
    def encode(batches):
        for batch in K.regroup(batches, 16 << 20):
            yield pa.RecordBatch.from_pydict({"tokenizer": [version] * batch.num_rows, "digest": batch.column("digest"), "n_tokens": count_batch(batch.column("text"), tokenizer)})

    misses.mapInArrow(encode, "tokenizer string, digest string, n_tokens long").write.mode("append").parquet(cache)
    return looked_up(staged(keyed.drop("text"), "digests"), known(), "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
