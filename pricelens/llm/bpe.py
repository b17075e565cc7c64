"""Byte-level BPE encoding and decoding by the tiktoken library with a local rank file."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import documents

#: Characters of a text that tiktoken gets at once, about.
SEGMENT_CHARS = 1 << 16
#: Bytes of text in a batch that goes back to Spark, about.
OUT_BYTES = 1 << 22


@lru_cache(2)
def encoding(ranks_path: str, pattern: str):
    """The vocabulary of a rank file, loaded once in each Python worker; it has no special tokens."""
    import base64

    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(1)
def _boundary():
    import regex

    return regex.compile(r"(?<=\S) (?=\S)")


def segments(text: str, chars: int = SEGMENT_CHARS) -> Iterator[str]:
    """text in parts that may be encoded one by one: cut before a single space between two characters
    that are no white space, which no match of the pattern spans. A stretch without such a place stays whole."""
    at = 0
    while len(text) - at > chars:
        found = _boundary().search(text, at + chars)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def encode_text(enc, text: str):
    """Ids of a whole text as a NumPy array."""
    import numpy as np

    if len(text) <= SEGMENT_CHARS:
        return enc.encode_to_numpy(text, disallowed_special=())
    return np.concatenate([enc.encode_to_numpy(s, disallowed_special=()) for s in segments(text)])


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int>, decoded binary: each text's ids, and the bytes that they decode to.

    Every row of docs gives one row, repeated rows and null doc_ids too. A null or empty text has no
    ids and decodes to no bytes. Other columns of docs are not read. The ids of a text of any length
    are those of the whole text; decoding joins the tokens' bytes, so that a token which ends within
    a character is no problem.
    """

    def work(batches):
        import numpy as np

        enc = encoding(ranks_path, pattern)

        def out(keys, ids, raw):
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(raw, pa.binary())], ["doc_id", "ids", "decoded"])

        for batch in batches:
            keys, ids, raw, size = [], [], [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = encode_text(enc, text.as_py() or "")
                keys.append(key)
                ids.append(got)
                raw.append(enc.decode_bytes(got.tolist()))
                size += len(raw[-1])
                if size >= OUT_BYTES:
                    yield out(keys, ids, raw)
                    keys, ids, raw, size = [], [], [], 0
            if keys:
                yield out(keys, ids, raw)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, ids array<int>, decoded binary")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    coded = encode(documents(spark, sf_dir), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
