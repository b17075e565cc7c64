"""Token ids in sorted-string-table shards.

A shard holds the documents of a range of identifiers in ascending order:

    block*  index  bloom  footer

block   zstd of entries: varint shared | varint unshared | varint bytes | key suffix | ids.
        The first key of a block is whole, the others leave out what they share with the one before.
        ids are little-endian, 2 bytes each if all of the document's fit, else 4 (a byte says which).
index   for each block: varint key length | last key | varint offset | varint bytes
bloom   bits of a Bloom filter over the 8-byte identifiers
footer  six little-endian 64-bit numbers (offset of the index, of the Bloom filter, of the footer,
        documents, ids, blocks), then 8 bytes of magic

A key is a byte 1 and the identifier, big-endian with the sign turned, then four bytes that count
rows of the same identifier; a null identifier's key is a byte 0 and the count, so it sorts first.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import cut, documents, shared_folder

MAGIC = b"PLSST\x00\x00\x01"
FOOTER = struct.Struct("<6q8s")
BLOCK_BYTES = 1 << 16
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: Documents of a shard, about.
SHARD_DOCS = 8192


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def key_of(doc_id: int | None, count: int = 0) -> bytes:
    head = b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", doc_id + (1 << 63))
    return head + struct.pack(">I", count)


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:9])[0] - (1 << 63) if key[0] else None


def _bloom_places(key: bytes, bits: int) -> Iterator[int]:
    import xxhash

    h = xxhash.xxh64_intdigest(key[:9] if key[0] else b"\x00")
    step = (h >> 32) | 1
    for i in range(BLOOM_HASHES):
        yield ((h & 0xFFFFFFFF) + i * step) % bits


def pack_ids(ids: np.ndarray) -> bytes:
    return b"\x02" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\x04" + ids.astype("<u4").tobytes()


def unpack_ids(value: bytes) -> np.ndarray:
    return np.frombuffer(value, f"<u{value[0]}", offset=1).astype(np.uint32)


class Writer:
    """Writes one shard to a binary file; keys come in ascending order."""

    def __init__(self, sink) -> None:
        import zstandard

        self.sink, self.at, self.block, self.index = sink, 0, bytearray(), []
        self.last, self.keys, self.n_ids = b"", [], 0
        self.zip = zstandard.ZstdCompressor(level=1)

    def put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        value = pack_ids(ids)
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.n_ids += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.block:
            data = self.zip.compress(bytes(self.block))
            self.index.append((self.last, self.at, len(data)))
            self.put(data)
            self.block = bytearray()

    def close(self) -> None:
        self.flush()
        index_at = self.at
        self.put(b"".join(varint(len(k)) + k + varint(at) + varint(n) for k, at, n in self.index))
        bloom_at = self.at
        bits = bytearray(max(8, -(-len(self.keys) * BLOOM_BITS // 8)))
        for key in self.keys:
            for place in _bloom_places(key, 8 * len(bits)):
                bits[place >> 3] |= 1 << (place & 7)
        self.put(bytes(bits))
        self.put(FOOTER.pack(index_at, bloom_at, self.at, len(self.keys), self.n_ids, len(self.index), MAGIC))


class Reader:
    """Reads one shard from a random-access file."""

    def __init__(self, source) -> None:
        import zstandard

        self.source, self.zip = source, zstandard.ZstdDecompressor()
        size = source.size()
        *self.foot, magic = FOOTER.unpack(self.get(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        index_at, bloom_at, foot_at, self.n_docs, self.n_ids, blocks = self.foot
        data, at, self.index = self.get(index_at, bloom_at - index_at), 0, []
        for _ in range(blocks):
            n, at = read_varint(data, at)
            key, at = data[at : at + n], at + n
            place, at = read_varint(data, at)
            length, at = read_varint(data, at)
            self.index.append((key, place, length))
        self.bloom = self.get(bloom_at, foot_at - bloom_at)

    def get(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def entries(self, block: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, n = self.index[block]
        data, key, at = self.zip.decompress(self.get(at, n)), b"", 0
        while at < len(data):
            shared, at = read_varint(data, at)
            more, at = read_varint(data, at)
            n, at = read_varint(data, at)
            key = key[:shared] + data[at : at + more]
            at += more
            yield key, unpack_ids(data[at : at + n])
            at += n

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for block in range(len(self.index)):
            yield from self.entries(block)

    def find(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of the rows of doc_id: the Bloom filter first, then binary search in the sparse index."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, 8 * len(self.bloom))):
            return []
        out, block = [], bisect_left([k for k, _, _ in self.index], key)
        while block < len(self.index):
            for k, ids in self.entries(block):
                if k[:-4] == key[:-4]:
                    out.append(ids)
                elif k > key:
                    return out
            block += 1
        return out


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder, as executors see it."""
    if "://" not in uri:
        uri = uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}"
    return pafs.FileSystem.from_uri(uri)


def write_shards(docs: DataFrame, vocabulary: str, end_id: int | None, folder: str, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Writes the ids of every text, with end_id after each, to shards in folder, and returns the
    shards: shard int, path string, n_docs long, n_ids long; shard numbers ascend with the identifiers.

    Null texts count as empty. Null identifiers come before all others; rows of the same identifier
    are all kept, next to each other, in the order of their texts. An empty table gives no shard.
    Other columns of docs are not read. A shard is written under another name and then moved, so a
    task that runs twice or is lost leaves no half shard.
    """
    n = max(1, -(-docs.count() // shard_docs))

    def work(batches):
        from pyspark import TaskContext

        from ._tokens import coder

        code, part = coder(vocabulary), TaskContext.get()
        fs, path = open_fs(folder)
        name = f"{path}/shard-{part.partitionId():06d}"
        draft, writer, last, count = f"{name}.{part.taskAttemptId()}.part", None, (), 0
        for batch in batches:
            at, step = 0, 2048
            while at < batch.num_rows:
                some = batch.slice(at, step)
                at += step
                ids, sizes = code.encode(some.column(1))
                stop = np.cumsum(sizes)
                for doc_id, i, j in zip(some.column(0).to_pylist(), stop - sizes, stop, strict=True):
                    if writer is None:
                        fs.create_dir(path, recursive=True)
                        sink = fs.open_output_stream(draft)
                        writer = Writer(sink)
                    count = count + 1 if last == (doc_id,) else 0
                    last = (doc_id,)
                    writer.add(key_of(doc_id, count), ids[i:j] if end_id is None else np.append(ids[i:j], np.uint32(end_id)))
        if writer is not None:
            writer.close()
            sink.close()
            fs.move(draft, f"{name}.sst")
            yield pa.RecordBatch.from_pydict({"shard": pa.array([part.partitionId()], pa.int32()), "path": [f"{folder.rstrip('/')}/shard-{part.partitionId():06d}.sst"], "n_docs": [len(writer.keys)], "n_ids": [writer.n_ids]})

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(n, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    return cut(rows.mapInArrow(work, "shard int, path string, n_docs long, n_ids long"))


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id long, start long, ids array<int> of every document in the shards of write_shards(), with
    start the ids of all documents before it. What goes through the driver is one number a shard."""
    return _read(shards, "ids array<int>", lambda ids: pa.array(ids, pa.list_(pa.int32())))


def _read(shards: DataFrame, column: str, arrow) -> DataFrame:
    spark = shards.sparkSession
    rows, total = [], 0
    for r in sorted(shards.collect(), key=lambda r: r.shard):
        rows.append((r.path, total))
        total += r.n_ids

    def work(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, file = open_fs(path)
                with fs.open_input_file(file) as source:
                    reader = Reader(source)
                    for block in range(len(reader.index)):
                        keys, starts, values = [], [], []
                        for key, ids in reader.entries(block):
                            keys.append(id_of(key))
                            starts.append(start)
                            values.append(ids)
                            start += len(ids)
                        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), *columns(arrow(values))], names)

    names = ["doc_id", "start", *(c.split()[0] for c in column.split(", "))]
    columns = lambda x: x if isinstance(x, list) else [x]
    frame = spark.createDataFrame(rows, "path string, start long")
    return frame.repartition(max(1, len(rows)), "path").mapInArrow(work, f"doc_id long, start long, {column}")


def find(shards: DataFrame, doc_id: int | None) -> list[np.ndarray]:
    """The ids of the rows of one identifier, looked up in the shards by an action of few tasks."""

    def work(batches):
        for batch in batches:
            for path in batch.column(1).to_pylist():
                fs, file = open_fs(path)
                with fs.open_input_file(file) as source:
                    got = Reader(source).find(doc_id)
                    if got:
                        yield pa.RecordBatch.from_pydict({"ids": pa.array([x.tolist() for x in got], pa.list_(pa.int64()))})

    return [np.array(r.ids, np.uint32) for r in shards.mapInArrow(work, "ids array<long>").collect()]


def op8_sstable_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    shards = write_shards(documents(spark, sf_dir), P.path("byte_bpe_50k.json"), 2, shared_folder(spark, "sstable"))
    digest = lambda ids: [pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())]
    return _read(shards, "n_tokens long, ids_crc32 long", digest)
