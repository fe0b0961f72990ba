"""Token ids in sorted-string-table shards.

A shard holds documents in ascending key order:

    data blocks | sparse index | Bloom filter | footer

A data block is a run of entries: varint of the key bytes shared with the entry before,
varint of the rest's length, varint of the value's length, the rest of the key, the value.
The first entry of a block shares nothing; a crc32 ends the block. The sparse index has
each block's last key, offset and length. The footer has a fixed size and is read first.
A lookup asks the Bloom filter, finds the block by binary search in the index and scans it.

A key is 9 bytes that sort as the identifier does: 0 for null, else 1, then the signed
64-bit number with its sign bit turned, big-endian. A value is the ids, little-endian,
2 bytes each where the vocabulary allows, else 4.

Null identifiers sort first; rows that repeat an identifier are all kept, in the order of
a hash of their text. A null or empty text has the end id alone. Other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binfold.llm import common
from binfold.llm.wordcache import BLOCK, word_tokenizer

MAGIC = b"BFSST001"
FOOTER = struct.Struct("<QIQIQQBB8s")
BLOCK_BYTES = 64 << 10
SHARD_BYTES = 128 << 20
BITS_PER_KEY, HASHES = 10, 7


def key_bytes(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & (1 << 64) - 1)


def key_id(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: memoryview, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = data[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.adler32(key[::-1]) * 2654435761 % (1 << 32) | 1
    return [(a + i * b) % bits for i in range(HASHES)]


class ShardWriter:
    """Streams entries to one shard; holds a block, the index and the keys' hashes."""

    def __init__(self, sink: pa.NativeFile, width: int) -> None:
        self.sink, self.width = sink, width
        self.block, self.last, self.offset = bytearray(), b"", 0
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.tokens = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        value = ids.astype(f"<u{self.width}").tobytes()
        shared = 0
        if self.block:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.tokens += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.offset += len(data)

    def _flush(self) -> None:
        if self.block:
            data = bytes(self.block) + struct.pack("<I", zlib.crc32(self.block))
            self.index.append((self.last, self.offset, len(data)))
            self._put(data)
            self.block = bytearray()

    def finish(self) -> dict:
        self._flush()
        at_index = self.offset
        index = b"".join(key + struct.pack("<QI", at, n) for key, at, n in self.index)
        self._put(index)
        bits = max(64, len(self.keys) * BITS_PER_KEY)
        bloom = np.zeros(bits, np.uint8)
        for key in self.keys:
            bloom[_probes(key, bits)] = 1
        packed, at_bloom = np.packbits(bloom).tobytes(), self.offset
        self._put(packed)
        self._put(FOOTER.pack(at_index, len(self.index), at_bloom, bits, len(self.keys), self.tokens, self.width, len(self.last) or 9, MAGIC))
        self.sink.close()
        return {"n_docs": len(self.keys), "n_tokens": self.tokens, "first_key": self.keys[0], "last_key": self.keys[-1], "n_bytes": self.offset}


class Shard:
    """A reader of one shard."""

    def __init__(self, source: pa.NativeFile) -> None:
        self.source = source
        size = source.size()
        source.seek(size - FOOTER.size)
        at, n, at_bloom, self.bits, self.n_docs, self.n_tokens, self.width, wide, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        entry = wide + 12
        raw = self._at(at, n * entry)
        self.index = [(raw[i : i + wide], *struct.unpack("<QI", raw[i + wide : i + entry])) for i in range(0, len(raw), entry)]
        self.bloom = (at_bloom, (self.bits + 7) // 8)
        self.last_keys = [x[0] for x in self.index]

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def _block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, offset, n = self.index[i]
        raw = self._at(offset, n)
        if struct.unpack("<I", raw[-4:])[0] != zlib.crc32(raw[:-4]):
            raise ValueError("a block's checksum differs")
        data, at, key = memoryview(raw)[:-4], 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + bytes(data[at : at + rest])
            at += rest
            yield key, np.frombuffer(data[at : at + size], f"<u{self.width}")
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.index)):
            yield from self._block(i)

    def may_hold(self, key: bytes) -> bool:
        bloom = np.unpackbits(np.frombuffer(self._at(*self.bloom), np.uint8))
        return bool(bloom[_probes(key, self.bits)].all())

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every row with that identifier."""
        key, out = key_bytes(doc_id), []
        if not self.may_hold(key):
            return out
        for i in range(bisect_left(self.last_keys, key), len(self.index)):
            for k, ids in self._block(i):
                if k > key:
                    return out
                if k == key:
                    out.append(ids)
        return out


MANIFEST = "part int, seq int, path string, n_docs long, n_tokens long, first_key binary, last_key binary, n_bytes long"


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards to the shared folder; returns their manifest, in a written table.

    Rows are dealt to ranges of (identifier, hash of text), so that a repeated identifier
    spreads too. A task names its files anew each time it runs, and the manifest has those
    of the runs that Spark committed: a lost or repeated task leaves no wrong row.
    """
    import pyarrow.fs as pafs

    spark = docs.sparkSession
    folder = common.fresh(spark, "sst")
    # a plain select: the range sampler reads the rows twice, so encoding comes after it
    dealt = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("h")).repartitionByRange(common.parallelism(spark), "k", "h").sortWithinPartitions("k", "h", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, run, seq = TaskContext.get().partitionId(), uuid.uuid4().hex[:8], 0
        encoder = word_tokenizer(tokenizer)
        width = 2 if len(encoder.ends) <= 1 << 16 and end_id < 1 << 16 else 4
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        out, rows = None, []

        def done() -> None:
            rows.append({"part": part, "seq": seq, "path": path} | out.finish())

        for block in common.blocks(batches, "text", BLOCK):
            ids, per = encoder.encode(block.column(1), end_id)
            at = 0
            for doc_id, n in zip(block.column(0).to_pylist(), per.tolist()):
                if out is None:
                    path = f"shard-{part:06d}-{seq:06d}-{run}.sst"
                    out = ShardWriter(fs.open_output_stream(f"{base}/{path}"), width)
                out.add(key_bytes(doc_id), ids[at : at + n])
                at += n
                if out.offset >= shard_bytes:
                    done()
                    out, seq = None, seq + 1
        if out is not None:
            done()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("first_key", pa.binary()), ("last_key", pa.binary()), ("n_bytes", pa.int64())]))

    made = common.written(common.arrow_map(dealt, write, MANIFEST), "sst-manifest")
    return made.withColumn("path", F.concat(F.lit(folder + "/"), "path"))


def read_shards(manifest: DataFrame) -> DataFrame:
    """The documents of the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The manifest has a row for each shard of up to 128 MB; its running sum gives each
    shard's first position.
    """
    import pyarrow.fs as pafs

    spark = manifest.sparkSession
    totals = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    base, bases = 0, []
    for r in totals:  # a row for each range of the shuffle
        bases.append((r["part"], base))
        base += r["n"]
    from pyspark.sql import Window

    within = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = spark.createDataFrame(bases, "part int, base long")
    each = manifest.join(F.broadcast(known), "part").select("path", (F.col("base") + within).alias("base")).repartition(common.parallelism(spark), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, name = pafs.FileSystem.from_uri(path)
                rows: tuple[list, list, list, list] = ([], [], [], [])
                with fs.open_input_file(name) as source:
                    for key, ids in Shard(source):
                        for c, v in zip(rows, (key_id(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))):
                            c.append(v)
                        start += len(ids)
                        if len(rows[0]) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                            rows = ([], [], [], [])
                if rows[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return common.arrow_map(each, read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, doc_id: int | None) -> list[np.ndarray]:
    """The ids of one document's rows: shards by their key ranges, then binary search within."""
    import pyarrow.fs as pafs

    key, out = bytearray(key_bytes(doc_id)), []
    held = manifest.where((F.col("first_key") <= F.lit(key)) & (F.col("last_key") >= F.lit(key))).orderBy("part", "seq")
    for r in held.select("path").collect():  # the shards that hold this one key
        fs, name = pafs.FileSystem.from_uri(r["path"])
        with fs.open_input_file(name) as source:
            out += [x.astype(np.uint32) for x in Shard(source).get(doc_id)]
    return out
