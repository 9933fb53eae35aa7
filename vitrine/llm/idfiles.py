"""Token-id files with a shared zstandard dictionary.

The file: the magic "VTIDZ1\\n\\0", one zstandard frame for each document over its ids (16-bit
little-endian if the vocabulary allows, else 32-bit), then an index block and a footer. The
index holds for each document its id, the offset of its frame and its number of ids; the
footer holds the offset of the index, the number of documents, the width of an id and the
SHA-256 of the dictionary. Any document is read by one seek and one small frame. The
dictionary is trained on the serialized ids of a bounded sample and stored beside the files
under the name of its hash; a reader refuses a file whose dictionary hash differs.

Documents are written in ascending order of their ids. Encoding and compressing come first;
the small frames are stored once, and Spark's own range partitioner deals them by id to as many
shards as their number and bytes ask for, a shard to a partition. A random second key divides
an id (or null) that very many documents share.

Defined cases: a null or empty text is its end id alone; null ids come first; repeated ids are
all kept, next to each other; an empty table gives no rows; extra columns are ignored; texts
of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, new_folder, table, uniform
from .files import Upload, open_file
from .tokens import encoded

MAGIC = b"VTIDZ1\n\0"
FOOTER = struct.Struct("<QQI32s8s")
ENTRY = np.dtype([("has_id", "<u1"), ("doc_id", "<i8"), ("offset", "<u8"), ("count", "<u8")])
LEVEL = 3


def footer(at: int, documents: int, width: int, digest: bytes) -> bytes:
    return FOOTER.pack(at, documents, width, digest, MAGIC)


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, width: int, rows: int, sample_bytes: int, size: int) -> bytes:
    """A dictionary from the ids of a sample of about `rows` documents of at most sample_bytes each; empty if there are too few.

    Rows are drawn by a hash of their id with the same chance each, so only drawn texts leave
    their executors.
    """
    small = docs.filter(F.octet_length("text") <= sample_bytes)
    texts = small.filter(uniform(F.col("doc_id"), seed=29) < rows / max(docs.count(), 1)).select("text").limit(2 * rows).collect()
    end = end_id.to_bytes(width, "little")
    ids = [x + end for x in encoded([r["text"] for r in texts], tokenizer, width)]
    if len(ids) < 16:
        return b""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, ids)) // 8)), ids).as_bytes()
    except zstandard.ZstdError:
        return b""


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=LEVEL)


def write_id_files(
    df: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 2,
    shard_rows: int = 20_000,
    shard_bytes: int = 64 << 20,
    file_bytes: int = 64 << 20,
    sample_rows: int = 1500,
    sample_bytes: int = 20_000,
    dictionary_size: int = 64 << 10,
) -> DataFrame:
    """Writes the files and returns their manifest: shard, part (files of a shard in order), file, documents, ids, start (ids before it)."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dictionary = train_dictionary(docs, tokenizer, end_id, width, sample_rows, sample_bytes, dictionary_size)
    digest = hashlib.sha256(dictionary).digest()
    if dictionary:
        store_dictionary(folder, dictionary)
    end = end_id.to_bytes(width, "little")

    def frames(batches):
        pack = compressor(dictionary)
        for b in batches:
            ids, zipped, counts = b.column(0), [], []
            for x in encoded(b.column(1).to_pylist(), tokenizer, width):
                zipped.append(pack.compress(x + end))
                counts.append(len(x) // width + 1)
            size = pa.array([len(z) for z in zipped], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), size, pa.array(zipped, pa.binary())], names=["doc_id", "n", "size", "frame"])

    def write(batches):
        out, shard, part, index = None, TaskContext.get().partitionId(), -1, []
        done: list[tuple] = []

        def finish():
            nonlocal out, index
            if out is not None:
                table_ = np.array(index, dtype=ENTRY)
                at = out.write(table_.tobytes())
                out.write(footer(at, len(index), width, digest))
                done.append((shard, part, out.close(), len(index), int(table_["count"].sum())))
            out, index = None, []

        for b in batches:
            for i, c, f in zip(*(b.column(k).to_pylist() for k in range(3))):
                if out is not None and out.size >= file_bytes:
                    finish()
                if out is None:
                    out, part = Upload(folder, ".ids"), part + 1
                    out.write(MAGIC)
                index.append((i is not None, i or 0, out.write(f), c))
        finish()
        names = ["shard", "part", "file", "documents", "ids"]
        if done:
            columns = [pa.array(c, t) for c, t in zip(zip(*done), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    cut = materialize(docs.mapInArrow(frames, "doc_id long, n long, size long, frame binary").withColumn("tie", F.rand(41)), "frames")
    rows, size = cut.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    shards = max(1, -(-rows // shard_rows), -(-size // shard_bytes))
    order = (F.col("doc_id").asc_nulls_first(), F.col("tie"))
    dealt = cut.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "n", "frame")
    manifest = materialize(dealt.mapInArrow(write, "shard int, part int, file string, documents long, ids long"), "manifest")
    order = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, 0)
    return manifest.withColumn("start", F.sum("ids").over(order) - F.col("ids"))


def store_dictionary(folder: str, dictionary: bytes) -> None:
    out = Upload(folder, ".tmp")
    out.write(dictionary)
    out.out.close()
    out.system.move(out.partial, f"{out.path.rpartition('/')[0]}/{hashlib.sha256(dictionary).hexdigest()}.dict")


class IdFile:
    """Random access to the documents of one file."""

    def __init__(self, folder: str, name: str):
        self.file = open_file(folder, name)
        size = self.file.size()
        at, n, self.width, digest, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{name} is not an id file")
        self.index, self.end = np.frombuffer(self.file.read_at(n * ENTRY.itemsize, at), ENTRY), at
        if digest == hashlib.sha256(b"").digest():
            self.unpack = zstandard.ZstdDecompressor()
        else:
            with open_file(folder, f"{digest.hex()}.dict") as f:
                dictionary = f.read()
            if hashlib.sha256(dictionary).digest() != digest:
                raise ValueError(f"the dictionary of {name} was changed")
            self.unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))

    def __len__(self) -> int:
        return len(self.index)

    def ids(self, k: int) -> np.ndarray:
        """The ids of the file's k-th document."""
        lo = int(self.index["offset"][k])
        hi = int(self.index["offset"][k + 1]) if k + 1 < len(self.index) else self.end
        return np.frombuffer(self.unpack.decompress(self.file.read_at(hi - lo, lo)), "<u2" if self.width == 2 else "<u4")


def read_id_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""

    def read(batches):
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f = IdFile(folder, name)
                counts, crcs = np.zeros(len(f), np.int64), np.zeros(len(f), np.int64)
                for k in range(len(f)):
                    ids = f.ids(k)
                    counts[k], crcs[k] = len(ids), zlib.crc32(ids.astype("<u4").tobytes())
                starts = start + np.cumsum(counts) - counts
                doc_id = pa.array(f.index["doc_id"].astype(np.int64), mask=f.index["has_id"] == 0)
                yield pa.RecordBatch.from_arrays([doc_id, pa.array(starts), pa.array(counts), pa.array(crcs)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.select("file", "start")
    return files.repartition(max(1, min(files.count(), 10_000)), "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_dictionary_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as ids in files, read back."""
    folder = new_folder(spark, "idfiles")
    manifest = write_id_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_id_files(manifest, folder)
