"""Token ids in files of independent zstandard frames with a trailing seek table.

A shard file holds, in this order:

* data frames: each a complete zstandard frame of ids of one document, as little-endian unsigned integers of ``width``
  (2 or 4) bytes. A document of more than ``FRAME_IDS`` ids takes several frames in a row; no frame holds two documents.
* a skippable frame (magic 0x184D2A50) with the document index: width, number of documents, then for each its doc_id
  (signed 64 bits), a null flag (8 bits), its number of ids (unsigned 64 bits) and of frames (unsigned 32 bits);
* the seek table, a skippable frame (magic 0x184D2A5E) in the public seekable format: for each frame its compressed
  and decompressed size and the low 32 bits of the XXH64 of the decompressed bytes, then the number of frames, a descriptor
  byte with the checksum flag and the magic 0x8F92EAB1.

Any zstandard decoder reads the file as a whole; a reader that wants some documents reads the tail, then their frames only.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ENCODED_ROWS, CachedEncoder, Vocabulary
from .common import n_partitions, open_input, open_output, range_bounds, range_bucket, read, shared_dir, slices, small_batches, text_hash, whole_numbers

#: Ids of a frame at most.
FRAME_IDS = 1 << 16
_INDEX_MAGIC, _SEEK_MAGIC, _FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_ENTRY, _FOOTER, _DOC = struct.Struct("<III"), struct.Struct("<IBI"), struct.Struct("<qBQI")


class ShardWriter:
    """Writes one shard; ``add`` takes documents in their order."""

    def __init__(self, uri: str, width: int, level: int = 1):
        import zstandard

        self.uri, self.width, self.out = uri, width, open_output(uri)
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.table, self.docs, self.written = bytearray(), bytearray(), 0

    def add(self, doc_id: int | None, ids) -> None:
        """``ids``: a NumPy array."""
        import xxhash

        frames = 0
        for i in range(0, len(ids), FRAME_IDS):
            raw = ids[i : i + FRAME_IDS].astype(f"<u{self.width}").tobytes()
            packed = self.compressor.compress(raw)
            self.out.write(packed)
            self.table += _ENTRY.pack(len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF)
            self.written += len(packed)
            frames += 1
        self.docs += _DOC.pack(doc_id or 0, doc_id is None, len(ids), frames)

    def close(self) -> int:
        """Bytes of the file."""
        index = struct.pack("<BQ", self.width, len(self.docs) // _DOC.size) + bytes(self.docs)
        self.out.write(struct.pack("<II", _INDEX_MAGIC, len(index)) + index)
        self.table += _ENTRY.pack(len(index) + 8, 0, 0)
        body = bytes(self.table) + _FOOTER.pack(len(self.table) // _ENTRY.size, 0x80, _FOOTER_MAGIC)
        self.out.write(struct.pack("<II", _SEEK_MAGIC, len(body)) + body)
        self.out.close()
        return self.written + len(index) + 8 + len(body) + 8


class ShardReader:
    """Reads documents of a shard: the tail first, then only the frames asked for. A wrong checksum raises."""

    def __init__(self, uri: str):
        import numpy as np

        self.f = open_input(uri)
        end = self.f.seek(0, 2)
        self.f.seek(end - _FOOTER.size)
        n, flags, magic = _FOOTER.unpack(self.f.read(_FOOTER.size))
        if magic != _FOOTER_MAGIC or not flags & 0x80:
            raise ValueError(f"{uri} has no seek table with checksums")
        start = end - _FOOTER.size - n * _ENTRY.size
        self.f.seek(start)
        self.table = np.frombuffer(self.f.read(n * _ENTRY.size), "<u4").reshape(-1, 3)
        sizes = self.table[:, 0].astype(np.int64)
        self.starts = np.cumsum(sizes) - sizes
        self.f.seek(int(self.starts[-1]) + 8)
        index = self.f.read(int(sizes[-1]) - 8)
        self.width, count = struct.unpack_from("<BQ", index)
        self.docs = np.frombuffer(index, np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u8"), ("frames", "<u4")]), count, 9)
        frames = self.docs["frames"].astype(np.int64)
        self.first = np.cumsum(frames) - frames
        self.frames_read = 0

    def ids(self, k: int):
        """The ids of the k-th document."""
        import numpy as np
        import xxhash
        import zstandard

        d, parts = zstandard.ZstdDecompressor(), []
        for i in range(int(self.first[k]), int(self.first[k]) + int(self.docs["frames"][k])):
            self.f.seek(int(self.starts[i]))
            raw = d.decompress(self.f.read(int(self.table[i, 0])), max_output_size=int(self.table[i, 1]))
            if len(raw) != self.table[i, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[i, 2]:
                raise ValueError(f"frame {i} does not match its checksum")
            parts.append(np.frombuffer(raw, f"<u{self.width}"))
            self.frames_read += 1
        return np.concatenate(parts) if len(parts) != 1 else parts[0] if parts else np.empty(0, f"<u{self.width}")

    def find(self, doc_id: int) -> list[int]:
        """Positions of the documents with this id."""
        import numpy as np

        return np.flatnonzero((self.docs["id"] == doc_id) & (self.docs["null"] == 0)).tolist()

    def close(self) -> None:
        self.f.close()


class LibraryEncoder(CachedEncoder):
    """Encodes words with the tokenizers library. Texts are cut into words where the byte-level rule always cuts."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__(Vocabulary(path))
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        out = {}
        for i in range(0, len(words), 4096):
            part = words[i : i + 4096]
            # one call for many words, each encoded by itself; where a word's ids end follows from the bytes that they stand for
            ids = self.tokenizer.encode_batch_fast([part], is_pretokenized=True, add_special_tokens=False)[0].ids
            raw = array("I", ids).tobytes()
            stops = np.cumsum([len(w.encode("utf-8", "surrogatepass")) for w in part])
            reached = np.cumsum(self.lengths[ids])
            ends = np.searchsorted(reached, stops) + 1
            if len(ids) != ends[-1] or not np.array_equal(reached[ends - 1], stops):
                raise ValueError("the library's ids do not stand for the bytes of the words")
            cuts = (4 * ends).tolist()
            out.update(zip(part, map(raw.__getitem__, map(slice, [0, *cuts], cuts)), strict=True))
        return out


@lru_cache(maxsize=4)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def write_tokens(df: DataFrame, tokenizer_path: str, directory: str, end_id: int, width: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode every whole text, append ``end_id`` to each and write shards in ascending order of ids (null ids first, equal
    ids by the texts' hashes). Returns the manifest: shard, path, docs, ids, bytes - one row for each shard.

    One shuffle by ranges of ids, where an id (or null) with many rows takes several ranges of the texts' hashes; each task streams its sorted rows into one file. A task that runs again writes a
    file of its own name, and the manifest names the files of the attempts that succeeded. Empty tables give no shard; null and
    empty texts have the end id alone; further columns are not carried. Token ids beyond the width and document ids that are no whole numbers raise.
    """
    spark = df.sparkSession
    rows = small_batches(df, ENCODED_ROWS).select(whole_numbers(df, id_column).alias("id"), F.col(text_column).alias("text"))
    n = n_partitions(spark)
    bounds = range_bounds(rows, "id", n)
    placed = rows.withColumn("bucket", range_bucket(F.col("id"), text_hash("text"), bounds)).repartitionById(len(bounds) + 1, "bucket").sortWithinPartitions("bucket", "id", text_hash("text"))

    def run(batches) -> Iterator:
        import uuid

        import numpy as np
        import pyarrow as pa

        out = shard = None
        docs = total = 0
        for batch in slices(batches, ENCODED_ROWS):
            if out is None:
                shard = batch.column(2)[0].as_py()
                uri = f"{directory}/shard-{shard:08d}-{uuid.uuid4().hex}.ids.zst"
                out = ShardWriter(uri, width)
            for doc_id, ids in zip(batch.column(0).to_pylist(), library_encoder(tokenizer_path).encode(batch.column(1).to_pylist()), strict=True):
                a = np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id))
                if width == 2 and a.max() > 0xFFFF:
                    raise ValueError("an id does not fit in two bytes")
                out.add(doc_id, a)
                docs += 1
                total += len(a)
        if out is not None:
            size = out.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": uri, "docs": docs, "ids": total, "bytes": size}], schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())]))

    manifest = f"{directory}/manifest"
    placed.mapInArrow(run, "shard int, path string, docs long, ids long, bytes long").write.parquet(manifest)
    return spark.read.parquet(manifest)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Every document of the shards: doc_id, start (ids of all documents before it), n_tokens, ids (binary, unsigned 32 bits, little-endian).

    One task for each shard; the manifest alone is gathered, a row for each shard, for the starts.
    """
    spark = manifest.sparkSession
    shards = sorted(manifest.collect(), key=lambda r: r["shard"])
    starts, before = [], 0
    for k, r in enumerate(shards):
        starts.append((k, r["path"], before))
        before += r["ids"]
    jobs = spark.createDataFrame(starts, "k int, path string, start long").repartitionById(max(1, len(starts)), "k")

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for path, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                r = ShardReader(path)
                rows, size = [], 0
                for k in range(len(r.docs)):
                    ids = r.ids(k).astype("<u4")
                    rows.append((None if r.docs["null"][k] else int(r.docs["id"][k]), start, len(ids), ids.tobytes()))
                    start += len(ids)
                    size += len(ids)
                    if size > 1 << 21 or k + 1 == len(r.docs):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "start", "n_tokens", "ids"])
                        rows, size = [], 0
                r.close()

    return jobs.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op1_token_frames(spark, sf_dir):
    """Writes the ids of every whole document into shards and reads them back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    docs = read(spark, sf_dir, "documents")
    manifest = write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), shared_dir(spark, "tokens"), end_id=2)
    return read_tokens(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


