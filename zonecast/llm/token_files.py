"""Token-id files of patched frame-of-reference blocks.

A shard holds the ids of consecutive documents in blocks of `BLOCK` ids. Of a block its smallest id is subtracted, what is left is
packed at the smallest width that holds 90 % of its values, and the high bits of the rest go to an exception list with their
places. An index holds for each block its minimum, width, number of exceptions and where it starts, so any range of ids is
read from its own blocks.

Shard: magic, 3 counts (documents, ids, blocks; uint64); a document each: id (int64), has an id (uint8), ids (uint32);
a block each: minimum (uint32), width (uint8), exceptions (uint8), first byte (uint64); packed words (uint32); exceptions: place
in the block (uint8) and high bits (uint32), block by block. All little-endian.

`write` orders documents by id over the whole table (range partitions, one shard each) and writes to the cluster's shared folder
under a name that depends on the partition alone; a task that is run again replaces its own file by the same bytes.

Defined results: a null text is an empty document and still has its end id; null ids come first; rows that share an id are
ordered by text; an empty table writes no shard.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonecast.llm.common import map_rows, schema
from zonecast.llm.tokens import encoder
from zonecast.session import materialize, scratch_root

MAGIC = b"PFORIDS1"
#: Ids after which a shard is closed: 64 MB of them, a few times less once packed.
SHARD_IDS = 1 << 24
BLOCK = 128
PERCENTILE = 90
SLICE = 4096
_LANES = 32  # values packed together: 32 values of w bits fill w words


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 32 values below 2**width as rows of `width` words."""
    out = np.zeros((len(values), width), "<u4")
    for lane in range(_LANES):
        word, shift = divmod(lane * width, 32)
        out[:, word] |= values[:, lane] << np.uint32(shift)
        if shift + width > 32:
            out[:, word + 1] |= values[:, lane] >> np.uint32(32 - shift)
    return out


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    out = np.empty((len(words), _LANES), "<u4")
    mask = np.uint32((1 << width) - 1)
    for lane in range(_LANES):
        word, shift = divmod(lane * width, 32)
        value = words[:, word] >> np.uint32(shift)
        if shift + width > 32:
            value = value | words[:, word + 1] << np.uint32(32 - shift)
        out[:, lane] = value & mask
    return out


def encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """minimum, width, exceptions and first byte of each block, and the parts of the payload.

    Works on SLICE blocks at a time, so that its own arrays stay small beside the ids.
    """
    parts = [_encode_slice(ids[at : at + SLICE * BLOCK]) for at in range(0, len(ids), SLICE * BLOCK)] or [_encode_slice(ids)]
    low, width, odd = (np.concatenate([p[i] for p in parts]) for i in range(3))
    size = width.astype("<u8") * np.uint64(BLOCK // 8)
    start = np.cumsum(size, dtype="<u8") - size
    return low, width, odd, start, [p[i] for i in (3, 4, 5) for p in parts]


def _encode_slice(ids: np.ndarray) -> tuple:
    """minimum, width and exceptions of each block; packed words, places and high bits as bytes."""
    n = -(-len(ids) // BLOCK)
    if len(ids) % BLOCK:
        ids = np.concatenate([ids, np.full(n * BLOCK - len(ids), ids[-1], "<u4")])
    grid = ids.reshape(n, BLOCK)
    low = grid.min(axis=1) if n else np.zeros(0, "<u4")
    grid = grid - low[:, None]
    # frexp's exponent of an integer is its number of bits (0 for 0)
    at = np.sort(grid, axis=1)[:, BLOCK * PERCENTILE // 100 - 1] if n else low
    width = np.frexp(at.astype(np.float64))[1].astype(np.uint8)
    high = np.where((width < 32)[:, None], grid >> np.minimum(width, 31).astype("<u4")[:, None], 0)
    row, place = np.nonzero(high)
    odd = np.bincount(row, minlength=n).astype(np.uint8)
    words = width.astype(np.int64) * (BLOCK // 32)
    start = np.cumsum(words) - words
    payload = np.zeros(int(words.sum()), "<u4")
    for w in np.unique(width):
        if w:
            rows = np.nonzero(width == w)[0]
            part = grid[rows] & np.uint32((1 << int(w)) - 1)
            packed = _pack(part.reshape(-1, _LANES), int(w)).reshape(len(rows), -1)
            payload[start[rows][:, None] + np.arange(packed.shape[1])] = packed
    return low, width, odd, payload.tobytes(), place.astype(np.uint8).tobytes(), high[row, place].astype("<u4").tobytes()


def encode_shard(doc_ids: list[int | None], parts: list[bytes]) -> bytes:
    ids = np.frombuffer(b"".join(parts), "<u4")
    low, width, odd, start, payload = encode_blocks(ids)
    head = np.array([len(parts), len(ids), len(low)], "<u8").tobytes()
    known = np.array([d is not None for d in doc_ids], np.uint8)
    names = np.array([d or 0 for d in doc_ids], "<i8")
    sizes = np.array([len(p) // 4 for p in parts], "<u4")
    return b"".join([MAGIC, head, names.tobytes(), known.tobytes(), sizes.tobytes(), low.tobytes(), width.tobytes(), odd.tobytes(), start.tobytes(), *payload])


class Shard:
    """Reads a shard's documents, or any range of its ids."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token-id shard")
        docs, self.n_ids, blocks = (int(x) for x in np.frombuffer(data, "<u8", 3, 8))
        self._data, self._at = data, 32
        self.doc_ids, known, self.sizes = self._take("<i8", docs), self._take("u1", docs), self._take("<u4", docs)
        self.known = known.astype(bool)
        self._low, self._width, self._odd, self._start = (self._take(k, blocks) for k in ("<u4", "u1", "u1", "<u8"))
        self._words = self._take("<u4", int(self._width.astype(np.int64).sum()) * (BLOCK // 32))
        self._odd_end = np.cumsum(self._odd.astype(np.int64))
        n = int(self._odd_end[-1]) if blocks else 0
        self._places, self._high = self._take("u1", n), self._take("<u4", n)

    def _take(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self._data, kind, n, self._at)
        self._at += out.nbytes
        return out

    def blocks(self, first: int, last: int) -> np.ndarray:
        """Ids of the blocks [first, last)."""
        width, start = self._width[first:last], self._start[first:last]
        grid = np.zeros((last - first, BLOCK), "<u4")
        for w in np.unique(width):
            if w:
                rows = np.nonzero(width == w)[0]
                at = (start[rows] // 4).astype(np.int64)[:, None] + np.arange(int(w) * (BLOCK // 32))
                grid[rows] = _unpack(self._words[at].reshape(-1, int(w)), int(w)).reshape(len(rows), BLOCK)
        odd = self._odd[first:last]
        end = int(self._odd_end[last - 1]) if last else 0
        begin = end - int(odd.astype(np.int64).sum())
        rows = np.repeat(np.arange(last - first), odd)
        grid[rows, self._places[begin:end]] |= self._high[begin:end] << width[rows].astype("<u4")
        return (grid + self._low[first:last, None]).reshape(-1)

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if stop <= start:
            return np.zeros(0, "<u4")
        first = start // BLOCK
        return self.blocks(first, -(-stop // BLOCK))[start - first * BLOCK : stop - first * BLOCK]


def write(
    docs: DataFrame, path: str, end_id: int, folder: str | None = None, parts: int | None = None, shard_ids: int = SHARD_IDS
) -> tuple[str, DataFrame]:
    """Encode `docs(doc_id, text)` and write its shards in ascending doc_id order.

    A task writes its range of documents as one shard after the other, each closed once it has `shard_ids` ids, which bounds what a task
    holds and a file has (but for a single longer document). Rows of one doc_id may lie in several ranges, ordered by a hash of the text. Returns the
    folder and its manifest `shard, file, n_docs, n_ids, first_id`, where first_id is the number of ids in the shards before.
    """
    spark = docs.sparkSession
    folder = folder or f"{scratch_root(spark)}/token-files-{uuid.uuid4().hex}"
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # rows of one id are told apart by a hash: range bounds are drawn from the keys, and a key must not hold a text
    rows = rows.withColumn("_tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_tie").asc()]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_tie")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode, end = encoder(path), np.array([end_id], "<u4").tobytes()
        part_id, n_shards, names, held, size = TaskContext.get().partitionId(), 0, [], [], 0

        def close():
            shard = (part_id << 32) + n_shards
            file = f"{part_id:08d}-{n_shards:08d}.pfor"
            _save(folder, file, encode_shard(names, held))
            return pa.RecordBatch.from_pydict({"shard": [shard], "file": [file], "n_docs": [len(names)], "n_ids": [size]}, schema=kind)

        kind = pa.schema([("shard", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64).to_pydict()
                for doc_id, ids in zip(part["doc_id"], encode(part["text"])):
                    names.append(doc_id)
                    held.append(ids + end)
                    size += len(held[-1]) // 4
                    if size >= shard_ids:
                        yield close()
                        n_shards, names, held, size = n_shards + 1, [], [], 0
        if names:
            yield close()

    manifest = materialize(rows.mapInArrow(run, "shard long, file string, n_docs long, n_ids long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    return folder, manifest.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _save(folder: str, file: str, data: bytes) -> None:
    """Write under a name of this attempt, then move to the final name, so that a reader never sees half a shard."""
    from pyarrow import fs

    store, top = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    store.create_dir(top, recursive=True)
    draft = f"{top}/.{file}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        out.write(data)
    store.move(draft, f"{top}/{file}")


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """One row per document, from the files alone but for the shards' places: doc_id, start, n_tokens, ids_crc32, ids."""
    def make():
        def work(rows: dict) -> dict:
            out = {k: [] for k in ("doc_id", "start", "n_tokens", "ids_crc32", "ids")}
            for content, first in zip(rows["content"], rows["first_id"]):
                shard = Shard(content)
                ids, at = shard.ids().tobytes(), 0
                for doc_id, known, n in zip(shard.doc_ids.tolist(), shard.known.tolist(), shard.sizes.tolist()):
                    part = ids[4 * at : 4 * (at + n)]
                    for k, v in zip(out, (doc_id if known else None, first + at, n, zlib.crc32(part), part)):
                        out[k].append(v)
                    at += n
            return out

        return work

    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
    files = spark.read.format("binaryFile").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    files = files.join(F.broadcast(manifest.select("file", "first_id")), "file")  # a row per shard
    return map_rows(files.select("content", "first_id"), make, schema("doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"), size=1)
