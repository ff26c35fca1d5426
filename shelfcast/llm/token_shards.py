"""Token ids in training order, as files of fixed-stride binary records.

Texts become ids, each ended by the end id, and a task's ids are laid one after the other and cut into sequences of ``stride``
ids; only a task's last sequence is padded. The sequences are numbered from 0
without gaps, and a keyed Feistel network maps the number to a slot: a permutation of the next power of
four, walked on until it lands inside the number of sequences. So the order is a permutation, is known
from the key alone, and needs no sort of random numbers and no table of its own. Slots are cut into ranges, the shards; a shard is
one file, sorted by slot. A record is its slot in eight bytes, the ids in two bytes each (four for vocabularies above 65,536) and one
more id that is always the padding, all little-endian. So slot s is at byte ``s % per_shard * record_bytes`` of the file of shard
``s // per_shard``: a reader seeks there, reads on, and can stop and go on anywhere (``read_records``). Spark reads the files in
splits of whole records, whatever a shard's size; that reader gives an RDD, the only one here (``read_shards``).

Folders under ``out``: ``records``, the files; ``pieces``, per slot what it holds: document, first id there, place in the record,
length; ``files``, per shard its file, first slot and number of records; ``layout``, one row, written last.

Cases: a null or empty text is the end id alone; repeated rows are pieces each; null identifiers are kept;
an empty table writes no file; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from shelfcast.llm import tokens
from shelfcast.llm.common import stored

STRIDE = 2048
PER_SHARD = 16_384
ROUNDS = 6
PAD_ID = 0
# tasks that write shards: beyond that, a task writes a range of shards, one after the other
MOST_WRITERS = 20_000
# records that a task holds before it hands them on
HELD = 1000
PIECE = "struct<doc_id: bigint, start: bigint, offset: int, n_tokens: int>"
LAYOUT = "n_records long, per_shard long, stride int, id_bytes int, record_bytes long, seed long"


def _mixed(x: np.ndarray, key: np.uint64) -> np.ndarray:
    """A 64-bit finaliser; the constants are its published ones."""
    x = (x + key).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(numbers: np.ndarray, count: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """The slot of each number under the keyed permutation of 0 .. count - 1."""
    half = max(1, (max(count - 1, 1).bit_length() + 1) // 2)
    shift, mask = np.uint64(half), np.uint64((1 << half) - 1)
    with np.errstate(over="ignore"):
        keys = _mixed(np.arange(1, rounds + 1, dtype=np.uint64), np.uint64(key % (1 << 64)))
        out = np.asarray(numbers).astype(np.uint64)
        walking = np.ones(len(out), dtype=bool)
        while walking.any():
            left, right = out[walking] >> shift, out[walking] & mask
            for k in keys:
                left, right = right, left ^ (_mixed(right, k) & mask)
            out[walking] = (left << shift) | right
            walking = out >= np.uint64(count)
    return out.astype(np.int64)


class Filler:
    """Records of ``stride`` ids, filled by one document after the other."""

    def __init__(self, stride: int, kind: str):
        self.stride, self.kind = stride, kind
        self.parts: list[np.ndarray] = []
        self.used = 0
        self._start()

    def _start(self) -> None:
        self.records: list[bytes] = []
        self.sums: list[int] = []
        self.ends = [0]
        self.pieces: tuple[list, list, list, list] = ([], [], [], [])

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            n = min(len(ids) - at, self.stride - self.used)
            for column, value in zip(self.pieces, (doc_id, at, self.used, n)):
                column.append(value)
            self.parts.append(ids[at : at + n])
            self.used += n
            at += n
            if self.used == self.stride:
                self.close()

    def close(self) -> None:
        """End the open record, padded if it is not full."""
        if self.used:
            self.parts.append(np.full(self.stride - self.used, PAD_ID, dtype=self.kind))
            self.records.append(np.concatenate(self.parts).tobytes())
            self.sums.append(zlib.crc32(self.records[-1]))
            self.ends.append(len(self.pieces[0]))
            self.parts, self.used = [], 0

    def taken(self) -> pa.RecordBatch:
        """The closed records; the pieces of an open one stay."""
        until = self.ends[-1]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        columns = [pa.array(c[:until], k) for c, k in zip(self.pieces, kinds)]
        inside = pa.StructArray.from_arrays(columns, ["doc_id", "start", "offset", "n_tokens"])
        lists = pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), inside)
        sums, records = pa.array(self.sums, pa.int64()), pa.array(self.records, pa.binary())
        batch = pa.RecordBatch.from_arrays([lists, sums, records], ["pieces", "record_crc32", "ids"])
        rest = tuple(c[until:] for c in self.pieces)
        self._start()
        self.pieces = rest
        return batch


def sequences(docs: DataFrame, path: str, key: str, text: str, stride: int) -> DataFrame:
    """The records of all documents and the pieces in each."""
    kind = id_type(path)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filler = Filler(stride, kind)
        for batch in batches:
            own = batch.column("doc_id").to_pylist()
            for i, ids in tokens.encoded(path, batch.column("text").to_pylist()):
                filler.add(own[i], np.append(ids, np.uint32(tokens.END_ID)).astype(kind))
                if len(filler.records) >= HELD:
                    yield filler.taken()
        filler.close()
        if filler.records:
            yield filler.taken()

    read = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return read.mapInArrow(cut, f"pieces array<{PIECE}>, record_crc32 long, ids binary")


def id_type(path: str) -> str:
    return "<u2" if tokens.worker_cache(path).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


def numbered(found: DataFrame) -> tuple[DataFrame, int]:
    """Stored sequences with numbers from 0 without gaps: the totals of earlier partitions plus the place in their own."""
    rows = stored(
        found.select("*", F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("at")), "sequences"
    )
    # one row for each task that wrote, so small enough to send to all: the records themselves stay where they are
    runs = rows.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("run", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    count = rows.count()
    number = (F.col("earlier") + F.col("at") - F.col("first")).alias("number")
    return rows.join(F.broadcast(starts), "run").select(number, "pieces", "record_crc32", "ids"), count


def write_shards(
    docs: DataFrame,
    out: str,
    seed: int,
    path: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    stride: int = STRIDE,
    per_shard: int = PER_SHARD,
) -> int:
    """Write the shards to ``out`` and return the number of sequences."""
    spark, path = docs.sparkSession, path or tokens.default_path()
    rows, count = numbered(sequences(docs, path, key, text, stride))
    id_bytes = np.dtype(id_type(path)).itemsize
    record_bytes = 8 + (stride + 1) * id_bytes

    def slots(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for numbers in batches:
            yield pd.Series(permuted(numbers.to_numpy(), count, seed))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Slots, and records compressed for the exchange."""
        codec = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            slot = permuted(batch.column("number").to_numpy(), count, seed)
            ids = pa.array([codec.compress(r.as_buffer()) for r in batch.column("ids")], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(slot // per_shard), ids], ["slot", "shard", "ids"])

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = zstandard.ZstdDecompressor()
        for batch in batches:
            heads = batch.column("slot").to_numpy().astype("<i8")
            value = [h.tobytes() + codec.decompress(r.as_buffer()) for h, r in zip(heads, batch.column("ids"))]
            places = [batch.column("shard"), batch.column("slot")]
            yield pa.RecordBatch.from_arrays([*places, pa.array(value, pa.binary())], ["shard", "slot", "value"])

    held = rows.select(F.pandas_udf(slots, "long")("number").alias("slot"), "pieces", "record_crc32")
    held.write.option("compression", "zstd").parquet(f"{out}/pieces")
    if count:
        shards = -(-count // per_shard)
        # slots are a permutation, so ranges of them are even without sampling
        each = -(-shards // MOST_WRITERS)
        (
            rows.select("number", "ids")
            .mapInArrow(packed, "slot long, shard long, ids binary")
            .repartitionById(-(-shards // each), F.floor(F.col("shard") / each).cast("int"))
            .mapInArrow(unpacked, "shard long, slot long, value binary")
            # the last step before the write, so that this is the order in the file
            .sortWithinPartitions("shard", "slot")
            # a line of text is its bytes as they are, and a line's end the id that ends a record
            .select("shard", F.col("value").cast("string").alias("value"))
            .write.partitionBy("shard")
            .option("lineSep", chr(PAD_ID) * id_bytes)
            .text(f"{out}/records")
        )
        files = spark.read.format("binaryFile").load(f"{out}/records")
        own = F.col("shard").cast("long")
        files.select(
            own.alias("shard"), "path", (own * per_shard).alias("first_slot"), F.expr(f"length div {record_bytes}").alias("n_records")
        ).write.parquet(f"{out}/files")
    layout = [(count, per_shard, stride, id_bytes, record_bytes, seed)]
    spark.createDataFrame(layout, LAYOUT).coalesce(1).write.json(f"{out}/layout")
    return count


def layout(spark: SparkSession, out: str) -> Row:
    """How the records of ``out`` lie."""
    return spark.read.schema(LAYOUT).json(f"{out}/layout").first()


def read_shards(spark: SparkSession, out: str, first_slot: int = 0) -> DataFrame:
    """The records of the files from ``first_slot`` on, with where they lie; only its shard and later ones are opened."""
    told, kind = layout(spark, out), "slot long, ids binary"
    if first_slot >= told.n_records:
        rows = spark.createDataFrame([], kind)
    else:
        first, last = first_slot // told.per_shard, (told.n_records - 1) // told.per_shard
        paths = [f"{out}/records/shard={k}" for k in range(first, last + 1)] if first else [f"{out}/records/*"]
        end = told.id_bytes

        def parts(records: Iterator[bytes]) -> Iterator[tuple[int, bytes]]:
            return ((int.from_bytes(r[:8], "little"), r[8:-end]) for r in records)

        found = spark.sparkContext.binaryRecords(",".join(paths), told.record_bytes).mapPartitions(parts)
        rows = spark.createDataFrame(found, kind, verifySchema=False).where(F.col("slot") >= first_slot)
    place = F.col("slot") % told.per_shard * told.record_bytes
    return rows.select("slot", F.expr(f"slot div {told.per_shard}").alias("shard"), place.alias("byte_offset"), "ids")


def read_pieces(spark: SparkSession, out: str) -> DataFrame:
    """One row per piece of a document: its record's slot and checksum, and the place there."""
    held = spark.read.schema(f"slot long, pieces array<{PIECE}>, record_crc32 long").parquet(f"{out}/pieces")
    return held.select("slot", "record_crc32", F.inline("pieces"))


def read_records(file: BinaryIO, slot: int, n: int, told: Row) -> np.ndarray:
    """Up to ``n`` records of an open shard file from ``slot`` on, with their slots: one seek, one read."""
    file.seek(slot % told.per_shard * told.record_bytes)
    ids = f"<u{told.id_bytes}"
    kind = np.dtype([("slot", "<i8"), ("ids", ids, told.stride), ("end", ids)])
    return np.frombuffer(file.read(n * told.record_bytes), kind)
