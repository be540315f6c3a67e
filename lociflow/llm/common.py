"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Raw text bytes that one block of documents is planned to hold.
BLOCK_BYTES = 16 << 20


def hash_pair(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes of the columns, as one 128-bit key."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit(0x5EED), *cols)]


#: Up to this many bytes of text blocks have their given size; beyond it they grow as the root of the input, up to MOST_GROWTH times that size.
STEADY_BYTES, MOST_GROWTH = 100 << 30, 8


def blocks_needed(docs: DataFrame, text_col: str, block_bytes: int = BLOCK_BYTES, least: int = 1) -> int:
    """How many blocks of about block_bytes the texts fill (one aggregate job).

    Blocks and buckets exchange a message for each pair, so both grow as the root of the input beyond STEADY_BYTES, until executors' memory bounds a block: at 100 TB
    blocks of 16 MB are 128 MB each, some 800,000, and a message still holds tens of entries.
    """
    total = docs.agg(F.sum(F.octet_length(text_col).cast("long")).alias("n"), F.count(F.lit(1)).alias("k")).first()
    size = (total["n"] or 0) + 64 * total["k"]
    return max(least, -(-size // int(block_bytes * min(MOST_GROWTH, max(1.0, (size / STEADY_BYTES) ** 0.5)))))


def modest_batches(docs: DataFrame, rows: int = 1000) -> DataFrame:
    """docs; from now on its session sends Python at most `rows` rows at once, as texts are long: the default of 10,000 takes both sides tens of MB a task.

    The setting stays lower, as frames run later than they are made: it is this package's one lasting change to a session. Smaller values of the caller's stay.
    """
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", docs.sparkSession.conf
    if not 0 < int(conf.get(name, "10000")) <= rows:
        conf.set(name, str(rows))
    return docs


def sliced(batches, rows: int = 400):
    """Arrow batches cut into parts of at most `rows`, so that a task turns few texts at once into Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def compressed(batches):
    """Arrow batches with the text in the last column compressed (null as empty), the others as they are."""
    z = zstandard.ZstdCompressor(level=3)
    for batch in sliced(batches):
        packed = pa.array([z.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], packed], batch.schema.names)


def unpacked(column: pa.ChunkedArray):
    """The UTF-8 bytes of texts from compressed()."""
    z = zstandard.ZstdDecompressor()
    return (z.decompress(x.as_buffer()) for x in column)


#: Partitions that blocks or buckets are dealt to at most. A partition takes its groups one after the other, so memory follows a group, and the exchange's messages the partitions.
MOST_PARTITIONS = 4096


def dealt(rows: DataFrame, groups: int, by: str) -> DataFrame:
    """rows dealt by a column that numbers `groups` blocks or buckets, to as many partitions as there are groups, or to MOST_PARTITIONS."""
    return rows.repartition(max(1, min(groups, MOST_PARTITIONS)), by)


def dealt_in_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """block, id_col, z (compressed text) for each row, dealt to blocks of about block_bytes by a hash of id and text; and how many blocks there are.

    Texts make this one trip, at less than half their size; what needs a block's texts twice in a query shares the exchange.
    """
    blocks = blocks_needed(docs, text_col, block_bytes)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.pmod(F.xxhash64(id_col, text_col), F.lit(blocks)).cast("int").alias("block"), id_col, F.col(text_col).alias("z"))
    return dealt(rows.mapInArrow(compressed, f"block int, `{id_col}` {kind}, z binary"), blocks, "block"), blocks


def packed(x: np.ndarray) -> bytes:
    """An array's bytes, compressed."""
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 3)


def array_of(z: pa.Scalar, kind) -> np.ndarray:
    """The array of packed()."""
    return np.frombuffer(zstandard.decompress(z.as_buffer()), kind)


#: Bits of bitmaps for ids and hashes: 4 MB whatever the input. A bitmap helps as long as it is sparse: for up to some ten million ids or seeds; with more,
#: it lets ever more rows through to the exact join behind it, which stays right.
FILTER_BITS = 25
_CHUNK_BITS = 18


def bit_rows(slots: DataFrame) -> np.ndarray:
    """A bitmap of 2**FILTER_BITS bits with those set that the one column of slots (long) names: chunks of it are made in tasks, and the driver gets each chunk once."""

    def make(chunk: pa.Table) -> pa.Table:
        bits = np.zeros(1 << _CHUNK_BITS, np.uint8)
        bits[chunk.column("slot").to_numpy() & ((1 << _CHUNK_BITS) - 1)] = 1
        return pa.Table.from_arrays([chunk.column("chunk").slice(0, 1), pa.array([packed(np.packbits(bits, bitorder="little"))], pa.binary())], ["chunk", "bits"])

    rows = slots.toDF("slot").where(F.col("slot").isNotNull()).distinct().select(F.shiftright("slot", _CHUNK_BITS).cast("int").alias("chunk"), "slot")
    out, size = np.zeros(1 << FILTER_BITS >> 3, np.uint8), 1 << _CHUNK_BITS >> 3
    for row in rows.groupBy("chunk").applyInArrow(make, "chunk int, bits binary").collect():
        out[row["chunk"] * size : (row["chunk"] + 1) * size] = np.frombuffer(zstandard.decompress(row["bits"]), np.uint8)
    return out


def has_bit(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 > 0
