"""Document fingerprints by a randomised edit embedding.

All texts are walked with the same coins: at step j, character c is emitted and the walk stays or moves on as coin[j, c] says.
After an edit, two walks fall in step again, so few edits leave most steps of two texts alike: edit distance
becomes Hamming distance between walks. A fingerprint samples that walk: for each of K samples the step with the lowest
shared random number among the walk's steps, and there an 8-bit hash of the characters ahead. Texts of about
equal length sample the same steps, whatever that length is.

Near texts are found exactly: the samples are cut into so many parts that near fingerprints agree in a whole one; those that do
are compared on their whole fingerprints.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.llm.common import blocks_needed, modest_batches, sliced
from lociflow.sources.shared import written

SAMPLES, AHEAD, PERIOD, SEED = 128, 8, 4096, 20250117
STOP = 255  # the class of the end of a text, where no coin moves the walk
BLOCK = 6 << 20
SAMPLED = 20  # ids a range, to choose ranges of ids
RANGES = 4096  # ranges of ids at most, whatever the number of blocks
LOT = 6 << 20  # characters that a task fingerprints at once
CROWD = 8192  # classes of a chunk, about


@lru_cache(maxsize=1)
def _coins() -> np.ndarray:
    coins = np.random.default_rng(SEED).integers(0, 2, (PERIOD, 256)).astype(np.int64)
    coins[:, STOP] = 0
    return coins


@lru_cache(maxsize=1)
def _records() -> dict[int, np.ndarray]:
    """For each step at which samples get a new lowest number: those samples, for walks of any length.

    A number is lower than the lowest so far, m, with probability m, and then evenly spread below it: so records are drawn one by one, not numbers step by step.
    """
    rng, out = np.random.default_rng(SEED + 1), {}
    for sample in range(SAMPLES):
        step, lowest = 0, rng.random()
        while step < 1 << 40:
            out.setdefault(step, []).append(sample)
            step += int(rng.geometric(max(lowest, 1e-15)))
            lowest *= rng.random()
    return {k: np.array(v) for k, v in out.items()}


def fingerprints(texts: list[str]) -> np.ndarray:
    """SAMPLES bytes for each text, from its whole walk; an empty text's are all 0, others' never."""
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)]).astype(np.int64)
    kind, ahead = np.full(starts[-1] + 1, STOP, np.uint8), np.zeros(starts[-1] + 1, np.uint8)
    for i, text in enumerate(texts):
        if not (n := len(text)):
            continue
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind[starts[i] : starts[i] + n] = (codes * np.uint32(0x9E3779B1) >> np.uint32(8)) % np.uint32(255)
        padded = np.concatenate([codes, np.zeros(AHEAD - 1, np.uint32)])
        h = np.zeros(n, np.uint32)
        for k in range(AHEAD):
            h = (h ^ padded[k : k + n]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
        ahead[starts[i] : starts[i] + n] = h % np.uint32(255) + np.uint32(1)
    out = np.zeros((len(texts), SAMPLES), np.uint8)
    order = np.flatnonzero(lengths)
    if not len(order):
        return out
    coins, records = _coins(), _records()
    pos, j = starts[order].copy(), 0
    seen, move = np.empty(len(pos), np.uint8), np.empty(len(pos), np.int64)
    while len(pos):
        for j in range(j, j + 128):
            np.take(kind, pos, out=seen, mode="clip")
            if (samples := records.get(j)) is not None:
                live = seen != STOP
                out[np.ix_(order[live], samples)] = ahead[pos[live], None]
            np.take(coins[j % PERIOD], seen, out=move, mode="clip")
            pos += move
        j += 1
        live = kind[pos] != STOP
        if not live.all():
            order, pos = order[live], pos[live]
            seen, move = np.empty(len(pos), np.uint8), np.empty(len(pos), np.int64)
    return out


def _beyond_chance(share: np.ndarray) -> np.ndarray:
    return np.clip((share - 1 / 255) / (1 - 1 / 255), 0, 1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples beyond what chance gives, 0 to 1."""
    return _beyond_chance((a == b).mean(-1))


def edited(text: str, following: str) -> str:
    """text with its last third replaced by as much of the following text's start, or by all of that."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fingerprint (hex) of each whole text. A null text counts as empty; repeated rows get equal fingerprints."""

    def apply(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                made = fingerprints([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f.tobytes().hex() for f in made], pa.string())], [id_col, "fingerprint"])

    return docs.select(id_col, text_col).mapInArrow(apply, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fingerprint string")


def fingerprint_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_ranges: int = RANGES) -> DataFrame:
    """Each text's fingerprint beside those of its edited text and of the next document, by descending id (after the last: the first).

    Returns id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Defined cases: a null text is empty; null ids come last and rows of equal ids have a fixed order by their
    texts; a single row is its own next; other columns are left out; an empty table gives no rows.

    Texts travel once, compressed, to `most_ranges` ranges of ids or fewer, whose bounds come from a bounded sample of ids (SAMPLED a range, taken by hash). Spark sorts a range by id, which may
    spill, and a task reads it in lots of about LOT characters, so memory doesn't depend on a range's size. The first document of the range below, found before by one aggregate, comes last in each.
    """
    ranges, ids = min(blocks_needed(modest_batches(docs), text_col, BLOCK), most_ranges), docs.select(F.col(id_col).cast("double").alias("_id"))
    known = ids.agg(F.count("_id").alias("n"), F.count(F.lit(1)).alias("of"), F.min("_id").alias("least")).first()
    share = min(1.0, 2.0 * SAMPLED * ranges / max(1, known["n"]))
    drawn = ids.where(F.col("_id").isNotNull() & (F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < share * (1 << 30))).limit(4 * SAMPLED * ranges)
    sample = np.sort(np.array([r[0] for r in drawn.collect()], np.float64))
    bounds = np.unique(sample[np.arange(1, ranges) * len(sample) // ranges]) if len(sample) and ranges > 1 else np.zeros(0)
    top, lowest = len(bounds), int(known["n"] == known["of"] and len(bounds) > 0 and known["least"] >= bounds[0])  # each bound is an id, so only the first range can be empty

    def placed(ids: pa.Array) -> np.ndarray:
        return np.searchsorted(bounds, ids.cast(pa.float64(), safe=False).fill_null(-np.inf).to_numpy(zero_copy_only=False), side="right")

    def deal(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in sliced(batches):
            packed = [squeeze.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(placed(batch.column(0)), pa.int32()), batch.column(0), pa.array(packed, pa.binary())], ["_range", id_col, "_z"])

    def first(batches):
        """Of each batch the rows with the highest id of their range."""
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in sliced(batches):
            at, own = placed(batch.column(0)), batch.column(0).to_pylist()
            highest: dict[int, object] = {}
            for r, i in zip(at, own):
                if r not in highest or (i is not None and (highest[r] is None or i > highest[r])):
                    highest[r] = i
            kept = np.array([k for k, (r, i) in enumerate(zip(at, own)) if i == highest[r]], np.int64)
            texts = batch.column(1).take(pa.array(kept)).to_pylist()
            packed = [squeeze.compress((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(at[kept], pa.int32()), batch.column(0).take(pa.array(kept)), pa.array(packed, pa.binary())], ["_range", id_col, "_z"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows, packed = docs.select(id_col, text_col), f"_range int, `{id_col}` {kind}, _z binary"
    heads = rows.mapInArrow(first, packed).groupBy("_range").agg(F.max(F.struct(id_col, "_z")).alias("head"))
    below = heads.select(F.when(F.col("_range") == top, lowest).otherwise(F.col("_range") + 1).cast("int").alias("_range"), F.lit(None).cast(kind).alias(id_col), F.col("head._z").alias("_z"), F.lit(1).alias("_last"))
    dealt = rows.mapInArrow(deal, packed).withColumn("_last", F.lit(0)).unionByName(below)
    ordered = dealt.repartition(ranges, "_range").sortWithinPartitions("_range", "_last", F.col(id_col).desc_nulls_last(), F.col("_z").desc())

    def made(ids: list, texts: list[str], of: pa.DataType) -> pa.RecordBatch:
        """Rows of ids, whose texts the first ones are; one more text follows them."""
        n, changed = len(ids), [edited(a, b) for a, b in zip(texts, texts[1:])]
        prints = fingerprints(texts + changed)
        own, nxt, other = prints[:n], prints[1 : n + 1], prints[n + 1 :]
        hexes = lambda x: pa.array([f.tobytes().hex() for f in x], pa.string())
        columns = [pa.array([len(t) for t in texts[:n]], pa.int64()), pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()), hexes(own), hexes(other), pa.array(likeness(own, other)), pa.array(likeness(own, nxt))]
        return pa.RecordBatch.from_arrays([pa.array(ids, of), *columns], [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def apply(batches):
        unpack, ids, texts, size = zstandard.ZstdDecompressor(), [], [], 0
        for batch in batches:
            of = batch.column(1).type
            for at, z, last in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                text = unpack.decompress(z).decode("utf-8", "surrogatepass")
                texts.append(text)
                if last:
                    yield made(ids, texts, of)
                    ids, texts, size = [], [], 0
                    continue
                ids.append(at)
                size += len(text)
                if size > LOT and len(ids) > 1:
                    yield made(ids[:-1], texts, of)
                    ids, texts, size = ids[-1:], texts[-1:], len(text)

    schema = f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(apply, schema)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Numbers of the runs of rows with equal values in all columns."""
    return np.cumsum(np.concatenate([[False], np.any([c[1:] != c[:-1] for c in columns], axis=0)]))


def parts_needed(threshold: float) -> tuple[int, np.ndarray]:
    """How many samples of two fingerprints are equal at least where their likeness reaches `threshold`, and the starts of parts of the samples, one more than samples that may differ.

    So two such fingerprints agree in all samples of one part at least.
    """
    reached = np.flatnonzero(_beyond_chance(np.arange(SAMPLES + 1) / SAMPLES) >= threshold)
    least = int(reached[0]) if len(reached) else SAMPLES + 1
    if not 0 < least <= SAMPLES:
        raise ValueError("threshold must be above 0, and 1 at most")
    parts = SAMPLES - least + 1
    return least, np.arange(parts) * SAMPLES // parts


def _links(prints: np.ndarray, cell: np.ndarray, side: np.ndarray, across: np.ndarray, part: np.ndarray, least: int, starts: np.ndarray):
    """Pairs of rows of a cell, each with its number of equal samples: those of `least` or more, where they first agree in the rows' part. Cells are runs of rows; where across, only pairs of two sides count."""
    for d in range(1, len(prints)):
        same = cell[d:] == cell[:-d]
        if not same.any():
            return
        i = np.flatnonzero(same & (~across[d:] | (side[d:] != side[:-d])))
        equal = prints[i] == prints[i + d]
        n = np.bitwise_count(np.packbits(equal, axis=1)).sum(1)
        near = np.flatnonzero(n >= least)
        if len(near):
            own = near[np.logical_and.reduceat(equal[near], starts, axis=1).argmax(1) == part[i[near]]]
            yield i[own], i[own] + d, n[own]


def near_links(prints: DataFrame, id_col: str = "doc_id", threshold: float = 0.8) -> DataFrame:
    """The classes of equal fingerprints and all their near ones: fingerprint, class_id (lowest id), near_id and near_score (the nearest class of `threshold` or more, of equal ones that of the highest id, or null), n_verified (how many classes are as near as that).

    No link is lost: the samples are cut into one part more than may differ at the threshold (26 at 0.8), so near classes agree in all samples of some part. All that agree in a part are compared
    with each other on whole fingerprints, and a pair counts in the first part in which it agrees. Parts that more than CROWD classes share are cut into chunks of about that many, and
    each two chunks meet in a cell of their own, so no task holds a part's classes; what a cell hands on is each class's number of links and its nearest one, not its links. The work grows as the square of
    the classes that share a part.

    Defined cases: rows with a null fingerprint or id are left out; rows of an equal fingerprint are one class, whatever their texts; an empty table gives no rows.
    Membership is by fingerprint, so copies need no pairs.
    """
    kind = prints.schema[id_col].dataType.simpleString()
    least, starts = parts_needed(threshold)
    known = prints.where(F.col("fingerprint").isNotNull() & F.col(id_col).isNotNull())
    classes = written(known.groupBy("fingerprint").agg(F.min(id_col).alias("class_id")), "classes")

    def compare(batches):
        held: list[pa.RecordBatch] = []

        def told(rows: pa.Table) -> pa.RecordBatch:
            part, key, lo, hi, side = (rows.column(k).to_numpy() for k in range(5))
            ids = rows.column("class_id").combine_chunks()
            made = np.frombuffer(b"".join(rows.column("_z").to_pylist()), np.uint8).reshape(-1, SAMPLES)
            by_id = pa.compute.sort_indices(ids).to_numpy()
            rank, n, best = np.empty(len(ids), np.int64), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            rank[by_id] = np.arange(len(ids))
            for a, b, equal in _links(made, _runs(part, key, lo, hi), side, lo != hi, part, least, starts):
                for x, y in ((a, b), (b, a)):
                    n += np.bincount(x, minlength=len(n))
                    np.maximum.at(best, x, equal.astype(np.int64) << 32 | rank[y])
            some = np.flatnonzero(n)
            near = _beyond_chance((best[some] >> 32) / SAMPLES)
            return pa.RecordBatch.from_arrays([ids.take(pa.array(some)), ids.take(pa.array(by_id[best[some] & 0xFFFFFFFF])), pa.array(near), pa.array(n[some])], ["class_id", "near_id", "near", "n"])

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) < CROWD:
                continue
            rows = pa.Table.from_batches(held)
            last = _runs(*(rows.column(k).to_numpy() for k in range(4)))
            whole = int(np.searchsorted(last, last[-1]))  # the last cell may go on
            if whole:
                yield told(rows.slice(0, whole))
                held = rows.slice(whole).combine_chunks().to_batches()
        if held:
            yield told(pa.Table.from_batches(held))

    hashes = [F.xxhash64(F.substring("fingerprint", int(2 * a + 1), int(2 * (b - a)))) for a, b in zip(starts, [*starts[1:], SAMPLES])]
    banded = classes.select("class_id", F.posexplode(F.array(*hashes)).alias("part", "key"))
    shared = banded.join(banded.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), ["part", "key"])
    chunks = F.ceil(F.col("n") / CROWD)
    members = shared.withColumns({"chunks": chunks, "side": F.pmod(F.xxhash64("class_id", "part"), chunks)}).join(classes.select("class_id", F.unhex("fingerprint").alias("_z")), "class_id")
    met = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    cell = ["part", "key", "lo", "hi"]
    cells = met.select("part", "key", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "class_id", "_z").repartition(*cell).sortWithinPartitions(*cell)
    linked = cells.mapInArrow(compare, f"class_id {kind}, near_id {kind}, near double, n long")
    best = linked.groupBy("class_id").agg(F.max(F.struct("near", "near_id")).alias("m"), F.sum("n").alias("n_verified"))
    return classes.join(best, "class_id", "left").select("fingerprint", "class_id", F.col("m.near_id").alias("near_id"), F.col("m.near").alias("near_score"), F.coalesce("n_verified", F.lit(0).cast("long")).alias("n_verified"))


def op6_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, how near those and the next documents' are, and each document's class with the nearest other one and how many are near."""
    prints = written(fingerprint_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet")), "prints")
    return prints.join(near_links(prints), "fingerprint", "left").select(*prints.columns, "class_id", "near_id", "near_score", "n_verified")
