"""Best-fit packing of documents into fixed-length token sequences by large-item matching."""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociflow.llm.common import modest_batches, sliced
from lociflow.sources.shared import written

CAPACITY, END_ID = 1024, 2
#: Rows of one length that one task ranks, about.
RANKED_ROWS = 50_000


def _byte_of() -> dict[str, int]:
    """The byte that each printable stand-in of byte-level vocabularies means (the public bytes-to-unicode rule)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def tokenizer(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizers JSON file; its merge order is its id order, which tiktoken takes as ranks."""
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    special = {t["content"]: t["id"] for t in given.get("added_tokens", [])}
    byte_of = _byte_of()
    ranks = {bytes(byte_of[c] for c in token): i for token, i in given["model"]["vocab"].items() if token not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed: the byte-level pre-tokenizer's pattern
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


#: Runs of white space (as the pattern's \\s) that are too long for the pattern matcher's stack.
LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{20000,}")


def token_ids(text: str | None, path: str) -> list[int]:
    """The text's ids. Long runs of white space are cut out where the pattern would cut: all but the last character before a word, all before a special token or the end."""
    bpe = tokenizer(path)
    if not text:
        return []
    plain = (lambda t: bpe.encode(t, allowed_special="all")) if "<|" in text else bpe.encode_ordinary
    ids, at = [], 0
    for run in LONG_RUN.finditer(text):
        end = run.end() if run.end() == len(text) or text.startswith(tuple(bpe.special_tokens_set), run.end()) else run.end() - 1
        ids += plain(text[at : run.start()]) + bpe._encode_single_piece(text[run.start() : end])
        at = end
    return ids + plain(text[at:])


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Each document's ids with end_id behind, cut where longer than `capacity`: id_col, piece, start, length, ids_crc32 and, if asked for, ids.

    The first of several pieces takes the remainder, so all others are full. A null or empty text is the end id alone.
    """

    def cut(batches):
        for batch in sliced(batches):
            texts, at, rows = batch.column(1).to_pylist(), [], defaultdict(list)
            for i, text in enumerate(texts):
                ids = np.array([*token_ids(text, tokenizer_path), end_id], "<u4")
                ends = [*range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)]
                for piece, (a, b) in enumerate(zip([0, *ends], ends)):
                    at.append(i)
                    rows["piece"].append(piece)
                    rows["start"].append(a)
                    rows["length"].append(b - a)
                    rows["ids_crc32"].append(zlib.crc32(ids[a:b].tobytes()))
                    if with_ids:
                        rows["ids"].append(ids[a:b].astype("i4"))
            if at:
                columns = [batch.column(0).take(pa.array(at)), pa.array(rows["piece"], pa.int32()), *[pa.array(rows[c], pa.int64()) for c in ("start", "length", "ids_crc32")]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(rows["ids"], pa.list_(pa.int32()))] if with_ids else columns, [id_col, "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(cut, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit packing of counts[n] items of each length n, worked out on the counts alone.

    Items over a third of the capacity fit at most twice: the largest goes with the largest large one that still fits.
    Then the others, longest first, go to the fullest bin that takes them. Bins with equal contents are one pattern
    with a number, so the work depends on the number of lengths, not of items. Returns (length, low, high, sequence, times, offset):
    items of that length ranked low <= rank < high go, `times` to a sequence, to the sequences from `sequence` on, from `offset` on.
    """
    left = Counter({n: k for n, k in counts.items() if k})
    done: list[tuple[list[tuple[int, int]], int]] = []
    free: dict[int, list[tuple[list[tuple[int, int]], int]]] = defaultdict(list)

    def put(items, bins):
        gap = capacity - sum(n * t for n, t in items)
        if bins:
            (free[gap] if gap else done).append((items, bins))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        i = bisect_right(large, capacity - a) - 1
        if i < 0:
            put([(a, 1)], left[a])
            left[a] = 0
        elif (b := large[i]) == a:
            put([(a, 2)], left[a] // 2)
            left[a] %= 2
            if left[a]:  # the odd one takes the next that fits
                if i:
                    put([(a, 1), (large[i - 1], 1)], 1)
                    left[large[i - 1]] -= 1
                else:
                    put([(a, 1)], 1)
                left[a] = 0
        else:
            k = min(left[a], left[b])
            put([(a, 1), (b, 1)], k)
            left[a] -= k
            left[b] -= k
        large = [n for n in large if left[n]]
    for n in sorted((n for n in left if left[n]), reverse=True):
        while left[n]:
            gap = next((g for g in range(n, capacity) if free[g]), capacity)
            items, bins = free[gap].pop() if gap < capacity else ([], -(-left[n] // (capacity // n)))
            each = gap // n
            whole = min(bins, left[n] // each)
            put([*items, (n, each)], whole)
            left[n] -= whole * each
            if whole < bins and left[n]:
                put([*items, (n, left[n])], 1)
                left[n], whole = 0, whole + 1
            if items:
                put(items, bins - whole)
    ranked, sequence, out = Counter(), 0, []
    for items, bins in [*done, *(x for stack in free.values() for x in stack)]:
        offset = 0
        for n, times in items:
            out.append((n, ranked[n], ranked[n] + bins * times, sequence, times, offset))
            ranked[n] += bins * times
            offset += n * times
        sequence += bins
    return out


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (with a column length, 1 to capacity) with sequence_id and offset added; `pieces` must be a written table, as it is read twice.

    The plan needs only how many pieces have each length, `capacity` numbers at most, so it is made on the
    driver whatever the input's size. Pieces of one length are alike to it: each gets its rank among them, counted in buckets
    of rows so that a length which many share is ranked by many tasks, and the rank's place in the plan, a broadcast of a few
    rows for each length.
    """
    spark = pieces.sparkSession
    buckets = max(1, pieces.count() // RANKED_ROWS)
    keyed = pieces.withColumn("_row", F.monotonically_increasing_id()).withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(buckets)))
    sizes = keyed.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    assert len(counts) <= capacity and all(1 <= n <= capacity for n in counts)
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).drop("_n")
    ranked = keyed.withColumn("_nth", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("_row"))).join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_nth") - 1)
    plan = spark.createDataFrame(plan_bins(counts, capacity), "_length long, _low long, _high long, _seq long, _times long, _offset long")
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high")))
    nth = F.col("_rank") - F.col("_low")
    return placed.select(*pieces.columns, (F.col("_seq") + F.floor(nth / F.col("_times"))).cast("long").alias("sequence_id"), (F.col("_offset") + (nth % F.col("_times")) * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Each piece of each document with its place: id_col, piece, start, length, ids_crc32, (ids,) sequence_id, offset.

    Defined cases: a null or empty text is one piece, the end id; a null id is kept; repeated rows are packed
    each on their own; other columns are left out; an empty table gives no rows.
    """
    return pack_pieces(written(tokenize_pieces(modest_batches(docs), tokenizer_path, id_col, text_col, capacity, end_id, with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces with ids: sequence_id, ids (array of at most capacity ids), length."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids")).withColumn("length", F.size("ids"))


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
