"""Substring dedup: repeated windows of words, found by super-k-mers that share a minimiser."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.llm.common import array_of, dealt, dealt_in_blocks, modest_batches, packed, sliced, unpacked
from lociflow.llm.words import _BASE, _BASE_INVERSE, _power_table, mixed, ngrams, parts, single_spaced, slices, Words, words_of

WINDOW, MINIMISER = 13, 3
CELL_BITS, HOT_SHARE = 20, 1e-4
BLOCK = 12 << 20
LAST_ID = np.iinfo(np.int64).max


def _cells(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def hot_cells(docs: DataFrame, text_col: str, minimiser: int) -> np.ndarray:
    """A bitmap of fixed size: which of 2**CELL_BITS cells of word runs hold more than HOT_SHARE of all runs.

    A cell that is so frequent in all is so in some task, so each task reports only its own frequent ones.
    """

    def count(batches):
        n = np.zeros(1 << CELL_BITS, np.int64)
        for batch in sliced(batches):
            for _, run in parts((t or "").encode("utf-8", "surrogatepass") for t in batch.column(0).to_pylist()):
                n += np.bincount(_cells(ngrams(words_of(run), minimiser)[1]), minlength=len(n))
        cells = np.flatnonzero(n > n.sum() * HOT_SHARE)
        yield pa.RecordBatch.from_arrays([pa.array([*cells.tolist(), -1], pa.int32()), pa.array([*n[cells].tolist(), int(n.sum())], pa.int64())], ["cell", "n"])

    found = docs.select(text_col).mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    total = found.where("cell < 0").first()
    hot = np.zeros(1 << CELL_BITS, bool)
    if total and total["n"]:
        hot[[r["cell"] for r in found.where((F.col("cell") >= 0) & (F.col("n") > total["n"] * HOT_SHARE / 2)).select("cell").collect()]] = True
    return hot


def super_kmers(words: Words, hot: np.ndarray, window: int, minimiser: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The longest runs of a text's windows with one minimiser: the first word, the word behind the last, the minimiser.

    A window's minimiser is the lowest hash of its runs of `minimiser` words, the hot ones last; so it depends on the window's words alone, and
    a phrase that is everywhere seldom is one.
    """
    at, h = ngrams(words, minimiser)
    value = np.full(len(words.hash) + window, np.iinfo(np.uint64).max, np.uint64)
    value[at] = (h >> np.uint64(1)) | (hot[_cells(h)].astype(np.uint64) << np.uint64(63))
    span, low = 1, value
    runs = window - minimiser + 1
    while span * 2 <= runs:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    low = np.minimum(low[: len(low) - (runs - span)], low[runs - span :]) if runs > span else low
    at = ngrams(words, window)[0]
    low = low[at]
    new = np.ones(len(at), bool)
    new[1:] = (low[1:] != low[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1 if len(first) else first
    return at[first], at[last] + window, low[first]


def run_keys(h: np.ndarray, first: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """A 64-bit hash of all of h[first:behind] in order, for each pair."""
    upto = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _power_table(_BASE, len(h)), out=upto[1:])
    return mixed((upto[behind] - upto[first]) * _power_table(_BASE_INVERSE, max(1, len(h)))[first]) + (behind - first).astype(np.uint64)


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, minimiser: int = MINIMISER) -> DataFrame:
    """Each text without the words that a smaller id's document has in a window too: id_col, n_words, n_removed, kept (the words left, joined by one space).

    A window is `window` words in a row; a word goes if some window over it, in the input, also starts in a document with a smaller id. Ids are integers.

    Defined cases: a null or empty text has no words; texts shorter than a window lose nothing; a null id is larger than all others; rows
    with equal ids don't remove each other's words, only smaller ids' do; repeats within one text stay; other columns are left out; an empty table gives no rows.

    Texts travel once, compressed, to blocks. A block sends each distinct super-k-mer (all its windows count) once, as text, to its minimiser's
    bucket with the lowest and highest id that hold it, so copies and passages that very many documents share
    arrive once for each block. A bucket sorts its windows and answers a block only for windows that a smaller id holds.
    Windows are compared by 128 bits in buckets, answers applied by 64 bits within a block.
    """
    hot = docs.sparkSession.sparkContext.broadcast(hot_cells(modest_batches(docs), text_col, minimiser))
    held, blocks = dealt_in_blocks(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "id", "text", BLOCK)
    buckets = 2 * blocks

    def ids_of(table: pa.Table) -> np.ndarray:
        return table.column("id").fill_null(LAST_ID).to_numpy()

    def send(block: pa.Table) -> pa.Table:
        ids, number = ids_of(block), block.column("block")[0].as_py()
        rows: dict[int, list] = {}
        for first, run in parts(unpacked(block.column("z"))):
            words = words_of(run)
            a, b, low = super_kmers(words, hot.value, window, minimiser)
            if not len(a):
                continue
            data, start, end = single_spaced(words)
            at, h = ngrams(words, window)
            index = np.zeros(len(words.hash), np.int64)
            index[at] = np.arange(len(at))
            key = run_keys(h, index[a], index[b - window] + 1)
            bucket = ((low & np.uint64((1 << 62) - 1)) % np.uint64(buckets)).astype(np.int64)
            owner = ids[first + words.text_of()[a]]
            order = np.lexsort((key, bucket))
            new = np.ones(len(order), bool)
            new[1:] = key[order][1:] != key[order][:-1]
            heads = np.flatnonzero(new)
            least, most = np.minimum.reduceat(owner[order], heads), np.maximum.reduceat(owner[order], heads)
            pick = order[heads]
            edges = np.flatnonzero(np.diff(bucket[pick], prepend=-1))
            for lo, hi in zip(edges, [*edges[1:], len(pick)]):
                s = pick[lo:hi]
                rows.setdefault(int(bucket[s[0]]), []).append((slices(data, start[a[s]], end[b[s] - 1], 0x0A), (b - a)[s].astype(np.int32), least[lo:hi], most[lo:hi]))
        keys = sorted(rows)
        columns = [[packed(np.concatenate([x[k] for x in rows[key]])) for key in keys] for k in range(4)]
        return pa.Table.from_arrays([pa.array(keys, pa.int32()), pa.array(np.full(len(keys), number, np.int32)), *[pa.array(c, pa.binary()) for c in columns]], ["bucket", "block", "texts", "words", "least", "most"])

    def answer(bucket: pa.Table) -> pa.Table:
        hashes, others, least, most, whose = [], [], [], [], []
        for texts, counts, lo, hi, block in zip(*[bucket.column(c) for c in ("texts", "words", "least", "most", "block")]):
            counts = array_of(counts, np.int32).astype(np.int64)
            words = words_of([array_of(texts, np.uint8).tobytes()])
            words.first = np.concatenate([[0], np.cumsum(counts)])
            at, h = ngrams(words, window)
            owner = words.text_of()[at]
            hashes.append(h)
            others.append(ngrams(words, window, salt=1)[1])
            least.append(array_of(lo, np.int64)[owner])
            most.append(array_of(hi, np.int64)[owner])
            whose.append(np.full(len(h), block.as_py(), np.int32))
        hashes, others, least, most, whose = (np.concatenate(x) for x in (hashes, others, least, most, whose))
        order = np.lexsort((others, hashes))
        new = np.ones(len(order), bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (others[order][1:] != others[order][:-1])
        lowest = np.minimum.reduceat(least[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        told = np.flatnonzero(lowest < most[order])
        told = told[np.argsort(whose[order[told]], kind="stable")]
        owner = whose[order[told]]
        edges = np.flatnonzero(np.diff(owner, prepend=-1))
        ends = [*edges[1:], len(told)]
        columns = [[packed(x[a:b]) for a, b in zip(edges, ends)] for x in (hashes[order[told]], lowest[told])]
        return pa.Table.from_arrays([pa.array(owner[edges], pa.int32()), *[pa.array(c, pa.binary()) for c in columns]], ["block", "windows", "lowest"])

    def remove(block: pa.Table, answers: pa.Table) -> pa.Table:
        ids = ids_of(block)
        windows = np.concatenate([np.zeros(0, np.uint64), *[array_of(z, np.uint64) for z in answers.column("windows")]])
        lowest = np.concatenate([np.zeros(0, np.int64), *[array_of(z, np.int64) for z in answers.column("lowest")]])
        windows, one = np.unique(windows, return_index=True)
        lowest = lowest[one]
        total, removed, kept = [], [], []
        for first, run in parts(unpacked(block.column("z"))):
            words = words_of(run)
            at, h = ngrams(words, window)
            gone = np.zeros(len(words.hash) + 1, np.int64)
            if len(windows) and len(at):
                i = np.minimum(np.searchsorted(windows, h), len(windows) - 1)
                hit = at[(windows[i] == h) & (lowest[i] < ids[first + words.text_of()[at]])]
                np.add.at(gone, hit, 1)
                np.add.at(gone, hit + window, -1)
            gone = np.cumsum(gone)[:-1] > 0
            data, start, end = single_spaced(words)
            stay = np.repeat(~gone, end - start + 1)
            data = data[stay]
            length = np.concatenate([[0], np.cumsum((end - start + 1) * ~gone)])
            out = np.concatenate([[0], np.cumsum(gone)])
            for a, b in zip(words.first[:-1], words.first[1:]):
                total.append(int(b - a))
                removed.append(int(out[b] - out[a]))
                kept.append(data[length[a] : max(length[a], length[b] - 1)].tobytes().decode("utf-8", "surrogatepass"))
        return pa.Table.from_arrays([block.column("id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept"])

    sent = held.groupBy("block").applyInArrow(send, "bucket int, block int, texts binary, words binary, least binary, most binary")
    answers = dealt(sent, buckets, "bucket").groupBy("bucket").applyInArrow(answer, "block int, windows binary, lowest binary")
    out = held.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(remove, "id long, n_words long, n_removed long, kept string")
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_words", "n_removed", "kept")


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without words that smaller documents repeat: doc_id, n_words, n_removed, kept_sha256."""
    return repeated_words(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
