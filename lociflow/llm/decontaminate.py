"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of the passages around them."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociflow.llm.common import bit_rows, FILTER_BITS, has_bit, hash_pair, modest_batches, sliced
from lociflow.llm.words import _MULTIPLIERS, mixed, ngrams, parts, words_of
from lociflow.sources.shared import written

SEED_WORDS = 3
#: Three words of four in a row of an item, and of five in a row of a text (one more may stand between them).
ITEM_OFFSETS = (0, 1, 2), (0, 1, 3), (0, 2, 3)
TEXT_OFFSETS = (0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4)
GAP, MISMATCH = 0.5, 0.5
STRETCH = 8192  # words of a passage aligned at once


def _lower(texts: list[str | None]) -> list[bytes]:
    return [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]


def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << FILTER_BITS) - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)


def spaced(words, offsets: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Where each choice of a text's words at the given offsets starts (word index), and its hash, which doesn't depend on the offsets."""
    total = len(words.hash) - offsets[-1]
    if total <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(total, np.uint64)
    for k, o in enumerate(offsets):
        h += words.hash[o : o + total] * _MULTIPLIERS[k]
    at = np.arange(total)
    whole = at + offsets[-1] < words.first[1:][words.text_of()[:total]]
    return at[whole], mixed(h[whole])


def least_shared(words: int, threshold: float) -> int:
    """How many seeds an item of so many words shares at least with a copy that scores `threshold` after changed or dropped words.

    Such a copy keeps so many words that (2 threshold - 0.5) / 1.5 of the item's stretches of four words, less three at its ends, have three kept ones or more, and each seed stands for two
    stretches at most.
    """
    return max(1, -int(-((2 * threshold - 0.5) / 1.5 * words - 3) // 2))


def kind_of(words: int, threshold: float) -> tuple[int, int]:
    """Items that are looked for together: (how many seeds they must share, up to 4; a power of two above their length, for those of 4). (0, words) where the text itself is the seed."""
    if words < SEED_WORDS:
        return 0, words
    need = min(4, least_shared(words, threshold))
    return need, words.bit_length() if need == 4 else 0


def item_seeds(benchmark: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """item, words (how many the item has), need and size (kind_of()), seed, for each distinct seed of each item; items of fewer than three words give their whole text."""

    def make(batches):
        for batch in batches:
            at, counts, kinds, seeds = [], [], [], []
            for k, text in enumerate(_lower(batch.column(1).to_pylist())):
                words = words_of([text])
                if m := len(words.hash):
                    found = [spaced(words, o)[1] for o in ITEM_OFFSETS] if m >= SEED_WORDS else [ngrams(words, m)[1]]
                    own = np.unique(np.concatenate(found))
                    at += [k] * len(own)
                    counts += [m] * len(own)
                    kinds += [kind_of(m, threshold)] * len(own)
                    seeds.append(own)
            flat = np.concatenate(seeds).view(np.int64) if seeds else np.zeros(0, np.int64)
            told = [pa.array(counts, pa.int32()), *(pa.array([x[i] for x in kinds], pa.int32()) for i in (0, 1)), pa.array(flat)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *told], ["item", "words", "need", "size", "seed"])

    kind = benchmark.schema[id_col].dataType.simpleString()
    return benchmark.select(id_col, text_col).mapInArrow(make, f"item {kind}, words int, need int, size int, seed long").distinct()


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """A bitmap of fixed size that has two bits for each seed, and lets few other hashes through."""
    low, high = F.col("seed").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)), F.shiftright("seed", 32).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    return bit_rows(seeds.select(F.explode(F.array(low, high)).alias("slot")))


def _hits(found, bits):
    """Word indexes and hashes of the seeds, of those found, that the filter lets through, in order."""
    kept = []
    for at, h in found:
        a, b = _slots(h)
        ok = has_bit(bits, a)
        ok[ok] = has_bit(bits, b[ok])
        kept.append((at[ok], h[ok]))
    at, h = (np.concatenate(x) for x in zip(*kept))
    order = np.argsort(at, kind="stable")
    return at[order], h[order]


def _close(at: np.ndarray, text: np.ndarray, need: int, span: int) -> np.ndarray:
    """Which hits stand among `need` hits of one text that start within `span` words."""
    out = np.zeros(len(at), bool)
    last = len(at) - need + 1
    if last > 0:
        first = np.flatnonzero((at[need - 1 :] - at[:last] <= span) & (text[need - 1 :] == text[:last]))
        for k in range(need):
            out[first + k] = True
    return out


def passages(docs: DataFrame, id_col: str, text_col: str, kinds: list[dict], bits) -> DataFrame:
    """id_col, need, size (the kind's), start (word index), passage (its words, lower case), seeds: for each kind of items the document's words around seeds of such items, hits that are near in one passage.

    Hits count where as many as the kind needs stand within the words that a copy can span (those of the longest item of the kind, and two gaps for each of its matches to spare).
    """

    def cut(batches):
        for batch in sliced(batches):
            at_row, starts, texts, found, told = [], [], [], [], []
            for first, run in parts(_lower(batch.column(1).to_pylist())):
                words = words_of(run)
                triples = [spaced(words, o) for o in TEXT_OFFSETS] if any(k["need"] for k in kinds) else []
                for kind, own in zip(kinds, bits.value):
                    margin = kind["words"]
                    at, h = _hits(triples if kind["need"] else [ngrams(words, kind["size"])], own)
                    text = words.text_of()[at]
                    near = _close(at, text, max(1, kind["need"]), 3 * margin)
                    at, h, text = at[near], h[near], text[near]
                    if not len(at):
                        continue
                    new = np.flatnonzero(np.diff(at, prepend=-1) > 2 * margin)
                    new = np.union1d(new, np.flatnonzero(np.diff(text, prepend=-1) > 0))
                    for a, b in zip(new, [*new[1:], len(at)]):
                        t = int(text[a])
                        lo, hi = max(int(at[a]) - margin, int(words.first[t])), min(int(at[b - 1]) + 1 + TEXT_OFFSETS[-1][-1] + margin, int(words.first[t + 1]))
                        at_row.append(first + t)
                        starts.append(lo - int(words.first[t]))
                        texts.append(words.bytes_between(lo, hi).decode("utf-8", "replace"))
                        found.append(np.unique(h[a:b]).view(np.int64))
                        told.append((kind["need"], kind["size"]))
            columns = [*(pa.array([x[i] for x in told], pa.int32()) for i in (0, 1)), pa.array(starts, pa.int64()), pa.array(texts, pa.string()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at_row, pa.int64())), *columns], [id_col, "need", "size", "start", "passage", "seeds"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(cut, f"`{id_col}` {kind}, need int, size int, start long, passage string, seeds array<long>")


def rare_seeds(seeds: DataFrame, spread: DataFrame, threshold: float) -> DataFrame:
    """item, need, size, seed, least: each item's seeds without its most frequent ones, and how many of the others a copy shares at least.

    Frequencies are counted over all distinct passages (spread: seed). A copy shares least_shared() seeds, so half as many of the most frequent ones may go, and no copy is lost.
    """
    known = seeds.join(spread.groupBy("seed").agg(F.count(F.lit(1)).alias("_n")), "seed", "left").withColumn("_nth", F.row_number().over(Window.partitionBy("item").orderBy(F.desc(F.coalesce("_n", F.lit(0))), "seed")))
    shared = F.when(F.col("words") < SEED_WORDS, 1).otherwise(F.greatest(F.lit(1), F.ceil(((2 * threshold - 0.5) / 1.5 * F.col("words") - 3) / 2)))
    gone = F.floor((shared - 1) / 2)
    return known.where(F.col("_nth") > gone).select("item", "need", "size", "seed", (shared - gone).alias("least"))


def split_words(text: str) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def align(item: list[str], passage: list[str]) -> tuple[float, int, int, int]:
    """Smith-Waterman over words: best local score (1 a match, less 0.5 a gap or mismatch) over the item's words, matched words, and the passage's aligned words [from, to)."""
    code: dict[str, int] = {}
    x = np.array([code.setdefault(w, len(code)) for w in item])
    y = np.array([code.setdefault(w, len(code)) for w in passage])
    if not len(x) or not len(y):
        return 0.0, 0, 0, 0
    slope = GAP * np.arange(1, len(y) + 1)
    table = np.zeros((len(x) + 1, len(y) + 1), np.float32)
    for i, w in enumerate(x):
        up = table[i]
        best = np.maximum(np.maximum(up[:-1] + np.where(y == w, 1.0, -MISMATCH), up[1:] - GAP), 0)
        table[i + 1, 1:] = np.maximum.accumulate(best + slope) - slope
    i, j = divmod(int(table.argmax()), len(y) + 1)
    score, matches, end = float(table[i, j]), 0, j
    while i and j and table[i, j] > 0:
        same = x[i - 1] == y[j - 1]
        if abs(table[i, j] - (table[i - 1, j - 1] + (1.0 if same else -MISMATCH))) < 1e-4:
            matches += int(same)
            i, j = i - 1, j - 1
        elif abs(table[i, j] - (table[i - 1, j] - GAP)) < 1e-4:
            i -= 1
        else:
            j -= 1
    return score / len(x), matches, j, end


def best_alignment(item: list[str], passage: list[str], threshold: float) -> tuple[float, int, int, int]:
    """align(), or zeros where the words that both have can't reach `threshold`. Long passages go in stretches that overlap by more words than a local alignment can span (as many matches as the item has words, two gaps each)."""
    if sum((Counter(item) & Counter(passage)).values()) < threshold * len(item):
        return 0.0, 0, 0, 0
    over, best = 3 * len(item), (0.0, 0, 0, 0)
    for at in range(0, max(1, len(passage) - over), STRETCH):
        score, matches, start, end = align(item, passage[at : at + STRETCH + over])
        best = max(best, (score, matches, at + start, at + end), key=lambda r: r[0])
    return best


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.4) -> DataFrame:
    """Which documents hold copies of which items, edited ones too: id_col, item, score, matched, from_word, to_word; the best passage for each pair.

    `score` is the Smith-Waterman score of the item's words against the document's passage, 1 for a whole copy; pairs of `threshold`
    or more count. Words are runs without white space, lower case. A seed is three of four words in a row of an item, and in a text three of five, so that words between them may be changed, dropped
    or put in. A passage is aligned with the items of which it holds as many seeds as their copies share at least, counted over the rarer seeds of each item; equal passages once.

    Defined cases: null or empty texts, of documents or items, match nothing; an item of fewer than three words is its own
    only seed; rows of an equal id count as one document; other columns are left out; an empty table on either side gives no rows.

    Nothing of the documents is kept back or moved but the words around seeds, as many as the longest item of a like length has. The broadcasts are a bitmap of fixed size for each of
    at most some twenty kinds of items. A passage that very many documents hold makes a frequent join key with a row for each item on the other side, which Spark broadcasts or splits.
    Items of up to 25 words are aligned after one shared seed; a copy of theirs that keeps only two words in a row is not looked for.
    """
    spark = modest_batches(docs).sparkSession
    seeds = written(item_seeds(benchmark, item_col, item_text_col, threshold), "seeds")
    kinds = [r.asDict() for r in seeds.groupBy("need", "size").agg(F.max("words").alias("words")).orderBy("need", "size").collect()]
    bits = [seed_filter(seeds.where((F.col("need") == k["need"]) & (F.col("size") == k["size"]))) for k in kinds]
    cut = passages(docs, id_col, text_col, kinds, spark.sparkContext.broadcast(bits))
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    k0, k1 = hash_pair(F.col("need"), F.col("size"), F.col("passage"), F.col("seeds"))
    keyed = written(cut.withColumns({"_k0": k0, "_k1": k1}), "passages")
    distinct = keyed.groupBy("_k0", "_k1").agg(*[F.first(c).alias(c) for c in ("need", "size", "passage", "seeds")])
    spread = written(distinct.select("_k0", "_k1", "need", "size", F.explode("seeds").alias("seed")), "spread")
    rare = rare_seeds(seeds, spread, threshold)
    pairs = spread.join(rare, ["need", "size", "seed"]).groupBy("_k0", "_k1", "item").agg(F.count(F.lit(1)).alias("n"), F.max("least").alias("least")).where("n >= least").select("_k0", "_k1", "item")
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("_item_text"))
    both = pairs.join(distinct.select("_k0", "_k1", "passage"), ["_k0", "_k1"]).join(items, "item")

    def score(batches):
        for batch in batches:
            rows = [best_alignment(split_words((x or "").lower()), split_words(y), threshold) for x, y in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            at, kept = pa.array([r[0] >= threshold for r in rows], pa.bool_()), [r for r in rows if r[0] >= threshold]
            told = [pa.array([r[i] for r in kept], t) for i, t in enumerate((pa.float64(), pa.int32(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(i).filter(at) for i in range(3)], *told], ["_k0", "_k1", "item", "score", "matched", "first", "last"])

    aligned = both.select("_k0", "_k1", "item", "_item_text", "passage").mapInArrow(score, f"_k0 long, _k1 long, item {item_kind}, score double, matched int, first long, last long")
    scored = keyed.select("_k0", "_k1", id_col, "start").join(written(aligned, "aligned"), ["_k0", "_k1"]).select(id_col, "item", "score", "matched", (F.col("start") + F.col("first")).alias("from_word"), (F.col("start") + F.col("last")).alias("to_word"))
    best = F.max(F.struct("score", (-F.col("from_word")).alias("back"), "matched", "to_word")).alias("b")
    return scored.groupBy(id_col, "item").agg(best).select(id_col, "item", "b.score", "b.matched", (-F.col("b.back")).alias("from_word"), "b.to_word")


def op7_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items: doc_id, item_id, score, matched, from_word, to_word."""
    leaks = find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return leaks.withColumnRenamed("item", "item_id")
