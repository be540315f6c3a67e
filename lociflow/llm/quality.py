"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model's units are characters and its order is 5, so that words no text has shown before still get a fair probability. Characters up to U+06FF (Latin, Greek,
Cyrillic, Hebrew, Arabic) are one unit, all others two: which 1,024 code points they lie in, and which of those they are. Five
units of 12 bits make one 64-bit number, its suffixes and contexts come by shifts, and all counts are tables that Spark joins by those numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociflow.llm.common import FILTER_BITS, array_of, bit_rows, blocks_needed, compressed, dealt, has_bit, hash_pair, modest_batches, packed, sliced, unpacked
from lociflow.llm.words import mixed
from lociflow.sources.shared import drop_written, written

ORDER, BITS = 5, 12
BEGIN = 1  # the unit before the text
NARROW, UPPER, LOWER = 0x700, 0x700, 0xC00  # code points that are their own unit; where the units of wide characters' halves begin
BLOCK = 16 << 20
PART = 1 << 19


def units_of(text: str) -> np.ndarray:
    """The text's units: one for each character below NARROW, two for each other one."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    wide = codes >= NARROW
    if not wide.any():
        return codes
    at = np.cumsum(1 + wide) - 1 - wide
    out = np.zeros(len(codes) + int(wide.sum()), np.int64)
    out[at] = np.where(wide, UPPER + (codes >> 10), codes)
    out[at[wide] + 1] = LOWER + (codes[wide] & 0x3FF)
    return out


def gram_runs(text: str):
    """The ORDER-grams that end at each of the text's units, as numbers, in runs of bounded size."""
    before = np.full(ORDER - 1, BEGIN, np.int64)
    for at in range(0, len(text), PART):
        padded = np.concatenate([before, units_of(text[at : at + PART])])
        before, n = padded[-(ORDER - 1) :], len(padded) - ORDER + 1
        g = np.zeros(n, np.int64)
        for k in range(ORDER):
            g = (g << BITS) | padded[k : k + n]
        yield g


def _suffix(gram: Column, order: int) -> Column:
    """The last `order` characters."""
    return gram.bitwiseAND(F.lit((1 << (BITS * order)) - 1))


def _context(gram: Column) -> Column:
    return F.shiftright(gram, BITS)


def _merge(sets: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by key."""
    keys, n = (np.concatenate(x) for x in zip(*sets))
    keys, inverse = np.unique(keys, return_inverse=True)
    return keys, np.bincount(inverse, n, len(keys)).astype(np.int64)


def _texts(column: pa.ChunkedArray | pa.Array):
    return (t.decode("utf-8", "surrogatepass") for t in unpacked(column))


def _gram_counts(texts) -> tuple[np.ndarray, np.ndarray]:
    """The texts' distinct grams, ascending, and how often each occurs; in parts of bounded size."""
    done: list[tuple[np.ndarray, np.ndarray]] = []
    run: list[np.ndarray] = []

    def close():
        done.append(np.unique(np.concatenate(run), return_counts=True))
        run.clear()
        if len(done) > 7:
            done[:] = [_merge(done)]

    for text in texts:
        for grams in gram_runs(text):
            run.append(grams)
            if sum(map(len, run)) > PART or len(run) > 2000:
                close()
    if run:
        close()
    return _merge(done) if done else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _slot(id_col: str) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(1 << FILTER_BITS)).alias("_slot")


def train_counts(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """gram, n over the texts of the trusted ids. Other texts stay where they are: a bitmap of the ids lets few through to the join."""
    bits = docs.sparkSession.sparkContext.broadcast(bit_rows(trusted.select(_slot(id_col))))
    kind = docs.schema[id_col].dataType.simpleString()

    def near(batches):
        for batch in batches:
            yield batch.filter(pa.array(has_bit(bits.value, batch.column(0).to_numpy())))

    def count(batches):
        grams, n = _gram_counts(t for batch in batches for t in _texts(batch.column(0)))
        for at in range(0, len(grams), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(grams[at : at + 100_000]), pa.array(n[at : at + 100_000])], ["gram", "n"])

    rows = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(_slot(id_col), F.col(id_col).alias("_id"), F.col(text_col).alias("z"))
    kept = rows.mapInArrow(lambda batches: compressed(near(batches)), f"_slot long, _id {kind}, z binary")
    ids = trusted.select(F.col(id_col).alias("_id")).distinct()
    return kept.join(ids, "_id", "left_semi").select("z").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and more, from how many grams have counts 1 to 4."""
    n = [float(x or 0) for x in counts.agg(*[F.sum((F.col("n") == k).cast("long")) for k in (1, 2, 3, 4)]).first()]
    if not all(n[:3]):
        return [0.5, 0.75, 0.9]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(d, 0.05), k - 0.05) for k, d in ((1, 1 - 2 * y * n[1] / n[0]), (2, 2 - 3 * y * n[2] / n[1]), (3, 3 - 4 * y * n[3] / n[2]))]


def fit(counts: DataFrame) -> dict[int, tuple[DataFrame, DataFrame]]:
    """For each order: the probabilities of its seen grams (gram, p), and what each seen context leaves to the order below (context, rest).

    Orders below the highest count distinct left neighbours. All are tables in the shared folder, joined by number.
    """
    seen = {ORDER: written(counts, f"order{ORDER}")}
    for k in range(ORDER - 1, 0, -1):
        seen[k] = written(seen[k + 1].groupBy(_suffix(F.col("gram"), k).alias("gram")).agg(F.count(F.lit(1)).alias("n")), f"order{k}")
    model: dict[int, tuple[DataFrame, DataFrame]] = {}
    for k in range(1, ORDER + 1):
        d = _discounts(seen[k])
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        contexts = seen[k].groupBy(_context(F.col("gram")).alias("context")).agg(F.sum("n").alias("total"), F.sum(cut).alias("mass"))
        rows = seen[k].withColumn("context", _context(F.col("gram"))).join(contexts, "context")
        below = F.lit(1.0 / (1 << BITS))
        if k > 1:
            rows = rows.withColumn("suffix", _suffix(F.col("gram"), k - 1)).join(model[k - 1][0].select(F.col("gram").alias("suffix"), "p"), "suffix")
            below = F.col("p")
        p = (F.col("n") - cut + F.col("mass") * below) / F.col("total")
        model[k] = written(rows.select("gram", p.alias("p")), f"p{k}"), written(contexts.select("context", (F.col("mass") / F.col("total")).alias("rest")), f"rest{k}")
    drop_written(*seen.values())
    return model


def distinct_grams(docs: DataFrame, text_col: str, buckets: int) -> DataFrame:
    """gram: all grams of the texts once. Tasks send theirs sorted and packed to buckets by hash."""

    def cut(batches):
        grams, _ = _gram_counts(t for batch in sliced(batches) for t in batch.column(0).to_pylist() if t)
        for bucket, own, _ in _dealt(grams, buckets):
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([packed(np.diff(own, prepend=0))], pa.binary())], ["bucket", "grams"])

    def merge(bucket: pa.Table) -> pa.Table:
        return pa.Table.from_arrays([pa.array(np.unique(np.concatenate([np.cumsum(array_of(z, np.int64)) for z in bucket.column("grams")])))], ["gram"])

    return dealt(docs.select(text_col).mapInArrow(cut, "bucket int, grams binary"), buckets, "bucket").groupBy("bucket").applyInArrow(merge, "gram long")


def _bucket(grams: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(grams.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def _dealt(grams: np.ndarray, buckets: int):
    """Bucket, grams and their indexes, for each bucket that has some; grams stay in order."""
    bucket = _bucket(grams, buckets)
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for a, b in zip(edges, [*edges[1:], len(order)]):
        yield int(bucket[order[a]]), grams[order[a:b]], order[a:b]


def log_probabilities(grams: DataFrame, model: dict) -> DataFrame:
    """gram, logp for distinct grams, seen or not: the longest seen suffix's probability times what the contexts above it leave; a table in the shared folder.

    Only the grams that an order hasn't seen go on to the next lower one.
    """
    rows, done, tables = grams.select("gram", F.lit(1.0).alias("left")), [], []
    for k in range(ORDER, 0, -1):
        known, rest = model[k]
        rows = rows.withColumn("key", _suffix(F.col("gram"), k)).join(known.select(F.col("gram").alias("key"), F.col("p").alias("found")), "key", "left")
        rows = written(rows.withColumn("context", _context(F.col("key"))).join(rest, "context", "left").select("gram", "left", "found", "rest"), f"asked{k}")
        tables.append(rows)
        done.append(rows.where("found IS NOT NULL").select("gram", (F.col("left") * F.col("found")).alias("p")))
        rows = rows.where("found IS NULL").select("gram", (F.col("left") * F.coalesce("rest", F.lit(1.0))).alias("left"))
    done.append(rows.select("gram", (F.col("left") / (1 << BITS)).alias("p")))
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    out = written(whole.select("gram", F.log("p").cast("float").alias("logp")), "logp")
    drop_written(*tables)
    return out


def perplexities(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id_col, lang, k0, k1 (hashes of id, language and text), chars, nats (mean negative log probability of a character): a row for each non-null text.

    Texts travel once, compressed, to blocks of documents. A block sends its distinct grams, not its characters, sorted and packed, to buckets of the
    probability table and gets their log probabilities back: what moves grows with the number of blocks, and no task
    holds more of the model than its block's texts use.
    """
    blocks = blocks_needed(docs, text_col, BLOCK)
    kind = docs.schema[id_col].dataType.simpleString()
    probabilities = log_probabilities(distinct_grams(docs.where(F.col(text_col).isNotNull()), text_col, blocks), model)

    def place(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_bucket(batch.column(0).to_numpy(), blocks)), *batch.columns], ["bucket", "gram", "logp"])

    shards = probabilities.mapInArrow(place, "bucket int, gram long, logp float")
    k0, k1 = hash_pair(F.col(id_col), F.col(lang_col), F.col(text_col))
    rows = docs.where(F.col(text_col).isNotNull()).select(F.pmod(k0, F.lit(blocks)).cast("int").alias("block"), id_col, F.col(lang_col).cast("string").alias("lang"), k0.alias("k0"), k1.alias("k1"), F.col(text_col).alias("z"))
    texts = dealt(rows.mapInArrow(compressed, f"block int, `{id_col}` {kind}, lang string, k0 long, k1 long, z binary"), blocks, "block")

    def ask(block: pa.Table) -> pa.Table:
        grams, _ = _gram_counts(_texts(block.column("z")))
        parts = [(bucket, packed(np.diff(own, prepend=0))) for bucket, own, _ in _dealt(grams, blocks)]
        return pa.Table.from_arrays([pa.array([b for b, _ in parts], pa.int32()), pa.array([block.column("block")[0].as_py()] * len(parts), pa.int32()), pa.array([g for _, g in parts], pa.binary())], ["bucket", "block", "grams"])

    def look_up(asked: pa.Table, shard: pa.Table) -> pa.Table:
        order = np.argsort(grams := shard.column("gram").to_numpy())
        grams, logp = grams[order], shard.column("logp").to_numpy()[order]
        found = [packed(logp[np.searchsorted(grams, np.cumsum(array_of(z, np.int64)))]) for z in asked.column("grams")]
        return pa.Table.from_arrays([asked.column("block"), asked.column("grams"), pa.array(found, pa.binary())], ["block", "grams", "logp"])

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        grams = np.concatenate([np.zeros(0, np.int64), *[np.cumsum(array_of(z, np.int64)) for z in answers.column("grams")]])
        logp = np.concatenate([np.zeros(0, np.float32), *[array_of(z, np.float32) for z in answers.column("logp")]])
        order = np.argsort(grams)
        grams, logp = grams[order], logp[order].astype(np.float64)
        chars, nats = [], []
        for text in _texts(texts.column("z")):
            total = 0.0
            for run in gram_runs(text):
                own, n = np.unique(run, return_counts=True)
                total -= float(logp[np.searchsorted(grams, own)] @ n)
            chars.append(len(text))
            nats.append(total / len(text) if text else None)
        return pa.Table.from_arrays([*[texts.column(c) for c in (id_col, "lang", "k0", "k1")], pa.array(chars, pa.int64()), pa.array(nats, pa.float64())], [id_col, "lang", "k0", "k1", "chars", "nats"])

    asked = texts.groupBy("block").applyInArrow(ask, "bucket int, block int, grams binary")
    told = dealt(asked, blocks, "bucket").groupBy("bucket").cogroup(dealt(shards, blocks, "bucket").groupBy("bucket")).applyInArrow(look_up, "block int, grams binary, logp binary")
    return texts.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(score, f"`{id_col}` {kind}, lang string, k0 long, k1 long, chars long, nats double")


#: Characters' worth of the language's middle value that every text's mean gets, so that a few words don't decide.
PRIOR_CHARS = 40
BINS = 1000  # of a nat, for exact quantiles of bounded memory


def _quantile(values: DataFrame, by: str, q: float, name: str) -> DataFrame:
    """by, name, n: the lowest bin of column v whose running share reaches q, for each group (all groups together: null)."""
    binned = values.withColumn(by, F.explode(F.array(F.col(by), F.lit(None).cast("string")))).groupBy(by, F.ceil(F.col("v") * BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(by)
    running = binned.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "n": F.sum("n").over(w)})
    return running.where(F.col("upto") >= F.col("n") * q).groupBy(by).agg((F.min("bin") / BINS).alias(name), F.max("n").alias("n"))


def _of_language(scored: DataFrame, table: DataFrame, name: str, least: int) -> DataFrame:
    """scored with the language's value, or that of all languages together where it has fewer than `least` texts."""
    own = table.where(F.col("lang").isNotNull() & (F.col("n") >= least)).select("lang", F.col(name).alias("_own"))
    every = table.where(F.col("lang").isNull()).select(F.col(name).alias("_every"))
    return scored.join(own, "lang", "left").join(F.broadcast(every.agg(F.first("_every").alias("_every"))), how="cross").withColumn(name, F.coalesce("_own", "_every")).drop("_own", "_every")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = 0.995, held_out: int = 5, least: int = 30) -> DataFrame:
    """id_col, lang, k0, k1, perplexity (a character's), threshold, keep: a row for each document.

    `labels` (id_col, quality, toxic): texts all of whose labels say good and not toxic are trusted. The model is counted on all of them
    but one in `held_out`; what those show, which the model hasn't seen, sets each language's threshold: the `quantile` of their
    perplexities, or that of all languages together where a language has fewer than `least`. A text's mean is drawn
    to the language's middle as if by PRIOR_CHARS more characters.

    Defined cases: a null or empty text has no perplexity and isn't kept; a null language has the threshold of all; without trusted
    texts nothing is known and all texts are kept; repeated rows get equal results; an empty table gives no rows.
    """
    modest_batches(docs)
    judged = labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("q = 1 AND t = 0").select(id_col)
    out = F.pmod(F.xxhash64(id_col, F.lit("held out")), F.lit(held_out)) == 0
    model = fit(train_counts(docs, judged.where(~out), id_col, text_col))
    raw = written(perplexities(docs, model, id_col, text_col, lang_col), "nats")
    drop_written(*(table for pair in model.values() for table in pair))
    seen = raw.join(judged.where(out), id_col, "left_semi").where(F.col("nats").isNotNull())
    middle = _quantile(seen.select("lang", F.col("nats").alias("v")), "lang", 0.5, "middle")

    def drawn(rows: DataFrame) -> DataFrame:
        rows = _of_language(rows, middle, "middle", least)
        return rows.withColumn("v", (F.col("nats") * F.col("chars") + F.coalesce("middle", "nats") * PRIOR_CHARS) / (F.col("chars") + PRIOR_CHARS)).drop("middle")

    limits = _quantile(drawn(seen).select("lang", "v"), "lang", quantile, "threshold")
    scored = _of_language(drawn(raw), limits, "threshold", least)
    keep = F.coalesce(F.col("v") <= F.col("threshold"), F.col("v").isNotNull())
    k0, k1 = hash_pair(F.col(id_col), F.col(lang_col), F.col(text_col))
    none = docs.where(F.col(text_col).isNull()).select(id_col, F.col(lang_col).cast("string").alias("lang"), k0.alias("k0"), k1.alias("k1"), F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), F.lit(False).alias("keep"))
    return scored.select(id_col, "lang", "k0", "k1", F.exp("v").alias("perplexity"), F.exp("threshold").alias("threshold"), keep.alias("keep")).unionByName(none)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The documents that classify() keeps, unchanged."""
    good = classify(docs, labels, id_col, text_col, lang_col, **options).where("keep").select("k0", "k1").distinct()
    k0, k1 = hash_pair(F.col(id_col), F.col(lang_col), F.col(text_col))
    return docs.select(F.struct(*docs.columns).alias("row"), k0.alias("k0"), k1.alias("k1")).join(good, ["k0", "k1"], "left_semi").select("row.*")


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Every document's perplexity and whether it is kept: doc_id, lang, perplexity, threshold, keep."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("k0", "k1")
