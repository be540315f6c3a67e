"""Exact Jaccard join of documents' shingle sets, with index lists skipped in blocks and answers derived from near sets' answers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.llm.common import array_of, blocks_needed, dealt, modest_batches, packed, sliced, unpacked
from lociflow.operators.components import components
from lociflow.llm.words import mixed, ngrams, parts, words_of
from lociflow.sources.shared import written

SHINGLE = 4
BLOCK = 8 << 20
#: Bits of a shingle by which its frequency is counted; another shingle with the same bits can only make it seem more frequent.
COUNTED_BITS = 40


def shingle_sets(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """Each text's distinct shingles as ascending 64-bit hashes; one of all words where they are fewer than `shingle`."""
    words = words_of(texts, lower_ascii=True)
    at, h = ngrams(words, shingle)
    edges = np.searchsorted(at, words.first)
    out = []
    for k, n in enumerate(np.diff(words.first)):
        if 0 < n < shingle:
            own = words.hash[words.first[k] : words.first[k + 1]]
            total = np.uint64(0xABCD + int(n))
            for x in own:
                total = mixed(np.array([total ^ x], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0]
            out.append(np.array([total], np.uint64))
        else:
            out.append(np.unique(h[edges[k] : edges[k + 1]]))
    return out


def _signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    with np.errstate(over="ignore"):
        a = mixed(np.array([mixed(s ^ np.uint64(0x1234567)).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64))[0]
        b = mixed(np.array([mixed(s * np.uint64(0xD6E8FEB86659FD93) + np.uint64(99)).sum(dtype=np.uint64)], np.uint64))[0]
    return int(a.view(np.int64)), int(b.view(np.int64))


def _raw(texts: list[str | None]):
    return ((t or "").encode("utf-8", "surrogatepass") for t in texts)


def set_table(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """id, n, s1, s2 for each row: the set's size and signature (null: empty)."""

    def make(batches):
        for batch in sliced(batches):
            n, s1, s2 = [], [], []
            for _, run in parts(_raw(batch.column(1).to_pylist())):
                for s in shingle_sets(run, shingle):
                    a, b = _signature(s) if len(s) else (None, None)
                    n.append(len(s))
                    s1.append(a)
                    s2.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64())], ["id", "n", "s1", "s2"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(make, "id long, n long, s1 long, s2 long")


def _need(nx, ny, num: int, den: int):
    """The least intersection with which sets of these sizes link (num / den of the union at least), for numbers or columns."""
    return (nx + ny) * num / (num + den)


def linkable_sets(docs: DataFrame, text_col: str, shingle: int, num: int, den: int) -> DataFrame:
    """The distinct sets that may have links: s1, s2, n, centre, shared (packed shingles that other sets have too), tokens, places.

    A set with links shares num/den of its shingles with others at least, so most sets end here. `tokens` are its prefix in the order of
    frequency, then hash, without those that it has alone; `places` their positions in that order.
    `centre` says how frequent its shingles are: a group's original has more than its edited copies.

    One text of each set and task, about, is dealt by its signature, so copies meet in a block. Blocks send their shingles' frequencies, sorted and packed, to
    buckets by hash range, and get back those that another set has too.
    """
    blocks = blocks_needed(docs, text_col, BLOCK)
    buckets = 2 * blocks
    drop = np.uint64(64 - COUNTED_BITS)

    def deal(batches):
        z, seen = zstandard.ZstdCompressor(level=3), set()
        for batch in sliced(batches):
            rows = []
            if len(seen) > 200_000:
                seen.clear()
            for _, run in parts(_raw(batch.column(0).to_pylist())):
                for text, s in zip(run, shingle_sets(run, shingle)):
                    if len(s) and (key := _signature(s)) not in seen:
                        seen.add(key)
                        rows.append((key[0] % blocks, *key, z.compress(text)))
            columns = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["block", "s1", "s2", "z"])

    texts = dealt(docs.select(text_col).mapInArrow(deal, "block int, s1 long, s2 long, z binary"), blocks, "block")

    def sets_of(block: pa.Table):
        keys = list(zip(block.column("s1").to_pylist(), block.column("s2").to_pylist()))
        one = sorted({key: i for i, key in enumerate(keys)}.items())
        texts = block.column("z").take(pa.array([i for _, i in one], pa.int64()))
        return [key for key, _ in one], (s for _, run in parts(unpacked(texts)) for s in shingle_sets(run, shingle))

    def count(block: pa.Table) -> pa.Table:
        number = block.column("block")[0].as_py() if block.num_rows else 0
        _, sets = sets_of(block)
        done, run, held = [], [], 0
        for s in sets:
            run.append(s >> drop)
            held += len(s)
            if held > 1 << 20:
                done.append(np.unique(np.concatenate(run), return_counts=True))
                run, held = [], 0
        done += [np.unique(np.concatenate(run), return_counts=True)] if run else []
        tokens, n = _summed(done)
        edges = np.searchsorted(tokens, (np.arange(1, buckets, dtype=np.float64) / buckets * (1 << COUNTED_BITS)).astype(np.uint64))
        cut = [(k, t, c) for k, (t, c) in enumerate(zip(np.split(tokens, edges), np.split(n, edges))) if len(t)]
        return pa.Table.from_arrays([pa.array([k for k, _, _ in cut], pa.int32()), pa.array([number] * len(cut), pa.int32()), pa.array([packed(np.diff(t, prepend=np.uint64(0))) for _, t, _ in cut], pa.binary()), pa.array([packed(c) for _, _, c in cut], pa.binary())], ["bucket", "block", "tokens", "n"])

    def answer(bucket: pa.Table) -> pa.Table:
        own = [(b.as_py(), np.cumsum(array_of(t, np.uint64)), array_of(c, np.int32)) for b, t, c in zip(bucket.column("block"), bucket.column("tokens"), bucket.column("n"))]
        tokens, n = _summed([(t, c) for _, t, c in own])
        tokens, n = tokens[n > 1], n[n > 1]
        rows = []
        for block, t, _ in own:
            i = np.searchsorted(tokens, t)
            i = i[np.isin(t, tokens, assume_unique=True, kind="sort")] if len(tokens) else i[:0]
            if len(i):
                rows.append((block, packed(np.diff(tokens[i], prepend=np.uint64(0))), packed(n[i])))
        columns = list(zip(*rows)) or [[], [], []]
        return pa.Table.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], ["block", "tokens", "n"])

    def select(block: pa.Table, answers: pa.Table) -> pa.Table:
        tokens = np.concatenate([np.zeros(0, np.uint64), *[np.cumsum(array_of(t, np.uint64)) for t in answers.column("tokens")]])
        n = np.concatenate([np.zeros(0, np.int32), *[array_of(c, np.int32) for c in answers.column("n")]])
        order = np.argsort(tokens)
        tokens, n = tokens[order], n[order]
        rows = []
        keys, sets = sets_of(block)
        for key, s in zip(keys, sets):
            if not len(tokens):
                break
            i = np.minimum(np.searchsorted(tokens, s >> drop), len(tokens) - 1)
            known = tokens[i] == s >> drop
            shared, often = s[known], n[i[known]]
            least = -(-num * len(s) // den)
            if len(shared) < max(1, least):
                continue
            alone = len(s) - len(shared)
            prefix = np.lexsort((shared, often))[: len(s) - least + 1 - alone]
            rows.append((*key, len(s), float(np.log2(often).sum() / len(s)), packed(np.diff(shared, prepend=np.uint64(0))), shared[prefix].view(np.int64), np.arange(alone, alone + len(prefix), dtype=np.int32)))
        columns = list(zip(*rows)) or [[]] * 7
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
        return pa.Table.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["s1", "s2", "n", "centre", "shared", "tokens", "places"])

    counted = texts.groupBy("block").applyInArrow(count, "bucket int, block int, tokens binary, n binary")
    told = dealt(counted, buckets, "bucket").groupBy("bucket").applyInArrow(answer, "block int, tokens binary, n binary")
    return texts.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(select, "s1 long, s2 long, n long, centre double, shared binary, tokens array<long>, places array<int>")


def _summed(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not runs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    tokens, n = (np.concatenate(x) for x in zip(*runs))
    tokens, inverse = np.unique(tokens, return_inverse=True)
    return tokens, np.bincount(inverse, n, len(tokens)).astype(np.int32)


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with a_n, b_n, a_shared (how many shingles of a others have too) and common, the size of the intersection."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("a_n"), F.col("shared").alias("_x"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("b_n"), F.col("shared").alias("_y"))

    def count(batches):
        for batch in batches:
            common, many, last = [], [], (None, None)
            for x, y in zip(batch.column(4), batch.column(5)):
                x = np.cumsum(array_of(x, np.uint64))
                if last[0] != (key := y.as_py()):
                    last = key, np.cumsum(array_of(y, np.uint64))
                common.append(len(np.intersect1d(x, last[1], assume_unique=True)))
                many.append(len(x))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(many, pa.int64()), pa.array(common, pa.int64())], ["a", "b", "a_n", "b_n", "a_shared", "common"])

    both = pairs.join(left, "a").join(right, "b").select("a", "b", "a_n", "b_n", "_x", "_y")
    return both.mapInArrow(count, "a long, b long, a_n long, b_n long, a_shared long, common long")


def set_links(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b: ids) that join all linkable sets (written table; id, n, centre, shared, tokens, places) into their components.

    Two sets that link share a token of their prefixes. First each set asks only its leader, the most central set that
    most of its index lists name, so a group of near copies costs one comparison for each. Then each list is joined with those
    of its sets that are outside the component most of the list is in. Lists are cut into blocks of sizes, of which only equal and adjacent ones can hold partners;
    an entry is skipped whose place in the list's sets leaves too little behind it, and a pair with a common leader
    whose answers there (what each shares with the leader, and what else it has that others have) bound their intersection too low. The pairs left are compared whole.
    """
    entries = sets.select("id", "n", "centre", F.explode(F.arrays_zip("tokens", "places")).alias("e")).select("id", "n", "centre", F.col("e.tokens").alias("token"), F.col("e.places").alias("place"))
    lists = entries.groupBy("token").agg(F.max(F.struct("centre", (-F.col("id")).alias("back"))).alias("lead"), F.count(F.lit(1)).alias("of")).where("of > 1").select("token", (-F.col("lead.back")).alias("leader"))
    votes = entries.join(lists, "token").groupBy("id", "leader").agg(F.count(F.lit(1)).alias("votes"))
    leaders = votes.groupBy("id").agg(F.max(F.struct("votes", (-F.col("leader")).alias("back"))).alias("v")).select(F.col("id").alias("a"), (-F.col("v.back")).alias("b")).where("a <> b")
    asked = written(overlaps(leaders, sets), "asked")
    first = asked.where(F.col("common") >= _need(F.col("a_n"), F.col("b_n"), num, den)).select("a", "b")
    group = components(first)
    state = sets.select("id").join(asked.select(F.col("a").alias("id"), F.col("b").alias("leader"), F.col("common"), (F.col("a_shared") - F.col("common")).alias("more")), "id", "left")
    state = state.join(group.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("label", "id").alias("label"), F.coalesce("leader", "id").alias("leader"), "common", "more")
    index = written(entries.drop("centre").join(state, "id").withColumn("size", F.floor(F.log(F.col("n").cast("double")) / float(np.log(den / num))).cast("int")), "index")
    shares = index.groupBy("token", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("token").agg(F.max(F.struct("k", "label")).alias("top"), F.count(F.lit(1)).alias("labels")).where("labels > 1").select("token", F.col("top.label").alias("main"))
    mixed_lists = index.join(shares, "token")
    apart = mixed_lists.where("label <> main").withColumn("size", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)))
    x, y = apart.alias("x"), mixed_lists.alias("y")
    need = _need(F.col("x.n"), F.col("y.n"), num, den)
    ahead = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    own = lambda s: F.coalesce(F.col(f"{s}.common"), F.col(f"{s}.n"))  # noqa: E731  a leader has all of itself, and nothing more
    more = lambda s: F.coalesce(F.col(f"{s}.more"), F.lit(0))
    bound = F.least(own("x"), own("y")) + F.least(more("x"), more("y"))
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.size") == F.col("y.size")) & (F.col("x.label") != F.col("y.label")) & (F.col("x.n") * den >= F.col("y.n") * num) & (F.col("y.n") * den >= F.col("x.n") * num) & (ahead >= need) & ((F.col("x.leader") != F.col("y.leader")) | (bound >= need)))
    pairs = met.select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b")).distinct()
    second = overlaps(pairs, sets).where(F.col("common") >= _need(F.col("a_n"), F.col("b_n"), num, den)).select("a", "b")
    return group.select(F.col("node").alias("a"), F.col("label").alias("b")).where("a <> b").unionByName(second)


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, num: int = 85, den: int = 100) -> DataFrame:
    """id_col, n_shingles, component_id for each row: the size of its set of word shingles, and the smallest id that links lead to, itself included.

    Words are runs without white space with A-Z in lower case. Sets link when the intersection has num / den of the union at least. Ids are integers.

    Defined cases: a null or empty text has an empty set and is linked with nothing; fewer words than `shingle` make one shingle of all; rows with equal sets are linked;
    a null id is never a component's id unless no other is known (then null); other columns are left out; an empty table gives no rows.

    The method is exact up to hash collisions (64 bits a shingle, 128 a set). Equal sets are one set from the start. Only the shingles of sets that may have links, and
    only those that other sets have too, are compared.
    """
    rows = written(set_table(modest_batches(docs), id_col, text_col, shingle), "sets")
    classes = rows.where("s1 IS NOT NULL").groupBy("s1", "s2").agg(F.min("id").alias("first"))
    sets = written(linkable_sets(docs, text_col, shingle, num, den).join(classes.where("first IS NOT NULL").withColumnRenamed("first", "id"), ["s1", "s2"]).drop("s1", "s2"), "linkable")
    labels = components(set_links(sets, num, den))
    found = rows.join(classes, ["s1", "s2"], "left").join(labels.withColumnRenamed("node", "first"), "first", "left")
    return found.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("label", "first", "id").cast(docs.schema[id_col].dataType).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with the smallest id of their component: one of each group of near copies, unchanged.

    Rows of one id are one document, which stays if any of its rows is its component's first; rows without an id stay.
    """
    groups = near_duplicate_groups(docs, id_col, text_col, **options).where(F.col(id_col).isNotNull())
    gone = groups.groupBy(id_col).agg(F.max((F.col("component_id") == F.col(id_col)).cast("int")).alias("first")).where("first = 0").select(id_col)
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)


def op8_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Components of documents by 4-word shingles at a Jaccard similarity of 0.85: doc_id, n_shingles, component_id."""
    return near_duplicate_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
