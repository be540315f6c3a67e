"""How the sources of each language diverge from each other and from the language: sorted runs of terms, scanned once."""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociflow.llm.common import modest_batches, sliced
from lociflow.sources.shared import written

SCALE = 1_000_000_000
#: Partial runs that a task holds before it sends them, documents these may come from, and pairs of one step of a scan.
HELD_RUNS, HELD_DOCUMENTS, STEP_PAIRS = 600_000, 1 << 22, 1 << 21

#: A-Z lower-cased, a-z and all bytes of other characters as they are, a space for the rest.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: One document in a run's number: documents above, occurrences below.
_DOCUMENT = 1 << 40
RUNS = "lang string, term string, document long, sources array<string>, docs array<long>, n array<long>"


def partial_runs(batches):
    """Rows RUNS of the texts in batches (document, lang, source, text): a term's runs in the sources that hold it, in order, with documents and occurrences; `document` is the first that the row can stem from.

    A task adds up what it holds before it sends any, so a term of many sources and documents is one row.
    """
    held: dict[tuple, dict[bytes, int]] = defaultdict(dict)
    size = documents = since = 0

    def send():
        for lang in sorted({lang for lang, _ in held}):
            own = sorted((source, runs) for (x, source), runs in held.items() if x == lang)
            counts = np.concatenate([np.fromiter(runs.values(), np.int64, len(runs)) for _, runs in own])
            terms = pa.array([t for _, runs in own for t in runs], pa.binary()).dictionary_encode()
            code = terms.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            begin = np.append(np.flatnonzero(np.diff(code[order], prepend=-1)), len(order))
            source = pa.array([x for x, _ in own], pa.string()).take(pa.array(np.repeat(np.arange(len(own)), [len(runs) for _, runs in own])[order]))
            docs, n = np.divmod(counts[order], _DOCUMENT)
            names = terms.dictionary.cast(pa.string())
            for at in range(0, len(begin) - 1, 5_000):
                edges = begin[at : at + 5_001]
                part = slice(edges[0], edges[-1])
                offsets = pa.array((edges - edges[0]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, x) for x in (source.slice(edges[0], edges[-1] - edges[0]), pa.array(docs[part]), pa.array(n[part]))]
                k = len(edges) - 1
                yield pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), names.slice(at, k), pa.array(np.full(k, since)), *lists], ["lang", "term", "document", "sources", "docs", "n"])
        held.clear()

    for batch in chain.from_iterable(map(lambda b: sliced([b]), batches)):
        for document, lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            runs = held[lang, source]
            before, documents = len(runs), documents + 1
            known = runs.get
            for term, n in Counter(text.encode().translate(_TERM_BYTES).split()).items():
                runs[term] = known(term, 0) + _DOCUMENT + n
            size += len(runs) - before
            if size > HELD_RUNS or documents >= HELD_DOCUMENTS:
                yield from send()
                size = documents = 0
                since = document
    yield from send()


def _changes(table: pa.Table, *names: str) -> np.ndarray:
    """Where a row differs from the one before in any of the columns; the first row does."""
    out = np.zeros(table.num_rows, bool)
    out[:1] = True
    for name in names:
        column = table.column(name)
        out[1:] |= pc.not_equal(column.slice(1), column.slice(0, table.num_rows - 1)).to_numpy(zero_copy_only=False)
    return out


def _gathered(batches, rows: int = 50_000):
    """Tables of at least `rows` rows, but for the last."""
    run, size = [], 0
    for batch in batches:
        run.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield pa.Table.from_batches(run)
            run, size = [], 0
    if run:
        yield pa.Table.from_batches(run)


def _whole(batches, *key: str):
    """Tables of whole runs: batches sorted by the key, the last run of each held back until the next key comes."""
    held = None
    for table in _gathered(batches):
        table = table if held is None else pa.concat_tables([held, table])
        if not table.num_rows:
            continue
        last = int(np.flatnonzero(_changes(table, *key))[-1])
        held = table.slice(last).combine_chunks()
        if last:
            yield table.slice(0, last).combine_chunks()
    if held is not None:
        yield held


def kept_runs(least: int):
    """A scan of rows RUNS sorted by lang, term, document: lang, term, source, n, opens for the terms in at least `least` documents; `opens` is true on a term's first row.

    The rows of a (lang, term) run are laid out by source, and run lengths added up within a source and within the term. Of a term that goes on in the next batch what it has so far is held,
    a number for each of its sources.
    """

    def scan(batches):
        for table in _whole(batches, "lang", "term"):
            lists = [table.column(c).combine_chunks() for c in ("sources", "docs", "n")]
            first = np.flatnonzero(_changes(table, "lang", "term"))
            run = np.repeat(np.arange(len(first)), np.diff(np.append(first, table.num_rows)))
            source = lists[0].flatten().dictionary_encode()
            key = np.repeat(run, lists[0].value_lengths().to_numpy()) * len(source.dictionary) + source.indices.to_numpy()
            order = np.argsort(key, kind="stable")
            at = np.flatnonzero(np.diff(key[order], prepend=-1))
            docs, n = (np.add.reduceat(x.flatten().to_numpy()[order], at) for x in lists[1:])
            run, code = np.divmod(key[order][at], len(source.dictionary))
            opens = np.diff(run, prepend=-1) > 0
            known = (np.add.reduceat(docs, np.flatnonzero(opens)) >= least)[run]
            rows = table.take(pa.array(first[run[known]]))
            out = [rows.column("lang").combine_chunks(), rows.column("term").combine_chunks(), source.dictionary.take(pa.array(code[known])), pa.array(n[known]), pa.array(opens[known])]
            yield pa.RecordBatch.from_arrays(out, ["lang", "term", "source", "n", "opens"])

    return scan


def scaled(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * count / total) for 0 <= count <= total < 2**53, by long division in thousands, so that nothing exceeds 64 bits."""
    whole, rest = np.divmod(count, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digit
    return 1 + whole


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _added(codes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes and the sums of their values."""
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    at = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[at], np.add.reduceat(values[order], at)


def run_parts(batches):
    """A scan of rows (lang, term, source, n, total, lang_total, vocabulary) sorted by lang and term: partial `pair` rows, added up in the task, and `term` rows.

    A pair of sources that both hold a term gets what that adds to the value that the sources' own counts give (own_parts). A run is taken in steps of left sides, so its pairs
    are never all held.
    """
    names: dict[tuple[str, str], int] = {}
    sums = (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def sent(part, lang, source, item, value):
        return pa.RecordBatch.from_arrays([pa.array([part] * len(value), pa.string()), lang, source, item, pa.array(value, pa.int64())], ["part", "lang", "source", "item", "value"])

    def pairs_sent():
        known = list(names)
        for at in range(0, len(sums[0]), 10_000):
            a, b = np.divmod(sums[0][at : at + 10_000], 1 << 31)
            yield sent("pair", pa.array([known[i][0] for i in a], pa.string()), pa.array([known[i][1] for i in a], pa.string()), pa.array([known[i][1] for i in b], pa.string()), sums[1][at : at + 10_000])

    for table in _whole(batches, "lang", "term"):
        first = np.flatnonzero(_changes(table, "lang", "term"))
        size = np.diff(np.append(first, table.num_rows))
        n, total, lang_total, vocabulary = (table.column(c).to_numpy() for c in ("n", "total", "lang_total", "vocabulary"))
        p, p0 = scaled(n + 1, total + vocabulary), scaled(np.ones_like(n), total + vocabulary)
        q = np.repeat(scaled(np.add.reduceat(n, first) + 1, (lang_total + vocabulary)[first]), size)
        if len(over := np.flatnonzero(p > q)):
            rows = table.take(pa.array(over)).combine_chunks()
            yield sent("term", *(rows.column(c).combine_chunks() for c in ("lang", "source", "term")), _gap(p[over], q[over]))
        code = np.array([names.setdefault(x, len(names)) for x in zip(table.column("lang").to_pylist(), table.column("source").to_pylist())], np.int64)
        begin, many = np.repeat(first, size), np.repeat(size, size)
        upto = np.cumsum(many)
        left = 0
        while left < len(n):
            right = max(left + 1, int(np.searchsorted(upto, upto[left] - many[left] + STEP_PAIRS, "right")))
            a = np.repeat(np.arange(left, right), many[left:right])
            b = begin[a] + np.arange(len(a)) - np.repeat(upto[left:right] - many[left:right] - (upto[left] - many[left]), many[left:right])
            a, b = a[a != b], b[a != b]
            if len(a):
                more = _gap(p[a], p[b]) - _gap(p[a], p0[b]) - _gap(p0[a], p[b]) + _gap(p0[a], p0[b])
                found = _added(code[a] << 31 | code[b], more)
                sums = _added(*(np.concatenate(x) for x in zip(sums, found)))
            left = right
        if len(sums[0]) > STEP_PAIRS:
            yield from pairs_sent()
            names.clear()
            sums = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    yield from pairs_sent()


def _share(count, total: str, vocabulary: str = "vocabulary"):
    """1 + floor(SCALE * count / (total + vocabulary)) in decimals; null where nothing is kept."""
    return F.expr(f"1 + CAST({SCALE} AS DECIMAL(10,0)) * CAST({count} AS DECIMAL(20,0)) DIV NULLIF(CAST({total} + {vocabulary} AS DECIMAL(20,0)), 0)")


def own_parts(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """part, lang, source, item, value for all ordered pairs of a language's sources: what each one's own counts give against the other's share of an absent term.

    Terms of one count in one source give equal values, so a source goes in as the number of its terms for each count.
    """
    own = groups.select("lang", "vocabulary", F.col("source"), _share(1, "total").alias("p0"))
    other = groups.select("lang", F.col("source").alias("item"), _share(1, "total").alias("q0"))
    pairs = own.join(other, "lang").where("source <> item").withColumn("f0", F.expr("(p0 - q0) * (p0 - q0) DIV q0"))
    counted = kept.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("terms")).join(groups.select("lang", "source", "total", "vocabulary"), ["lang", "source"])
    counted = counted.select("lang", "source", "terms", _share("n + 1", "total").alias("p"))
    there = pairs.join(counted, ["lang", "source"]).select("lang", "source", "item", F.expr("terms * ((p - q0) * (p - q0) DIV q0 - f0)").alias("value"))
    back = pairs.join(counted.withColumnRenamed("source", "item"), ["lang", "item"]).select("lang", "source", "item", F.expr("terms * ((p0 - p) * (p0 - p) DIV p - f0)").alias("value"))
    base = pairs.select("lang", "source", "item", F.coalesce(F.expr("vocabulary * f0"), F.lit(0)).alias("value"))
    return base.unionByName(there).unionByName(back)


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from each other one (`pair`) and its terms above the language's share (`term`, to rank `top`).

    A language keeps the terms that at least `least` of its documents hold; shares are counts plus one in a thousand million, all in whole numbers. Texts are turned into partial runs in
    the tasks that read them, a row for each term with its sources in order; rows are dealt by language and term, sorted by these and document, and scanned once for what is kept, and what is
    kept, sorted by source too, once more for pairs and terms.

    Defined cases: a null language, source or text is ''; every row is a document of its own, so repeated rows count each; a language with one source has no pairs; without kept terms
    pairs have value 0 and there are no term rows; equal values go by the item's bytes; other columns are left out, whatever their names; an empty table gives no rows.
    A run's rows in the scans are at most the sources of its language; totals must stay below 2**53.
    """
    spark = docs.sparkSession
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = modest_batches(docs).select(F.monotonically_increasing_id().alias("document"), blank(lang_col).alias("lang"), blank(source_col).alias("source"), blank(text_col).alias("text"))
    deal = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = rows.mapInArrow(partial_runs, RUNS).repartition(deal, "lang", "term").sortWithinPartitions("term", "lang", "document")
    kept = written(runs.mapInArrow(kept_runs(least), "lang string, term string, source string, n long, opens boolean"), "kept_terms")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("opens").cast("long")).alias("opened"))
    known = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").na.fill(0)
    of_lang = known.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("opened").alias("vocabulary"))
    groups = written(known.join(of_lang, "lang").drop("opened"), "groups")
    sized = kept.drop("opens").join(groups, ["lang", "source"]).select("lang", "term", "source", "n", "total", "lang_total", "vocabulary")
    parts = written(sized.repartition(deal, "lang", "term").sortWithinPartitions("term", "lang", "source").mapInArrow(run_parts, "part string, lang string, source string, item string, value long"), "parts")
    value = own_parts(groups, kept).unionByName(parts.where("part = 'pair'").drop("part")).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = parts.where("part = 'term'").drop("part").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    ranked = [df.withColumn("part", F.lit(part)).select("lang", "source", "part", "item", "value", "rank") for part, df in (("pair", value.withColumn("rank", F.row_number().over(order))), ("term", terms))]
    return ranked[0].unionByName(ranked[1])


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    """Divergence between the sources of each language of documents, and each source's terms above the language."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS document, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT document, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT document) >= 3),
vocabulary AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
counts AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT lang, source, coalesce(v, 0)::HUGEINT AS v, (SELECT coalesce(sum(c.n), 0) FROM counts c WHERE c.lang = g.lang AND c.source = g.source)::HUGEINT AS total
    FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN vocabulary USING (lang)),
shares AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.total + g.v))::BIGINT AS p
    FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
apart AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
whole AS (SELECT k.lang, k.term, (1 + 1000000000::HUGEINT * (k.n + 1) // (v.n + v.v))::BIGINT AS q FROM kept k JOIN vocabulary v USING (lang)),
terms AS (SELECT s.lang, s.source, 'term' AS part, s.term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM shares s JOIN whole w USING (lang, term) WHERE s.n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
