"""Transcripts: features, filters, consensus over runs, comparison."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.operators.running import running


def features(trs: DataFrame, exons: str = "exons") -> DataFrame:
    """trs with n_exons, length, start, end, introns (array<struct<l,r>>)."""
    e = F.col(exons)
    between = F.zip_with(F.slice(e, 1, F.size(e) - 1), F.slice(e, 2, F.size(e)), lambda a, b: F.struct(a["r"].alias("l"), b["l"].alias("r")))
    return trs.withColumns({"n_exons": F.size(e), "length": F.aggregate(e, F.lit(0), lambda n, x: n + (x["r"] - x["l"]).cast("int")), "start": e[0]["l"], "end": F.element_at(e, -1)["r"], "introns": F.when(F.size(e) > 1, between).otherwise(F.array().cast("array<struct<l:int,r:int>>"))})


def long_and_covered(n_exons: Column, length: Column, coverage: Column, base: int = 150, increase: int = 50, single: float = 20, multi: float = 1.5) -> Column:
    """Whether a transcript is long enough for its exons and covered enough."""
    return (length >= base + increase * n_exons) & (coverage >= F.when(n_exons > 1, multi).otherwise(single))


def nested(inner: DataFrame, introns: DataFrame, keys: Sequence[str], bin_width: int = 4096) -> DataFrame:
    """The rows of introns (id, keys, l, r, cov) within which some other row of inner (id, keys, l, r, cov) with at least its coverage lies: ids only.

    Introns are cut into bins, and an inner row is looked for in the bin of its start only, so what meets is near.
    """
    a = introns.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("l") / bin_width), F.floor(F.col("r") / bin_width)))).alias("a")
    b = inner.select(*keys, F.floor(F.col("l") / bin_width).alias("_bin"), F.col("l").alias("_l"), F.col("r").alias("_r"), F.col("cov").alias("_cov"))
    return a.join(b.alias("b"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.col("a._bin") == F.col("b._bin"), F.col("b._l") > F.col("a.l"), F.col("b._r") < F.col("a.r"), F.col("b._cov") >= F.col("a.cov")], "left_semi").select("a.id").distinct()


def not_contained(rows: DataFrame, keys: Sequence[str], order: Sequence[str], left: str = "pos", right: str = "rpos", bin_width: int = 4096) -> DataFrame:
    """rows that no other of their keys contains, by one pass in bins of the order: a row is contained if one that starts before it, or with it but first in order, reaches as far.

    `order` starts with the left end; equal intervals keep their first.
    """
    far = running(rows, keys, F.floor(F.col(left) / bin_width), [F.col(left), F.col(right).desc(), *order], F.col(right), "max", "_far", with_own=False)
    return far.where(F.col("_far").isNull() | (F.col(right) > F.col("_far"))).drop("_far")


def gene_features(trs: DataFrame) -> DataFrame:
    """gene_id, n, coverage, start, end, boundaries (distinct exon ends, ascending) over transcripts (gene_id, coverage, exons)."""
    ends = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.concat(F.transform("exons", lambda e: e["l"]), F.transform("exons", lambda e: e["r"]))))))
    first, last = F.col("exons")[0]["l"], F.element_at("exons", -1)["r"]
    return trs.groupBy("gene_id").agg(F.count(F.lit(1)).alias("n"), F.sum("coverage").alias("coverage"), F.min(first).alias("start"), F.max(last).alias("end"), ends.alias("boundaries"))


def joined_neighbours(rows: DataFrame, keys: Sequence[str], gap: int, bin_width: int = 4096) -> DataFrame:
    """Single-exon transcripts (keys, l, r, coverage) joined where at most `gap` apart: keys, l, r, n, coverage (by length)."""
    bins, order = F.floor(F.col("l") / bin_width), ["l", "r", *[c for c in rows.columns if c not in (*keys, "l", "r")]]
    reached = running(rows, keys, bins, order, F.col("r"), "max", "_reach", with_own=False)
    new = F.when(F.col("_reach").isNull() | (F.col("l") > F.col("_reach") + gap), 1).otherwise(0)
    size = F.col("r") - F.col("l")
    return running(reached, keys, bins, order, new, "sum", "_k").groupBy(*keys, "_k").agg(F.min("l").alias("l"), F.max("r").alias("r"), F.count(F.lit(1)).alias("n"), (F.sum(F.col("coverage") * size) / F.sum(size)).alias("coverage")).drop("_k")


def _reaches(a: list, start: int, end: int, ratio: float) -> bool:
    """Whether item a (start, end, ...) and the stretch overlap by `ratio` of either's length."""
    over = min(a[1], end) - max(a[0], start)
    return over >= ratio * (a[1] - a[0]) or over >= ratio * (end - start)


def merged_singles(rows: DataFrame, keys: Sequence[str], order: Sequence[str] = ("run",), ratio: float = 0.9, bin_width: int = 4096) -> DataFrame:
    """keys, cnt, coverage (the least), start, end of single-exon transcripts (keys, order columns, start, end, coverage) merged where they overlap by `ratio` of either's length.

    Transcripts are taken one after the other, by `order`, then start and end. Among the items so far, in order of start and end, one goes to the first that it matches and widens
    that item's bounds; if it meets one that starts behind it (or with it, but ends behind it) without a match, or the last, it becomes an item of its own. Only what overlaps can match, so
    each island of overlapping transcripts is worked out for itself, in one pass over its rows in that order: a task holds the items of one island, however many rows it has. Equal stretches of
    one place in the order are added up before they are dealt.
    """
    equal = rows.groupBy(*keys, *order, "start", "end").agg(F.count(F.lit(1)).alias("cnt"), F.min("coverage").cast("double").alias("coverage"))
    bins = F.floor(F.col("start") / bin_width)
    by = ["start", "end", *order]
    reached = running(equal, keys, bins, by, F.col("end"), "max", "_reach", with_own=False)
    islands = running(reached, keys, bins, by, F.when(F.col("_reach").isNull() | (F.col("start") >= F.col("_reach")), 1).otherwise(0), "sum", "_island")
    own = [*keys, "_island"]
    dealt = islands.drop("_reach").repartition(*own).sortWithinPartitions(*own, *order, "start", "end")
    kinds = dict(dealt.dtypes)
    out = [*keys, "cnt", "coverage", "start", "end"]

    def merge(frames):
        items: list[list] = []
        starts: list[int] = []
        longest, now = 0, None

        def told():
            return [(*now[:-1], n, c, a, b) for a, b, n, c in items]

        for frame in frames:
            done = []
            for row in frame[[*own, "start", "end", "cnt", "coverage"]].itertuples(index=False, name=None):
                key, (start, end, cnt, cov) = row[: len(own)], row[len(own) :]
                if key != now:
                    if items:
                        done += told()
                    items, starts, longest, now = [], [], 0, key
                at = bisect_left(starts, start - longest)
                while at < len(items) and not _reaches(items[at], start, end, ratio) and (items[at][0], items[at][1]) <= (start, end):
                    at += 1
                if at < len(items) and _reaches(items[at], start, end, ratio):
                    a = items[at]
                    items[at] = [min(a[0], start), max(a[1], end), a[2] + cnt, min(a[3], cov)]
                    starts[at] = items[at][0]
                else:
                    items.insert(at, [start, end, cnt, cov])
                    starts.insert(at, start)
                longest = max(longest, items[at][1] - items[at][0])
            if done:
                yield pd.DataFrame(done, columns=out)
        if items:
            yield pd.DataFrame(told(), columns=out)

    return dealt.mapInPandas(merge, ", ".join(f"`{c}` {kinds[c]}" for c in out))


def consensus(runs: DataFrame, keys: Sequence[str], least_multi: int = 5, least_single: int = 11, n_runs: int = 10, order: Sequence[str] = ("run",), ratio: float = 0.9) -> DataFrame:
    """keys, introns, cnt, coverage, start, end of transcripts (keys, introns, coverage, start, end, and columns that order them) that enough runs agree on.

    Multi-exon ones (one or more introns) agree by intron chain and add up coverage, over the number of runs; single-exon ones by overlap (merged_singles()), with the least coverage.
    """
    multi = runs.where(F.size("introns") > 0).groupBy(*keys, "introns").agg(F.count(F.lit(1)).alias("cnt"), (F.sum("coverage") / n_runs).alias("coverage"), F.min("start").alias("start"), F.max("end").alias("end")).where(F.col("cnt") >= least_multi)
    single = merged_singles(runs.where(F.size("introns") == 0).select(*keys, *order, "start", "end", "coverage"), keys, order, ratio).where(F.col("cnt") >= least_single)
    return multi.unionByName(single.withColumn("introns", F.array().cast(runs.schema["introns"].dataType)))


def merge_items(items: DataFrame, keys: Sequence[str], mode: str = "add") -> DataFrame:
    """keys, cnt, coverage, start, end, samples (map of sample to its highest coverage) of equal transcripts (keys, coverage, start, end, sample).

    mode: coverages are added, or the highest or lowest one stays ("max", "min"); "none" keeps those of the first item (lowest sample, then bounds and coverage) and only counts.
    """
    first = lambda c: F.min(F.struct("sample", "start", "end", "coverage"))[c]
    known = {"add": F.sum("coverage"), "max": F.max("coverage"), "min": F.min("coverage"), "none": first("coverage")}[mode]
    bounds = (first("start"), first("end")) if mode == "none" else (F.min("start"), F.max("end"))
    by_sample = items.groupBy(*keys, "sample").agg(F.max("coverage").alias("_c")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("sample", "_c"))).alias("samples"))
    merged = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt"), known.alias("coverage"), bounds[0].alias("start"), bounds[1].alias("end"))
    return merged.join(by_sample, list(keys))


def known_chains(trs: DataFrame, others: DataFrame, on: Sequence[str], least: int = 1) -> DataFrame:
    """trs with found: whether `least` rows or more of others have its key (strand and intron chain)."""
    known = others.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return trs.join(known, list(on), "left").withColumn("found", F.col("_n").isNotNull()).drop("_n")


def expressed(trs: DataFrame, least: float, single_exons: bool = False) -> DataFrame:
    """Transcripts (exons, coverage) of `least` coverage, without those of one exon unless asked for."""
    return trs.where((F.col("coverage") >= least) & (F.lit(single_exons) | (F.size("exons") > 1)))


def expression(rows: DataFrame, coverage: str, length: str) -> DataFrame:
    """rows with rpkm (coverage over all aligned bases, times 1e9) and tpm (its share of all, times 1e6): sums over the table, joined as one row."""
    total = rows.agg(F.sum(length).alias("_bases"), F.sum(coverage).alias("_all"))
    return rows.crossJoin(F.broadcast(total)).withColumns({"rpkm": F.col(coverage) * 1e9 / F.col("_bases"), "tpm": F.col(coverage) * 1e6 / F.col("_all")}).drop("_bases", "_all")


def best_overlap(queries: DataFrame, targets: DataFrame, keys: Sequence[str], bin_width: int = 64) -> DataFrame:
    """qid, id, overlap: for each query (keys, qid, l, r) the target (keys, id, l, r) that overlaps it most, the lowest id on ties. Both sides meet in bins of the coordinate."""
    bins = lambda l, r: F.explode(F.sequence(F.floor(F.col(l) / bin_width), F.floor((F.col(r) - 1) / bin_width)))
    q = queries.where("r > l").withColumn("_bin", bins("l", "r"))
    t = targets.where("r > l").select(*keys, "id", F.col("l").alias("tl"), F.col("r").alias("tr")).withColumn("_bin", bins("tl", "tr"))
    both = q.join(t, [*keys, "_bin"]).where("tl < r AND l < tr").select("qid", "id", (F.least("r", "tr") - F.greatest("l", "tl")).alias("overlap"))
    return both.groupBy("qid").agg(F.max(F.struct("overlap", (-F.col("id")).alias("back"))).alias("_m")).select("qid", (-F.col("_m.back")).alias("id"), "_m.overlap")


def compare(reference: DataFrame, predicted: DataFrame, on: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn of distinct rows, for each value of the columns `by` (some of on)."""
    a, b = reference.select(*on).distinct().withColumn("_a", F.lit(1)), predicted.select(*on).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, list(on), "full")
    return both.groupBy(*by).agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("tp"), F.count_if(F.col("_a").isNull()).alias("fp"), F.count_if(F.col("_b").isNull()).alias("fn"))


def path_exons(paths: DataFrame, vertices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """paths with exons: their vertices' stretches, touching ones joined."""
    from lociflow.sources.gtf import merged_exons

    steps = paths.select(*keys, "k", F.explode("path").alias("v")).join(vertices.select(*keys, "v", "l", "r"), [*keys, "v"])
    exons = steps.groupBy(*keys, "k").agg(F.collect_list(F.struct(F.col("l").cast("int").alias("l"), F.col("r").cast("int").alias("r"))).alias("_e"))
    return paths.join(exons.select(*keys, "k", merged_exons(F.col("_e")).alias("exons")), [*keys, "k"])
