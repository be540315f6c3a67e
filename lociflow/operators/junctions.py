"""Junctions, the regions between them, and how alignments lie on regions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociflow.operators.bins import WIDTH, within
from lociflow.sources.shared import shuffled_unions

#: Kinds of boundaries (fixed values).
START, END, LEFT, RIGHT, BOTH = 1, 2, 3, 4, 5


def junctions(introns: DataFrame, keys: Sequence[str] = ("tid",), least: int = 1) -> DataFrame:
    """keys, lpos, rpos, cnt, s1, s2 (how many on + and on -), strand ('.' if both or none), and nm (sum of mismatches) where introns have it, of each intron (lpos, rpos, xs) with `least` alignments."""
    plus, minus = F.count_if(F.col("xs") == "+"), F.count_if(F.col("xs") == "-")
    out = introns.groupBy(*keys, "lpos", "rpos").agg(F.count(F.lit(1)).alias("cnt"), plus.alias("s1"), minus.alias("s2"), *[F.sum("nm").alias("nm") for c in introns.columns if c == "nm"]).where(F.col("cnt") >= least)
    return out.withColumn("strand", F.when((F.col("s1") > 0) & (F.col("s2") == 0), "+").when((F.col("s2") > 0) & (F.col("s1") == 0), "-").otherwise("."))


def regions(stretches: DataFrame, cuts: DataFrame, keys: Sequence[str] = ("tid", "bid")) -> DataFrame:
    """keys, l, r, ltype, rtype: the stretches (lpos, rpos) tiled at junction ends (cuts: keys, lpos, rpos) strictly inside.

    A junction's left end closes a region on its left and its right end opens one on its right; a place that is both is RIGHT to its left and LEFT to its right.
    """
    bounds = stretches.select(*keys, F.explode(F.array(F.struct(F.col("lpos").alias("x"), F.lit(1 << START).alias("t")), F.struct(F.col("rpos").alias("x"), F.lit(1 << END).alias("t")))).alias("e"))
    inner = cuts.join(stretches.select(*keys, F.col("lpos").alias("_l"), F.col("rpos").alias("_r")), list(keys)).select(*keys, "_l", "_r", F.explode(F.array(F.struct(F.col("lpos").alias("x"), F.lit(1 << LEFT).alias("t")), F.struct(F.col("rpos").alias("x"), F.lit(1 << RIGHT).alias("t")))).alias("e")).where("e.x > _l AND e.x < _r")
    marked = bounds.unionByName(inner.select(*keys, "e")).groupBy(*keys, F.col("e.x").alias("x")).agg(F.bit_or("e.t").alias("m"))
    kind = F.when(F.col("m").bitwiseAND(1 << START) > 0, START).when(F.col("m").bitwiseAND(1 << END) > 0, END).when(F.col("m") == (1 << LEFT | 1 << RIGHT), BOTH).when(F.col("m").bitwiseAND(1 << LEFT) > 0, LEFT).otherwise(RIGHT)
    typed = marked.select(*keys, "x", kind.alias("t"))
    w = Window.partitionBy(*keys).orderBy("x")
    tiled = typed.withColumns({"r": F.lead("x").over(w), "rt": F.lead("t").over(w)}).where("r IS NOT NULL")
    return tiled.select(*keys, F.col("x").alias("l"), "r", F.when(F.col("t") == BOTH, RIGHT).otherwise(F.col("t")).alias("ltype"), F.when(F.col("rt") == BOTH, LEFT).otherwise(F.col("rt")).alias("rtype"))


def numbered(regs: DataFrame, keys: Sequence[str] = ("tid", "bid"), left: str = "l") -> DataFrame:
    """regs with rid: their places, from 0, within keys."""
    return regs.withColumn("rid", F.row_number().over(Window.partitionBy(*keys).orderBy(left)) - 1)


def locate(hits: DataFrame, regs: DataFrame, keys: Sequence[str] = ("tid", "bid"), left: str = "pos", right: str = "rpos", bin_width: int = WIDTH) -> DataFrame:
    """hits with first_rid and last_rid: the numbered regions that hold their first and last base."""
    at = lambda name: regs.select(*keys, F.col("l").alias("_l"), F.col("r").alias("_r"), F.col("rid").alias(name))
    both = within(hits, F.col(left), at("first_rid"), keys, "_l", "_r", bin_width).drop("_l", "_r")
    both = within(both, F.col(right) - 1, at("last_rid"), keys, "_l", "_r", bin_width)
    return both.select(*hits.columns, "first_rid", "last_rid")


def locate_blocks(hits: DataFrame, regs: DataFrame, ids: Sequence[str], keys: Sequence[str] = ("tid", "bid"), bin_width: int = WIDTH) -> DataFrame:
    """Spliced hits (keys, ids, blocks: array<struct<l,r>>, ascending) with ends (array<struct<k,rid,...>>: the region of each block's first and last base, two entries for each block) and v, the regions along the blocks.

    The outer ends are looked up by place; the inner ones are splices, so they must be a region's own boundary, and are joined by it. Regions between blocks are left out of v.
    A hit with an end on no region or boundary, or whose regions don't ascend, is left out. `ids` tell hits of equal keys apart; other columns of regs come along in ends.
    """
    shuffled_unions(hits.sparkSession)
    more = [c for c in regs.columns if c not in (*keys, "rid")]
    at = lambda *names: regs.select(*keys, *[F.col(c).alias(n) for c, n in names], F.struct("rid", *more).alias("_e"))
    own = hits.select(*keys, *ids, F.size("blocks").alias("_of"), F.posexplode("blocks").alias("_i", "_b")).select(*keys, *ids, "_of", "_i", F.col("_b.l").alias("_x"), F.col("_b.r").alias("_y"))
    out = lambda df, k: df.select(*keys, *ids, "_of", k.alias("_k"), "_e")
    left, right = 2 * F.col("_i"), 2 * F.col("_i") + 1
    outer = at(("l", "_l"), ("r", "_r"))
    ends = out(within(own.where("_i = 0"), F.col("_x"), outer, keys, "_l", "_r", bin_width), left)
    ends = ends.unionByName(out(within(own.where("_i = _of - 1"), F.col("_y") - 1, outer, keys, "_l", "_r", bin_width), right))
    ends = ends.unionByName(out(own.where("_i > 0").join(at(("l", "_x")), [*keys, "_x"]), left)).unionByName(out(own.where("_i < _of - 1").join(at(("r", "_y")), [*keys, "_y"]), right))
    held = ends.groupBy(*keys, *ids, "_of").agg(F.array_sort(F.collect_list(F.struct(F.col("_k").alias("k"), "_e.*"))).alias("ends")).where(F.size("ends") == 2 * F.col("_of"))
    rising = F.forall(F.sequence(F.lit(1), F.size("ends") - 1), lambda k: F.when(k % 2 == 1, F.get("ends", k - 1)["rid"] <= F.get("ends", k)["rid"]).otherwise(F.get("ends", k - 1)["rid"] < F.get("ends", k)["rid"]))
    v = F.flatten(F.transform(F.sequence(F.lit(0), F.col("_of") - 1), lambda i: F.sequence(F.get("ends", 2 * i)["rid"], F.get("ends", 2 * i + 1)["rid"])))
    return hits.join(held.where(rising).select(*keys, *ids, "ends", v.alias("v")), [*keys, *ids])


def annotated(introns: DataFrame, loci: DataFrame, keys: Sequence[str] = ("tid",), bin_width: int = WIDTH) -> DataFrame:
    """Junctions of reference transcripts' introns (keys, lpos, rpos, xs) strictly inside a locus (keys, bid, lpos, rpos): keys, bid, lpos, rpos, cnt (negative: not from reads), strand."""
    bounds = loci.select(*keys, "bid", F.col("lpos").alias("_l"), F.col("rpos").alias("_r"))
    held = within(introns, F.col("lpos"), bounds, keys, "_l", "_r", bin_width).where("lpos > _l AND rpos < _r")
    return junctions(held, [*keys, "bid"]).select(*keys, "bid", "lpos", "rpos", (-F.col("cnt")).alias("cnt"), "strand")


def clipped(blocks: DataFrame, loci: DataFrame, keys: Sequence[str] = ("tid",), bin_width: int = WIDTH) -> DataFrame:
    """blocks (keys, pos, rpos, ...) with bid, cut to each locus (keys, bid, lpos, rpos) that they overlap. A pair counts in the bin where the later of both starts."""
    from lociflow.operators.bins import in_bins

    bounds = in_bins(loci.select(*keys, "bid", F.col("lpos").alias("_l"), F.col("rpos").alias("_r")), "_l", "_r", bin_width)
    both = in_bins(blocks, "pos", "rpos", bin_width).join(bounds, [*keys, "_bin"]).where((F.col("pos") < F.col("_r")) & (F.col("_l") < F.col("rpos")) & (F.col("_bin") == F.floor(F.greatest("pos", "_l") / bin_width)))
    return both.select(*[F.greatest("pos", "_l").alias(c) if c == "pos" else F.least("rpos", "_r").alias(c) if c == "rpos" else F.col(c) for c in blocks.columns], "bid")


def align_blocks(blocks: DataFrame, exons: DataFrame, keys: Sequence[str] = ("tid", "bid"), slack: int = 3, bin_width: int = WIDTH) -> DataFrame:
    """blocks (keys, pos, rpos) with first and last: the numbered exons (keys, v, l, r; from 1) of their ends.

    An end with less than `slack` in its exon, but more than that of the exon outside, belongs to the next one inward. Blocks with an end in no exon are left out.
    """
    n = exons.groupBy(*keys).agg(F.max("v").alias("_n"))
    at = exons.select(*keys, "v", F.col("l").alias("_l"), F.col("r").alias("_r"))
    left = within(blocks, F.col("pos"), at, keys, "_l", "_r", bin_width)
    first = F.col("v") + ((F.col("pos") - F.col("_l") > slack) & (F.col("_r") - F.col("pos") < slack)).cast("int")
    right = within(left.select(*blocks.columns, first.alias("first")), F.col("rpos") - 1, at, keys, "_l", "_r", bin_width)
    last = F.col("v") - ((F.col("_r") - F.col("rpos") > slack) & (F.col("rpos") - F.col("_l") <= slack)).cast("int")
    return right.select(*blocks.columns, "first", last.alias("last")).join(n, list(keys)).where("first <= _n AND last >= 1").drop("_n")


def linked_paths(pairs: DataFrame, exons: DataFrame, keys: Sequence[str] = ("tid", "bid"), slack: int = 3, bin_width: int = WIDTH) -> DataFrame:
    """keys, path (exon numbers), cnt: the exons of each two blocks that a junction links (pairs: keys, pos, rpos, next_pos, next_rpos), how often each list of three or more occurs.

    Equal pairs are counted before they are located. Pairs with an end in no exon of their locus, or with the second not behind the first, are left out.
    """
    at = ["pos", "rpos", "next_pos", "next_rpos"]
    counted = pairs.groupBy(*keys, *at).agg(F.count(F.lit(1)).alias("cnt"))
    own = align_blocks(counted, exons, keys, slack, bin_width)
    then = own.select(*keys, F.col("next_pos").alias("pos"), F.col("next_rpos").alias("rpos"), F.col("first").alias("from"), F.col("last").alias("to"), "cnt")
    both = align_blocks(then, exons, keys, slack, bin_width).where("from <= to AND to < first AND first <= last")
    path = F.concat(F.sequence("from", "to"), F.sequence("first", "last"))
    return both.select(*keys, path.alias("path"), "cnt").where(F.size("path") >= 3).groupBy(*keys, "path").agg(F.sum("cnt").alias("cnt"))


def _covered(regs: DataFrame, segs: DataFrame, keys: Sequence[str], on: Sequence[str], gap: int, bin_width: int) -> DataFrame:
    """keys, _l, _r (the region's), l, r, area of the covered stretches of each region, with gaps of at most `gap` filled, the region's ends too."""
    inside = within(segs, F.col("p"), regs.select(*keys, "l", "r"), on, "l", "r", bin_width).where("q <= r").select(*keys, "l", "r", "p", "q", "cov")
    w = Window.partitionBy(*keys, "l").orderBy("p")
    new = F.when(F.col("p") > F.coalesce(F.lag("q").over(w), F.col("l")) + gap, 1).otherwise(0)
    cut = inside.withColumn("_k", F.sum(new).over(w))
    parts = cut.groupBy(*keys, "l", "r", "_k").agg(F.min("p").alias("a"), F.max("q").alias("b"), F.sum((F.col("q") - F.col("p")) * F.col("cov")).alias("area"))
    a, b = F.when(F.col("a") - F.col("l") <= gap, F.col("l")).otherwise(F.col("a")), F.when(F.col("r") - F.col("b") <= gap, F.col("r")).otherwise(F.col("b"))
    return parts.select(*keys, F.col("l").alias("_l"), F.col("r").alias("_r"), a.alias("l"), b.alias("r"), "area")


def partial_exons(regs: DataFrame, segs: DataFrame, keys: Sequence[str] = ("tid", "bid"), on: Sequence[str] = ("tid",), gap: int = 3, least_length: int = 15, least_sum: float = 3, least_ave: float = 1.5, bin_width: int = WIDTH) -> DataFrame:
    """keys, l, r, length, area, empty: the covered stretches of each region, with gaps of at most `gap` filled, the region's ends too.

    A stretch that doesn't touch both ends of its region is empty if short, thin on average or thin in sum.
    """
    parts = _covered(regs, segs, keys, on, gap, bin_width).withColumn("length", F.col("r") - F.col("l"))
    thin = (F.col("length") < least_length) | (F.col("area") < least_ave * F.col("length")) | (F.col("area") < least_sum)
    return parts.select(*keys, "l", "r", "length", "area", (thin & ~((F.col("l") == F.col("_l")) & (F.col("r") == F.col("_r")))).alias("empty"))


def low_middles(regs: DataFrame, segs: DataFrame, keys: Sequence[str] = ("tid", "bid"), on: Sequence[str] = ("tid",), least_region: int = 100, least_middle: int = 10, least_flank: int = 40, most_cov: int = 2, least_ave: float = 10, bin_width: int = WIDTH) -> DataFrame:
    """keys, l, r (the region's), left, right, left_ave, right_ave: where a region covered from its start on, but not throughout, splits.

    A split lies between two segments of more than `most_cov` with none between them, `least_middle` apart and `least_flank` from both ends of the region; before and
    behind it the mean coverage is `least_ave` at least. Regions shorter than `least_region` have none.
    """
    inside = within(segs, F.col("p"), regs.select(*keys, "l", "r"), on, "l", "r", bin_width).where(f"q <= r AND r - l >= {least_region}").withColumn("_area", F.col("cov") * (F.col("q") - F.col("p")))
    whole = Window.partitionBy(*keys, "l")
    upto = whole.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    before = whole.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    heavy = lambda c: F.last(F.when(F.col("cov") > most_cov, F.col(c)), ignorenulls=True).over(before)
    summed = inside.withColumns({"_sum": F.sum("_area").over(upto), "_all": F.sum("_area").over(whole), "_covered": F.sum(F.col("q") - F.col("p")).over(whole), "_first": F.min("p").over(whole)})
    met = summed.withColumns({"left": heavy("q"), "_left_area": heavy("_sum"), "right": F.col("p"), "_right_area": F.col("_all") - F.col("_sum") + F.col("_area")})
    met = met.where((F.col("cov") > most_cov) & (F.col("_first") == F.col("l")) & (F.col("_covered") < F.col("r") - F.col("l")) & (F.col("right") - F.col("left") >= least_middle) & (F.col("left") - F.col("l") >= least_flank) & (F.col("r") - F.col("right") >= least_flank))
    split = met.select(*keys, "l", "r", "left", "right", (F.col("_left_area") / (F.col("left") - F.col("l"))).alias("left_ave"), (F.col("_right_area") / (F.col("r") - F.col("right"))).alias("right_ave"))
    return split.where((F.col("left_ave") >= least_ave) & (F.col("right_ave") >= least_ave))


#: Weight of a one-base exon at a splice that coverage doesn't show (a fixed value).
STUB_WEIGHT = 0.01


def typed_exons(regs: DataFrame, segs: DataFrame, keys: Sequence[str] = ("tid", "bid"), on: Sequence[str] = ("tid",), gap: int = 3, least_length: int = 15, least_sum: float = 3, least_ave: float = 1.5, bin_width: int = WIDTH) -> DataFrame:
    """keys, rl, rr (the region's), l, r, ltype, rtype, w (mean coverage), empty, stub: partial exons with kinds of boundaries, and one-base stubs.

    A stretch has its region's kind of boundary where it reaches that end, else START or END. One that reaches a spliced end isn't empty. Where coverage
    doesn't reach a region's spliced end, a stub of one base and STUB_WEIGHT stands there, so that the junction has an exon. Regions without coverage have none.
    """
    kinds = regs.select(*keys, F.col("l").alias("rl"), F.col("r").alias("rr"), F.col("ltype").alias("_lt"), F.col("rtype").alias("_rt"))
    parts = _covered(regs, segs, keys, on, gap, bin_width).withColumnsRenamed({"_l": "rl", "_r": "rr"}).join(kinds, [*keys, "rl", "rr"])
    left, right, length = F.col("l") == F.col("rl"), F.col("r") == F.col("rr"), F.col("r") - F.col("l")
    thin = (length < least_length) | (F.col("area") < least_ave * length) | (F.col("area") < least_sum)
    spliced = (left & (F.col("_lt") == RIGHT)) | (right & (F.col("_rt") == LEFT))
    columns = [*keys, "rl", "rr", "l", "r", "ltype", "rtype", "w", "empty", "stub"]
    own = parts.withColumns({"ltype": F.when(left, F.col("_lt")).otherwise(START), "rtype": F.when(right, F.col("_rt")).otherwise(END), "w": F.col("area") / length, "empty": thin & ~(left & right) & ~spliced, "stub": F.lit(False)})
    seen = parts.groupBy(*keys, "rl", "rr", "_lt", "_rt").agg(F.bool_or(left).alias("_left"), F.bool_or(right).alias("_right"))
    stub = lambda l, lt, rt: F.struct(l.cast("int").alias("l"), (l + 1).cast("int").alias("r"), lt.alias("ltype"), rt.alias("rtype"))
    at = F.array_compact(F.array(F.when(~F.col("_left") & (F.col("_lt") == RIGHT), stub(F.col("rl"), F.col("_lt"), F.lit(END))), F.when(~F.col("_right") & (F.col("_rt") == LEFT), stub(F.col("rr") - 1, F.lit(START), F.col("_rt")))))
    stubs = seen.select(*keys, "rl", "rr", F.explode(at).alias("e")).select(*keys, "rl", "rr", "e.*", F.lit(STUB_WEIGHT).alias("w"), F.lit(False).alias("empty"), F.lit(True).alias("stub"))
    return own.select(*columns).unionByName(stubs.select(*columns))
