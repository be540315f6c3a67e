"""Queries over fragments, exon kinds and lookups, each with its SQL where that can express it.

In the projection mates are the n-th odd and the n-th even line of a locus and stretch of 64 days, mismatches are `qid % 4`, and links of type 1 those of every fifth `hid`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociflow.operators import bridging, coverage, fragments, graphs, junctions, loci, mates, transcripts
from lociflow.plans.locus_queries import BASE, BIN, HITS, ORD, _assigned, _introns, _junctions, _located, _loci, _regions, _segments
from lociflow.operators.running import look_back
from lociflow.sources.shared import written
from lociflow.sources.tables import ALN_SQL, ORDER, alignments

MATE = ["pos", "rpos", "qid", "ln", "hid", "xs", "nm", "kl", "kr", "outer_l", "outer_r", "v", "size"]
#: The fragment lengths that a bridge may lead to, from a median of 60.
LOW, HIGH = bridging.length_window(60, 10, 150)


def _reads(spark, d) -> tuple[DataFrame, DataFrame]:
    """Spliced alignments of up to four blocks, the following rows of a locus and strand as long as each lies behind the one before it, and the regions."""
    rows, regs = written(_assigned(spark, d), "assigned"), written(_regions(spark, d), "regions")
    w = Window.partitionBy("tid", "bid", "xs").orderBy(*ORDER)
    ahead = [F.lead(F.struct("pos", "rpos"), k).over(w).alias(f"_b{k}") for k in (1, 2, 3)]
    reads = rows.join(loci.loci(rows).select("tid", "bid"), ["tid", "bid"], "left_semi").select("*", *ahead)
    own, ok = [F.struct(F.col("pos").alias("l"), F.col("rpos").alias("r"))], F.lit(True)
    for k in (1, 2, 3):
        b, before = F.col(f"_b{k}"), F.col("rpos") if k == 1 else F.col(f"_b{k - 1}.rpos")
        ok = ok & F.coalesce((b["pos"] > before) & (F.col("qid") % 4 >= k), F.lit(False))
        own.append(F.when(ok, F.struct(b["pos"].alias("l"), b["rpos"].alias("r"))))
    reads = reads.withColumn("blocks", F.array_compact(F.array(*own)))
    return reads.withColumn("rpos", F.element_at("blocks", -1)["r"]).drop("_b1", "_b2", "_b3"), regs


def _paired(hits: DataFrame) -> DataFrame:
    one = hits.select("tid", "bid", F.floor(F.col("pos") / 64).alias("part"), *ORDER, F.struct(*MATE).alias("m"))
    pairs = mates.pair_mates(one.where("ln % 2 = 1"), one.where("ln % 2 = 0"), ["tid", "bid", "part"], ORDER, ORDER)
    frags = fragments.fragments(pairs.select("tid", "bid", F.least("m", "mate_m").alias("m1"), F.greatest("m", "mate_m").alias("m2")))
    return frags.withColumns({"fid": F.struct(*[F.col(f"m1.{c}").alias(c) for c in ORDER]), "type": F.when(F.col("m1.hid") % 5 == 0, 1).otherwise(0)})


def _fragments(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fragments, located alignments and regions."""
    hits, regs = _located(spark, d)
    hits = written(fragments.with_offsets(hits.withColumn("nm", F.col("qid") % 4), regs), "hits")
    return _paired(hits), hits, regs


def _spliced_fragments(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fragments of spliced mates, the spliced alignments and regions."""
    reads, regs = _reads(spark, d)
    hits = written(fragments.on_regions(reads.withColumn("nm", F.col("qid") % 4), regs, ORDER, bin_width=BIN), "hits")
    return _paired(hits), hits, regs


def spliced_region_list(spark, d):
    """The regions along the blocks of each spliced alignment, and their length."""
    reads, regs = _reads(spark, d)
    hits = fragments.on_regions(reads, regs, ORDER, bin_width=BIN)
    return hits.select("tid", "bid", *ORDER, F.size("blocks").alias("n_blocks"), F.array_join("v", ">").alias("v"), "size")


def spliced_fragments(spark, d):
    """Fragments of spliced mates: offsets, what may be shortened, lengths and regions."""
    f = _spliced_fragments(spark, d)[0]
    told = [F.col(f"m{i}.{c}").alias(f"{c}{i}") for i in (1, 2) for c in ("qid", "ln", "hid", "size")]
    return f.select("tid", "bid", *told, "lpos", "rpos", "k1l", "k1r", "k2l", "k2r", "b1", "b2", *[F.array_join(f"m{i}.v", ">").alias(f"v{i}") for i in (1, 2)])


def fragment_offsets(spark, d):
    f = _fragments(spark, d)[0]
    return f.select("tid", "bid", *[F.col(f"m{i}.{c}").alias(f"{c}{i}") for i in (1, 2) for c in ("qid", "ln", "hid")], "lpos", "rpos", "k1l", "k1r", "k2l", "k2r", "b1", "b2")


def fragment_groups(spark, d):
    g = fragments.grouped(_fragments(spark, d)[0])
    return g.select("tid", "bid", F.col("v1")[0].alias("f1"), F.element_at("v1", -1).alias("l1"), F.col("v2")[0].alias("f2"), F.element_at("v2", -1).alias("l2"), "k1l", "k1r", "k2l", "k2r", "cnt", "lpos", "rpos")


def fragment_sizes(spark, d):
    """Lengths of fragments whose mates' regions overlap."""
    frags, _, regs = _fragments(spark, d)
    over = frags.where(F.element_at("m1.v", -1) >= F.col("m2.v")[0]).withColumn("path", F.array_sort(F.array_union("m1.v", "m2.v")))
    return fragments.sized(over, regs).select("tid", "bid", *[F.col(f"fid.{c}").alias(c) for c in ("qid", "ln", "hid")], "length")


def region_lengths(spark, d):
    return fragments.upto(_regions(spark, d)).select("tid", "bid", "rid", "upto")


def _ways(spark, d, frags: DataFrame, hits: DataFrame, regs: DataFrame) -> DataFrame:
    """Bridged fragments, over regions that hits or junctions show in a row, or that touch."""
    seen = fragments.region_pairs(hits)
    left = regs.select("tid", "bid", F.col("r").alias("lpos"), F.col("rid").alias("lexon"))
    right = regs.select("tid", "bid", F.col("l").alias("rpos"), F.col("rid").alias("rexon"))
    spliced = _junctions(spark, d).select("tid", "lpos", "rpos", "cnt").join(left, ["tid", "lpos"]).join(right, ["tid", "bid", "rpos"]).select("tid", "bid", F.array("lexon", "rexon").alias("path"), "cnt")
    touching = regs.where("rid > 0").select("tid", "bid", (F.col("rid") - 1).alias("s"), F.col("rid").alias("t"))
    edges = bridging.junction_graph(seen.unionByName(spliced).groupBy("tid", "bid", "path").agg(F.max("cnt").alias("cnt")), touching, ["tid", "bid"])
    return written(fragments.bridged(written(frags, "fragments"), regs, written(edges, "ways"), LOW, HIGH), "bridged")


def _unused(rows: DataFrame, out: DataFrame) -> DataFrame:
    """The rows that are in no fragment of a fitting length."""
    used = out.where("kind = 1").select("tid", F.explode(F.array(*[F.struct(*[F.col(f"{m}.{c}").alias(c) for c in ORDER]) for m in ("m1", "m2")])).alias("h")).select("tid", "h.*")
    return rows.join(used, ["tid", *ORDER], "left_anti")


def _bridged(spark, d) -> tuple[DataFrame, DataFrame]:
    """Bridged fragments, and the alignments that are in none of a fitting length."""
    out = _ways(spark, d, *_fragments(spark, d))
    return out, _unused(alignments(spark, d), out)


def spliced_bridges(spark, d):
    """Fragments of spliced mates with the ways between them."""
    return _told(_ways(spark, d, *_spliced_fragments(spark, d)))


def spliced_coverage(spark, d):
    """Coverage of bridged fragments of spliced mates and of the blocks of the alignments that are in none."""
    frags, hits, regs = _spliced_fragments(spark, d)
    out = _ways(spark, d, frags, hits, regs)
    alone = _unused(hits, out).select("tid", F.explode("blocks").alias("b")).select("tid", F.col("b.l").alias("pos"), F.col("b.r").alias("rpos"))
    return coverage.segments(fragments.blocks_of(out, alone), bin_width=8 * BIN)


def _told(f: DataFrame) -> DataFrame:
    return f.select("tid", "bid", *[F.col(f"fid.{c}").alias(c) for c in ORDER], F.array_join("path", ">").alias("path"), "length", "kind", F.size("splices").alias("n_splices"), F.size("blocks").alias("n_blocks"))


def bridged_fragments(spark, d):
    return _told(_bridged(spark, d)[0])


def bridge_counts(spark, d):
    return fragments.bridge_counts(_bridged(spark, d)[0])


def bridged_coverage(spark, d):
    """Coverage of bridged fragments and of the alignments that are in none."""
    f, alone = _bridged(spark, d)
    return coverage.segments(fragments.blocks_of(f, alone), bin_width=8 * BIN)


def bridged_junctions(spark, d):
    """Junctions of bridged fragments and of the alignments that are in none."""
    f, alone = _bridged(spark, d)
    own = loci.next_block(alone).where("nxt IS NOT NULL").select("tid", F.col("rpos").alias("lpos"), F.col("nxt").alias("rpos"), "xs", (F.col("qid") % 4).alias("nm"))
    return junctions.junctions(fragments.introns_of(f, own))


def junction_mismatches(spark, d):
    rows = loci.next_block(alignments(spark, d)).where("nxt IS NOT NULL")
    return junctions.junctions(rows.select("tid", F.col("rpos").alias("lpos"), F.col("nxt").alias("rpos"), "xs", (F.col("qid") % 4).alias("nm"))).select("tid", "lpos", "rpos", "cnt", "nm", "strand")


def annotated_junctions(spark, d):
    """The introns of strand + as if they were a reference's, inside loci."""
    return junctions.annotated(_introns(alignments(spark, d).where("xs = '+'")), written(_loci(spark, d), "loci"), bin_width=BIN)


def clipped_exons(spark, d):
    """Alignments without a strand as if they were a reference's exons, cut to the loci that they overlap and located on regions."""
    blocks = alignments(spark, d).where("xs = '.'").select("tid", "pos", "rpos", "qid", "ln", "hid")
    cut = junctions.clipped(blocks, written(_loci(spark, d), "loci"), bin_width=BIN)
    return junctions.locate(cut, written(_regions(spark, d), "regions"), bin_width=BIN)


def _typed(spark, d) -> DataFrame:
    regs = written(_regions(spark, d), "regions")
    bounds = regs.groupBy("tid", "bid").agg(F.min("l").alias("_bl"), F.max("r").alias("_br"))
    x = junctions.typed_exons(regs, _segments(spark, d), bin_width=BIN).join(bounds, ["tid", "bid"])
    whole = (F.col("l") == F.col("_bl")) & (F.col("r") == F.col("_br"))
    return x.withColumn("regional", (F.col("ltype") == junctions.START) & (F.col("rtype") == junctions.END) & ~whole).drop("_bl", "_br")


def exon_types(spark, d):
    return _typed(spark, d).select("tid", "bid", "l", "r", "ltype", "rtype", F.round("w", 6).alias("w"), "empty", "stub", "regional")


def region_inclusion(spark, d):
    """Whether a region's first exon starts at its start, and its last ends at its end."""
    return _typed(spark, d).groupBy("tid", "bid", "rl", "rr").agg((F.min("l") == F.col("rl")).alias("left"), (F.max("r") == F.col("rr")).alias("right"))


def regional_loci(spark, d):
    """Loci with more than regional exons, as typed, of those with a graph."""
    x = written(_typed(spark, d).where("NOT empty"), "typed")
    return graphs.worth_solving(x, x.where("rtype = 3").select("tid", "bid"), ["tid", "bid"])


def low_middles(spark, d):
    out = junctions.low_middles(_regions(spark, d), _segments(spark, d), least_region=10, least_middle=1, least_flank=2, most_cov=0, least_ave=0.5, bin_width=BIN)
    return out.select("tid", "bid", "l", "r", "left", "right", F.round("left_ave", 6).alias("left_ave"), F.round("right_ave", 6).alias("right_ave"))


def hit_exon_list(spark, d):
    hits, regs = _located(spark, d)
    ex = junctions.partial_exons(regs, _segments(spark, d), bin_width=BIN).where("NOT empty")
    numbered = written(junctions.numbered(ex).withColumn("v", F.col("rid") + 1).select("tid", "bid", "v", "l", "r"), "exons")
    return junctions.align_blocks(hits.select("tid", "bid", *ORDER), numbered, bin_width=BIN).select("tid", "bid", "qid", "ln", "hid", "first", "last")


def well_covered(spark, d):
    """How many alignments of each sequence lie on regions with a mean coverage of 1.5 or more only."""
    hits, regs = _located(spark, d)
    stats = coverage.stretch_stats(regs.select("tid", "bid", "rid", F.col("l").alias("lpos"), F.col("r").alias("rpos")), _segments(spark, d), ["tid"], bin_width=BIN)
    on = hits.select("tid", "bid", F.struct(*ORDER).alias("h"), F.explode(F.sequence("first_rid", "last_rid")).alias("rid")).join(stats.select("tid", "bid", "rid", "ave"), ["tid", "bid", "rid"])
    return on.groupBy("tid", "bid", "h").agg(F.bool_and(F.col("ave") >= 1.5).alias("ok")).groupBy("tid").agg(F.count_if("ok").alias("n"))


def strand_conflicts(spark, d):
    flags = F.when(F.col("hid") % 4 == 0, "+").when(F.col("hid") % 4 == 1, "-").otherwise(".")
    return alignments(spark, d).groupBy(F.coalesce(loci.settled_strand(flags, F.col("xs")), F.lit("conflict")).alias("strand"), "xs").agg(F.count(F.lit(1)).alias("n"))


def touching_hits(spark, d):
    a = alignments(spark, d)
    hits, segs = a.where("xs = '+'").select("tid", *ORDER), coverage.segments(a.where("xs = '-'"), bin_width=8 * BIN)
    return loci.touching_coverage(hits, segs, bin_width=BIN).groupBy("tid", "inside").agg(F.count(F.lit(1)).alias("n"))


def coverage_splits(spark, d):
    a = alignments(spark, d)
    points = a.where("xs = '.'").select("tid", (F.col("pos") + 1).alias("x"))
    return coverage.split(_segments(spark, d), points, bin_width=BIN)


def region_line_fit(spark, d):
    """The least-squares line through the segments of each region that has three or more."""
    from lociflow.operators.bins import within

    regs = written(_regions(spark, d).select("tid", "bid", "l", "r"), "regions")
    inside = within(_segments(spark, d), F.col("p"), regs, ["tid"], "l", "r", BIN).where("q <= r")
    big = inside.groupBy("tid", "bid", "l").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    f = coverage.line_fit(inside.join(big, ["tid", "bid", "l"], "left_semi"), ["tid", "bid", "l"])
    return f.select("tid", "bid", "l", (F.round("slope", 5) + 0.0).alias("slope"))


def contained_within_ten(spark, d):
    """Alignments that one of the ten before them contains."""
    x = look_back(alignments(spark, d), ["tid"], F.floor(F.col("pos") / (8 * BIN)), ORDER, F.col("rpos"), "max", "far", 10)
    return x.where("far >= rpos").select("tid", *ORDER)


def merge_modes(spark, d):
    """Alignments as transcripts of a strand, merged in each mode; a sample is a supplier's last digit."""
    items = alignments(spark, d).select("tid", "xs", (F.col("hid") % 10).alias("sample"), F.col("qid").cast("double").alias("coverage"), F.col("pos").alias("start"), F.col("rpos").alias("end"))
    out = None
    for mode in ("add", "max", "min", "none"):
        m = transcripts.merge_items(items, ["tid", "xs"], mode).select(F.lit(mode).alias("mode"), "tid", "xs", "cnt", "coverage", "start", "end", F.aggregate(F.map_values("samples"), F.lit(0.0), lambda a, x: a + x).alias("samples"))
        out = m if out is None else out.unionByName(m)
    return out


def known_chains(spark, d):
    """Distinct introns of strand +, and whether strand - has them twice or more."""
    i = _introns(alignments(spark, d))
    return transcripts.known_chains(i.where("xs = '+'").select("tid", F.col("rpos") - F.col("lpos")).toDF("tid", "length").distinct(), i.where("xs = '-'").select("tid", (F.col("rpos") - F.col("lpos")).alias("length")), ["tid", "length"], 2)


def capped_sample(spark, d):
    """At most three alignments of each locus of six or more, 2,000 in all."""
    return mates.capped(_assigned(spark, d), ["tid", "bid"], ORDER, per_key=3, least=6, total=2000).select("tid", "bid", *ORDER)


PAIRED = BASE + f""", {HITS},
one AS (SELECT h.*, CAST(floor(h.pos / 64.0) AS BIGINT) AS part, h.pos - f.l AS kl, z.r - h.rpos AS kr, z.l AS ol, f.r AS orr, last_rid - first_rid + 1 AS nv, qid % 4 AS nm FROM hit h JOIN reg f ON h.tid = f.tid AND h.bid = f.bid AND h.first_rid = f.rid JOIN reg z ON h.tid = z.tid AND h.bid = z.bid AND h.last_rid = z.rid),
oa AS (SELECT *, row_number() OVER (PARTITION BY tid, bid, part ORDER BY {ORD}) AS k FROM one WHERE ln % 2 = 1), ob AS (SELECT *, row_number() OVER (PARTITION BY tid, bid, part ORDER BY {ORD}) AS k FROM one WHERE ln % 2 = 0),
pq AS (SELECT a.tid, a.bid, (a.pos, a.rpos, a.qid, a.ln, a.hid) < (b.pos, b.rpos, b.qid, b.ln, b.hid) AS up, a, b FROM oa a JOIN ob b ON a.tid = b.tid AND a.bid = b.bid AND a.part = b.part AND a.k = b.k),
fr AS (SELECT tid, bid, CASE WHEN up THEN a ELSE b END AS m1, CASE WHEN up THEN b ELSE a END AS m2 FROM pq)
"""
READS = BASE + f""", rd0 AS (SELECT b.*, lead(pos, 1) OVER w AS p1, lead(rpos, 1) OVER w AS q1, lead(pos, 2) OVER w AS p2, lead(rpos, 2) OVER w AS q2, lead(pos, 3) OVER w AS p3, lead(rpos, 3) OVER w AS q3 FROM bnd b SEMI JOIN bun USING (tid, bid) WINDOW w AS (PARTITION BY tid, bid, xs ORDER BY {ORD})),
rd1 AS (SELECT *, coalesce(p1 > rpos AND qid % 4 >= 1, false) AS k1, coalesce(p1 > rpos AND p2 > q1 AND qid % 4 >= 2, false) AS k2, coalesce(p1 > rpos AND p2 > q1 AND p3 > q2 AND qid % 4 >= 3, false) AS k3 FROM rd0),
rd AS (SELECT tid, bid, pos, CASE WHEN k3 THEN q3 WHEN k2 THEN q2 WHEN k1 THEN q1 ELSE rpos END AS rpos, qid, ln, hid, 1 + CAST(k1 AS INT) + CAST(k2 AS INT) + CAST(k3 AS INT) AS nb, list_filter([struct_pack(a := pos, b := rpos), CASE WHEN k1 THEN struct_pack(a := p1, b := q1) END, CASE WHEN k2 THEN struct_pack(a := p2, b := q2) END, CASE WHEN k3 THEN struct_pack(a := p3, b := q3) END], lambda x: x IS NOT NULL) AS blocks FROM rd1),
on_ AS (SELECT DISTINCT h.tid, h.bid, pos, rpos, qid, ln, hid, nb, g.rid, g.l, g.r FROM (SELECT *, unnest(blocks) AS x FROM rd) h JOIN reg g ON h.tid = g.tid AND h.bid = g.bid AND g.l < h.x.b AND g.r > h.x.a),
rl AS (SELECT tid, bid, pos, rpos, qid, ln, hid, nb, list(rid ORDER BY rid) AS v, CAST(sum(r - l) AS BIGINT) AS size, pos - min(l) AS kl, max(r) - rpos AS kr, max(l) AS ol, min(r) AS orr, qid % 4 AS nm, CAST(floor(pos / 64.0) AS BIGINT) AS part FROM on_ GROUP BY tid, bid, pos, rpos, qid, ln, hid, nb)
"""
SPLICED = READS + f""", oa AS (SELECT *, row_number() OVER (PARTITION BY tid, bid, part ORDER BY {ORD}) AS k FROM rl WHERE ln % 2 = 1), ob AS (SELECT *, row_number() OVER (PARTITION BY tid, bid, part ORDER BY {ORD}) AS k FROM rl WHERE ln % 2 = 0),
pq AS (SELECT a.tid, a.bid, (a.pos, a.rpos, a.qid, a.ln, a.hid) < (b.pos, b.rpos, b.qid, b.ln, b.hid) AS up, a, b FROM oa a JOIN ob b ON a.tid = b.tid AND a.bid = b.bid AND a.part = b.part AND a.k = b.k),
fr AS (SELECT tid, bid, CASE WHEN up THEN a ELSE b END AS m1, CASE WHEN up THEN b ELSE a END AS m2 FROM pq)
"""
PARTS = ", ins AS (SELECT g.tid, bid, l, r, ltype, rtype, p, q, cov FROM reg g JOIN seg s ON g.tid = s.tid AND p >= l AND q <= r), c AS (SELECT *, CASE WHEN p > coalesce(lag(q) OVER (PARTITION BY tid, bid, l ORDER BY p), l) + 3 THEN 1 ELSE 0 END AS new FROM ins), k AS (SELECT *, sum(new) OVER (PARTITION BY tid, bid, l ORDER BY p) AS k FROM c), g2 AS (SELECT tid, bid, l, r, ltype, rtype, k, min(p) AS a, max(q) AS b, CAST(sum((q - p) * cov) AS BIGINT) AS area FROM k GROUP BY tid, bid, l, r, ltype, rtype, k), g3 AS (SELECT tid, bid, l AS ol, r AS orr, ltype AS olt, rtype AS ort, CASE WHEN a - l <= 3 THEN l ELSE a END AS l, CASE WHEN r - b <= 3 THEN r ELSE b END AS r, area FROM g2)"
TYPED = BASE + PARTS + """, own AS (SELECT tid, bid, ol, orr, l, r, CASE WHEN l = ol THEN olt ELSE 1 END AS ltype, CASE WHEN r = orr THEN ort ELSE 2 END AS rtype, area / CAST(r - l AS DOUBLE) AS w, (r - l < 15 OR area < 1.5 * (r - l) OR area < 3) AND NOT (l = ol AND r = orr) AND NOT (l = ol AND olt = 4) AND NOT (r = orr AND ort = 3) AS empty, false AS stub FROM g3),
seen AS (SELECT tid, bid, ol, orr, olt, ort, bool_or(l = ol) AS lf, bool_or(r = orr) AS rf FROM g3 GROUP BY ALL),
typ AS (SELECT t.*, ltype = 1 AND rtype = 2 AND NOT (l = lpos AND r = rpos) AS regional FROM (SELECT * FROM own UNION ALL SELECT tid, bid, ol, orr, ol, ol + 1, olt, 2, 0.01, false, true FROM seen WHERE NOT lf AND olt = 4 UNION ALL SELECT tid, bid, ol, orr, orr - 1, orr, 1, ort, 0.01, false, true FROM seen WHERE NOT rf AND ort = 3) t JOIN bun USING (tid, bid))
"""

QUERIES = {
    "fragment_offsets": (
        fragment_offsets,
        PAIRED + "SELECT tid, bid, m1.qid AS qid1, m1.ln AS ln1, m1.hid AS hid1, m2.qid AS qid2, m2.ln AS ln2, m2.hid AS hid2, m1.pos AS lpos, m2.rpos AS rpos, m1.kl AS k1l, m1.kr AS k1r, m2.kl AS k2l, m2.kr AS k2r, m1.nv > 1 AND m1.rpos - m1.ol <= 20 + m1.nm AS b1, m2.nv > 1 AND m2.orr - m2.pos <= 20 + m2.nm AS b2 FROM fr",
    ),
    "spliced_region_list": (spliced_region_list, READS + f"SELECT tid, bid, {ORD}, nb AS n_blocks, array_to_string(v, '>') AS v, size FROM rl"),
    "spliced_fragments": (
        spliced_fragments,
        SPLICED + "SELECT tid, bid, m1.qid AS qid1, m1.ln AS ln1, m1.hid AS hid1, m1.size AS size1, m2.qid AS qid2, m2.ln AS ln2, m2.hid AS hid2, m2.size AS size2, m1.pos AS lpos, m2.rpos AS rpos, m1.kl AS k1l, m1.kr AS k1r, m2.kl AS k2l, m2.kr AS k2r, "
        "len(m1.v) > 1 AND m1.rpos - m1.ol <= CASE WHEN m1.v[-2] = m1.v[-1] - 1 THEN 20 ELSE 10 END + m1.nm AS b1, len(m2.v) > 1 AND m2.orr - m2.pos <= 20 + m2.nm AS b2, array_to_string(m1.v, '>') AS v1, array_to_string(m2.v, '>') AS v2 FROM fr",
    ),
    "spliced_bridges": (spliced_bridges, None),
    "spliced_coverage": (spliced_coverage, None),
    "fragment_groups": (fragment_groups, PAIRED + "SELECT tid, bid, m1.first_rid AS f1, m1.last_rid AS l1, m2.first_rid AS f2, m2.last_rid AS l2, m1.kl AS k1l, m1.kr AS k1r, m2.kl AS k2l, m2.kr AS k2r, count(*) AS cnt, min(m1.pos) AS lpos, max(m2.rpos) AS rpos FROM fr GROUP BY ALL"),
    "fragment_sizes": (fragment_sizes, PAIRED + "SELECT f.tid, f.bid, m1.qid AS qid, m1.ln AS ln, m1.hid AS hid, CAST(sum(r - l) - any_value(m1.kl) - any_value(m2.kr) AS BIGINT) AS length FROM fr f JOIN reg g ON f.tid = g.tid AND f.bid = g.bid AND (rid BETWEEN m1.first_rid AND m1.last_rid OR rid BETWEEN m2.first_rid AND m2.last_rid) WHERE m1.last_rid >= m2.first_rid GROUP BY f.tid, f.bid, m1.qid, m1.ln, m1.hid, m1.pos, m1.rpos"),
    "region_lengths": (region_lengths, BASE + "SELECT tid, bid, rid, CAST(sum(r - l) OVER (PARTITION BY tid, bid ORDER BY rid) AS BIGINT) AS upto FROM reg"),
    "bridged_fragments": (bridged_fragments, None),
    "bridge_counts": (bridge_counts, None),
    "bridged_coverage": (bridged_coverage, None),
    "bridged_junctions": (bridged_junctions, None),
    "junction_mismatches": (junction_mismatches, BASE + "SELECT tid, rpos AS lpos, nx AS rpos, count(*) AS cnt, CAST(sum(qid % 4) AS BIGINT) AS nm, CASE WHEN bool_or(xs = '+') AND NOT bool_or(xs = '-') THEN '+' WHEN bool_or(xs = '-') AND NOT bool_or(xs = '+') THEN '-' ELSE '.' END AS strand FROM nxt WHERE nx > rpos GROUP BY tid, rpos, nx"),
    "annotated_junctions": (annotated_junctions, BASE + "SELECT b.tid, b.bid, n.rpos AS lpos, n.nx AS rpos, -count(*) AS cnt, '+' AS strand FROM nxt n JOIN bun b ON n.tid = b.tid AND n.rpos > b.lpos AND n.nx < b.rpos WHERE n.xs = '+' AND n.nx > n.rpos GROUP BY b.tid, b.bid, n.rpos, n.nx"),
    "clipped_exons": (
        clipped_exons,
        BASE + ", cl AS (SELECT a.tid, qid, ln, hid, greatest(a.pos, b.lpos) AS pos, least(a.rpos, b.rpos) AS rpos, b.bid FROM aln a JOIN bun b ON a.tid = b.tid AND a.pos < b.rpos AND b.lpos < a.rpos WHERE xs = '.') SELECT c.*, f.rid AS first_rid, z.rid AS last_rid FROM cl c JOIN reg f ON c.tid = f.tid AND c.bid = f.bid AND c.pos >= f.l AND c.pos < f.r JOIN reg z ON c.tid = z.tid AND c.bid = z.bid AND c.rpos - 1 >= z.l AND c.rpos - 1 < z.r",
    ),
    "exon_types": (exon_types, TYPED + "SELECT tid, bid, l, r, ltype, rtype, round(w, 6) AS w, empty, stub, regional FROM typ"),
    "region_inclusion": (region_inclusion, TYPED + 'SELECT tid, bid, ol AS rl, orr AS rr, min(l) = ol AS "left", max(r) = orr AS "right" FROM typ GROUP BY tid, bid, ol, orr'),
    "regional_loci": (regional_loci, TYPED + "SELECT tid, bid FROM typ WHERE NOT empty GROUP BY tid, bid HAVING NOT bool_and(regional) AND bool_or(rtype = 3)"),
    "low_middles": (
        low_middles,
        BASE + ", x AS (SELECT g.tid, bid, l, r, p, q, cov FROM reg g JOIN seg s ON g.tid = s.tid AND p >= l AND q <= r WHERE r - l >= 10), c AS (SELECT tid, bid, l FROM x GROUP BY tid, bid, l, r HAVING min(p) = l AND sum(q - p) < r - l), h AS (SELECT *, lag(q) OVER (PARTITION BY tid, bid, l ORDER BY p) AS a FROM x JOIN c USING (tid, bid, l) WHERE cov > 0), "
        "m AS (SELECT h.tid, h.bid, h.l, h.r, h.a, h.p, sum(CASE WHEN x.q <= h.a THEN (x.q - x.p) * x.cov END) / CAST(h.a - h.l AS DOUBLE) AS la, sum(CASE WHEN x.p >= h.p THEN (x.q - x.p) * x.cov END) / CAST(h.r - h.p AS DOUBLE) AS ra FROM h JOIN x ON x.tid = h.tid AND x.bid = h.bid AND x.l = h.l WHERE h.p - h.a >= 1 AND h.a - h.l >= 2 AND h.r - h.p >= 2 GROUP BY h.tid, h.bid, h.l, h.r, h.a, h.p) "
        "SELECT tid, bid, l, r, a AS \"left\", p AS \"right\", round(la, 6) AS left_ave, round(ra, 6) AS right_ave FROM m WHERE la >= 0.5 AND ra >= 0.5",
    ),
    "hit_exon_list": (
        hit_exon_list,
        BASE + PARTS + f", {HITS}, e0 AS (SELECT tid, bid, l, r FROM g3 WHERE NOT ((r - l < 15 OR area < 1.5 * (r - l) OR area < 3) AND NOT (l = ol AND r = orr))), e AS (SELECT *, CAST(row_number() OVER (PARTITION BY tid, bid ORDER BY l) AS INT) AS v, count(*) OVER (PARTITION BY tid, bid) AS n FROM e0), x AS (SELECT h.tid, h.bid, qid, ln, hid, a.v + CASE WHEN pos - a.l > 3 AND a.r - pos < 3 THEN 1 ELSE 0 END AS first, b.v - CASE WHEN b.r - rpos > 3 AND rpos - b.l <= 3 THEN 1 ELSE 0 END AS last, a.n FROM hit h JOIN e a ON h.tid = a.tid AND h.bid = a.bid AND pos >= a.l AND pos < a.r JOIN e b ON h.tid = b.tid AND h.bid = b.bid AND rpos - 1 >= b.l AND rpos - 1 < b.r) SELECT * EXCLUDE (n) FROM x WHERE first <= n AND last >= 1",
    ),
    "well_covered": (well_covered, BASE + f", {HITS}, av AS (SELECT g.tid, g.bid, g.rid, coalesce(sum((q - p) * cov), 0) / CAST(r - l AS DOUBLE) AS ave FROM reg g LEFT JOIN seg s ON g.tid = s.tid AND p >= l AND q <= r GROUP BY g.tid, g.bid, g.rid, l, r), o AS (SELECT h.tid, h.bid, pos, rpos, qid, ln, hid, bool_and(ave >= 1.5) AS ok FROM hit h JOIN av a ON h.tid = a.tid AND h.bid = a.bid AND a.rid BETWEEN first_rid AND last_rid GROUP BY ALL) SELECT tid, count(*) FILTER (ok) AS n FROM o GROUP BY tid"),
    "strand_conflicts": (strand_conflicts, f"WITH {ALN_SQL}, s AS (SELECT xs, CASE hid % 4 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '.' END AS st FROM aln) SELECT CASE WHEN st = '.' THEN xs WHEN xs = '.' OR st = xs THEN st ELSE 'conflict' END AS strand, xs, count(*) AS n FROM s GROUP BY 1, 2"),
    "touching_hits": (touching_hits, f"WITH {ALN_SQL}, h AS (SELECT *, EXISTS (SELECT 1 FROM aln b WHERE b.tid = a.tid AND b.xs = '-' AND b.pos <= a.pos AND a.pos < b.rpos) OR EXISTS (SELECT 1 FROM aln b WHERE b.tid = a.tid AND b.xs = '-' AND b.pos <= a.rpos - 1 AND a.rpos - 1 < b.rpos) AS inside FROM aln a WHERE xs = '+') SELECT tid, inside, count(*) AS n FROM h GROUP BY tid, inside"),
    "coverage_splits": (coverage_splits, BASE + ", x AS (SELECT DISTINCT tid, pos + 1 AS x FROM aln WHERE xs = '.'), e AS (SELECT s.tid, cov, p, q, p AS x FROM seg s UNION ALL SELECT s.tid, cov, p, q, x FROM seg s JOIN x ON s.tid = x.tid AND x > p AND x < q) SELECT tid, x AS p, coalesce(lead(x) OVER (PARTITION BY tid, p ORDER BY x), q) AS q, cov FROM e"),
    "region_line_fit": (region_line_fit, BASE + "SELECT g.tid, g.bid, g.l, round(regr_slope(CAST(cov AS DOUBLE), (p + q) / 2.0), 5) + 0.0 AS slope FROM reg g JOIN seg s ON g.tid = s.tid AND p >= l AND q <= r GROUP BY g.tid, g.bid, g.l HAVING count(*) >= 3"),
    "contained_within_ten": (contained_within_ten, f"WITH {ALN_SQL} SELECT tid, {ORD} FROM (SELECT *, max(rpos) OVER (PARTITION BY tid ORDER BY {ORD} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS far FROM aln) WHERE far >= rpos"),
    "merge_modes": (
        merge_modes,
        f"WITH {ALN_SQL}, i AS (SELECT tid, xs, hid % 10 AS sample, CAST(qid AS DOUBLE) AS c, pos, rpos FROM aln), s AS (SELECT tid, xs, sum(c) AS samples FROM (SELECT tid, xs, sample, max(c) AS c FROM i GROUP BY ALL) GROUP BY tid, xs), g AS (SELECT tid, xs, count(*) AS cnt, sum(c) AS a, max(c) AS b, min(c) AS m, min(pos) AS p, max(rpos) AS q, min((sample, pos, rpos, c)) AS f FROM i GROUP BY tid, xs) "
        "SELECT v.mode, g.tid, g.xs, cnt, CASE v.mode WHEN 'add' THEN a WHEN 'max' THEN b WHEN 'min' THEN m ELSE f[4] END AS coverage, CASE WHEN v.mode = 'none' THEN f[2] ELSE p END AS \"start\", CASE WHEN v.mode = 'none' THEN f[3] ELSE q END AS \"end\", samples FROM g JOIN s ON g.tid = s.tid AND g.xs = s.xs, (VALUES ('add'), ('max'), ('min'), ('none')) v(mode)",
    ),
    "known_chains": (known_chains, BASE + ", i AS (SELECT tid, xs, nx - rpos AS length FROM nxt WHERE nx > rpos), m AS (SELECT tid, length FROM i WHERE xs = '-' GROUP BY ALL HAVING count(*) >= 2) SELECT DISTINCT tid, length, (tid, length) IN (SELECT (tid, length) FROM m) AS found FROM i WHERE xs = '+'"),
    "capped_sample": (capped_sample, BASE + f"SELECT tid, bid, {ORD} FROM (SELECT *, row_number() OVER (PARTITION BY tid, bid ORDER BY {ORD}) AS k, count(*) OVER (PARTITION BY tid, bid) AS n FROM bnd) WHERE n >= 6 AND k <= 3 ORDER BY tid, bid, {ORD} LIMIT 2000"),
}
