"""Queries over alignments grouped into loci, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociflow.functions import alignments as A
from lociflow.operators import coverage, junctions, loci, mates
from lociflow.operators.bins import within
from lociflow.operators.running import following
from lociflow.sources.shared import written
from lociflow.sources.tables import ALN_SQL, ORDER, alignments, read

GAP = 20
#: Width of coordinate bins: the projection's coordinates are days.
BIN = 64
ORD = "pos, rpos, qid, ln, hid"
#: What the SQL of most queries starts with: alignments, their loci (bnd), the loci (bun), introns (jun0), junctions (jun), segments (seg).
BASE = f"""WITH {ALN_SQL},
new_ AS (SELECT *, CASE WHEN pos > coalesce(max(rpos) OVER (PARTITION BY tid ORDER BY {ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1000000) + {GAP} THEN 1 ELSE 0 END AS new FROM aln),
bnd AS (SELECT * EXCLUDE (new), CAST(sum(new) OVER (PARTITION BY tid ORDER BY {ORD}) AS BIGINT) AS bid FROM new_),
bun AS (SELECT tid, bid, min(pos) AS lpos, max(rpos) AS rpos, count(*) AS n FROM bnd GROUP BY tid, bid HAVING count(*) >= 5),
nxt AS (SELECT *, lead(pos) OVER (PARTITION BY tid, xs ORDER BY {ORD}) AS nx FROM aln),
jun AS (SELECT tid, rpos AS lpos, nx AS rpos, count(*) AS cnt, CAST(sum(CASE WHEN xs = '+' THEN 1 ELSE 0 END) AS BIGINT) AS s1, CAST(sum(CASE WHEN xs = '-' THEN 1 ELSE 0 END) AS BIGINT) AS s2 FROM nxt WHERE nx > rpos GROUP BY tid, rpos, nx),
pts AS (SELECT tid, p, CAST(sum(d) AS BIGINT) AS d FROM (SELECT tid, pos AS p, 1 AS d FROM aln UNION ALL SELECT tid, rpos, -1 FROM aln) GROUP BY tid, p),
seg AS (SELECT tid, p, q, cov FROM (SELECT tid, p, lead(p) OVER (PARTITION BY tid ORDER BY p) AS q, CAST(sum(d) OVER (PARTITION BY tid ORDER BY p) AS BIGINT) AS cov FROM pts) WHERE cov > 0 AND q IS NOT NULL),
cut AS (SELECT DISTINCT b.tid, b.bid, x, t FROM (SELECT tid, lpos AS x, 3 AS t FROM jun UNION ALL SELECT tid, rpos, 4 FROM jun) e JOIN bun b ON e.tid = b.tid AND x > b.lpos AND x < b.rpos),
mrk AS (SELECT tid, bid, x, CASE WHEN min(t) < 3 THEN min(t) WHEN min(t) <> max(t) THEN 5 ELSE min(t) END AS t FROM (SELECT * FROM cut UNION ALL SELECT tid, bid, lpos, 1 FROM bun UNION ALL SELECT tid, bid, rpos, 2 FROM bun) GROUP BY tid, bid, x),
reg0 AS (SELECT tid, bid, x AS l, lead(x) OVER (PARTITION BY tid, bid ORDER BY x) AS r, t, lead(t) OVER (PARTITION BY tid, bid ORDER BY x) AS rt FROM mrk),
reg AS (SELECT tid, bid, l, r, CASE WHEN t = 5 THEN 4 ELSE t END AS ltype, CASE WHEN rt = 5 THEN 3 ELSE rt END AS rtype, CAST(row_number() OVER (PARTITION BY tid, bid ORDER BY l) - 1 AS INT) AS rid FROM reg0 WHERE r IS NOT NULL)
"""


def _assigned(spark, d) -> DataFrame:
    return loci.assign_loci(alignments(spark, d), GAP, bin_width=8 * BIN)


def _loci(spark, d) -> DataFrame:
    return loci.loci(_assigned(spark, d))


def _introns(aln: DataFrame) -> DataFrame:
    return loci.next_block(aln).where("nxt IS NOT NULL").select("tid", F.col("rpos").alias("lpos"), F.col("nxt").alias("rpos"), "xs")


def _junctions(spark, d) -> DataFrame:
    return junctions.junctions(_introns(alignments(spark, d)))


def _segments(spark, d) -> DataFrame:
    return coverage.segments(alignments(spark, d))


def _regions(spark, d) -> DataFrame:
    bun = written(_loci(spark, d).select("tid", "bid", "lpos", "rpos"), "loci")
    ends = _junctions(spark, d).select("tid", "lpos", "rpos", F.explode(F.array("lpos", "rpos")).alias("x"))
    held = within(ends, F.col("x"), bun.select("tid", "bid", F.col("lpos").alias("_l"), F.col("rpos").alias("_r")), ["tid"], "_l", "_r", BIN).where("x > _l")
    return junctions.numbered(junctions.regions(bun, held.select("tid", "bid", "lpos", "rpos").distinct()))


def _located(spark, d) -> tuple[DataFrame, DataFrame]:
    """Alignments of loci with the regions of their ends, and the regions."""
    rows, regs = written(_assigned(spark, d), "assigned"), written(_regions(spark, d), "regions")
    hits = rows.join(loci.loci(rows).select("tid", "bid"), ["tid", "bid"], "left_semi")
    return junctions.locate(hits, regs, bin_width=BIN), regs


def bundles(spark: SparkSession, d: str) -> DataFrame:
    return _loci(spark, d)


def bundles_mate_extended(spark, d):
    aln = following(alignments(spark, d), ["tid"], F.floor(F.col("pos") / (8 * BIN)), ORDER, "pos", "mpos")
    return loci.loci(loci.assign_loci(aln.withColumn("ext", loci.mate_extended()), GAP, end="ext"), end="ext")


def bundle_strand(spark, d):
    return loci.locus_strand(_assigned(spark, d))


def strand_router(spark, d):
    rows = loci.next_block(alignments(spark, d)).withColumn("spliced", F.col("nxt").isNotNull())
    return loci.route_strands(rows).groupBy("tid", "stream").agg(F.count(F.lit(1)).alias("n"))


def row_admission(spark, d):
    rows = alignments(spark, d).select((F.col("tid") % 1000 - 1).alias("tid"), F.when(F.col("qid") % 11 == 0, 4).when(F.col("ln") == 7, 256).otherwise(0).alias("flag"), (F.col("hid") % 5).alias("n_cigar"), (F.col("qid") % 7).alias("mapq"), (1 + F.col("ln") % 3).alias("nh"))
    return rows.groupBy(loci.admission(unique=True).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def strand_from_flags(spark, d):
    flags = read(spark, d, "lineitem").groupBy(((F.col("l_orderkey") % 2) + (F.col("l_linenumber") % 8) * 16 + (F.col("l_suppkey") % 2) * 128).cast("int").alias("flag")).agg(F.count(F.lit(1)).alias("n"))
    rows = flags.withColumn("lib", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return rows.select("flag", "lib", A.strand_from_flags(F.col("flag"), F.col("lib")).alias("strand"), A.concordant(F.col("flag")).alias("concordant"), "n")


def coverage_segments(spark, d):
    return _segments(spark, d)


def coverage_bundle_stats(spark, d):
    b = _loci(spark, d).select("tid", "bid", "lpos", "rpos")
    s = coverage.stretch_stats(written(b, "loci"), _segments(spark, d), ["tid"], bin_width=BIN)
    return s.select("tid", "bid", F.col("max").alias("mx"), "area", "covered", F.round("ave", 6).alias("ave"), F.round("dev", 6).alias("dev"))


def coverage_point(spark, d):
    days = read(spark, d, "orders").select(F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")).alias("x"), (F.col("o_custkey") % 50 + 1).alias("tid"))
    return coverage.covering(days, _segments(spark, d), ["tid"]).groupBy("tid", "cov").agg(F.count(F.lit(1)).alias("n"))


def coverage_islands(spark, d):
    return coverage.islands(_segments(spark, d), gap=3)


def coverage_line_fit(spark, d):
    f = coverage.line_fit(_segments(spark, d))
    return f.select("tid", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


def junction_counts(spark, d):
    return _junctions(spark, d).drop("strand")


def junction_strand(spark, d):
    return _junctions(spark, d).select("tid", "lpos", "rpos", "strand")


def regions(spark, d):
    return _regions(spark, d).drop("rid")


def partial_exons(spark, d):
    return junctions.partial_exons(_regions(spark, d), _segments(spark, d), bin_width=BIN)


def hit_region_list(spark, d):
    return _located(spark, d)[0].select("tid", "bid", "qid", "ln", "hid", "first_rid", "last_rid")


def region_inverted_index(spark, d):
    listed = _located(spark, d)[0].select("tid", "bid", F.posexplode(F.sequence("first_rid", "last_rid")).alias("place", "rid"))
    return listed.groupBy("tid", "bid", "rid").agg(F.count(F.lit(1)).alias("n"), F.sum("place").alias("places"))


def junction_exon_link(spark, d):
    regs = written(_regions(spark, d), "regions")
    left = regs.select("tid", "bid", F.col("r").alias("lpos"), F.col("rid").alias("lexon"))
    right = regs.select("tid", "bid", F.col("l").alias("rpos"), F.col("rid").alias("rexon"))
    return _junctions(spark, d).select("tid", "lpos", "rpos", "cnt").join(left, ["tid", "lpos"]).join(right, ["tid", "bid", "rpos"]).select("tid", "bid", "lpos", "rpos", "cnt", "lexon", "rexon")


def mate_pairs(spark, d):
    a = alignments(spark, d)
    own = ["pos", "tid", "ln"]
    left = a.where("ln % 2 = 1").select("qid", "tid", "pos", "rpos", "ln")
    right = a.where("ln % 2 = 0").select("qid", "tid", "pos", "rpos", "ln")
    return mates.pair_mates(left, right, ["qid"], own, own).select("qid", "ln", "mate_ln", "pos", "mate_pos")


def fragment_length(spark, d):
    p = mate_pairs(spark, d)
    return p.groupBy("qid").agg(F.sum(F.col("mate_pos") - F.col("pos")).alias("span"), F.count(F.lit(1)).alias("n"))


def umi_links(spark, d):
    e = read(spark, d, "events")
    return mates.link_chain(e, ["user_id", "event_type"], ["ts", "event_id"], "event_id", "next_event_id").select("event_id", "next_event_id")


def tiny_boundary(spark, d):
    located, regs = _located(spark, d)
    first = located.join(regs.select("tid", "bid", F.col("rid").alias("first_rid"), "l", "r"), ["tid", "bid", "first_rid"])
    own = F.least("rpos", "r") - F.col("pos")
    tiny = (own <= 10) & (own < F.lit(0.4) * (F.col("r") - F.col("l"))) & (F.col("last_rid") == F.col("first_rid") + 1)
    return first.groupBy("tid", tiny.alias("tiny")).agg(F.count(F.lit(1)).alias("n"))


def path_filter_median(spark, d):
    c = mate_pairs(spark, d).withColumn("len", F.abs(F.col("mate_pos") - F.col("pos")))
    return mates.best_by_distance(c, ["qid"], "len", F.lit(250), ["ln", "mate_ln"]).select("qid", "ln", "mate_ln", "len")


def insert_size_hist(spark, d):
    return read(spark, d, "lineitem").groupBy(F.col("l_quantity").cast("int").alias("size")).agg(F.count(F.lit(1)).alias("n"))


def insert_size_stats(spark, d):
    s = mates.insert_size_stats(read(spark, d, "lineitem").select(F.col("l_quantity").cast("long").alias("size")))
    return s.select("median", "low", "high", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def strand_inference(spark, d):
    rows = alignments(spark, d).select("xs", F.when(F.col("hid") % 10 == 0, F.when(F.col("xs") == "+", "-").otherwise("+")).otherwise(F.col("xs")).alias("predicted"), F.struct("tid", *ORDER).alias("i"))
    return mates.infer_library(rows)


def locus_topk(spark, d):
    w = Window.partitionBy("tid").orderBy(F.desc("n"), "bid")
    return _loci(spark, d).withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("tid", "bid", "n", "rank")


def cluster_islands(spark, d):
    e = read(spark, d, "events").select("user_id", "event_type", "event_id", F.round(F.col("value") * 100).cast("long").alias("v"))
    return mates.flank_clusters(e, ["user_id", "event_type"], ["v", "event_id"], "v", 300).groupBy("user_id", "event_type", "cluster").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))


def sessions(spark, d):
    e = read(spark, d, "events").select("user_id", "event_id", F.unix_timestamp("ts").alias("pos"))
    s = loci.assign_loci(e.withColumn("rpos", F.col("pos")), 6 * 3600, ["user_id"], ["pos", "event_id"], bin_width=30 * 86400)
    return s.groupBy("user_id", "bid").agg(F.count(F.lit(1)).alias("n"))


def locus_summary(spark, d):
    """Each locus of five alignments or more: bounds, number, junctions inside, covered length and highest coverage."""
    b = written(_loci(spark, d), "loci")
    st = coverage.stretch_stats(b.select("tid", "bid", "lpos", "rpos"), _segments(spark, d), ["tid"], bin_width=BIN).select("tid", "bid", "covered", F.col("max").alias("highest"))
    j = _junctions(spark, d).select("tid", F.col("lpos").alias("jl"), F.col("rpos").alias("jr"))
    inside = within(j, F.col("jl"), b.select("tid", "bid", "lpos", "rpos"), ["tid"], "lpos", "rpos", BIN).where("jr <= rpos").groupBy("tid", "bid").agg(F.count(F.lit(1)).alias("junctions"))
    return b.join(st, ["tid", "bid"]).join(inside, ["tid", "bid"], "left").fillna(0, ["junctions"])


STATS = "SELECT b.tid, b.bid, lpos, rpos, n, coalesce(max(cov), 0) AS mx, CAST(coalesce(sum((q - p) * cov), 0) AS BIGINT) AS area, CAST(coalesce(sum(q - p), 0) AS BIGINT) AS covered, CAST(coalesce(sum((q - p) * cov * cov), 0) AS BIGINT) AS sq FROM bun b LEFT JOIN seg s ON b.tid = s.tid AND p >= lpos AND q <= rpos GROUP BY b.tid, b.bid, lpos, rpos, n"
HITS = "hit AS (SELECT a.*, f.rid AS first_rid, z.rid AS last_rid FROM bnd a JOIN reg f ON a.tid = f.tid AND a.bid = f.bid AND a.pos >= f.l AND a.pos < f.r JOIN reg z ON a.tid = z.tid AND a.bid = z.bid AND a.rpos - 1 >= z.l AND a.rpos - 1 < z.r)"
PAIRS = "pr AS (SELECT a.qid, a.ln, b.ln AS mate_ln, a.pos, b.pos AS mate_pos FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pos, tid, ln) AS k FROM aln WHERE ln % 2 = 1) a JOIN (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pos, tid, ln) AS k FROM aln WHERE ln % 2 = 0) b ON a.qid = b.qid AND a.k = b.k)"

QUERIES = {
    "locus_summary": (locus_summary, BASE + f", st AS ({STATS}) SELECT st.tid, st.bid, st.lpos, st.rpos, st.n, covered, mx AS highest, count(j.tid) AS junctions FROM st LEFT JOIN jun j ON j.tid = st.tid AND j.lpos >= st.lpos AND j.rpos <= st.rpos GROUP BY ALL"),
    "bundles": (bundles, BASE + "SELECT * FROM bun"),
    "bundles_mate_extended": (
        bundles_mate_extended,
        f"WITH {ALN_SQL}, m AS (SELECT *, lead(pos) OVER (PARTITION BY tid ORDER BY {ORD}) AS mpos FROM aln), e AS (SELECT *, CASE WHEN mpos > rpos AND mpos <= rpos + 100000 THEN mpos ELSE rpos END AS ext FROM m), n AS (SELECT *, CASE WHEN pos > coalesce(max(ext) OVER (PARTITION BY tid ORDER BY {ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1000000) + {GAP} THEN 1 ELSE 0 END AS new FROM e), b AS (SELECT *, CAST(sum(new) OVER (PARTITION BY tid ORDER BY {ORD}) AS BIGINT) AS bid FROM n) SELECT tid, bid, min(pos) AS lpos, max(ext) AS rpos, count(*) AS n FROM b GROUP BY tid, bid HAVING count(*) >= 5",
    ),
    "bundle_strand": (bundle_strand, BASE + "SELECT tid, bid, CASE WHEN p > q THEN '+' WHEN p < q THEN '-' ELSE '.' END AS strand FROM (SELECT tid, bid, count(*) FILTER (xs = '+') AS p, count(*) FILTER (xs = '-') AS q FROM bnd GROUP BY tid, bid)"),
    "strand_router": (strand_router, BASE + "SELECT tid, stream, count(*) AS n FROM (SELECT tid, xs AS stream FROM nxt WHERE xs <> '.' UNION ALL SELECT tid, s FROM nxt, (VALUES ('+'), ('-')) v(s) WHERE xs = '.' AND NOT coalesce(nx > rpos, false)) GROUP BY tid, stream"),
    "row_admission": (
        row_admission,
        f"WITH {ALN_SQL} SELECT CASE WHEN tid % 1000 - 1 < 0 THEN 'no sequence' WHEN qid % 11 = 0 THEN 'unmapped' WHEN ln = 7 THEN 'secondary' WHEN hid % 5 < 1 THEN 'cigar' WHEN qid % 7 < 1 THEN 'mapping quality' WHEN 1 + ln % 3 <> 1 THEN 'not unique' ELSE 'admitted' END AS reason, count(*) AS n FROM aln GROUP BY 1",
    ),
    "strand_from_flags": (
        strand_from_flags,
        "WITH f AS (SELECT CAST(l_orderkey % 2 + (l_linenumber % 8) * 16 + (l_suppkey % 2) * 128 AS INT) AS flag, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT *, flag & 1 > 0 AS pr, flag & 16 > 0 AS bk, flag & 32 > 0 AS mb, flag & 64 > 0 AS r1, flag & 128 > 0 AS r2 FROM f, (VALUES (0), (1), (2)) v(lib)) "
        "SELECT flag, lib, CASE WHEN lib = 1 AND pr AND r1 AND NOT r2 THEN CASE WHEN bk THEN '+' ELSE '-' END WHEN lib = 1 AND pr AND r2 AND NOT r1 THEN CASE WHEN bk THEN '-' ELSE '+' END WHEN lib = 2 AND pr AND r1 AND NOT r2 THEN CASE WHEN bk THEN '-' ELSE '+' END WHEN lib = 2 AND pr AND r2 AND NOT r1 THEN CASE WHEN bk THEN '+' ELSE '-' END WHEN lib = 1 AND NOT pr THEN CASE WHEN bk THEN '+' ELSE '-' END WHEN lib = 2 AND NOT pr THEN CASE WHEN bk THEN '-' ELSE '+' END ELSE '.' END AS strand, (bk <> mb) AND (r1 <> r2) AS concordant, n FROM b",
    ),
    "coverage_segments": (coverage_segments, BASE + "SELECT * FROM seg"),
    "coverage_bundle_stats": (coverage_bundle_stats, BASE + f", st AS ({STATS}) SELECT tid, bid, mx, area, covered, round(area / CAST(rpos - lpos AS DOUBLE), 6) AS ave, round(CASE WHEN covered = 0 THEN 1 ELSE sqrt(greatest(0, (sq - 2.0 * area / (rpos - lpos) * area + CAST(area AS DOUBLE) / (rpos - lpos) * (CAST(area AS DOUBLE) / (rpos - lpos)) * covered) / (rpos - lpos))) END, 6) AS dev FROM st"),
    "coverage_point": (coverage_point, BASE + ", o AS (SELECT row_number() OVER () AS i, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS x, o_custkey % 50 + 1 AS tid FROM orders) SELECT tid, cov, count(*) AS n FROM (SELECT o.tid, i, coalesce(max(cov), 0) AS cov FROM o LEFT JOIN seg s ON o.tid = s.tid AND p <= x AND x < q GROUP BY o.tid, i) GROUP BY tid, cov"),
    "coverage_islands": (coverage_islands, BASE + ", c AS (SELECT *, CASE WHEN p > coalesce(lag(q) OVER (PARTITION BY tid ORDER BY p), -1000000) + 3 THEN 1 ELSE 0 END AS new FROM seg), k AS (SELECT *, sum(new) OVER (PARTITION BY tid ORDER BY p) AS k FROM c) SELECT tid, min(p) AS l, max(q) AS r FROM k GROUP BY tid, k"),
    "coverage_line_fit": (coverage_line_fit, BASE + "SELECT tid, round(regr_slope(CAST(cov AS DOUBLE), (p + q) / 2.0), 6) AS slope, round(regr_intercept(CAST(cov AS DOUBLE), (p + q) / 2.0), 4) AS intercept FROM seg GROUP BY tid"),
    "junction_counts": (junction_counts, BASE + "SELECT * FROM jun"),
    "junction_strand": (junction_strand, BASE + "SELECT tid, lpos, rpos, CASE WHEN s1 > 0 AND s2 = 0 THEN '+' WHEN s2 > 0 AND s1 = 0 THEN '-' ELSE '.' END AS strand FROM jun"),
    "regions": (regions, BASE + "SELECT tid, bid, l, r, ltype, rtype FROM reg"),
    "partial_exons": (
        partial_exons,
        BASE + ", ins AS (SELECT g.tid, bid, l, r, p, q, cov FROM reg g JOIN seg s ON g.tid = s.tid AND p >= l AND q <= r), c AS (SELECT *, CASE WHEN p > coalesce(lag(q) OVER (PARTITION BY tid, bid, l ORDER BY p), l) + 3 THEN 1 ELSE 0 END AS new FROM ins), k AS (SELECT *, sum(new) OVER (PARTITION BY tid, bid, l ORDER BY p) AS k FROM c), g2 AS (SELECT tid, bid, l, r, k, min(p) AS a, max(q) AS b, CAST(sum((q - p) * cov) AS BIGINT) AS area FROM k GROUP BY tid, bid, l, r, k), g3 AS (SELECT tid, bid, l AS ol, r AS orr, CASE WHEN a - l <= 3 THEN l ELSE a END AS l, CASE WHEN r - b <= 3 THEN r ELSE b END AS r, area FROM g2) "
        "SELECT tid, bid, l, r, r - l AS length, area, (r - l < 15 OR area < 1.5 * (r - l) OR area < 3) AND NOT (l = ol AND r = orr) AS empty FROM g3",
    ),
    "hit_region_list": (hit_region_list, BASE + f", {HITS} SELECT tid, bid, qid, ln, hid, first_rid, last_rid FROM hit"),
    "region_inverted_index": (region_inverted_index, BASE + f", {HITS} SELECT h.tid, h.bid, CAST(first_rid + i AS INT) AS rid, count(*) AS n, CAST(sum(i) AS BIGINT) AS places FROM hit h, LATERAL (SELECT unnest(range(0, last_rid - first_rid + 1)) AS i) u GROUP BY h.tid, h.bid, first_rid + i"),
    "junction_exon_link": (junction_exon_link, BASE + "SELECT j.tid, a.bid, j.lpos, j.rpos, cnt, a.rid AS lexon, b.rid AS rexon FROM jun j JOIN reg a ON j.tid = a.tid AND j.lpos = a.r JOIN reg b ON j.tid = b.tid AND a.bid = b.bid AND j.rpos = b.l"),
    "mate_pairs": (mate_pairs, f"WITH {ALN_SQL}, {PAIRS} SELECT * FROM pr"),
    "fragment_length": (fragment_length, f"WITH {ALN_SQL}, {PAIRS} SELECT qid, CAST(sum(mate_pos - pos) AS BIGINT) AS span, count(*) AS n FROM pr GROUP BY qid"),
    "umi_links": (umi_links, "SELECT * FROM (SELECT event_id, lead(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS next_event_id FROM events) WHERE next_event_id IS NOT NULL"),
    "tiny_boundary": (tiny_boundary, BASE + f", {HITS}, t AS (SELECT h.tid, least(h.rpos, g.r) - h.pos AS own, g.r - g.l AS len, first_rid, last_rid FROM hit h JOIN reg g ON h.tid = g.tid AND h.bid = g.bid AND h.first_rid = g.rid) SELECT tid, own <= 10 AND own < 0.4 * len AND last_rid = first_rid + 1 AS tiny, count(*) AS n FROM t GROUP BY 1, 2"),
    "path_filter_median": (path_filter_median, f"WITH {ALN_SQL}, {PAIRS} SELECT qid, ln, mate_ln, len FROM (SELECT *, abs(mate_pos - pos) AS len, row_number() OVER (PARTITION BY qid ORDER BY abs(abs(mate_pos - pos) - 250), ln, mate_ln) AS k FROM pr) WHERE k = 1"),
    "insert_size_hist": (insert_size_hist, "SELECT CAST(l_quantity AS INT) AS size, count(*) AS n FROM lineitem GROUP BY 1"),
    "insert_size_stats": (
        insert_size_stats,
        "WITH h AS (SELECT CAST(l_quantity AS BIGINT) AS size, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT *, sum(n) OVER (ORDER BY size) AS upto, sum(n) OVER () AS of FROM h), b AS (SELECT * FROM r WHERE upto - n < of * 0.999), m AS (SELECT CAST(sum(n * size) AS DOUBLE) / sum(n) AS mean, CAST(sum(n * size * size) AS DOUBLE) / sum(n) AS sq FROM b) "
        "SELECT min(size) FILTER (upto >= of * 0.5) AS median, min(size) FILTER (upto >= of * 0.005) AS low, min(size) FILTER (upto >= of * 0.998) AS high, round(any_value(mean), 6) AS mean, round(sqrt(any_value(sq) - any_value(mean) * any_value(mean)), 6) AS std FROM r, m",
    ),
    "strand_inference": (
        strand_inference,
        f"WITH {ALN_SQL}, p AS (SELECT xs, CASE WHEN hid % 10 = 0 THEN CASE WHEN xs = '+' THEN '-' ELSE '+' END ELSE xs END AS predicted, row_number() OVER (PARTITION BY xs ORDER BY tid, {ORD}) AS n FROM aln WHERE xs <> '.'), c AS (SELECT * FROM p WHERE n <= 50000), e AS (SELECT least(count(*) FILTER (xs = '+'), count(*) FILTER (xs = '-')) AS each FROM c), t AS (SELECT count(*) FILTER (xs = predicted) AS first, count(*) FILTER (xs <> predicted) AS second, max(each) AS sampled FROM c, e WHERE n <= each) "
        "SELECT *, CASE WHEN sampled < 10000 THEN 'unstranded' WHEN first > 0.85 * 2 * sampled THEN 'first' WHEN second > 0.85 * 2 * sampled THEN 'second' ELSE 'unstranded' END AS library FROM t",
    ),
    "locus_topk": (locus_topk, BASE + "SELECT tid, bid, n, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY n DESC, bid) AS rank FROM bun) WHERE rank <= 10"),
    "cluster_islands": (cluster_islands, "WITH e AS (SELECT user_id, event_type, event_id, CAST(round(value * 100) AS BIGINT) AS v FROM events), c AS (SELECT *, CASE WHEN abs(v - lag(v) OVER (PARTITION BY user_id, event_type ORDER BY v, event_id)) > 300 THEN 1 ELSE 0 END AS cut FROM e), k AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY user_id, event_type ORDER BY v, event_id) AS BIGINT) AS cluster FROM c) SELECT user_id, event_type, cluster, count(*) AS n, min(v) AS lo, max(v) AS hi FROM k GROUP BY 1, 2, 3"),
    "sessions": (sessions, "WITH e AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events), c AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) <= 21600 THEN 0 ELSE 1 END AS new FROM e), k AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY s, event_id) AS BIGINT) AS bid FROM c) SELECT user_id, bid, count(*) AS n FROM k GROUP BY 1, 2"),
}
