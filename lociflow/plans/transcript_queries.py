"""Queries over transcripts and text formats, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociflow.functions import alignments as A
from lociflow.operators import transcripts
from lociflow.plans.locus_queries import BASE, _assigned, _introns, _loci
from lociflow.sources import gtf, sam
from lociflow.sources.tables import ALN_SQL, alignments, read


def _transcripts(spark, d):
    """Each locus's alignments as one transcript: tid, bid, coverage, exons."""
    rows = _assigned(spark, d).join(_loci(spark, d).select("tid", "bid"), ["tid", "bid"], "left_semi")
    return rows.groupBy("tid", "bid").agg(F.count(F.lit(1)).cast("double").alias("coverage"), F.collect_list(F.struct(F.col("pos").alias("l"), F.col("rpos").alias("r"))).alias("e")).withColumn("exons", gtf.merged_exons(F.col("e"))).drop("e")


def transcript_features(spark, d):
    return transcripts.features(_transcripts(spark, d)).select("tid", "bid", "n_exons", "length", "start", "end", F.size("introns").alias("n_introns"))


def expressed_transcripts(spark, d):
    return transcripts.expressed(_transcripts(spark, d), 8.0).select("tid", "bid", "coverage", F.size("exons").alias("n_exons"))


def transcript_filter(spark, d):
    f = transcripts.features(_transcripts(spark, d))
    return f.select("tid", "bid", transcripts.long_and_covered(F.col("n_exons"), F.col("length"), F.col("coverage"), base=20, increase=10, single=6).alias("kept"))


def single_exon_containment(spark, d):
    kept = transcripts.not_contained(alignments(spark, d), ["tid"], ["qid", "ln", "hid"])
    return kept.select("tid", "pos", "rpos", "qid", "ln", "hid")


def nested_containment(spark, d):
    introns = _introns(alignments(spark, d).where("xs = '+'")).distinct().select(F.struct("tid", "lpos", "rpos").alias("id"), "tid", F.col("lpos").alias("l"), F.col("rpos").alias("r"), F.lit(1.0).alias("cov"))
    rows = alignments(spark, d).where("xs = '-'").select("tid", F.col("pos").alias("l"), F.col("rpos").alias("r"), F.lit(2.0).alias("cov"))
    return transcripts.nested(rows, introns, ["tid"]).select("id.tid", F.col("id.lpos").alias("l"), F.col("id.rpos").alias("r"))


def gene_features(spark, d):
    t = _transcripts(spark, d).withColumn("gene_id", F.col("tid") % 100)
    return transcripts.gene_features(t).select("gene_id", "n", "coverage", "start", "end", F.size("boundaries").alias("n_boundaries"))


def joined_neighbours(spark, d):
    rows = alignments(spark, d).where("xs = '.'").select("tid", F.col("pos").alias("l"), F.col("rpos").alias("r"), (F.col("hid") % 7 + 1).cast("double").alias("coverage"))
    return transcripts.joined_neighbours(rows, ["tid"], 30).select("tid", "l", "r", "n", F.round("coverage", 6).alias("coverage"))


def consensus_merge(spark, d):
    """Alignments as single-exon transcripts of ten runs (a supplier's last digit), merged where they overlap by 90 % of either."""
    rows = alignments(spark, d).select("tid", "xs", (F.col("hid") % 10).alias("run"), F.array().cast("array<struct<l:int,r:int>>").alias("introns"), (F.col("qid") % 7 + 1).cast("double").alias("coverage"), F.col("pos").alias("start"), F.col("rpos").alias("end"))
    return transcripts.consensus(rows, ["tid", "xs"], least_single=2).select("tid", "xs", "cnt", "coverage", "start", "end")


def rpkm_tpm(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_suppkey") + 1).alias("len"))
    x = transcripts.expression(rows, "l_quantity", "len")
    return x.select("l_orderkey", "l_linenumber", F.round("rpkm", 3).alias("rpkm"), F.round("tpm", 3).alias("tpm"))


def best_overlap_gene(spark, d):
    """For each order, as a stretch of 30 days on the sequence of its customer's number, the locus that overlaps it most."""
    day = F.datediff("o_orderdate", F.lit("1995-01-01").cast("date"))
    q = read(spark, d, "orders").select(F.col("o_custkey").alias("tid"), F.col("o_orderkey").alias("qid"), day.alias("l"), (day + 30).alias("r"))
    t = _loci(spark, d).select("tid", F.col("bid").alias("id"), F.col("lpos").alias("l"), F.col("rpos").alias("r"))
    return transcripts.best_overlap(q, t, ["tid"])


def compare_halves(spark, d):
    a = alignments(spark, d)
    return transcripts.compare(a.where("hid % 2 = 0"), a.where("hid % 2 = 1"), ["tid", "pos"])


def set_ops(spark, d):
    a = alignments(spark, d)
    x, y = a.where("hid % 2 = 0").select("tid", "pos"), a.where("hid % 2 = 1").select("tid", "pos")
    both = x.intersect(y).withColumn("kind", F.lit("both")).unionByName(x.exceptAll(y).withColumn("kind", F.lit("rest"))).unionByName(x.union(y).withColumn("kind", F.lit("all")))
    return both.groupBy("kind", "tid").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("places"))


def gtf_format(spark, d):
    t = _transcripts(spark, d).select(F.concat(F.lit("s"), "tid").alias("seqname"), F.lit("+").alias("strand"), F.concat(F.lit("g"), "tid", F.lit("."), "bid").alias("gene_id"), F.concat(F.lit("t"), "tid", F.lit("."), "bid").alias("transcript_id"), "coverage", "exons")
    return gtf.gtf_lines(t).select("transcript_id", "line_no", "value")


def gtf_parse(spark, d):
    back = gtf.transcripts(gtf.parse_gtf(gtf_format(spark, d).select("value")))
    return back.select("seqname", "gene_id", "transcript_id", "strand", "coverage", F.size("exons").alias("n_exons"), F.aggregate("exons", F.lit(0), lambda n, e: n + e["r"] - e["l"]).alias("length"))


def sam_parse(spark, d):
    """Alignments written as SAM lines with a splice each, parsed again."""
    a = alignments(spark, d).where("pos >= 0")
    line = F.concat_ws("\t", F.concat(F.lit("q"), "qid"), F.when(F.col("ln") % 2 == 0, "16").otherwise("0"), F.concat(F.lit("s"), "tid"), (F.col("pos") + 1).cast("string"), (F.col("hid") % 60).cast("string"), F.concat(F.lit("2S"), (F.col("rpos") - F.col("pos")).cast("string"), F.lit("M100N7M1I5M2D4M")), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"), F.concat(F.lit("NH:i:"), "ln"), F.concat(F.lit("XS:A:"), "xs"))
    s = sam.parse_sam(a.select(line.alias("value")))
    return s.groupBy("chrm").agg(F.count(F.lit(1)).alias("n"), F.sum("rpos").alias("rpos"), F.sum("qlen").alias("qlen"), F.sum("tags.NH").alias("nh"), F.sum(F.col("splices")[0]["l"]).alias("sl"), F.sum(F.size("matches")).alias("m"), F.sum(F.col("deletions")[0]["l"]).alias("dl"), F.sum(F.col("insertions")[0]["l"]).alias("il"), F.count_if(F.col("xs") == "+").alias("plus"))


def aligned_blocks(spark, d):
    a = alignments(spark, d).withColumn("s", F.array(F.struct((F.col("pos") + 3).alias("l"), (F.col("pos") + 5).alias("r")))).where("rpos > pos + 5")
    return a.select("tid", F.explode(A.aligned_blocks(F.col("pos"), F.col("rpos"), F.col("s"))).alias("b")).groupBy("tid").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("b.r") - F.col("b.l")).alias("length"))


MERGED = BASE + """, own AS (SELECT a.* FROM bnd a JOIN bun b ON a.tid = b.tid AND a.bid = b.bid), ic AS (SELECT *, CASE WHEN pos > max(rpos) OVER (PARTITION BY tid, bid ORDER BY pos, rpos, qid, ln, hid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM own), ik AS (SELECT *, sum(new) OVER (PARTITION BY tid, bid ORDER BY pos, rpos, qid, ln, hid) AS k FROM ic),
exo AS (SELECT tid, bid, k, min(pos) AS l, max(rpos) AS r, count(*) AS n FROM ik GROUP BY tid, bid, k),
trs AS (SELECT tid, bid, CAST(count(*) AS INT) AS n_exons, CAST(sum(r - l) AS INT) AS length, min(l) AS "start", max(r) AS "end", CAST(sum(n) AS DOUBLE) AS coverage FROM exo GROUP BY tid, bid),
itr AS (SELECT tid, bid, r AS l, lead(l) OVER (PARTITION BY tid, bid ORDER BY l) AS r FROM exo)
"""

QUERIES = {
    "transcript_features": (transcript_features, MERGED + 'SELECT tid, bid, n_exons, length, "start", "end", CAST(n_exons - 1 AS INT) AS n_introns FROM trs'),
    "transcript_filter": (transcript_filter, MERGED + "SELECT tid, bid, length >= 20 + 10 * n_exons AND coverage >= CASE WHEN n_exons > 1 THEN 1.5 ELSE 6 END AS kept FROM trs"),
    "expressed_transcripts": (expressed_transcripts, MERGED + "SELECT tid, bid, coverage, CAST(n_exons AS INT) AS n_exons FROM trs WHERE coverage >= 8 AND n_exons > 1"),
    "single_exon_containment": (
        single_exon_containment,
        f"WITH {ALN_SQL} SELECT tid, pos, rpos, qid, ln, hid FROM (SELECT *, max(rpos) OVER (PARTITION BY tid ORDER BY pos, rpos DESC, qid, ln, hid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM aln) WHERE far IS NULL OR rpos > far",
    ),
    "nested_containment": (nested_containment, BASE + "SELECT DISTINCT tid, rpos AS l, nx AS r FROM nxt n WHERE xs = '+' AND nx > rpos AND EXISTS (SELECT 1 FROM aln a WHERE a.tid = n.tid AND a.xs = '-' AND a.pos > n.rpos AND a.rpos < n.nx)"),
    "gene_features": (gene_features, MERGED + ', gb AS (SELECT tid % 100 AS gene_id, count(DISTINCT x) AS nb FROM (SELECT tid, l AS x FROM exo e WHERE EXISTS (SELECT 1 FROM trs t WHERE t.tid = e.tid AND t.bid = e.bid) UNION ALL SELECT tid, r FROM exo) GROUP BY 1) SELECT tid % 100 AS gene_id, count(*) AS n, sum(coverage) AS coverage, min("start") AS "start", max("end") AS "end", CAST(any_value(nb) AS INT) AS n_boundaries FROM trs JOIN gb ON gb.gene_id = tid % 100 GROUP BY 1'),
    "joined_neighbours": (
        joined_neighbours,
        f"WITH {ALN_SQL}, s AS (SELECT tid, pos AS l, rpos AS r, CAST(hid % 7 + 1 AS DOUBLE) AS c FROM aln WHERE xs = '.'), n AS (SELECT *, CASE WHEN l <= max(r) OVER (PARTITION BY tid ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 30 THEN 0 ELSE 1 END AS new FROM s), k AS (SELECT *, sum(new) OVER (PARTITION BY tid ORDER BY l, r ROWS UNBOUNDED PRECEDING) AS kk FROM n) SELECT tid, min(l) AS l, max(r) AS r, count(*) AS n, round(sum(c * (r - l)) / sum(r - l), 6) AS coverage FROM k GROUP BY tid, kk",
    ),
    "consensus_merge": (
        consensus_merge,
        f"WITH RECURSIVE {ALN_SQL}, t AS (SELECT tid, xs, hid % 10 AS run, pos AS s, rpos AS e, qid % 7 + 1 AS c, row_number() OVER (PARTITION BY tid, xs ORDER BY hid % 10, pos, rpos) AS n FROM aln), "
        "step AS (SELECT tid, xs, s, e, c, n, [struct_pack(s := s, e := e, n := 1, c := c)] AS items FROM t WHERE n = 1 UNION ALL SELECT tid, xs, s, e, c, n, CASE WHEN hit THEN list_transform(items, lambda x, k: CASE WHEN k = spot THEN struct_pack(s := least(x.s, s), e := greatest(x.e, e), n := x.n + 1, c := least(x.c, c)) ELSE x END) "
        "ELSE list_concat(list_concat(items[1:spot - 1], [struct_pack(s := s, e := e, n := 1, c := c)]), items[spot:]) END FROM (SELECT *, coalesce(list_min(list_transform(list_filter(list_zip(items, range(1, len(items) + 1)), lambda z: least(z[1].e, e) - greatest(z[1].s, s) >= 0.9 * (z[1].e - z[1].s) OR least(z[1].e, e) - greatest(z[1].s, s) >= 0.9 * (e - s) OR z[1].s > s OR (z[1].s = s AND z[1].e > e)), lambda z: z[2])), len(items) + 1) AS spot, "
        "spot <= len(items) AND (least(items[spot].e, e) - greatest(items[spot].s, s) >= 0.9 * (items[spot].e - items[spot].s) OR least(items[spot].e, e) - greatest(items[spot].s, s) >= 0.9 * (e - s)) AS hit FROM (SELECT t.*, step.items FROM step JOIN t ON t.tid = step.tid AND t.xs = step.xs AND t.n = step.n + 1))), "
        "last AS (SELECT tid, xs, unnest(items) AS x FROM step WHERE n = (SELECT max(n) FROM t WHERE t.tid = step.tid AND t.xs = step.xs)) SELECT tid, xs, CAST(x.n AS BIGINT) AS cnt, CAST(x.c AS DOUBLE) AS coverage, x.s AS \"start\", x.e AS \"end\" FROM last WHERE x.n >= 2",
    ),
    "rpkm_tpm": (rpkm_tpm, "SELECT l_orderkey, l_linenumber, round(l_quantity * 1e9 / sum(l_suppkey + 1) OVER (), 3) AS rpkm, round(l_quantity * 1e6 / sum(l_quantity) OVER (), 3) AS tpm FROM lineitem"),
    "best_overlap_gene": (
        best_overlap_gene,
        BASE + ", oq AS (SELECT o_custkey AS tid, o_orderkey AS qid, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS l FROM orders), ob AS (SELECT qid, bid AS id, CAST(least(q.l + 30, t.rpos) - greatest(q.l, t.lpos) AS INT) AS overlap FROM oq q JOIN bun t ON q.tid = t.tid AND t.lpos < q.l + 30 AND q.l < t.rpos) SELECT qid, id, overlap FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY overlap DESC, id) AS kk FROM ob) WHERE kk = 1",
    ),
    "compare_halves": (compare_halves, f"WITH {ALN_SQL}, a AS (SELECT DISTINCT tid, pos FROM aln WHERE hid % 2 = 0), b AS (SELECT DISTINCT tid, pos FROM aln WHERE hid % 2 = 1) SELECT (SELECT count(*) FROM a JOIN b ON a.tid = b.tid AND a.pos = b.pos) AS tp, (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS fp, (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS fn"),
    "set_ops": (
        set_ops,
        f"WITH {ALN_SQL}, x AS (SELECT tid, pos FROM aln WHERE hid % 2 = 0), y AS (SELECT tid, pos FROM aln WHERE hid % 2 = 1), u AS (SELECT 'both' AS kind, * FROM (FROM x INTERSECT FROM y) UNION ALL SELECT 'rest', * FROM (FROM x EXCEPT ALL FROM y) UNION ALL SELECT 'all', * FROM (FROM x UNION ALL FROM y)) SELECT kind, tid, count(*) AS n, CAST(sum(pos) AS BIGINT) AS places FROM u GROUP BY kind, tid",
    ),
    "gtf_format": (
        gtf_format,
        MERGED + """, ids AS (SELECT tid, bid, 's' || tid AS sn, 'gene_id "g' || tid || '.' || bid || '"; transcript_id "t' || tid || '.' || bid || '";' AS att FROM trs)
SELECT 't' || i.tid || '.' || i.bid AS transcript_id, 0::INT AS line_no, concat_ws(chr(9), sn, 'lociflow', 'transcript', CAST("start" + 1 AS VARCHAR), CAST("end" AS VARCHAR), '1000', '+', '.', att || ' cov "' || printf('%.4f', coverage) || '";') AS value FROM ids i JOIN trs t ON i.tid = t.tid AND i.bid = t.bid
UNION ALL SELECT 't' || i.tid || '.' || i.bid, CAST(row_number() OVER (PARTITION BY e.tid, e.bid ORDER BY l) AS INT), concat_ws(chr(9), sn, 'lociflow', 'exon', CAST(l + 1 AS VARCHAR), CAST(r AS VARCHAR), '1000', '+', '.', att || ' exon "' || row_number() OVER (PARTITION BY e.tid, e.bid ORDER BY l) || '";') FROM ids i JOIN exo e ON i.tid = e.tid AND i.bid = e.bid""",
    ),
    "gtf_parse": (gtf_parse, MERGED + "SELECT 's' || tid AS seqname, 'g' || tid || '.' || bid AS gene_id, 't' || tid || '.' || bid AS transcript_id, '+' AS strand, coverage, n_exons, length FROM trs"),
    "sam_parse": (
        sam_parse,
        f"WITH {ALN_SQL} SELECT 's' || tid AS chrm, count(*) AS n, CAST(sum(rpos + 118) AS BIGINT) AS rpos, CAST(sum(rpos - pos + 19) AS BIGINT) AS qlen, CAST(sum(ln) AS BIGINT) AS nh, CAST(sum(rpos) AS BIGINT) AS sl, CAST(4 * count(*) AS BIGINT) AS m, CAST(sum(rpos + 112) AS BIGINT) AS dl, CAST(sum(rpos + 106) AS BIGINT) AS il, count(*) FILTER (xs = '+') AS plus FROM aln WHERE pos >= 0 GROUP BY tid",
    ),
    "aligned_blocks": (aligned_blocks, f"WITH {ALN_SQL} SELECT tid, 2 * count(*) AS n, CAST(sum(rpos - pos - 2) AS BIGINT) AS length FROM aln WHERE rpos > pos + 5 GROUP BY tid"),
}
