"""Compressed binary alignment files, written here by the public layouts, against the same alignments as text."""

import random
import struct
import zlib

import pytest

from lociflow.sources import bam, sam

NAMES = ["chr1", "chrX", "a_long_name_of_a_sequence"]


def block(data):
    """A block of the compressed layout."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return struct.pack("<4sIBBH2sHH", b"\x1f\x8b\x08\x04", 0, 0, 255, 6, b"BC", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def blocks(data, size):
    return b"".join(block(data[k : k + size]) for k in range(0, len(data), size)) + block(b"")


def tag_bytes(tag):
    name, kind, value = tag
    if kind == "Z":
        return name.encode() + b"Z" + value.encode() + b"\0"
    if kind == "B":
        return name.encode() + b"BI" + struct.pack(f"<i{len(value)}I", len(value), *value)
    return name.encode() + kind.encode() + (value.encode() if kind == "A" else struct.pack("<" + {"c": "b", "C": "B", "s": "h", "i": "i", "f": "f"}[kind], value))


def record(a, long_cigar=False):
    """A record's bytes, with a made-up sequence."""
    ops = [n << 4 | "MIDNSHP=X".index(k) for n, k in a["cigar"]]
    tags = list(a["tags"])
    n_seq = sum(n for n, k in a["cigar"] if k in "MIS=X")
    if long_cigar:
        tags.append(("CG", "B", ops))
        ops = [n_seq << 4 | 4, sum(n for n, k in a["cigar"] if k in "MDN=X") << 4 | 3]
    name = a["qname"].encode() + b"\0"
    body = struct.pack("<iiBBHHHiiii", a["ref"], a["pos"], len(name), a["mapq"], 0, len(ops), a["flag"], n_seq, a["mate"], a["mpos"], a["isize"])
    body += name + struct.pack(f"<{len(ops)}I", *ops) + bytes([0x12] * ((n_seq + 1) // 2)) + bytes([0xFF] * n_seq) + b"".join(map(tag_bytes, tags))
    return struct.pack("<i", len(body)) + body


def line(a):
    name = lambda k: "*" if k < 0 else NAMES[k]
    mate = "=" if a["mate"] == a["ref"] >= 0 else name(a["mate"])
    tags = [f"{n}:{'i' if k in 'csCi' else k}:{v}" for n, k, v in a["tags"] if k != "B"]
    return "\t".join([a["qname"], str(a["flag"]), name(a["ref"]), str(a["pos"] + 1), str(a["mapq"]), "".join(f"{n}{k}" for n, k in a["cigar"]) or "*", mate, str(a["mpos"] + 1), str(a["isize"]), "*", "*", *tags])


def alignments(n):
    r = random.Random(n)
    out = []
    for k in range(n):
        cigar = [(r.randint(1, 90), "M")]
        for _ in range(r.randint(0, 3)):
            cigar += [(r.randint(1, 900), r.choice("NID")), (r.randint(1, 60), "M")]
        ref = r.choice([0, 0, 1, 2, -1])
        tags = [t for t in (("NH", "C", r.randint(1, 9)), ("XS", "A", r.choice("+-")), ("ts", "A", "-"), ("NM", "c", r.randint(0, 9)), ("HI", "i", 70_000), ("UB", "Z", "ACGT"), ("ZB", "B", [1, 2, 3]), ("AS", "s", -300), ("xf", "f", 0.5), ("MD", "Z", "10A5")) if r.random() < 0.5]
        out.append({"qname": f"read{k}" * r.randint(1, 6), "flag": r.randint(0, 4095), "ref": ref, "pos": r.randint(0, 10**6) if ref >= 0 else -1, "mapq": r.randint(0, 255), "cigar": cigar if ref >= 0 else [], "mate": r.choice([ref, 1, -1]), "mpos": r.randint(-1, 10**6), "isize": r.randint(-500, 500), "tags": tags})
    return out


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """2,000 alignments in blocks of 700 bytes, so that records lie across blocks, and as text."""
    path, made = tmp_path_factory.mktemp("bam"), alignments(2000)
    head = b"BAM\1" + struct.pack("<i", 6) + b"@HD\tx\n" + struct.pack("<i", len(NAMES)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", 10**7) for n in NAMES)
    (path / "a.bam").write_bytes(blocks(head + b"".join(record(a, k % 50 == 0 and bool(a["cigar"])) for k, a in enumerate(made)), 700))
    (path / "none.bam").write_bytes(blocks(head, 40))
    (path / "a.sam").write_text("@HD\tx\n" + "\n".join(map(line, made)) + "\n")
    return path, rows(sam.read_sam(spark, str(path / "a.sam")))


@pytest.mark.parametrize("splits", [1, 8, 37, 400])
def test_binary_file_gives_what_text_gives(spark, files, splits):
    path, want = files
    df = bam.read_bam(spark, f"file://{path}/a.bam", splits)
    assert df.rdd.getNumPartitions() == splits and rows(df) == want and len(want) == 2000


def test_file_without_alignments_and_other_files(spark, files):
    path, _ = files
    assert bam.read_bam(spark, str(path / "none.bam"), 3).count() == 0 and bam.read_bam(spark, str(path / "none.bam")).columns == sam.read_sam(spark, str(path / "a.sam")).columns
    (path / "other").write_bytes(block(b"no alignments" * 9))
    with pytest.raises(Exception, match="BAM"):
        bam.read_bam(spark, str(path / "other")).count()


def test_first_record_is_never_within_one(files):
    """From every byte of the data on, the next record found is the true one."""
    made = [record(a) for a in alignments(60)]
    data, starts, at = b"".join(made), [], 0
    for m in made:
        starts.append(at)
        at += len(m)
    for k in range(0, starts[40], 7):
        assert k + bam.first_record(data[k:], len(NAMES), True) == next(s for s in starts if s >= k)
