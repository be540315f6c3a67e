"""Compressed binary alignment files (BAM): a data source that reads ranges of a file in parallel, by the public block and record layouts."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lociflow.sources.sam import with_alignment

SCHEMA = "qname string, flag int, chrm string, pos int, mapq int, cigar string, mchrm string, mpos int, isize int, tags struct<ts:string,XS:string,HI:int,NH:int,nm:int,UB:string>"
#: Fixed values of the layouts: how a block starts, the longest block, operations by number, and sizes of tag and array values.
MAGIC, LONGEST_BLOCK, OPERATIONS = b"\x1f\x8b\x08\x04", 1 << 16, "MIDNSHP=X"
WIDTHS = {"A": ("c", 1), "c": ("b", 1), "C": ("B", 1), "s": ("h", 2), "S": ("H", 2), "i": ("i", 4), "I": ("I", 4), "f": ("f", 4)}
#: Records in a row that must be sound for a place in the middle of a file to count as a record's start.
SOUND_RECORDS = 8


@dataclass
class Range(InputPartition):
    """The blocks of a file that start from `start` up to `end`; the file's first record begins at byte `skip` of the data of block `first`."""

    path: str
    start: int
    end: int
    first: int
    skip: int
    names: tuple[str, ...]

    def __post_init__(self):
        super().__init__(self.start)


def opened(path: str):
    """A random access file, of any store that the path names."""
    store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store.open_input_file(inner)


def block_at(f, at: int, size: int) -> tuple[bytes, int] | None:
    """The data of the block that starts at a byte of the file, and where the next one starts; None at the end or where no block starts."""
    if at >= size:
        return None
    head = f.read_at(12, at)
    if len(head) < 12 or head[:4] != MAGIC:
        return None
    extra_size = struct.unpack_from("<H", head, 10)[0]
    extra, k, whole = f.read_at(extra_size, at + 12), 0, None
    while k + 4 <= len(extra):
        length = struct.unpack_from("<H", extra, k + 2)[0]
        if extra[k : k + 2] == b"BC" and length == 2 and k + 6 <= len(extra):
            whole = struct.unpack_from("<H", extra, k + 4)[0] + 1
        k += 4 + length
    if whole is None or whole < 12 + extra_size + 8 or at + whole > size:
        return None
    try:
        return zlib.decompress(f.read_at(whole - 20 - extra_size, at + 12 + extra_size), -15), at + whole
    except zlib.error:
        return None


def next_block(f, at: int, size: int) -> int:
    """The first place from `at` on where a block starts whose data can be read and behind which another one starts, or the file ends."""
    while at < size:
        part = f.read_at(2 * LONGEST_BLOCK, at)
        k = part.find(MAGIC)
        while k >= 0:
            found = block_at(f, at + k, size)
            if found and (found[1] == size or f.read_at(4, found[1]) == MAGIC):
                return at + k
            k = part.find(MAGIC, k + 1)
        at += max(1, len(part) - 3)
    return size


class Stream:
    """The data of a file's blocks from one on, taken piece by piece, with the block in which each piece starts."""

    def __init__(self, f, at: int, size: int):
        self.f, self.next, self.size, self.data, self.at, self.starts = f, at, size, b"", 0, []

    def fill(self, n: int) -> bool:
        """Whether n bytes from the place on are there."""
        while len(self.data) - self.at < n:
            got = block_at(self.f, self.next, self.size)
            if got is None:
                return False
            if self.at:
                self.starts = [(max(0, k - self.at), b) for i, (k, b) in enumerate(self.starts) if i + 1 == len(self.starts) or self.starts[i + 1][0] > self.at]
                self.data, self.at = self.data[self.at :], 0
            self.starts.append((len(self.data), self.next))
            self.data, self.next = self.data + got[0], got[1]
        return True

    def block(self) -> int:
        """Where the block of the next byte starts."""
        self.fill(1)
        return max((b for k, b in self.starts if k <= self.at), default=self.next)

    def take(self, n: int) -> bytes | None:
        if not self.fill(n):
            return None
        self.at += n
        return self.data[self.at - n : self.at]


def header(f, size: int) -> tuple[tuple[str, ...], int, int]:
    """The names of the reference sequences, and where the first record starts: its block and the byte in its data."""
    s = Stream(f, 0, size)
    if s.take(4) != b"BAM\1":
        raise ValueError("no compressed alignment file: its data doesn't start with BAM")
    s.take(struct.unpack("<i", s.take(4))[0])
    names = []
    for _ in range(struct.unpack("<i", s.take(4))[0]):
        names.append(s.take(struct.unpack("<i", s.take(4))[0])[:-1].decode())
        s.take(4)
    block = s.block()
    return tuple(names), block, s.at - max((k for k, b in s.starts if b == block), default=s.at)


def _sound(data: bytes, at: int, n_refs: int) -> int | None:
    """Where the record that starts at a byte of the data ends, if it is one: its numbers fit each other and the name ends in a zero. None if it can't be one."""
    if at + 36 > len(data):
        return len(data) + 1
    length, ref, pos, name, _, _, ops, _, seq, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    fixed = 32 + name + 4 * ops + (seq + 1) // 2 + seq
    if not (-1 <= ref < n_refs and -1 <= mate < n_refs and pos >= -1 and mate_pos >= -1 and name >= 1 and seq >= 0 and length >= fixed and length < 1 << 28):
        return None
    end = at + 36 + name
    if end <= len(data) and (data[end - 1] or 0 in data[at + 36 : end - 1]):
        return None
    if end + 4 * ops <= len(data) and any(data[k] & 15 > 8 for k in range(end, end + 4 * ops, 4)):
        return None
    return at + 4 + length


def first_record(data: bytes, n_refs: int, last: bool) -> int | None:
    """The first byte of the data from which on SOUND_RECORDS records in a row lie whole in it and are sound, or, if nothing comes behind the data (last), all up to its end. None if there is none.

    A place whose records leave the data earlier doesn't count, so a wrong length that reaches far doesn't win over the true records behind it.
    """
    for at in range(len(data)):
        k, n = at, 0
        while k is not None and k < len(data) and n < SOUND_RECORDS:
            k, n = _sound(data, k, n_refs), n + 1
        if k is not None and k <= len(data) and (n == SOUND_RECORDS or (last and k == len(data))):
            return at
    return None


def tags_of(data: bytes, at: int) -> dict[str, object]:
    """The record's tags that the rows show, and CG (the operations of an alignment with too many of them), by name."""
    out: dict[str, object] = {}
    while at + 3 <= len(data):
        name, kind, at = data[at : at + 2].decode(), chr(data[at + 2]), at + 3
        if kind in "ZH":
            end = data.index(b"\0", at)
            value, at = data[at:end].decode(), end + 1
        elif kind == "B":
            code, width = WIDTHS[chr(data[at])]
            n = struct.unpack_from("<i", data, at + 1)[0]
            value, at = (struct.unpack_from(f"<{n}{code}", data, at + 5) if name == "CG" else None), at + 5 + n * width
        else:
            code, width = WIDTHS[kind]
            value = struct.unpack_from(f"<{code}", data, at)[0]
            value, at = value.decode() if kind == "A" else value, at + width
        if (name in ("ts", "XS") and kind == "A") or (name in ("HI", "NH", "NM", "nM") and kind in "cCsSiI") or (name == "UB" and kind in "ZH") or name == "CG":
            out[name] = value
    return out


def record(data: bytes, names: tuple[str, ...]) -> tuple:
    """A row of SCHEMA from a record without its length."""
    ref, pos, name_size, mapq, _, n_ops, flag, n_seq, mate, mate_pos, isize = struct.unpack_from("<iiBBHHHiiii", data)
    at = 32 + name_size
    ops = struct.unpack_from(f"<{n_ops}I", data, at)
    tags = tags_of(data, at + 4 * n_ops + (n_seq + 1) // 2 + n_seq)
    if "CG" in tags and n_ops == 2 and ops[0] == n_seq << 4 | 4:
        ops = tags["CG"]
    cigar = "".join(f"{x >> 4}{OPERATIONS[x & 15]}" for x in ops) or "*"
    known = {"ts": tags.get("ts"), "XS": tags.get("XS"), "HI": tags.get("HI"), "NH": tags.get("NH"), "nm": tags.get("NM", tags.get("nM", 0)), "UB": tags.get("UB")}
    of = lambda k: names[k] if k >= 0 else "*"
    return data[32 : at - 1].decode(), flag, of(ref), pos, mapq, cigar, of(mate), mate_pos, isize, known


class BamReader(DataSourceReader):
    def __init__(self, path: str, splits: int):
        self.path, self.splits = path, splits

    def partitions(self) -> list[Range]:
        """Ranges of like size; the header goes to all."""
        with opened(self.path) as f:
            size = f.size()
            names, first, skip = header(f, size)
        cuts = [first + (size - first) * k // self.splits for k in range(self.splits)] + [size]
        return [Range(self.path, a, b, first, skip, names) for a, b in zip(cuts, cuts[1:]) if a < b]

    def read(self, own: Range) -> Iterator[pa.RecordBatch]:
        """The records that start in the range's blocks; the last one may go on in the next range's."""
        with opened(own.path) as f:
            size = f.size()
            at = own.first if own.start <= own.first else next_block(f, own.start, size)
            if at >= own.end:
                return
            s = Stream(f, at, size)
            if at == own.first:
                s.take(own.skip)
            else:
                wanted, start = 1 << 18, None
                while start is None:
                    there = s.fill(wanted)
                    start = first_record(s.data, len(own.names), not there)
                    if start is None and not there:
                        return
                    wanted *= 2
                s.at = start
            rows = []
            while s.fill(4) and s.block() < own.end:
                length = struct.unpack("<i", s.take(4))[0]
                if (data := s.take(length)) is None:
                    raise ValueError(f"{own.path} ends within a record")
                rows.append(record(data, own.names))
                if len(rows) == 5000:
                    yield self.batch(rows)
                    rows = []
            if rows:
                yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        text, whole = pa.string(), pa.int32()
        kinds = [text, whole, text, whole, whole, text, text, whole, whole, pa.struct([("ts", text), ("XS", text), ("HI", whole), ("NH", whole), ("nm", whole), ("UB", text)])]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["qname", "flag", "chrm", "pos", "mapq", "cigar", "mchrm", "mpos", "isize", "tags"])


class BamSource(DataSource):
    """format("bam"): option path, and splits, how many tasks read the file (8 if not given)."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(self.options["path"], int(self.options.get("splits", "8")))


def read_bam(spark: SparkSession, path: str, splits: int | None = None) -> DataFrame:
    """Alignment rows of a compressed binary file, as read_sam() gives them for the same alignments as text.

    The file is cut into `splits` ranges (by default one for each 64 MB). A reader looks for the first block that starts in its range, and in the data from there for the first record: the first
    place from which on several records in a row are sound. It reads on beyond its range until the last record that starts there is whole.
    """
    spark.dataSource.register(BamSource)
    if splits is None:
        with opened(path) as f:
            splits = max(1, -(-f.size() // (64 << 20)))
    return with_alignment(spark.read.format("bam").option("splits", str(splits)).load(path))
