"""Which tokens of two tokenizers stand for the same text: groups between common ends, and how often each pair of ids ends together."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.llm.common import array_of, modest_batches, packed
from lociflow.llm.packing import LONG_RUN, tokenizer
from lociflow.sources.shared import drop_written, written

#: Text bytes of one block: a task's documents whose links are looked up together.
BLOCK_BYTES = 16 << 20


@lru_cache(maxsize=2)
def _byte_level(path: str) -> tuple:
    """The byte-level tokenizer of a JSON file and the bytes of each of its ids."""
    bpe = tokenizer(path)
    lengths = np.zeros(bpe.max_token_value + 1, np.int64)
    for token in bpe.token_byte_values():
        lengths[bpe.encode_single_token(token)] = len(token)
    return bpe, lengths


@lru_cache(maxsize=2)
def _pieces(path: str) -> tuple:
    """The piece tokenizer of a model file and the bytes of each of its ids: U+2581 is a space, <0xHH> a byte."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.vocab_size())]
    tokens = [bytes([int(x[3:5], 16)]) if model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
    return model, tokens, np.array([len(x) for x in tokens], np.int64)


def plain_ids(text: str, path: str) -> list[int]:
    """The byte-level ids of the text, in which special tokens' strings are ordinary text. Runs of white space too long for the pattern matcher are cut where the pattern cuts them."""
    bpe = tokenizer(path)
    if len(text) < 20_000:
        return bpe.encode_ordinary(text)
    ids, at = [], 0
    for run in LONG_RUN.finditer(text):
        end = run.end() - (run.end() < len(text))
        ids += bpe.encode_ordinary(text[at : run.start()]) + bpe._encode_single_piece(text[run.start() : end])
        at = end
    return ids + bpe.encode_ordinary(text[at:])


def common_ends(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of a and of b end together: both lists of cumulative ends rise, and one walk over both merges them."""
    at = np.searchsorted(b_ends, a_ends)
    both = at < len(b_ends)
    both[both] = b_ends[at[both]] == a_ends[both]
    return np.flatnonzero(both), at[both]


_DIGITS = np.zeros((100_000, 6), np.uint8)
for _k in range(5):
    _DIGITS[:, 4 - _k] = 48 + np.arange(100_000) // 10**_k % 10
_SIZE = 1 + sum((np.arange(100_000) >= 10**k).astype(np.int64) for k in range(1, 5))


def written_groups(a: np.ndarray, b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray) -> bytes:
    """`a1,a2|b1;a3|b2,b3`: the ids of each group in order; a_last and b_last are the groups' last tokens. Ids are below 100,000."""
    a_of, b_of = (np.repeat(np.arange(len(last)), np.diff(last, prepend=-1)) for last in (a_last, b_last))
    before_a = np.concatenate([[0], b_last + 1])[a_of]
    a_at, b_at = np.arange(len(a)) + before_a, np.arange(len(b)) + (a_last + 1)[b_of]
    ids = np.empty(len(a) + len(b), np.int64)
    ids[a_at], ids[b_at] = a, b
    signs = np.full(len(ids), ord(","), np.uint8)
    signs[a_at[a_last]], signs[b_at[b_last]] = ord("|"), ord(";")
    rows = _DIGITS[ids]
    rows[:, 5] = signs
    return rows[np.arange(6) >= (5 - _SIZE[ids])[:, None]].tobytes()[:-1]


def aligned_tokens(text: str, a_path: str, b_ids: list[int], b_path: str) -> tuple[np.ndarray, ...] | None:
    """a's ids, b's ids, and which tokens of each end together; None where either's bytes aren't a space and the text."""
    bpe, a_len = _byte_level(a_path)
    _, tokens, b_len = _pieces(b_path)
    whole = f" {text}"
    a_ids = plain_ids(whole, a_path)
    whole = whole.encode()
    if b"".join(map(tokens.__getitem__, b_ids)) != whole or bpe.decode_bytes(a_ids) != whole:
        return None
    a, b = np.array(a_ids, np.int64), np.array(b_ids, np.int64)
    return a, b, *common_ends(np.cumsum(a_len[a]), np.cumsum(b_len[b]))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document: id (as string), block, n_a, n_b, n_groups, n_links, groups_sha256, (groups,) links (packed); and a row for each block of its links, with n_a null.

    The documents that a task reads one after the other make up blocks of about block_bytes of text, so texts aren't moved. Links are (a << 16 | b) and how often, sorted.
    """

    def one(text, b_ids):
        found = aligned_tokens(text, a_path, b_ids, b_path) if text else None
        if found is None:
            return (0, 0, 0, 0, "", ""), np.zeros(0, np.uint32)
        a, b, a_last, b_last = found
        groups = written_groups(a, b, a_last, b_last)
        codes = (a[a_last] << 16 | b[b_last]).astype(np.uint32)
        return (len(a), len(b), len(a_last), len(codes), hashlib.sha256(groups).hexdigest(), groups.decode() if with_groups else ""), codes

    def kept(codes, times):
        return packed(np.concatenate([np.diff(codes, prepend=np.uint32(0)), times.astype(np.uint32)]))

    def walk(frames):
        task, chunk, held, size, known = TaskContext.get().partitionId(), 0, [], 0, {}

        def block_row():
            codes, n = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame([(None, task << 32 | chunk, None, None, None, None, None, None, kept(codes, n))], columns=names).astype({c: "Int64" for c in counts})

        for frame in frames:
            for at in range(0, len(frame), 200):
                part, out = frame.iloc[at : at + 200], []
                texts = [t or "" for t in part["text"]]
                new = list(dict.fromkeys(t for t in texts if t not in known))
                if new:
                    known |= {t: one(t, ids) for t, ids in zip(new, _pieces(b_path)[0].encode(new, num_threads=1))}
                for key, text in zip(part["id"], texts):
                    row, codes = known[text]
                    distinct, n = np.unique(codes, return_counts=True)
                    out.append((key, task << 32 | chunk, *row, kept(distinct, n)))
                    held.append(codes)
                    size += len(text)
                yield pd.DataFrame(out, columns=names).astype({c: "Int64" for c in counts})
                if size >= block_bytes:
                    yield block_row()
                    chunk, held, size, known = chunk + 1, [], 0, {}
        if held:
            yield block_row()

    counts = ["n_a", "n_b", "n_groups", "n_links"]
    names = ["id", "block", *counts, "groups_sha256", "groups", "links"]
    rows = modest_batches(docs).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(walk, f"id string, block long, {', '.join(f'{c} long' for c in counts)}, groups_sha256 string, groups string, links binary")


def _unpacked(z) -> tuple[np.ndarray, np.ndarray]:
    codes, times = np.split(array_of(z, np.uint32), 2)
    return np.cumsum(codes, dtype=np.uint32), times


def block_links(aligned: DataFrame) -> DataFrame:
    """block, a, b, n: how many links each block holds of each pair of ids."""

    def unpack(batches):
        for batch in batches:
            for block, z in zip(batch.column(0), batch.column(1)):
                codes, times = _unpacked(z)
                for at in range(0, len(codes), 50_000):
                    part = codes[at : at + 50_000]
                    columns = [np.full(len(part), block.as_py(), np.int64), (part >> 16).astype(np.int32), (part & 0xFFFF).astype(np.int32), times[at : at + 50_000].astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["block", "a", "b", "n"])

    return aligned.where("n_a IS NULL").select("block", "links").mapInArrow(unpack, "block long, a int, b int, n long")


def pair_counts(links: DataFrame) -> DataFrame:
    """a, b, n, a_most, b_most: how many links hold each pair, and the highest such number of its a and of its b."""
    pairs = links.groupBy("a", "b").agg(F.sum("n").alias("n"))
    for side in ("a", "b"):
        pairs = pairs.join(pairs.groupBy(side).agg(F.max("n").alias(f"{side}_most")), side)
    return pairs.select("a", "b", "n", "a_most", "b_most")


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of docs.

    a is a byte-level tokenizer's JSON file and encodes a space and the text; b is a piece model that adds the space. Where tokens of both end at one byte, a group ends, and the two
    tokens are linked. Spark counts the links of each pair of ids, joins the highest count of each side, and the counts go back to the blocks of documents that hold the pair:
    a block asks once for each pair, however many of its documents hold it. n_best counts the document's links whose pair has the highest count of its b id; count_sum adds up the counts.

    Defined cases: a text that is null, empty or that either tokenizer doesn't give back byte for byte has zeros and an empty groups_sha256; repeated rows and null ids get a row and count each;
    ties for the highest count are all best; other columns are left out, whatever their names; an empty table gives no rows. A text is encoded whole, in one task.
    """
    kind = docs.schema[id_col].dataType
    aligned = written(align(docs, a_path, b_path, id_col, text_col, block_bytes=block_bytes), "aligned")
    links = block_links(aligned)
    counted = written(pair_counts(links), "pair_counts")
    answers = links.join(counted.select("a", "b", F.col("n").alias("count"), (F.col("n") == F.col("b_most")).alias("best")), ["a", "b"]).select("block", F.expr("shiftleft(CAST(a AS BIGINT), 16) | b").alias("code"), "count", "best")

    def look_up(rows: pa.Table, answers: pa.Table) -> pa.Table:
        code, count, best = (answers.column(c).to_numpy() for c in ("code", "count", "best"))
        order = np.argsort(code)
        code, count, best = code[order], count[order], best[order]
        n_best, total = [], []
        for z in rows.column("links"):
            codes, times = _unpacked(z)
            at, times = np.searchsorted(code, codes), times.astype(np.int64)
            n_best.append(int(times[best[at]].sum()) if len(at) else 0)
            total.append(int((times * count[at]).sum()) if len(at) else 0)
        return rows.select(["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64()))

    rows = aligned.where("n_a IS NOT NULL").select("id", "block", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links")
    made = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(look_up, "id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    return made.select(F.col("id").cast(kind).alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def vocabulary_map(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """b, a, n: for each id of b the ids of a that most often end with it (ties all), by the links of all documents."""
    aligned = written(align(docs, a_path, b_path, id_col, text_col), "aligned")
    out = written(pair_counts(block_links(aligned)), "pair_counts").where("n = b_most").select("b", "a", "n")
    drop_written(aligned)
    return out


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    """How the tokens of a byte-level and of a piece tokenizer line up in every document."""
    import public_tokenizers

    return align_tokenizers(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
