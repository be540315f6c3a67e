"""Nearest neighbours, token alignment and the source audit against brute force, with every odd case."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lociflow.llm import nearest, source_audit, token_alignment

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block long, n int, term string, total long, part string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "x", 4, "y") for r in rows], SCHEMA)


# --- source audit


def audited(rows, least, top):
    """The contract, term by term, in plain integers."""
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))) for _, text, lang, source in rows]
    held, counts, groups = defaultdict(Counter), defaultdict(Counter), sorted({d[:2] for d in docs})
    for lang, source, terms in docs:
        held[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, source in groups:
        kept = [t for t, n in held[lang].items() if n >= least]
        others = [s for x, s in groups if x == lang]
        all_n = {t: sum(counts[lang, s][t] for s in others) for t in kept}

        def p(c):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 1000000000 * (c[t] + 1) // total for t in kept}

        own, q = p(counts[lang, source]), p(all_n)
        apart = lambda a, b, t: (a[t] - b[t]) ** 2 // b[t]
        found = {"pair": [(s, sum(apart(own, p(counts[lang, s]), t) for t in kept)) for s in others if s != source], "term": [(t, apart(own, q, t)) for t in kept if counts[lang, source][t] and own[t] > q[t]]}
        for part, items in found.items():
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(items) if part == "pair" or k < top]
    return sorted(out)


def audit_rows():
    r = random.Random(5)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(90)] + ["Éa", "éa", "ЖЗ", "naïve", "THE", "the"]
    rows = [(i, " ".join(r.choices(words, weights=range(1, len(words) + 1), k=r.randint(0, 60))), r.choice(["en", "en", "fr", None]), r.choice(["s1", "s1", "s1", "s2", "s3", None, "x' "])) for i in range(120)]
    rows += [(900, None, "en", "empty"), (901, "", None, None), (902, "12 34 -- !", "de", "only"), (903, "alone here", "xx", "a"), (904, "gone", "xx", "b"), (None, "null id the", "en", "s1"), (None, "null id the", "en", "s1")]
    return rows + [rows[3]] * 2 + [(905, "the " * 40_000 + "rare rare rare", "en", "s2")]


def test_audit_by_brute_force(spark, monkeypatch):
    rows = audit_rows()
    monkeypatch.setattr(source_audit, "HELD_RUNS", 50)
    got = sorted(tuple(r) for r in source_audit.audit(documents(spark, rows).repartition(5), top=12).collect())
    assert got == audited(rows, 3, 12) and {x[2] for x in got} == {"pair", "term"} and {x[0] for x in got} >= {"", "en", "fr", "xx"}


def test_audit_of_scans_cut_anywhere(spark, monkeypatch):
    """Batches of a row or two cut runs at every place; steps of a few pairs and sums sent early change nothing."""
    rows = audit_rows()[:70]
    whole = source_audit._gathered
    monkeypatch.setattr(source_audit, "_gathered", lambda batches: whole((b.slice(k, 1) for b in batches for k in range(b.num_rows)), 2))
    monkeypatch.setattr(source_audit, "STEP_PAIRS", 3)
    got = sorted(tuple(r) for r in source_audit.audit(documents(spark, rows).repartition(2)).collect())
    assert got == audited(rows, 3, 200)


def test_audit_without_rows_or_terms(spark):
    assert source_audit.audit(documents(spark, [])).collect() == []
    got = source_audit.audit(documents(spark, [(1, "a b", "en", "s"), (2, None, "en", "t")])).collect()
    assert sorted(tuple(r) for r in got) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]


def test_shares_are_exact():
    r = random.Random(2)
    pairs = [(0, 1), (1, 1), (2**52, 2**53 - 1), *((lambda t: (r.randint(0, t), t))(r.randint(1, 10 ** r.randint(1, 15))) for _ in range(500))]
    count, total = np.array(pairs, np.int64).T
    assert source_audit.scaled(count, total).tolist() == [1 + 1000000000 * c // t for c, t in pairs]


# --- token alignment


def token_lists(text, a, b):
    """Each tokenizer's ids and their bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in plain]
    byte_of = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(rest)}
    a_ids, b_ids = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
    pieces = [b.id_to_piece(i) for i in b_ids]
    return a_ids, [bytes(byte_of[c] for c in a.id_to_token(i)) for i in a_ids], b_ids, [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b_ids, pieces)]


def aligned(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) for each text, with two pointers."""
    a, b = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a.encode_special_tokens = True
    out, counts = [], Counter()
    for text in texts:
        found = None
        if text:
            a_ids, a_bytes, b_ids, b_bytes = token_lists(text, a, b)
            if b"".join(a_bytes) == b"".join(b_bytes) == f" {text}".encode():
                i = j = a_end = b_end = a_from = b_from = 0
                groups, links = [], []
                while i < len(a_ids) or j < len(b_ids):
                    if a_end <= b_end:
                        a_end, i = a_end + len(a_bytes[i]), i + 1
                    else:
                        b_end, j = b_end + len(b_bytes[j]), j + 1
                    if a_end == b_end:
                        groups.append(",".join(map(str, a_ids[a_from:i])) + "|" + ",".join(map(str, b_ids[b_from:j])))
                        links.append((a_ids[i - 1], b_ids[j - 1]))
                        a_from, b_from = i, j
                counts.update(links)
                found = len(a_ids), len(b_ids), groups, links
        out.append(found)
    most = Counter()
    for (x, y), n in counts.items():
        most[y] = max(most[y], n)
    rows = [(0, 0, 0, 0, 0, 0, "") if f is None else (f[0], f[1], len(f[2]), len(f[3]), sum(counts[p] == most[p[1]] for p in f[3]), sum(counts[p] for p in f[3]), hashlib.sha256(";".join(f[2]).encode()).hexdigest()) for f in out]
    return rows, counts


def odd_texts():
    r = random.Random(3)
    made = [" ".join(r.choices("The quick brown fox über naïve 12345 <|endoftext|> don't\n re-entry 日本語 🎉  x ab\tcd".split(" "), k=r.randint(1, 80))) for _ in range(40)]
    return [*made, None, "", " ", "   leading and trailing  ", "\n\n\t", "<s>x</s><unk>[UNK]", "a▁b", "▁", "é́", "a\0b", "x" * 3000, " " * 50_000 + "end", "word " * 9000, "﻿bom", made[3], made[3], "  　 z"]


@pytest.mark.parametrize("block_bytes", [1 << 24, 500])
def test_alignment_by_brute_force(spark, block_bytes):
    texts = odd_texts()
    rows = [(i if i != 7 else None, t, "en", "s") for i, t in enumerate(texts)] + [(2, texts[2], "en", "s")]
    want, _ = aligned([r[1] for r in rows])
    got = token_alignment.align_tokenizers(documents(spark, rows).repartition(3), A_PATH, B_PATH, block_bytes=block_bytes)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] and got.schema["doc_id"].dataType.simpleString() == "bigint"
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(((r[0], *w) for r, w in zip(rows, want)), key=key)
    assert want[texts.index("a▁b")] == (0, 0, 0, 0, 0, 0, "") and want[texts.index("a\0b")][0] > 0


def test_alignment_outputs(spark):
    texts = odd_texts()[:30]
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    _, counts = aligned(texts)
    most = {b: max(n for (_, y), n in counts.items() if y == b) for _, b in counts}
    assert {(r.a, r.b, r.n) for r in token_alignment.vocabulary_map(docs, A_PATH, B_PATH).collect()} == {(a, b, n) for (a, b), n in counts.items() if n == most[b]}
    groups = token_alignment.align(docs, A_PATH, B_PATH, with_groups=True).where("n_a > 0").select("groups", "groups_sha256", "n_groups").collect()
    assert all(hashlib.sha256(g.groups.encode()).hexdigest() == g.groups_sha256 and g.groups.count(";") + 1 == g.n_groups for g in groups)
    assert token_alignment.align_tokenizers(documents(spark, []), A_PATH, B_PATH).collect() == []


# --- nearest neighbours


def true_nearest(rows, asks, k):
    """For each asking id its k best (score, id) by definition."""
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault(i, set()).add(tuple(v))
    out = {}
    for q in sorted(i for i in good if asks(i)):
        x = min(good[q], key=lambda v: np.array(v, "<f4").tobytes())
        near = sorted((-sum(float(a) * float(b) for a, b in zip(x, v)), i) for i, vs in good.items() for v in vs if i != q and len(v) == len(x))
        out[q] = [(i, -s) for s, i in near[:k]]
    return out


def recall_of(spark, rows, k=20, **bounds):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("vec_id", "embedding", F.lit(1).alias("cell"), F.lit("x").alias("v")).repartition(3)
    got = defaultdict(list)
    for r in nearest.nearest(df, F.col("vec_id") % 20 == 0, k, **bounds).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


@pytest.mark.parametrize("kind", ["sphere", "clusters", "norms"])
def test_nearest_recall(spark, kind):
    r = np.random.default_rng(1)
    x = r.standard_normal((4000, 24))
    if kind == "clusters":
        x = r.standard_normal((30, 24))[r.integers(0, 30, 4000)] + 0.1 * x
    x /= np.linalg.norm(x, axis=1)[:, None]
    if kind == "norms":
        x *= np.exp(r.standard_normal(4000))[:, None]
        x[7] *= 1e6
    x = x.astype(np.float32).astype(float)
    got = recall_of(spark, [(i, v.tolist()) for i, v in enumerate(x)], cell_rows=300, query_rows=40)
    hits = 0
    for q in range(0, 4000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(4000), -s))[:20]
        assert len(got[q]) == 20 and all(abs(s[i] - score) < 1e-9 * max(1, abs(s[i])) for i, score in got[q]) and [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)
        hits += len({i for i, _ in got[q]} & set(want.tolist()))
    assert hits / (200 * 20) >= 0.95


def test_nearest_odd_rows(spark):
    r = random.Random(4)
    near = [[float(r.randint(-2, 2)) for _ in range(4)] for _ in range(30)]
    rows = [(i, near[i % 30]) for i in range(400)]  # copies of 30 vectors: ties everywhere
    rows += [(500, [1.0, 2.0]), (520, [1.0, 1.0]), (521, [0.5, 0.5]), (540, None), (560, []), (580, [0.0] * 4), (600, [float("nan"), 1.0, 1.0, 1.0]), (620, [None, 1.0, 1.0, 1.0]), (640, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4), (660, [7.0, 7.0, 7.0])]
    rows += [rows[5]] * 3 + [(40, near[1]), (41, near[2]), (700, [2.0**-10, 0.0, 0.0, 1e3])]
    want = true_nearest(rows, lambda i: i % 20 == 0, 20)
    got = recall_of(spark, rows, cell_rows=50, query_rows=7)
    assert got == {q: v for q, v in want.items() if v}
    assert [i for i, _ in got[520]] == [500, 521] and 660 not in got and 540 not in got and 580 not in got


def test_nearest_of_one_vector_held_by_a_third(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((900, 8)).astype(np.float32).astype(float).tolist()
    rows = [(i, x[0] if i % 3 else v) for i, v in enumerate(x)]
    want = true_nearest(rows, lambda i: i % 20 == 0, 20)
    got = recall_of(spark, rows, cell_rows=100, query_rows=10)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.95 * 20 * len(want)
    assert all([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in want if q % 3)
    assert nearest.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect() == []


def test_chi_square_bound():
    draws = (np.random.default_rng(1).standard_normal((200_000, 8)) ** 2).sum(1)
    assert abs((draws <= nearest.chi_square_bound(0.97, 8)).mean() - 0.97) < 0.002


# --- blocks apart from partitions


def test_thousands_of_blocks_on_few_partitions(spark, monkeypatch):
    """The quality model, the Jaccard join and substring dedup give equal rows with a few blocks and with thousands of tiny ones on 16 partitions."""
    from lociflow.llm import common, jaccard_join, quality, substring_dedup

    r = random.Random(14)
    syllables = "the re on an er ing ed st nd or ea".split()
    made = ["".join(r.choice(syllables) + " " * (r.random() < 0.4) for _ in range(r.randint(10, 60))) for _ in range(60)]
    made += [f"{t} and more" for t in made[:10]] + made[5:12] + ["", None]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(made)], "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")

    def all_of():
        scored = [(x.doc_id, x.keep, x.perplexity and round(x.perplexity, 4)) for x in quality.classify(docs, labels).select("doc_id", "keep", "perplexity").collect()]
        return sorted(scored), sorted(map(tuple, jaccard_join.near_duplicate_groups(docs, shingle=3).collect())), sorted(map(tuple, substring_dedup.repeated_words(docs).collect()))

    few = all_of()
    monkeypatch.setattr(common, "MOST_PARTITIONS", 16)
    sizes = []
    for module in (quality, jaccard_join):
        monkeypatch.setattr(module, "BLOCK", 2)
        monkeypatch.setattr(module, "blocks_needed", lambda *a, **k: sizes.append(common.blocks_needed(*a, **k)) or sizes[-1])
    monkeypatch.setattr(substring_dedup, "BLOCK", 2)
    assert all_of() == few and min(sizes) > 5000
