"""Language identification: family first, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

import re
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociflow.llm.common import modest_batches

#: Families of language codes (fixed values). A code that is not here is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la lmo oc pt ro rm sc",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr tt ug uz",
    "indo-aryan": "bn gu hi mr ne pa sd si ur",
    "iranian": "fa ku ps tg",
    "semitic": "am ar he mt",
    "dravidian": "kn ml ta te",
    "austronesian": "id jv mg ms su tl",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

WIDTH_BITS, ORDERS, CHUNK = 13, 4, 1 << 20
NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Characters that patterns take for word characters but that are no letters (numbers such as "½", "²", "①"), by their categories.
NUMBERS = re.compile(f"[{''.join(c for c in map(chr, range(0x10000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())}]")
_WIDE_NUMBERS = re.compile(f"[{''.join(c for c in map(chr, range(0x10000, 0x20000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())}]")
_WIDE = re.compile("[\U00010000-\U0001ffff]")
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def features(text: str | None) -> np.ndarray | None:
    """Hashed counts of the lower-cased text's letter n-grams (orders 1 to 4), square-rooted, of length 1 plus a bias; None without letters.

    The whole text counts; a long one goes through in pieces that overlap by an n-gram.
    """
    letters = NOT_LETTERS.sub(" ", (text or "").lower())
    if not letters.isascii() and (NUMBERS.search(letters) or _WIDE.search(letters)):
        letters = NOT_LETTERS.sub(" ", _WIDE_NUMBERS.sub(" ", NUMBERS.sub(" ", letters)))
    letters = letters.strip()
    if not letters:
        return None
    codes = np.frombuffer(f" {letters} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.zeros(1 << WIDTH_BITS, np.int64)
    for order in range(1, ORDERS + 1):
        for at in range(0, max(1, len(codes) - order + 1), CHUNK):
            part = codes[at : at + CHUNK + order - 1]
            n = len(part) - order + 1
            if n <= 0:
                continue
            h = np.full(n, order * 0x165667B1 & 0xFFFFFFFF, np.uint32)
            for k in range(order):
                h ^= part[k : k + n] * _MULTIPLIERS[k]
                h *= np.uint32(0x2C1B3C6D)
                h ^= h >> np.uint32(15)
            counts += np.bincount(h >> np.uint32(32 - WIDTH_BITS), minlength=len(counts))
    x = np.sqrt(counts.astype(np.float32))
    return np.append(x / np.linalg.norm(x), np.float32(0.3))


def fit_svm(x: np.ndarray, positive: np.ndarray, penalty: float = 1e-3, steps: int = 120) -> np.ndarray:
    """Weights of a linear support vector machine (squared hinge, classes weighted alike), by accelerated gradient steps."""
    y = np.where(positive, 1.0, -1.0).astype(np.float32)
    share = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum())).astype(np.float32)
    w = last = np.zeros(x.shape[1], np.float32)
    step = 1 / (penalty + 2 * 1.1)
    for t in range(steps):
        ahead = w + (t / (t + 3)) * (w - last)
        slack = np.maximum(0, 1 - y * (x @ ahead))
        last, w = w, ahead - np.float32(step) * (penalty * ahead - 2 * (x.T @ (share * y * slack)))
    return w


def fit(x: np.ndarray, langs: list[str]) -> dict:
    """The hierarchy: machines between families and, for each family, between its languages."""
    known = sorted(set(langs))
    family_of = {code: FAMILY.get(code, f"only {code}") for code in known}
    members = {f: [c for c in known if family_of[c] == f] for f in sorted(set(family_of.values()))}
    lang, family = np.array(langs), np.array([family_of[c] for c in langs])

    def machines(labels, names):
        pairs = list(combinations(names, 2))
        return pairs, np.array([fit_svm(x[(m := np.isin(labels, p))], labels[m] == p[0]) for p in pairs], np.float32).reshape(len(pairs), x.shape[1])

    return {"families": list(members), "members": members, "between": machines(family, list(members)), "within": {f: machines(lang, names) for f, names in members.items()}}


def _vote(x: np.ndarray, names: list[str], pairs: list[tuple[str, str]], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row: which name wins its pairs with most confidence, and that confidence (0 to 1)."""
    if len(names) < 2:
        return np.zeros(len(x), int), np.ones(len(x))
    belief = 1 / (1 + np.exp(-4 * np.clip(x @ weights.T, -8, 8)))
    total = np.zeros((len(x), len(names)))
    for k, (a, b) in enumerate(pairs):
        total[:, names.index(a)] += belief[:, k]
        total[:, names.index(b)] += 1 - belief[:, k]
    return total.argmax(1), total.max(1) / (len(names) - 1)


def predict(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    best, sure = _vote(x, model["families"], *model["between"])
    langs = np.empty(len(x), object)
    for k, family in enumerate(model["families"]):
        if len(rows := np.flatnonzero(best == k)):
            won, belief = _vote(x[rows], model["members"][family], *model["within"][family])
            langs[rows] = np.array(model["members"][family], object)[won]
            sure[rows] *= belief
    return langs, sure


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", per_lang: int = 400, most_langs: int = 200) -> dict | None:
    """The hierarchy fitted on at most `per_lang` texts for each of the `most_langs` most frequent languages (the first in order on ties); rarer ones are never predicted.

    The texts with the lowest hash of key and text are taken, so the sample doesn't follow the input's order; each gives its whole text and
    a short middle part. Features are made on the executors; the driver gets
    per_lang * most_langs * 2 rows at most. None without labelled text.
    """
    labelled = modest_batches(docs).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = labelled.groupBy(lang_col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), lang_col).limit(most_langs).collect()
    if not counts:
        return None
    share = F.broadcast(docs.sparkSession.createDataFrame([(r[0], 2.5 * per_lang / r["n"] + 1e-9) for r in counts], "_lang string, _share double"))
    drawn = F.xxhash64(F.col(key_col), F.col(text_col))
    near = labelled.select(F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"), drawn.alias("_drawn")).join(share, "_lang").where(F.pmod("_drawn", F.lit(1 << 30)) < F.col("_share") * (1 << 30))
    order = Window.partitionBy("_lang").orderBy(F.pmod("_drawn", F.lit(1 << 30)), "_drawn", "_text")
    sample = near.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= per_lang)

    def make(batches):
        for batch in batches:
            langs, packed = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for part in (text, text[len(text) // 2 :][:80]):
                    if (x := features(part)) is not None:
                        langs.append(lang)
                        packed.append(zlib.compress(x.astype(np.float16).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(packed, pa.binary())], ["lang", "x"])

    rows = sample.select("_lang", "_text").mapInArrow(make, "lang string, x binary").collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    if not rows:
        return None
    return fit(np.stack([np.frombuffer(zlib.decompress(r["x"]), np.float16).astype(np.float32) for r in rows]), [r["lang"] for r in rows])


def identify(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score for each row, from its whole text alone.

    Defined cases: `und` with score 0 where the text is null or has no letter, or nothing was learned; repeated rows and
    ties give equal results (the first code in order wins); other columns are left out; an empty table gives no rows.
    """

    def apply(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [features(t) if model else None for t in part.column(1).to_pylist()]
                langs, score = np.full(len(made), "und", object), np.zeros(len(made))
                if rows := [i for i, x in enumerate(made) if x is not None]:
                    langs[rows], score[rows] = predict(model, np.stack([made[i] for i in rows]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(np.clip(score, 0, 1), pa.float64())], [id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(apply, f"`{id_col}` {kind}, lang_pred string, score double")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the folds that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = train(docs.where(fold != 1))
    found = identify(docs, model)
    return found.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
