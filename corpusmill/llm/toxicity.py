"""Operator 10: toxicity by a counterfactual-regularised linear classifier.

Features are hashed: each distinct word of a text (letters, A-Z lower-cased) and its beginnings of 4 and 5
characters, so inflected forms share evidence.  Labelled texts are also written with their identity terms swapped
for others of the same group; training minimises the logistic loss, an L1 penalty, and the squared change of the
score under those swaps, so that neutral mentions of a group don't move the score.

The classifier is fitted on a bounded sample of labelled rows (SAMPLE_ROWS, taken by a hash of the id); every
text is scored, whole.  Features that stand in fewer than LEAST_TEXTS or more than a third of the sample's different
texts get no weight; copies of a text count as one there, so a group of copies, however large, keeps its terms.  Labels of rows whose crc32(id as text) mod 3 is 1 are never read by the fit.

Defined results: null and empty texts score the model's intercept; null labels are not used; a label for a missing
document is not used; repeated label rows count as often as they occur; with no labels the score is 0.5; an empty
table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import pieces, texts_of

BITS = 20
SAMPLE_ROWS = 12_000
#: Features in fewer different texts, or in more than a third of them, get no weight.
LEAST_TEXTS = 3
L1 = 0.022  # divided by the root of the number of rows
SWAP_WEIGHT = 4.0
ROUNDS = 100
THRESHOLD = 0.7

#: Groups of identity terms; a term is swapped for the next of its group.
IDENTITY_GROUPS = (
    "woman man", "women men", "girl boy", "girls boys", "she he", "her his", "female male", "mother father",
    "muslim christian jewish hindu buddhist atheist", "muslims christians jews hindus buddhists atheists",
    "black white asian hispanic", "african european american", "gay lesbian straight bisexual transgender",
    "immigrant native", "immigrants natives", "old young", "elderly youthful", "deaf blind disabled", "mexican canadian", "chinese indian",
)


def swaps_of(groups: Iterable[str]) -> dict[bytes, bytes]:
    """Term to term: each is swapped for the next of its group."""
    return {a.encode(): b.encode() for g in groups for a, b in zip(g.split(), (*g.split()[1:], g.split()[0]), strict=True)}


_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> set[bytes]:
    return set(text.translate(_TABLE).split())


def features_of_word(word: bytes) -> list[int]:
    out, mask = [zlib.crc32(word) & ((1 << BITS) - 1)], (1 << BITS) - 1
    if len(word) >= 4:
        chars = word.decode(errors="ignore")
        out += [zlib.crc32(b"<%d>" % k + chars[:k].encode()) & mask for k in (4, 5) if len(chars) >= k]
    return out


def features(words: set[bytes]) -> list[int]:
    return sorted({f for w in words for f in features_of_word(w)})


class Rows:
    """Sparse rows of 1 (or -1) with the two products that the fit needs."""

    def __init__(self, parts: list[np.ndarray], minus: list[np.ndarray] | None = None):
        both = parts if minus is None else [np.append(a, b) for a, b in zip(parts, minus, strict=True)]
        self.n = len(both)
        self.at = np.repeat(np.arange(self.n), [len(x) for x in both])
        self.f = np.concatenate(both) if both else np.zeros(0, np.int64)
        signs = [np.append(np.ones(len(a)), -np.ones(len(b))) for a, b in zip(parts, minus or [], strict=False)]
        self.v = np.concatenate(signs) if signs else 1.0

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, self.v * w[self.f], self.n) if self.n else np.zeros(0)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.f, self.v * g[self.at], size) if self.n else np.zeros(size)


def fit(rows: list[tuple[int, bytes, bytes, bytes]]) -> tuple[np.ndarray, float]:
    """Weights and intercept from (label, features, features lost by the swap, features gained by it)."""
    weights = np.zeros(1 << BITS)
    if not rows:
        return weights, 0.0
    rows = sorted(rows)  # the result doesn't depend on the order in which rows came
    read = lambda k: [np.frombuffer(r[k], np.uint32).astype(np.int64) for r in rows]
    has, lost, gained, n = read(1), read(2), read(3), len(rows)
    texts = sorted({r[1] for r in rows})  # a group of copies counts as one text, so its terms aren't taken for common ones
    df = np.bincount(np.concatenate([np.frombuffer(t, np.uint32) for t in texts]), minlength=1 << BITS)
    used = np.flatnonzero((df >= max(LEAST_TEXTS, len(texts) // 2500)) & (df <= max(len(texts) // 3, LEAST_TEXTS)))
    df = np.bincount(np.concatenate(has), minlength=1 << BITS)
    slot = np.full(1 << BITS, -1)
    slot[used] = np.arange(len(used))
    pick = lambda parts: [(s := slot[p])[s >= 0] for p in parts]
    x, y = Rows(pick(has)), np.array([float(r[0]) for r in rows])
    swapped = [k for k in range(n) if len(lost[k]) or len(gained[k])]
    d = Rows(pick([lost[k] for k in swapped]), pick([gained[k] for k in swapped]))
    m = max(1, d.n)
    w, b = np.zeros(len(used)), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    # coordinate-scaled proximal gradient with momentum: common features take smaller steps
    scale = 1 / (2 * df[used] / n + 8 * SWAP_WEIGHT * np.bincount(d.f, minlength=len(used)) / m + 1e-3)
    z, zb, t = w.copy(), b, 1.0
    for _ in range(ROUNDS):
        g = 1 / (1 + np.exp(-np.clip(x.times(z) + zb, -30, 30))) - y
        grad = x.back(g, len(used)) / n + SWAP_WEIGHT * 2 / m * d.back(d.times(z), len(used))
        new = z - scale * grad
        new = np.sign(new) * np.maximum(0, np.abs(new) - scale * L1 / np.sqrt(n))
        nb, nt = zb - g.mean(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        if ((z - new) * (new - w)).sum() > 0:
            nt = 1.0  # restart the momentum when it points uphill
        z, zb = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    weights[used] = w
    return weights, float(b)


def training_rows(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int, groups: Iterable[str] = IDENTITY_GROUPS) -> list:
    """At most about sample_rows labelled rows, as features."""
    swaps = swaps_of(groups)
    usable = labels.filter((F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1) & F.col(label_col).isNotNull())
    order = F.pmod(F.xxhash64(F.col(id_col), F.lit(10)), F.lit(1 << 30))
    total = usable.count()
    if total > sample_rows:
        usable = usable.filter(order < int((1 << 30) * sample_rows / total))
    usable = usable.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"))
    texts = documents.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    joined = texts.join(F.broadcast(usable), "i").select("y", "t")  # bounded: two numbers for each sampled row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out: tuple[list, list, list] = ([], [], [])
            for t in texts_of(batch.column(1)):
                w = words_of(t)
                plain = set(features(w))
                other = set(features({swaps.get(x, x) for x in w})) if w & swaps.keys() else plain
                for o, fs in zip(out, (plain, plain - other, other - plain), strict=True):
                    o.append(np.array(sorted(fs), np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(o, pa.binary()) for o in out)], ["y", "a", "b", "c"])

    return [(r.y, bytes(r.a), bytes(r.b), bytes(r.c)) for r in joined.mapInArrow(run, "y int, a binary, b binary, c binary").toLocalIterator()]


def score_toxicity(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS,
    identity_groups: Iterable[str] = IDENTITY_GROUPS,
) -> DataFrame:
    """One row for each document: id, held_out, score."""
    weights, intercept = fit(training_rows(documents, labels, id_col, text_col, label_col, sample_rows, identity_groups))
    kept = np.flatnonzero(weights)
    shared = documents.sparkSession.sparkContext.broadcast((kept.astype(np.int32), weights[kept], intercept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values, start = shared.value
        model = dict(zip(at.tolist(), values.tolist(), strict=True))
        memo: dict[bytes, list[int]] = {}
        for batch in pieces(batches):
            scores = []
            for t in texts_of(batch.column(1)):
                found: set[int] = set()
                for w in words_of(t):
                    fs = memo.get(w)
                    if fs is None:
                        if len(memo) > 1_000_000:
                            memo.clear()
                        fs = memo[w] = [f for f in features_of_word(w) if f in model]
                    if fs:
                        found.update(fs)
                total = start + sum(model[f] for f in sorted(found))
                scores.append(1 / (1 + np.exp(-max(-30.0, min(30.0, total)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], [id_col, "score"])

    narrow = documents.select(id_col, text_col)
    scored = narrow.mapInArrow(run, T.StructType([narrow.schema[0], T.StructField("score", T.DoubleType())]))
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored.select(id_col, held.alias("held_out"), "score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: score and verdict of every document."""
    scored = score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
