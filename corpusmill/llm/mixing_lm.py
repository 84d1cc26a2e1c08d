"""Operator 1: language-model scoring by online logistic mixing of hashed-context bit predictors.

A token (a word, A-Z lower-cased, or the end of its text) is coded by up to two binary decisions and what they leave
open: does it follow the two words before it anywhere in the training texts (asked where those were seen RARE times at
most)?  if not, is it known at all?  After a first yes comes the token's share among all that follow that context; after a
second its shares after two words, after one and overall, weighed together; a word that is new is spelled byte by
byte.  This is a proper code: all possible next tokens share at most probability one.

Each decision is a bit.  Four predictors estimate it from counts under hashed contexts: how often the context was seen
and how far the tokens before were known, the word before, the two words before, and a longer history with the context's
frequency.  Their logits are added with weights that a gate picks by kind of decision and the token before; an adaptive
probability map refines the sum.  Counts, weights, map and shares are learned online: a block of documents is read in a
fixed order, every batch of tokens is predicted before it is learned from, and texts held out are never learned from.

What the model knows of the corpus are the exact counts of all words and the counts of all pairs and triples of words
of the training texts, added up by hash range and answered to the block that asks.  No task holds a range of more than
about RANGE_ITEMS different items of its own, whatever the words are, and nothing of it passes the driver.  A training
text is scored without one occurrence of each of its own tokens.

Blocks follow the bytes of the corpus and the hashes of the rows alone, so scores don't depend on partitions or files.
Words count as equal if their 64-bit hashes are; pairs and triples if some 16 bits more than their number takes are.

Defined results: null and empty texts are the end token alone; long texts are taken whole; a null id counts as held
in; repeated rows are scored and learned as often as they occur; without training rows every word is spelled and the
base score is 0; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import WordHashes, flat_words, mix64, pack, pieces, texts_of, unpack, write_table

BLOCK_BYTES = 8 << 20
RANGE_ITEMS = 1 << 20
SPARE = 16
BATCH = 8192
#: Contexts of two words are asked after up to so many occurrences; what follows frequent ones is weighed with the rest.
RARE = 16
#: Kinds of items: words, pairs, triples; and the bytes of spelled words.
WORD, PAIR, TRIPLE, BYTES = 1, 2, 3, 0
#: Hashes of the end of a text and of what stands before its first word; odd bases of pairs and triples.
END, BEGIN = np.uint64(0x8D2C7A5B1F3E6D49), np.uint64(0x1B873593CC9E2D51)
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Contexts of the bytes of a spelled word: two bytes hashed to so many rows, then one byte.
PAIRS, SINGLES, CHUNK_ROWS = 4096, 257, 64
SLOTS = 1 << 16
#: Gates of the shares: how often the word before was seen, and if the two words before are frequent, and known together.
SHARES = 32 * 4
INPUTS, GATES, MAP_CELLS = 5, 8, 33
DELTA, RATE = 0.4, 0.02
START = (0.3, 0.2, 0.2, 0.3, 0.0)
PARTS = "kind int, range long, block long, cells binary, counts binary"
ANSWERS = "kind int, range long, block long, totals binary, tokens long, types long"

_MEMO = WordHashes()


def squeeze(a: np.ndarray) -> bytes:
    """Integers, compressed byte by byte."""
    return zlib.compress(np.ascontiguousarray(a.astype(np.uint32)).view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def widen(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(b), np.uint8).reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -15, 15)))


class Layout:
    """How items of each kind become cells and ranges, from the bytes of the corpus alone."""

    def __init__(self, total_bytes: int):
        n = max(2.0, total_bytes / 6)
        self.range_bits = max(2, int(np.ceil(np.log2(n / RANGE_ITEMS)))) if n > RANGE_ITEMS else 2
        self.bits = min(60, int(np.ceil(np.log2(n))) + SPARE)

    def width(self, kind: int) -> int:
        """Bits of a cell inside its range; words keep all 64 bits of their hash."""
        return (64 if kind == WORD else self.bits) - self.range_bits

    def cells(self, kind: int, hashes: np.ndarray) -> np.ndarray:
        return hashes if kind == WORD else hashes >> np.uint64(64 - self.bits)


class Tokens:
    """The tokens of a block's texts end to end, in an order of the texts' own: hashes of words, pairs and triples."""

    def __init__(self, table: pa.Table):
        texts = [t.lower() for b in pieces(iter(table.select(["text"]).to_batches())) for t in texts_of(b.column(0))]  # bytes.lower() changes A-Z only
        held = table["held_out"].to_pylist()
        ids = list(map(str, table["id"].to_pylist()))
        self.order = sorted(range(len(texts)), key=lambda k: (texts[k], held[k], ids[k]))
        flat, counts, self.words = flat_words(_MEMO, [texts[k] for k in self.order])
        self.size = counts + 1
        self.ends = np.cumsum(self.size)
        n = int(self.ends[-1])
        self.first = np.zeros(n, bool)
        self.first[self.ends - self.size] = True
        self.is_word = np.ones(n, bool)
        self.is_word[self.ends - 1] = False
        self.held = np.repeat(np.array([held[k] for k in self.order], bool), self.size)
        self.h = np.full(n, END, np.uint64)
        self.h[self.is_word] = flat
        before = np.append(BEGIN, self.h[:-1])
        before[self.first] = BEGIN
        self.before = before
        self.pair = mix64(before * BASES[0] + self.h)
        earlier = np.append(BEGIN, self.pair[:-1])
        earlier[self.first] = BEGIN
        self.context = earlier  # the two words before, as the pair they are
        self.triple = mix64(earlier * BASES[1] + self.h)

    def items(self, kind: int) -> np.ndarray:
        return {WORD: self.h, PAIR: self.pair, TRIPLE: self.triple}[kind]


def spelled_rows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every byte of some words, the space behind each included: rows of its two contexts, the byte, and its word."""
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8).astype(np.int64) if words else np.zeros(0, np.int64)
    size = np.array([len(w) + 1 for w in words], np.int64)
    begin = np.zeros(len(data), bool)
    begin[np.cumsum(size) - size] = True
    one = np.append(256, data[:-1])[: len(data)]
    one[begin] = 256
    two = np.append(256, one[:-1])[: len(data)]
    two[begin] = 256
    return (two * 257 + one) * 2_654_435_761 % (1 << 32) * PAIRS >> 32, PAIRS + one, data, np.repeat(np.arange(len(words)), size)


def spelled(words: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Log10 probability of each word's bytes, from counts of (context row, byte)."""
    far, near, byte, word = spelled_rows(words)
    sums = counts.sum(1)
    close = (counts[near, byte] + 1 / 64) / (sums[near] + 4)
    return np.bincount(word, np.log10((counts[far, byte] + 2 * close) / (sums[far] + 2)), len(words))


class Mixer:
    """Predictors, gated weights and probability map of the decisions, learned as they come."""

    def __init__(self) -> None:
        self.n = np.zeros((2, INPUTS - 1, 2, SLOTS), np.float32)
        self.w = np.tile(np.array(START), (GATES, 1))
        self.seen = np.full((GATES, INPUTS), 1e-3)
        self.map = np.zeros((2, 2, MAP_CELLS))
        self.share = np.ones((SHARES, 3)) * (2, 2, 6)
        self.centre = squash((np.arange(MAP_CELLS) - MAP_CELLS // 2) / 2)

    def step(self, kind: int, slots: np.ndarray, gate: np.ndarray, bit: np.ndarray, learn: np.ndarray) -> np.ndarray:
        """Probabilities of a batch of decisions being yes; then learns from those that it may learn from."""
        n, x = self.n[kind], np.empty((INPUTS, len(bit)))
        for c in range(INPUTS - 1):
            x[c] = np.log((n[c, 1][slots[c]] + DELTA) / (n[c, 0][slots[c]] + DELTA))
        x[-1] = 0.3
        mixed = (self.w[gate].T * x).sum(0)
        p = squash(mixed)
        cell = np.clip(np.rint(mixed * 2).astype(np.int64) + MAP_CELLS // 2, 0, MAP_CELLS - 1)
        yes, every = self.map[1, kind], self.map[0, kind] + self.map[1, kind]
        refined = (yes + 20 * self.centre) / (every + 20)
        out = np.clip((p + refined[cell]) / 2, 1e-6, 1 - 1e-6)
        use = np.flatnonzero(learn)
        if len(use):
            y, g = bit[use], gate[use]
            slope = np.stack([np.bincount(g, (y - p[use]) * x[c][use], GATES) for c in range(INPUTS)], 1)
            self.seen += slope**2
            self.w += RATE * 5 * slope / np.sqrt(self.seen)
            for c in range(INPUTS - 1):
                for v in (0, 1):
                    n[c, v] += np.bincount(slots[c][use][y == v], minlength=SLOTS)
            for v in (0, 1):
                self.map[v, kind] += np.bincount(cell[use][y == v], minlength=MAP_CELLS)
        return out


    def weigh(self, gate: np.ndarray, each: np.ndarray, learn: np.ndarray) -> np.ndarray:
        """The shares of each way to say a token, weighed together; then learns how often each way was right."""
        parts = self.share[gate] / self.share[gate].sum(1, keepdims=True) * each
        out = parts.sum(1)
        right = parts[learn] / out[learn, None]
        for k in range(3):
            self.share[:, k] += np.bincount(gate[learn], right[:, k], SHARES)
        return out


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(48)).astype(np.int64)


def decisions(t: Tokens, counts: dict[int, np.ndarray], n_train: int, n_texts: int, bytes_of: np.ndarray) -> np.ndarray:
    """Log10 probability of every token of a block, from the training counts of its word, pair and triple."""
    own = (~t.held).astype(np.int64)
    after = lambda c, start: np.where(t.first, start, np.append(0, c[:-1]))  # noqa: E731  the count of what stands before a token
    word, pair, triple = (np.maximum(0, counts[k] - own) for k in (WORD, PAIR, TRIPLE))
    two, one = (np.maximum(0, c - own) for c in (after(counts[PAIR], n_texts), after(counts[WORD], n_texts)))
    level = np.where(triple > 0, 3, np.where(pair > 0, 2, np.where(word > 0, 1, 0)))
    last = np.append(0, level[:-1])
    last[t.first] = 0
    past = last.copy()
    for k in (1, 2, 3):
        past = past * 4 + np.append(np.zeros(k, np.int64), last[:-k])[: len(last)]
    log = lambda c: np.minimum(31, (2 * np.log2(np.maximum(c, 1))).astype(np.int64))
    often = (log(two), log(one))
    rare = (two > 0) & (two <= RARE)
    share = often[1] * 4 + np.where(two > RARE, 1 + (last >= 2) + (last == 3), 0)
    each = np.stack([np.where(two > RARE, triple / np.maximum(two, 1), 0), pair / np.maximum(one, 1), word / max(1, n_train - 1)], 1)
    each = np.minimum(1.0, each)
    out = np.zeros(len(own))
    mixer = Mixer()
    for at in range(0, len(own), BATCH):
        batch = np.arange(at, min(at + BATCH, len(own)))
        for kind, yes in enumerate((triple > 0, word > 0)):
            ask = batch[rare[batch]] if kind == 0 else batch
            if not len(ask) or not n_train:
                continue
            bit = yes[ask].astype(np.int64)
            slots = [often[kind][ask] * 16 + past[ask] // 16, _slot(t.before[ask]), _slot(t.context[ask]), past[ask] * 32 + often[0][ask]]
            p = mixer.step(kind, slots, kind * 4 + last[ask], bit, ~t.held[ask])
            out[ask] += np.log10(np.where(bit == 1, p, 1 - p))
            if kind == 0:
                hit = ask[bit == 1]
                out[hit] += np.log10(np.minimum(1.0, triple[hit] / two[hit]))
                batch = np.setdiff1d(batch, hit, assume_unique=True)
            else:
                hit = ask[bit == 1]
                out[hit] += np.log10(mixer.weigh(share[hit], each[hit], ~t.held[hit]))
    new = np.flatnonzero((level == 0) & t.is_word)
    if len(new):
        place = np.cumsum(t.is_word) - 1
        words = [w for ws in t.words for w in ws]
        out[new] += spelled([words[k] for k in place[new].tolist()], bytes_of)
    return out


def score_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte."""
    spark = df.sparkSession
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), held.alias("held_out"))
    total, n_texts = docs.agg(F.sum(F.octet_length("text")), F.count_if(~F.col("held_out"))).head()
    total = total or 0
    layout, blocks = Layout(total), total // BLOCK_BYTES + 1
    docs = docs.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))
    by_block = docs.repartition(blocks, "block").groupBy("block")

    def ask(table: pa.Table) -> pa.Table:
        """Every different item of a block with its count in training texts, by kind and range; and bytes of words."""
        t, rows = Tokens(table), []
        train = ~t.held
        for kind in (WORD, PAIR, TRIPLE):
            items, which = np.unique(layout.cells(kind, t.items(kind)), return_inverse=True)
            n = np.bincount(which, train, len(items))
            width = np.uint64(layout.width(kind))
            home = (items >> width).astype(np.int64)
            low = items & np.uint64((1 << int(width)) - 1)
            cut = np.flatnonzero(np.diff(home, prepend=-1)).tolist()
            rows += [(kind, int(home[a]), pack(low[a:b]), squeeze(n[a:b])) for a, b in zip(cut, [*cut[1:], len(items)], strict=True)]
        texts = np.append(0, t.ends)
        seen = {w for k, ws in enumerate(t.words) if train[texts[k]] for w in ws}
        far, near, byte, _ = spelled_rows(sorted(seen))
        cells, n = np.unique(np.append(far, near) * 256 + np.append(byte, byte), return_counts=True)
        home = cells // (256 * CHUNK_ROWS)
        cut = np.flatnonzero(np.diff(home, prepend=-1)).tolist()
        rows += [(BYTES, int(home[a]), pack(cells[a:b].astype(np.uint64)), squeeze(n[a:b])) for a, b in zip(cut, [*cut[1:], len(cells)], strict=True)]
        block = table["block"][0].as_py()
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        columns = [pa.array([r[k] for r in rows], kinds[k]) for k in range(4)]
        return pa.table([columns[0], columns[1], pa.array([block] * len(rows), pa.int64()), columns[2], columns[3]], names=["kind", "range", "block", "cells", "counts"])

    def meet(table: pa.Table) -> pa.Table:
        """The sums of a range: for each block those of its items, and in a row of its own how many tokens and types."""
        asked = [unpack(b, np.uint64) for b in table["cells"].to_pylist()]
        items, which = np.unique(np.concatenate(asked), return_inverse=True)
        sums = np.bincount(which, np.concatenate([widen(b) for b in table["counts"].to_pylist()]), len(items)).astype(np.int64)
        kind = table["kind"][0].as_py()
        if kind == BYTES:  # the whole range in one row
            answers, block = [pack(items) + squeeze(sums)], [len(pack(items))]
        else:
            answers, block = [squeeze(sums[w]) for w in np.split(which, np.cumsum([len(a) for a in asked])[:-1])], table["block"].to_pylist()
        own = (int(sums.sum()), int((sums > 0).sum()))
        n = len(answers)
        return pa.table({
            "kind": pa.array([kind] * (n + 1), pa.int32()), "range": pa.array([table["range"][0].as_py()] * (n + 1), pa.int64()), "block": pa.array([*block, None], pa.int64()),
            "totals": pa.array([*answers, None], pa.binary()), "tokens": pa.array([0] * n + [own[0]], pa.int64()), "types": pa.array([0] * n + [own[1]], pa.int64()),
        })

    answers, _ = write_table(by_block.applyInArrow(ask, PARTS).groupBy("kind", "range").applyInArrow(meet, ANSWERS), "lm-counts")
    whole = answers.filter(F.col("block").isNull() & (F.col("kind") == WORD)).agg(F.sum("tokens"), F.sum("types")).head()
    n_train, n_types = whole[0] or 0, whole[1] or 0
    bytes_of = np.zeros(((PAIRS + SINGLES) * 256,), np.float64)
    for r in answers.filter((F.col("kind") == BYTES) & F.col("block").isNotNull()).toLocalIterator():  # bounded by PAIRS
        bytes_of[unpack(bytes(r.totals[: r.block]), np.uint64).astype(np.int64)] = widen(bytes(r.totals[r.block :]))
    shared = spark.sparkContext.broadcast(bytes_of.reshape(-1, 256).astype(np.float32))
    result = T.StructType([
        docs.schema["id"], T.StructField("held_out", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")),
        T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("n_bytes", T.LongType()), T.StructField("bits_per_byte", T.DoubleType()),
    ])

    def score(table: pa.Table, told: pa.Table) -> pa.Table:
        ids = table["id"]
        if not table.num_rows:
            kinds = [ids.type, pa.bool_(), *[pa.int64()] * 3, pa.float64(), pa.float64(), pa.int64(), pa.float64()]
            return pa.table([pa.array([], k) for k in kinds], names=result.names)
        t, counts = Tokens(table), {}
        by: dict[int, list[tuple[int, bytes]]] = {k: [] for k in (WORD, PAIR, TRIPLE)}
        for kind, home, totals in zip(*(told[c].to_pylist() for c in ("kind", "range", "totals")), strict=True):
            by[kind].append((home, totals))
        for kind, parts in by.items():
            _, which = np.unique(layout.cells(kind, t.items(kind)), return_inverse=True)
            counts[kind] = np.concatenate([widen(b) for _, b in sorted(parts)])[which]
        begins = t.ends - t.size
        total_of = lambda x: np.add.reduceat(x, begins)
        known = counts[WORD]
        base = total_of(np.log10(known + 1.0)) - t.size * np.log10(n_train + n_types + 1)
        logs = total_of(decisions(t, counts, n_train, n_texts, shared.value))
        n_bytes = np.array([sum(map(len, ws)) + len(ws) + 1 for ws in t.words], np.int64)
        order = pa.array(t.order)
        return pa.table([
            ids.take(order), table["held_out"].take(order), pa.array(t.size), pa.array(total_of((known > 0).astype(np.int64))), pa.array(np.full(len(begins), n_train)),
            pa.array(base), pa.array(logs), pa.array(n_bytes), pa.array(-logs / np.log10(2) / n_bytes),
        ], names=result.names)

    told = answers.filter(F.col("block").isNotNull() & (F.col("kind") != BYTES)).select("kind", "range", "block", "totals")
    out = by_block.cogroup(told.groupBy("block")).applyInArrow(score, result)
    return out.withColumnRenamed("id", id_col)


def op1_mixing_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: base and model scores of every document."""
    return score_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"))
