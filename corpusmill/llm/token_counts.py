"""Operator 4: token counts by a linear longest-match automaton.

The vocabulary is a trie.  Each node has a failure link and the number of tokens that are popped when the
automaton follows it; both are computed once, so counting the greedy longest-match tokens of a word takes one
step for each byte and never builds a token.  Words are runs of other than the six white-space characters; each
but a text's first is matched together with one space before it.  Words repeat, so each task keeps the counts of
those it has seen (a bounded table).  The automaton is broadcast; its size is that of the vocabulary file.

Defined results: null and empty texts have no words and no tokens; a byte that begins no token makes its word one
unknown token (n_unknown); long texts are counted whole; repeated rows get equal results; an empty table gives
an empty table; other columns are not looked at.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

from .common import pieces, texts_of

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MEMO = 500_000


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Tokens of a ranks file: one base-64 token and its number a line."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class Automaton:
    def __init__(self, vocabulary: Iterable[bytes]):
        self.next: dict[int, int] = {}  # node * 256 + byte -> node
        token, n = [False], 1
        for word in vocabulary:
            at = 0
            for c in word:
                to = self.next.get(at << 8 | c)
                if to is None:
                    to = self.next[at << 8 | c] = n
                    token.append(False)
                    n += 1
                at = to
            token[at] = at > 0
        self.fail, self.pops = [-1] * n, [0] * n
        children: dict[int, list[tuple[int, int]]] = {}
        for key, to in self.next.items():
            children.setdefault(key >> 8, []).append((key & 255, to))
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for c, v in children.get(u, ()):
                if token[v]:  # the whole string is one token: pop it and start again
                    self.fail[v], self.pops[v] = 0, 1
                else:  # pop what the parent pops, until c can follow
                    z, popped = self.fail[u], self.pops[u]
                    while z >= 0 and (z << 8 | c) not in self.next:
                        popped += self.pops[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.pops[v] = self.next[z << 8 | c], popped
                queue.append(v)

    def count(self, word: bytes) -> int:
        """Greedy longest-match tokens of a word; -1 if it can't be matched."""
        step, fail, pops, at, n = self.next.get, self.fail, self.pops, 0, 0
        for c in word:
            while (to := step(at << 8 | c)) is None:
                if fail[at] < 0:
                    return -1
                n += pops[at]
                at = fail[at]
            at = to
        while at:
            if fail[at] < 0:
                return -1
            n += pops[at]
            at = fail[at]
        return n


def count_tokens(df: DataFrame, vocabulary: Iterable[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: id, n_words, n_tokens, n_unknown."""
    shared = df.sparkSession.sparkContext.broadcast(Automaton(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, memo = shared.value.count, {}
        for batch in pieces(batches):
            out = []
            for t in texts_of(batch.column(1)):
                words, n, unknown = t.split(), 0, 0
                for k, w in enumerate(words):
                    w = b" " + w if k else w
                    c = memo.get(w)
                    if c is None:
                        if len(memo) >= MEMO:
                            memo.clear()
                        c = memo[w] = count(w)
                    if c < 0:
                        unknown, c = unknown + 1, 1
                    n += c
                out.append((len(words), n, unknown))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[k] for o in out], pa.int64()) for k in range(3))], [id_col, "n_words", "n_tokens", "n_unknown"])

    narrow = df.select(id_col, text_col)
    return narrow.mapInArrow(run, T.StructType([narrow.schema[0], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_tokens", "n_unknown"))]))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and tokens of every document under the default vocabulary."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), read_vocabulary())


def brute_force(word: bytes, vocabulary: set[bytes]) -> int:
    """Greedy longest match by trying every length; for tests."""
    n, at = 0, 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in vocabulary), 0)
        if not end:
            return -1
        n, at = n + 1, end
    return n
