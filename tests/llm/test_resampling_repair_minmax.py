"""Operators 11 to 13 on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations
from math import floor, log

import numpy as np
import pytest

from corpusmill.llm import conversations, minmax, resampling
from tests.llm.test_operators import ASCII, DOCS, corpus, words


def near_group(seed: int, members: int, size: int, changed: int) -> list[str]:
    """Near copies of one text, each with some words of its own."""
    r = random.Random(seed)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(size)]
    out = []
    for m in range(members):
        t = list(base)
        for at in r.sample(range(size), changed):
            t[at] = f"own{seed}x{m}x{at}"
        out.append(" ".join(t))
    return out


def shingles(text, k):
    w = words((text or "").translate(ASCII))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k, percent):
    """Least id of each row's component (nulls last), by comparing all pairs."""
    sets, parent = [shingles(r[1], k) for r in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        key = (r[0] is None, r[0])
        least[root(i)] = min(least.get(root(i), key), key)
    return [(r[0], len(sets[i]), least[root(i)][1] if sets[i] else r[0]) for i, r in enumerate(rows)]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.fixture(scope="module")
def near_rows():
    rows = corpus(5, 70)
    texts = near_group(1, 40, 150, 2) + near_group(2, 25, 90, 2) + near_group(3, 12, 60, 1) + near_group(4, 20, 40, 5)
    more = [(1000 + k, t, "xx", "s", 1, 0.5, 2, "c", 3, "q") for k, t in enumerate(texts)]
    return rows + more + more[:3]


@pytest.mark.parametrize("block", [500, 4])
def test_op11_components(spark, near_rows, monkeypatch, block):
    monkeypatch.setattr(minmax, "BLOCK_CLASSES", block)
    got = minmax.near_components(spark.createDataFrame(near_rows, DOCS).repartition(3)).collect()
    want = brute_components(near_rows, 3, 85)
    assert order((r.doc_id, r.n_shingles, r.component_id) for r in got) == order(want)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert len({c for _, n, c in want if n}) < len({r[1] for r in near_rows}) - 40


def test_op11_residual_groups_are_compared_in_blocks(spark, monkeypatch):
    """Groups whose members mostly aren't linked with the pivot: what the pivot misses is found by products."""
    monkeypatch.setattr(minmax, "BLOCK_CLASSES", 6)
    r = random.Random(7)
    base = [f"b{k}" for k in range(80)]
    rows = []
    for m in range(60):  # each text has its own part of the changed words, so that links are with few neighbours
        t = list(base)
        for k in range(7):
            t[(m + k * 11) % 80] = f"c{(m + k) // 3}"
        rows.append((m, " ".join(t), "xx", "s", 1, 0.5, 2, "c", 3, "q"))
    r.shuffle(rows)
    got = minmax.near_components(spark.createDataFrame(rows, DOCS)).collect()
    assert order((x.doc_id, x.n_shingles, x.component_id) for x in got) == order(brute_components(rows, 3, 85))


def test_op11_signatures_estimate_similarity():
    """Both values of a permutation agree with the similarity as probability; bands of them hash to equal keys."""
    r = np.random.default_rng(1)
    a = np.unique(r.integers(0, 1 << 63, 1000).astype(np.uint64))
    b = np.concatenate([a[:850], np.unique(r.integers(0, 1 << 63, 150).astype(np.uint64))])
    a.sort(), b.sort()
    similarity = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    one, two = minmax.band_keys([a, b], bands=4000, pairs=1)
    assert abs((one == two).mean() - similarity**2) < 0.04
    assert (minmax.band_keys([a, a]) == minmax.band_keys([a])).all()


def test_op11_empty_and_lonely(spark):
    assert minmax.near_components(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(k, t, "x", "s", 1, 0.5, 2, "c", 3, "q") for k, t in [(1, None), (1, None), (2, ""), (None, "a"), (None, "a"), (3, "a b"), (4, "A  B")]]
    got = minmax.near_components(spark.createDataFrame(rows, DOCS)).collect()
    assert order((r.doc_id, r.component_id, r.n_shingles) for r in got) == order([(1, 1, 0), (1, 1, 0), (2, 2, 0), (None, None, 1), (None, None, 1), (3, 3, 1), (4, 3, 1)])


TALK = "conv_id long, turn long, role string, text string, name string, part long, seq long, audit string"


def talk(seed=3):
    r = random.Random(seed)
    rows, said = [], ["Hello there.", "What?", "cut off", "Yes!", "", " \n", "no. \t", "a.b", "same again."]
    for c in [*range(60), None]:
        n, role = r.choice([1, 2, 3, 5, 8, 13]), r.choice(["system", "user", "assistant"])
        for t in range(n):
            turn = None if r.random() < 0.05 else t + r.choice([0, 0, 0, 1])
            text = None if r.random() < 0.04 else r.choice(said) if r.random() < 0.5 else f"text {r.random()}."
            rows.append((c, turn, r.choice([role, "user", "assistant", "assistant", "tool", None, ""]), text))
            role = "user" if role != "user" else "assistant"
    for c, n in ((900, 700), (901, 90)):  # two long conversations, with rows repeated far apart
        rows += [(c, t, ("user", "assistant")[t % 2] if r.random() < 0.9 else "system", r.choice([f"line {t // 7 % 40}.", f"row {t}.", f"row {t}"])) for t in range(n)]
    rows += rows[5:9] + [(77, 3, "user", "only once")] * 4
    return [(*x, "n", 1, 2, "z") for x in rows]


def brute_repair(rows):
    """Damage, faults and dynamic programming over whole audits, one conversation at a time."""
    by = {}
    for c, t, role, text, *_ in rows:
        mine = by.setdefault(c, [])
        sp = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{sp(c)}:{sp(t)}".encode()) % 20
        role, text = sp(role), sp(text)
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            mine += [(t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for c, mine in by.items():
        mine.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, faults = set(), []
        for _, role, text in mine:
            rest = text.strip(" \t\n\v\f\r")
            faults.append("blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else "")
            seen.add((role, text))
        best = {"": (0, "", [])}  # by the last initial put out, and whether anything was
        put = lambda d, k, w: d.__setitem__(k, min(d.get(k, w), w))
        step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
        free = {"": "u", "s": "u", "u": "a", "a": "u"}
        full = {"u": "user", "a": "assistant"}

        def insert(b):
            b = dict(b)
            for _ in range(3):
                for s, (cost, audit, lines) in list(b.items()):
                    put(b, free[s], (cost + 3, audit + "I", [*lines, full[free[s]] + ":"]))
            return b

        for (_, role, text), fault in zip(mine, faults, strict=True):
            after = {}
            for s, (cost, audit, lines) in insert(best).items():
                put(after, s, (cost + 4, audit + "D", lines))
                if fault not in ("blank", "duplicate"):
                    more = 3 * (fault == "truncated")
                    if (s, role[:1]) in step:
                        put(after, step[s, role[:1]], (cost + more, audit + "K", [*lines, f"{role}:{text}"]))
                    put(after, free[s], (cost + 3 + more, audit + "R", [*lines, f"{full[free[s]]}:{text}"]))
            best = after
        end = insert(best)
        cost, audit, lines = min(end[s] for s in ("", "a") if s in end)
        turns = {t for t, *_ in mine if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        out.append((c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


@pytest.mark.parametrize(("segment", "parts"), [(256, 3), (5, 2), (1, 4)])
def test_op12_repairs(spark, segment, parts):
    rows = talk()
    got = conversations.repair(spark.createDataFrame(rows, TALK).repartition(parts), segment).collect()
    assert order(map(tuple, got)) == order(brute_repair(rows))


def test_op12_nothing_left_and_empty(spark):
    assert conversations.repair(spark.createDataFrame([], TALK)).count() == 0
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    got = conversations.repair(spark.createDataFrame([(gone, 0, "user", "Hi.", "n", 1, 2, "z")], TALK)).collect()
    assert list(map(tuple, got)) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_op12_heaps_meet_at_every_crossing():
    """Against all edit sequences of short conversations, ties included."""
    r = random.Random(2)
    for _ in range(300):
        n = r.randint(0, 5)
        initials, faults = [r.choice("suax") for _ in range(n)], [r.choice([0, 0, 1, 2]) for _ in range(n)]
        ways = {0: [(0, "", conversations.START)]}
        todo, found = [(0, "", conversations.START, 0)], []
        lattice = conversations.Lattice(initials, faults, True)
        while todo:
            cost, audit, s, i = todo.pop()
            if i == n and s in (conversations.START, conversations.ASSISTANT):
                found.append((cost, audit))
            for more, (j, t), letter in lattice.onward((i, s)):
                if cost + more <= 4 * n and not audit.endswith("III"):
                    todo.append((cost + more, audit + letter, t, j))
        assert lattice.cheapest(conversations.START, [conversations.START, conversations.ASSISTANT]) == min(found) and ways


def brute_resample(rows, items):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    docs = [features(r[1]) for r in rows]
    s, t = Counter(b for _, f in docs for b in f), Counter(b for x in items for b in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: floor(1000 * log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
    out = []
    for r, (n, f) in zip(rows, docs, strict=True):
        weight = sum(map(gain, f))
        h = int(hashlib.sha256(f"42:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        out.append([r[0], n, len(f), weight, weight + floor(-1000 * log(-log((h + 0.5) / 4294967296))), None])
    ranked = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], x[0] is not None, x[0]))
    for k, x in enumerate(ranked[: 5 * len(ranked) // 100]):
        x[5] = k + 1
    return [tuple(x) for x in out]


def test_op13_weights_and_ranks(spark):
    rows = corpus(9, 160)
    rows += [(500, "many Many many " * 3000, *rows[0][2:]), (501, "x" * 200 + " " + "é" * 40 + " y_z-W " + "q" * 64, *rows[0][2:])]
    items = [rows[3][1], rows[8][1] and rows[8][1].upper(), None, "", rows[3][1]]
    target = spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string")
    got = resampling.importance_resample(spark.createDataFrame(rows, DOCS).repartition(4), target).collect()
    assert order(map(tuple, got)) == order(brute_resample(rows, items))
    assert sum(r.rank is not None for r in got) >= 6


def test_op13_empty_tables(spark):
    target = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert resampling.importance_resample(spark.createDataFrame([], DOCS), target).count() == 0
    rows = corpus(2, 12)
    got = resampling.importance_resample(spark.createDataFrame(rows, DOCS), target.limit(0)).collect()
    assert order(map(tuple, got)) == order(brute_resample(rows, []))


def test_op13_planes_are_exact():
    r = np.random.default_rng(4)
    counts, gains = r.integers(0, 1 << 20, (7, 999)) * (r.random((7, 999)) < 0.2), r.integers(-12_000, 12_000, 999)
    assert (resampling.weigh(counts, gains) == counts @ gains).all()
    assert (resampling.weigh(counts * 0, gains) == 0).all()
