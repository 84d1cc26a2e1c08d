"""Operator 6 on repeated words, shared heads and templated items: results by brute force, and bounds on time and memory."""

import random
import time
import tracemalloc

import pytest

from corpusmill.llm import contamination as c


def brute(texts, items, window=13):
    """Hit words and labels of each text, window by window."""
    out = []
    for t in texts:
        w, hit, labels = c.words_of(t), set(), set()
        for i, x in items:
            x = c.words_of(x)
            k = min(window, len(x))
            for a in range(len(x) - k + 1 if x else 0):
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == x[a : a + k]:
                        hit.update(range(p, p + k))
                        labels |= {str(i)} if i is not None else set()
        out.append((len(w), hit, sorted(labels)))
    return out


def found(texts, items, window=13):
    tests = c.TestItems(items, window)
    hits = c.scan(texts, tests)
    return [(n, {p for a, b in r for p in range(a, b)}, i) for n, r, i in zip(hits.size.tolist(), hits.ranges(), hits.items(tests.labels).to_pylist(), strict=True)], hits


@pytest.mark.parametrize("seed", range(6))
def test_repeated_words_and_shared_heads(seed):
    r = random.Random(seed)
    word = lambda: r.choice([b"a", b"a", b"b", b"c"])
    text = lambda n: b" ".join(word() for _ in range(n))
    head = text(5)
    items = [(k if k % 7 else None, r.choice([head + b" ", b""]) + text(r.randint(1, 9))) for k in range(12)] + [(3, b""), (4, b"a a"), (4, b"zz")]
    texts = [r.choice([head + b" ", b"new "]) + text(r.randint(0, 30)) for _ in range(25)] + [b"", b"a", b"A a? a"]
    got, hits = found(texts, items, 4)
    want = brute(texts, items, 4)
    assert got == want and hits.hit_words().tolist() == [len(h) for _, h, _ in want]
    for _, runs, _ in got:
        assert all(isinstance(p, int) for p in runs)


def test_equal_words_take_little_time_and_memory():
    tests = c.TestItems([(1, b"x " * 4000), (2, b"y")], 13)
    tracemalloc.start()
    began = time.process_time()
    hits = c.scan([b"x " * 20_000, b"x " * 12, b"x y x"], tests)
    took, peak = time.process_time() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert hits.ranges() == [[[0, 20_000]], [], [[1, 2]]] and hits.items(tests.labels).to_pylist() == [["1"], [], ["2"]]
    assert took < 10 and peak < 300 << 20  # a tracing allocator is several times slower


def test_templated_items():
    """Ten thousand items with one head of a window's length: one class of suffixes, listed once for each text."""
    head = b"which of the following answers to the question below is the right one "
    items = [(k, head + f"case{k} of many".encode()) for k in range(10_000)]
    texts = [head + b"nothing"] * 300 + [b"other words", head + b"case77 of many"]
    began = time.process_time()
    tests = c.TestItems(items, 13)
    hits = c.scan(texts, tests)
    assert time.process_time() - began < 60
    lists = hits.items(tests.labels)
    assert len(lists[0]) == 10_000 and len(lists[300]) == 0 and hits.ranges()[0] == [[0, 13]] and hits.ranges()[301] == [[0, 16]]
