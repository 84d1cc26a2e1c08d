"""Blocked top-k against brute force, embedding once a worker, functions of SQL, fingerprints, masking, and walks over links."""

import hashlib
import random
import re
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import sql
from corpusmill.operators import chunking, frontier, guard, html, ingest, retrieval, rollups
from corpusmill.plans import registry
from corpusmill.sources import files

SMALL = "/root/testdata/sf0.001"


def nearest(queries, vectors, k):
    out = []
    for qid, q, f in queries:
        scored = sorted((-float(np.dot(np.float64(q), np.float64(v))), i) for i, v, g in vectors if v is not None and q is not None and f in (None, g))
        out += [(qid, i, n + 1) for n, (_, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize(("numbers", "strings"), [(1 << 22, False), (24, False), (24, True)])
def test_top_k_in_blocks(spark, monkeypatch, numbers, strings):
    """Ties, nulls, filters and filters of none; with small blocks several of each side meet."""
    monkeypatch.setattr(retrieval, "BLOCK_NUMBERS", numbers)
    monkeypatch.setattr(retrieval, "LEAST_ROWS", 5)
    monkeypatch.setattr(retrieval, "SCORES", 40)
    r = random.Random(4)
    name = (lambda i: f"v{i}é") if strings else (lambda i: i)
    vector = lambda: [float(r.randint(-2, 2)) for _ in range(4)]
    vectors = [(name(i), vector() if i % 9 else None, r.choice(["a", "b", None])) for i in range(90)]
    queries = [(i, vector() if i % 11 else None, r.choice(["a", "b", "c", None])) for i in range(30)]
    kind = "string" if strings else "long"
    v = spark.createDataFrame(vectors, f"id {kind}, embedding array<float>, f string").repartition(3)
    q = spark.createDataFrame(queries, "query_id long, embedding array<float>, f string")
    got = sorted((x.query_id, x.id, x.rank) for x in retrieval.top_k(q, v, 5, "f").collect())
    assert got == nearest(queries, vectors, 5)
    free = sorted((x.query_id, x.id, x.rank) for x in retrieval.top_k(q, v, 5).collect())
    assert free == nearest([(i, e, None) for i, e, _ in queries], vectors, 5)


@pytest.fixture
def uncoalesced(spark):
    """Shuffles keep their partitions, as they do with larger inputs."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_top_k_blocks_meet_in_whichever_partition(spark, uncoalesced, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_NUMBERS", 60)
    monkeypatch.setattr(retrieval, "LEAST_ROWS", 5)
    r = random.Random(5)
    vectors = [(i, [float(r.randint(-3, 3)) for _ in range(4)]) for i in range(80)]
    v = spark.createDataFrame(vectors, "id long, embedding array<float>")
    q = v.filter("id % 4 = 0").withColumnRenamed("id", "query_id")
    got = sorted((x.query_id, x.id, x.rank) for x in retrieval.top_k(q, v, 5).collect())
    assert got == nearest([(i, e, None) for i, e in vectors if i % 4 == 0], [(*x, None) for x in vectors], 5)


def test_top_k_scores_are_the_same_in_any_block(spark, monkeypatch):
    """Equal vectors are a tie by id; scores are sums from the first number on, to the last digit."""
    r = np.random.default_rng(6)
    kinds = r.normal(size=(3, 67)).astype(np.float32)
    vectors = [(i, kinds[i % 3].tolist()) for i in range(61)]
    v = spark.createDataFrame(vectors, "id long, embedding array<float>")
    q = v.filter("id < 7").withColumnRenamed("id", "query_id")
    for scores in (14, 1 << 21):
        monkeypatch.setattr(retrieval, "SCORES", scores)
        monkeypatch.setattr(retrieval, "LEAST_ROWS", 1000 if scores == 14 else 4)
        got = sorted((x.query_id, x.rank, x.id, x.score) for x in retrieval.top_k(q, v, 25).collect())
        want = []
        for i in range(7):
            of = [0.0] * 3
            for n, k in enumerate(kinds):
                for a, b in zip(kinds[i % 3], k, strict=True):
                    of[n] += float(a) * float(b)
            best = sorted((-of[j % 3], j) for j, _ in vectors)[:25]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
        assert got == want


def test_top_k_plan_is_the_same_for_any_number_of_queries(spark):
    v = spark.range(200).select("id", F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    plan = lambda n: retrieval.top_k(spark.range(n).select(F.col("id").alias("query_id"), F.array(F.lit(1.0).cast("float"), F.col("id").cast("float")).alias("embedding")), v)
    sizes = [len(re.findall(r"\n", plan(n)._jdf.queryExecution().optimizedPlan().toString())) for n in (10, 10_000)]
    assert sizes[0] == sizes[1]
    best = plan(10_000).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("id", "rank").alias("id")).agg(F.count(F.lit(1)), F.min("n"), F.min("id"), F.max("id")).head()
    assert tuple(best) == (10_000, 6, 199, 199)


def test_top_k_of_other_lengths_and_of_nothing(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "id int, embedding array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id int, embedding array<float>")
    with pytest.raises(ValueError, match="lengths from 1 to 2"):
        retrieval.top_k(q, v)
    with pytest.raises(ValueError, match="queries have 2 numbers, vectors 1"):
        retrieval.top_k(q, v.filter("id = 2"))
    assert retrieval.top_k(q, v.limit(0)).count() == 0 and retrieval.top_k(q.limit(0), v.filter("id = 1")).count() == 0


def test_model_is_made_once_a_worker_and_texts_are_embedded_once(spark, tmp_path):
    log = str(tmp_path / "log")

    def factory():
        import os

        with open(log, "a") as f:
            f.write(f"made {os.getpid()}\n")

        def model(texts):
            with open(log, "a") as f:
                f.write("".join(f"text {t}\n" for t in texts))
            return [[float(len(t)), 1.0] for t in texts]

        return model

    texts = spark.createDataFrame([(k, f"t{k}") for k in range(60)] + [(99, None)], "query_id int, text string").repartition(24)
    got = retrieval.embed(texts, factory=factory).collect()
    assert {r.query_id: r.embedding for r in got}[99] == [0.0, 1.0]
    made = [x for x in open(log) if x.startswith("made")]
    assert len(made) == len(set(made)) <= 4
    open(log, "w").close()
    stored = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "b")], "id int, embedding array<float>, text string").selectExpr("*", "'c' as citation", "'t' as source_type", "'u' as source_url")

    def noting(ts):
        with open(log, "a") as f:
            f.write("".join(f"text {t}\n" for t in ts))
        return [[1.0, 0.0] for _ in ts]

    retrieval.retrieve(spark.createDataFrame([(k, f"q{k}") for k in range(9)], "query_id int, question string"), stored, noting, 2, 1).collect()
    assert sorted(open(log)) == sorted(f"text q{k}\n" for k in range(9))
    with pytest.raises(ValueError, match="model or a factory"):
        retrieval.embed(texts)


def test_hashed_vectors_without_python(spark):
    d = retrieval.embed_hashed(spark.createDataFrame([(1, "A b  a"), (2, "a a B"), (3, None), (4, " \n")], "id int, text string"), 32)
    got = {r.id: r.embedding for r in d.collect()}
    assert got[1] == pytest.approx(got[2]) and sum(x * x for x in got[1]) == pytest.approx(1) and not any(got[3]) and not any(got[4]) and len(got[3]) == 32
    assert "Python" not in d._jdf.queryExecution().toString() and "ArrowEval" not in d._jdf.queryExecution().toString()


def test_chunks_by_sql_are_the_chunks(spark):
    one = registry.QUERIES["chunk_recursive"](spark, SMALL).select("source_path", "chunk_index", "id", "citation", "text").collect()
    two = registry.QUERIES["chunk_sql"](spark, SMALL).select("source_path", "chunk_index", "id", "citation", "text").collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert len(one) > 200 and sorted(one, key=key) == sorted(two, key=key)


def test_functions_of_sql(spark):
    sql.register(spark)
    sql.register(spark)
    value = lambda q: spark.sql(f"SELECT {q} AS x").head().x
    assert value("slugify('Hello,  World! ')") == "hello-world" and value("slugify(NULL)") == "" and value("normalize_space(' a\\n b ')") == "a b"
    assert value("cost_usd(1000000, 1000000, 15, 75)") == Decimal("90.000000") and value("cost_usd(1, 0, 0.5, 0)") == Decimal("0.000000") and value("cost_usd(3, 0, 0.5, 0)") == Decimal("0.000002") and value("cost_usd(1, 1, NULL, 1)") is None
    assert value("chunk_id('c', 3, 'text')") == hashlib.sha1(b"c\0003\0text").hexdigest()[:16] and value("chunk_id(NULL, 0, 'é')") == hashlib.sha1("\0000\0é".encode()).hexdigest()[:16]
    assert value("token_estimate('abc')") == 1 and value("token_estimate(NULL)") == 0 and value("token_estimate('abcdefgh!')") == 2
    assert value("section_number('https://x.y/law_section_236-a')") == "236-a" and value("section_number('/ors_107.105')") == "107.105"
    rows = spark.sql("SELECT k, p.piece_no, p.piece FROM VALUES (1, 'one two three'), (2, NULL), (3, ' ') AS t(k, x), LATERAL split_recursive(x, 8, 0) p").collect()
    assert [(r.k, r.piece) for r in rows] == [(1, p) for p in chunking.split_recursive("one two three", 8, 0)]


def test_fingerprints_of_any_size(spark):
    r = random.Random(1)
    files = [(k % 3 if k % 50 else None, "/".join(r.choices(["a", "b", "a b", "B"], k=r.randint(1, 4))) + f"/{k}", k * 7, k) for k in range(700)]
    df = spark.createDataFrame(files, "source int, path string, size long, mtime long").repartition(5)
    sha = lambda lines: hashlib.sha1("\n".join(lines).encode()).hexdigest()
    for most in (10_000, 40, 1):
        got = {x.source: (x.fingerprint, x.n_files) for x in rollups.fingerprint(df, "source", most).collect()}
        for source in (0, 1, 2, None):
            lines = [f"{p}:{s}:{m}" for _, p, s, m in sorted((f for f in files if f[0] == source), key=lambda f: f[1].split("/"))]
            want = sha(lines) if len(lines) <= most else sha(sha(lines[k : k + most]) for k in range(0, len(lines), most))
            assert got[source] == (want, len(lines))
    assert rollups.fingerprint(df.limit(0), "source").count() == 0


@pytest.mark.parametrize("lines", [1000, 7])
def test_fingerprint_of_a_large_group_is_of_its_lines(spark, monkeypatch, lines):
    """Over 10,000 files: still the SHA-1 of all lines, in whichever partitions they are sorted."""
    monkeypatch.setattr(rollups, "LINES", lines)
    files = [("g" if k % 5 else None, f"{k % 3}/{k}", k * 7, k) for k in range(15_000)]
    df = spark.createDataFrame(files, "source string, path string, size long, mtime long").repartition(5)
    got = {x.source: (x.fingerprint, x.n_files) for x in rollups.fingerprint(df, "source").collect()}
    for source in ("g", None):
        text = [f"{p}:{s}:{m}" for _, p, s, m in sorted((f for f in files if f[0] == source), key=lambda f: f[1].split("/"))]
        assert got.pop(source) == (hashlib.sha1("\n".join(text).encode()).hexdigest(), len(text))
    assert not got


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def brute_mask(text):
    spans = []
    for k, (kind, pattern) in enumerate([*guard.PII.items(), ("card", guard.CARD)]):
        for m in re.finditer(pattern, text):
            if kind != "card" or luhn(re.sub(r"\D", "", m[0])):
                spans.append((m.start(), -m.end(), k, kind))
    merged = []
    for start, end, _, kind in sorted(spans):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], -end)
        else:
            merged.append([start, -end, kind])
    out, at = "", 0
    for start, end, kind in merged:
        out, at = out + text[at:start] + "{" + kind.upper() + "}", end
    return out + text[at:], [m[2] for m in merged]


PARTS = ["123-45-6789", "912-70-1234", "routing number: 123456789", "Account # 12345678", "cvv 123", "cvv: 123-45-6789", "PIN 1234", "password=hunter2", "password: 912-70-1234", "4111 1111 1111 1111", "4111 1111 1111 1112", "4111111111111111", "x", "é", " ", ", ", "\n", "-45-6789", "account 4111111111111111"]


def test_masks_and_counts_agree(spark):
    r = random.Random(6)
    texts = ["".join(r.choices(PARTS, k=r.randint(1, 12))) for _ in range(400)] + ["", "plain", "cvv 123-45-6789 end", "é" * 50 + "123-45-6789", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = df.select("id", guard.mask_pii(F.col("text")).alias("masked"), F.struct(*(v.alias(k) for k, v in guard.pii_counts(F.col("text")).items())).alias("n")).collect()
    for x in got:
        text = texts[x.id]
        if text is None:
            assert x.masked is None and not any(x.n)
            continue
        masked, kinds = brute_mask(text)
        assert x.masked == masked, text
        assert {k: n for k, n in x.n.asDict().items() if n} == {f"n_{k}": kinds.count(k) for k in kinds}
    assert brute_mask("cvv 123-45-6789 end")[0] == "{CVV} end"


@pytest.mark.parametrize(("base", "href", "url"), [
    ("https://h.gov/a/b.htm?q=1#f", "c/d", "https://h.gov/a/c/d"), ("https://h.gov/a/b.htm", "../x", "https://h.gov/x"), ("https://h.gov/a/b/c", "../../../x/./y/..", "https://h.gov/x/"),
    ("https://h.gov/a/b", "/r/../s?z=../k", "https://h.gov/s?z=../k"), ("https://h.gov", "x", "https://h.gov/x"), ("https://h.gov/a?b#c", "#d", "https://h.gov/a?b#d"), ("https://h.gov/a?b#c", "?e", "https://h.gov/a?e"),
    ("https://h.gov/a/b", "mailto:x@y", "mailto:x@y"), ("https://h.gov/a/b", "//k.gov/z", "https://k.gov/z"), ("https://h.gov/a/b", ".", "https://h.gov/a/"), ("https://h.gov/a/b?c#d", "", "https://h.gov/a/b?c#d"),
])
def test_relative_links(spark, base, href, url):
    assert spark.range(1).select(html.resolve(F.lit(base), F.lit(href)).alias("u")).head().u == url


def test_link_matchers(spark):
    on = lambda c: spark.range(1).select(c.alias("x")).head().x
    assert on(html.child_link(F.lit("https://h/n.y._law_article_4"), F.lit("n.y._law"), "article")) and not on(html.child_link(F.lit("https://h/x_n.y._law_article_4"), F.lit("n.y._law"), "article"))
    assert on(html.deep_link(F.lit("https://h/a_tex._code_title_1_section_2"), F.lit("tex._code"), "_section_")) and not on(html.deep_link(F.lit("https://h/tex._code/section_2"), F.lit("tex._code"), "_section_"))
    assert on(html.numbered_link(F.lit("https://h/ors_107.105"), F.lit("ors"))) and not on(html.numbered_link(F.lit("https://h/ors_chapter_107"), F.lit("ors")))


def test_discovery_over_links(spark):
    r = "h/tex"
    links = [
        (r, f"{r}_title_1"), (r, f"{r}_title_2"), (r, f"{r}_section_9"), (r, "h/other_title_1"), (f"{r}_title_1", r), (f"{r}_title_1", f"{r}_title_2"), (f"{r}_title_1", f"{r}_title_1_chapter_3"), (f"{r}_title_1", f"{r}_title_1"),
        (f"{r}_title_1_chapter_3", f"{r}_title_1_chapter_3_section_7"), (f"{r}_title_1_chapter_3", f"{r}_title_1"), (f"{r}_title_1_chapter_3", f"{r}_title_1_chapter_3_section_7"), (f"{r}_title_2", f"{r}_title_2_part_4"),
        (f"{r}_title_2_part_4", f"{r}_title_2_part_4_section_1"), ("h/none", f"{r}_section_99"),
    ]
    codes = spark.createDataFrame([("all", "tex", r), ("one", "tex", f"{r}_title_1"), ("two", "tex", f"{r}_title_2"), ("two", "tex", f"{r}_title_1"), ("gone", "tex", "h/missing")], "code string, root string, seed string")
    captured = spark.createDataFrame([(s,) for s in {a for a, _ in links} - {f"{r}_title_2_part_4"}], "url string")
    containers, sections = frontier.discover(spark.createDataFrame(links, "src string, dst string"), codes, captured)
    found = {(x.code, x.url): (x.depth, x.failed) for x in containers.collect()}
    assert {k[1]: v for k, v in found.items() if k[0] == "all"} == {r: (0, False), f"{r}_title_1": (1, False), f"{r}_title_2": (1, False), f"{r}_title_1_chapter_3": (2, False), f"{r}_title_2_part_4": (2, True)}
    assert {k[1] for k in found if k[0] == "one"} == {f"{r}_title_1", f"{r}_title_1_chapter_3"} and found["gone", "h/missing"] == (0, True)
    got = sorted((x.code, x.url, x.depth) for x in sections.collect())
    assert got == [("all", f"{r}_section_9", 0), ("all", f"{r}_title_1_chapter_3_section_7", 2), ("one", f"{r}_title_1_chapter_3_section_7", 1), ("two", f"{r}_title_1_chapter_3_section_7", 1)]
    assert sorted((x.code, x.place) for x in frontier.within_quota(sections, 1).collect()) == [("all", 1), ("one", 1), ("two", 1)]
    with pytest.raises(ValueError, match="left after 1 steps"):
        frontier.discover(spark.createDataFrame(links, "src string, dst string"), codes, captured, 1)


YAML = """# registry
states:
  ny:
    name: New York
    public_law_subdomain: newyork
    statutes:
      - code_root: n.y._law
        citation_format: "N.Y. Law § {section}"
        articles: null
    courtlistener_courts: [ny, nyappdiv]   # two
  tx:
    name: Texas
    fetcher: other
"""


def test_registry_from_yaml_and_json(spark, tmp_path):
    (tmp_path / "s.yaml").write_text(YAML)
    (tmp_path / "s.json").write_text('{"states": {"ny": {"name": "New York"}}}')
    (tmp_path / "none.yaml").write_text("# nothing\n")
    (tmp_path / "bad.yaml").write_text("states: !!javax.script.ScriptEngineManager [x]\n")
    given = files.registry_file(spark, str(tmp_path / "s.yaml"))
    states = {r.slug: r for r in files.states(spark, given).collect()}
    assert states["ny"].statutes[0].citation_format == "N.Y. Law § {section}" and states["ny"].statutes[0].layout == "ny_article" and states["ny"].courtlistener_courts == ["ny", "nyappdiv"]
    assert states["tx"].fetcher == "other" and states["tx"].statutes == [] and states["ny"].fetcher == "public_law"
    assert files.registry_file(spark, str(tmp_path / "s.json")) == {"ny": {"name": "New York"}} and files.registry_file(spark, str(tmp_path / "none.yaml")) == {}
    with pytest.raises(Exception, match="not allowed|ConstructorException|Global tag"):
        files.registry_file(spark, str(tmp_path / "bad.yaml"))


def test_blocks_out_of_order_are_an_error(spark):
    text = "Sec. 1-1. One.\n(a) x\n(b) y\nSec. 1-2. Two.\nz"
    made = spark.createDataFrame([("a", "statute", "c", None, None, text), ("b", "statute", "c", None, None, text)], "source_path string, source_type string, citation string, title string, section string, text string")
    blocks = chunking.sections(made)
    assert chunking.numbered_pieces(blocks.coalesce(1)).count() == 6
    with pytest.raises(Exception, match="rows have been moved"):
        chunking.numbered_pieces(blocks.coalesce(1).sortWithinPartitions(F.desc("section_no"))).collect()


def test_spans_are_found_once_for_all_counts(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    plan = lambda q: registry.QUERIES[q](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    found = [plan("pii_masked").count("regexp_extract_all("), plan("pii_mask_counts").count("regexp_extract_all(")]
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    kinds = len(guard.PII) + 1
    assert found[0] <= 3 * kinds and found[1] <= 2 * 3 * kinds  # two tables


def test_ingest_embeds_each_chunk_once(spark, tmp_path):
    """Which files are replaced is read from the chunks as written, not worked out a second time."""
    log = str(tmp_path / "calls")

    def model(texts):
        with open(log, "a") as f:
            f.write("x" * len(texts))
        return [[1.0, float(len(t))] for t in texts]

    files_ = spark.createDataFrame([(f"notes-{k}.txt", f"text {k}") for k in range(20)], "source_path string, text string")
    kept = ingest.flat(ingest.chunked(files_.limit(3))).withColumns({"collection": F.lit("c"), "text": F.lit("old"), "embedding": F.array(F.lit(0.0).cast("float"))})
    out = ingest.ingest(files_, kept, "c", model, 2).collect()
    assert sorted(r.text for r in out) == sorted(f"text {k}" for k in range(20)) and all(len(r.embedding) == 2 for r in out)
    with open(log) as f:
        assert len(f.read()) == 20
