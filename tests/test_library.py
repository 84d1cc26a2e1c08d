"""Operators of the library on small literal tables, and registered queries against DuckDB."""

import os
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from corpusmill.functions import exprs as X
from corpusmill.operators import chunking, dom, frontier, guard, html, ingest, retrieval, rollups, scope, sync, usage
from corpusmill.plans import registry
from corpusmill.sources import files as sources
from corpusmill.sources.files import prices

SMALL = "/root/testdata/sf0.001"


def one(spark, sql_value, column):
    return spark.range(1).select(column(F.lit(sql_value)).alias("x")).head().x


def test_column_functions(spark):
    assert one(spark, "Hello,  World! ", X.slugify) == "hello-world" and one(spark, "§§", lambda c: X.slugify(c, "default")) == "default"
    for url, n in {"https://x.y/law_section_236-a": "236-a", "/fla._stat._61.08": "61.08", "/ors_107.105": "107.105", "/crs_14-10-106": "14-10-106"}.items():
        assert one(spark, url, X.section_number) == n
    assert one(spark, "N.Y. Law Section 170 – Action for  divorce (2026)", X.section_title) == "Action for divorce"
    assert one(spark, "No dash", X.section_title) == "No dash" and one(spark, "a\n b. .", X.clean_meta_value) == "a b"
    assert one(spark, "a/../b", X.safe_folder) is None and one(spark, "/a//./b/", X.safe_folder) == "a/b"
    assert one(spark, "abc", X.token_estimate) == 1 and one(spark, "", X.token_estimate) == 0
    front = spark.range(1).select(X.front_matter(F.lit("---\n# c\nsection: 170\nno colon\ntitle: \"'A: b'\"\ntitle: z\n---\nbody")).alias("m")).head().m
    assert front == {"section": "170", "title": "z"}


def test_costs(spark):
    rows = [("a", "chat", "BIG", 1_000_000, 1_000_000), ("b", "chat", "none", 5, 5), ("c", "embedding", "small", 200, 0), ("d", "chat", "big", 0, 0)]
    e = spark.createDataFrame(rows, "id string, kind string, model string, input_tokens long, output_tokens long").withColumn("mode", F.lit("m"))
    got = {r.id: r for r in usage.recordable(usage.priced(e, prices(spark, {"Big": ("15", "75"), "small": ("0.06", "0")}))).collect()}
    assert got["a"].cost_usd == Decimal("90.000000") and got["b"].cost_usd is None and got["c"].cost_usd == Decimal("0.000012") and "d" not in got and got["c"].mode is None


def files(spark, rows):
    df = spark.createDataFrame(rows, "source_path string, text string")
    return df.select("*", *(v.alias(k) for k, v in X.path_metadata(F.col("source_path"), F.col("text")).items()))


def test_sections_and_chunks(spark):
    got = chunking.chunks(files(spark, [
        ("d/cgs-46b-82.txt", "Sec. 46b-82. Alimony\nLead.\n(a) First part.\n(b) Second part."), ("d/pb-25.txt", "skip\nSec. 25-1. One\nx\nSec. 25-2. Two\ny"), ("d/guide-x.txt", "plain"), ("d/case-y.txt", None),
    ])).orderBy("source_path", "chunk_index").collect()
    by = {}
    for r in got:
        by.setdefault(r.source_path, []).append(r)
    a = by["d/cgs-46b-82.txt"]
    assert [r.subsection for r in a] == ["(a)", "(b)"] and a[1].citation.endswith("§ 46b-82(b)") and all(r.text.startswith("Sec. 46b-82. Alimony\nLead.\n\n(") for r in a)
    assert [(r.section, r.citation) for r in by["d/pb-25.txt"]] == [("25-1", "Conn. Practice Book § 25-1"), ("25-2", "Conn. Practice Book § 25-2")]
    assert len({r.id for r in got}) == len(got) and "d/case-y.txt" not in by


def test_recursive_splitter():
    text = "\n\n".join(". ".join(f"word{i} " * 30 for i in range(k, k + 9)) for k in range(12))
    parts = chunking.split_recursive(text)
    assert all(0 < len(p) <= 1200 and p in text for p in parts) and len(parts) > 5
    assert chunking.split_recursive("x" * 2500) == ["x" * 1200, "x" * 1200, "x" * 500]


def test_pages(spark):
    page = "<html><body><h1>A  b</h1><p>Top</p><script>no</script><ul><li>one</li><li>one</li></ul><p><span id='sec_1'>Sec 1.</span> first</p><p>more</p><p><span id='sec_2'>Sec 2.</span></p></body></html>"
    df = dom.page_trees(spark.createDataFrame([(1, page), (2, None)], "page_id int, html string"))
    got = {r.page_id: r for r in df.select("page_id", html.markdownish(F.col("tree")).alias("m"), html.section_text(F.col("tree"), F.lit("1")).alias("s")).collect()}
    assert got[1].m.startswith("# A b\n\n- one\n\nSec 1. first") and got[1].s == "Sec 1. first\n\nmore" and got[2].m == ""


def test_verdicts(spark):
    on = lambda a, more="": f'{{"action":"GUARDRAIL_INTERVENED","assessments":[{a}]{more}}}'
    pii = lambda act: '{"sensitiveInformationPolicy":{"piiEntities":[{"type":"SSN","action":"%s"}]}}' % act
    rows = [
        (1, "output", '{"action":"NONE"}'), (2, "output", on('{"contextualGroundingPolicy":{"filters":[{"type":"GROUNDING","action":"BLOCKED"}]}}')), (3, "input", on('{"topicPolicy":{"topics":[{"name":"t","action":"DENIED"}]}}')),
        (4, "output", on(pii("ANONYMIZED"), ',"outputs":[{"text":"masked"}]')), (5, "input", on(pii("ANONYMIZED"))), (6, "output", on(pii("BLOCKED"))), (7, "output", None),
    ]
    got = {r.id: r for r in guard.verdicts(spark.createDataFrame(rows, "id int, side string, resp string").withColumn("original", F.lit("o"))).collect()}
    assert [got[i].blocked for i in range(1, 8)] == [False, True, True, False, False, True, False]
    assert got[2].reasons == ["ungrounded:grounding"] and got[3].reasons == ["t"] and got[6].reasons == ["sensitive-info"]
    assert (got[4].masked, got[4].text) == (True, "masked") and got[5].text == got[7].text == "o"


def test_slugs_walk_and_sync(spark):
    r = spark.createDataFrame([("o", "x", 1), ("o", "x", 2), ("o", "x-2", 3), ("p", "x", 4), ("o", "x", 5)], "owner string, base string, n int")
    assert {x.n: x.slug for x in rollups.unique_slugs(r, "owner", "base", "n").collect()} == {1: "x", 2: "x-3", 3: "x-2", 4: "x", 5: "x-4"}
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    assert {x.node: x.depth for x in frontier.walk(edges, spark.createDataFrame([("a",)], "node string")).collect()} == {"a": 0, "b": 1, "c": 2}
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, v int, t string")
    new = spark.createDataFrame([(2, 2, "c")], "k int, v int, t string")
    up = sync.upsert_latest(old, new, ["k"], "v")
    assert sorted(map(tuple, up.collect())) == sorted(map(tuple, sync.upsert_latest(up, new, ["k"], "v").collect())) == [(1, 1, "a"), (2, 2, "c")]


def test_walks_lose_nothing(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert frontier.walk(edges, seeds, most_steps=2).count() == 3  # nothing is left
    with pytest.raises(ValueError):
        frontier.walk(edges, seeds, most_steps=1)
    pointers = spark.range(1500).selectExpr("concat('s_', id) as node", "concat(if(id < 1400, 's_', 'x_'), id + 1) as next").coalesce(1)
    got = {r.node: r.step for r in frontier.chain(pointers, "s_0", "s_").collect()}
    assert got == {f"s_{i}": i for i in range(1401)}
    with pytest.raises(ValueError):
        frontier.chain(pointers, "s_0", "s_", most_steps=1000)
    ring = edges.selectExpr("src as node", "dst as next")
    assert {r.node: r.step for r in frontier.chain(ring, "b", "").collect()} == {"b": 0, "c": 1, "a": 2}


def test_scope(spark):
    assert [one(spark, n, lambda c: scope.lead_between(c, 347, 381)) for n in ("347.1", "381", "3810", "x", None)] == [True, True, False, False, False]
    assert [one(spark, n, lambda c: scope.in_scope(c, "31-15-", r"3[13579]\d\d")) for n in ("31-15-2", "3301", "3401", "a3301", None)] == [True, True, False, False, False]
    assert [one(spark, n, lambda c: scope.is_section_link(c, "fla._stat.")) for n in ("fla._stat._61.08", "fla._stat._title", "flaX_statX_6")] == [True, False, False]
    assert [one(spark, n, scope.padded_number) for n in ("47", "0047", "123456", "x")] == ["00047", "00047", "123456", None]
    assert one(spark, "00312", lambda c: scope.title_number(c, "25")) == "25-312" and one(spark, "mcl-552-9a", lambda c: scope.citation_number(c, "mcl")) == "552.9a"
    assert [one(spark, n, lambda c: scope.dotted_name(c, "HRS")) for n in ("580-10.5", "580-10", "x")] == ["HRS_0580-0010_0005", "HRS_0580-0010", None]
    s = spark.createDataFrame([("1", "old"), ("2", "old"), (None, "old")], "section string, topic string")
    t = spark.createDataFrame([("1", "custody"), ("9", "x")], "section string, topic string")
    assert {r.section: r.topic for r in scope.curated(s, t, "section", {"topic": "general"}).collect()} == {"1": "custody", "2": "general", None: "general"}
    assert [r.section for r in scope.allowed(s, t, ["section"]).collect()] == ["1"] and scope.of_kinds(s.withColumnRenamed("topic", "kind"), {"old": False, "new": True}).count() == 0
    r = spark.createDataFrame([("ct", ["a", "b"]), ("ny", None)], "slug string, courtlistener_courts array<string>")
    assert sorted(map(tuple, scope.state_courts(r).collect()), key=repr) == [("ct", "a"), ("ct", "b"), ("ny", None)]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SMALL):
        c.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SMALL}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SMALL)
    rows = sorted(repr(tuple(r)) for r in df.collect())
    if name not in registry.ORACLES:
        assert rows
        return
    cursor = duck.execute(registry.ORACLES[name])
    at = [[c[0] for c in cursor.description].index(c) for c in df.columns]
    assert rows == sorted(repr(tuple(r[k] for k in at)) for r in cursor.fetchall())


def test_entry(spark):
    assert entry_point.entry(spark).columns == ["breakdown", "label", "requests", "input_tokens", "output_tokens", "total_tokens", "cost_usd"]
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_stream_equals_batch(spark, tmp_path):
    from corpusmill.streaming.usage import daily_usage, event_files

    e = registry.usage_events(spark, SMALL)
    e.write.parquet(f"{tmp_path}/in")
    q = daily_usage(event_files(spark, f"{tmp_path}/in", e.schema)).writeStream.outputMode("complete").format("memory").queryName("daily").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, e.groupBy(F.to_date("created_at").alias("day"), "model").agg(*usage.measures()).collect()))


def test_registry_and_its_courts(spark):
    r = sources.states(spark, {"ct": {"name": "Connecticut", "statutes": [{"code_root": "cgs", "citation_format": "CGS {section}"}], "courtlistener_courts": ["a", "b"]}, "ny": {"name": "New York"}})
    assert sorted(map(tuple, scope.state_courts(r).collect()), key=repr) == [("ct", "a"), ("ct", "b"), ("ny", None)]
    code = sources.state_codes(r).filter("slug = 'ct'").head()
    assert (code.code_root, code.base_path, code.layout) == ("cgs", "/laws/", "ny_article")
    asked = spark.createDataFrame([("New York",), ("CT",), ("zz",)], "state string")
    assert [x.slug for x in sources.resolve_state(asked, r).orderBy("state").collect()] == ["ct", "ny", None]


def test_index_trim_and_scaffold(spark):
    t = "Sec. 1-1. A.\nbody\nSec. 86-2. Last.\nrule text\n1 . . . . . . . . . . .  1-3\nmore"
    df = spark.createDataFrame([(t, "# a.pdf\n\n## Page 1\nx\n\n\n\n## Page 2\ny\n"), ("no heading\n1 . . . . . . 2", "12\n")], "t string, p string")
    got = df.select(html.trim_index(df.t), html.strip_scaffold(df.p)).collect()
    assert got[0][0] == "Sec. 1-1. A.\nbody\nSec. 86-2. Last.\nrule text\n" and got[1][0] == "no heading\n1 . . . . . . 2"
    assert got[0][1] == "x\n\ny" and got[1][1] == "12"


def test_front_matter_and_ingest(spark):
    raw = spark.createDataFrame([("a/cgs-46b-1.txt", "---\ncitation: Other\nbogus: x\n---\nSec. 46b-1. T.\nbody"), ("a/notes.txt", None), ("a/x.txt", "\ufeff---\nsource_type: statute\n---\nSec. 1. A.\nx\nSec. 2. B.\ny")], "source_path string, text string")
    m = {r.source_path: r for r in ingest.with_metadata(raw).collect()}
    assert m["a/cgs-46b-1.txt"].citation == "Other" and m["a/cgs-46b-1.txt"].section == "46b-1" and m["a/notes.txt"].source_type == "case_file"
    flat = ingest.flat(ingest.chunked(raw)).collect()
    assert sorted(r.citation for r in flat) == ["Conn. Gen. Stat. § 1", "Conn. Gen. Stat. § 2", "Other"] and all(r.topic == "" for r in flat)
    counts = {r.source_type: (r.n_files, r.n_chunks) for r in ingest.report(raw, ingest.chunked(raw)).collect()}
    assert counts == {"statute": (2, 3), None: (1, 0)}


def test_top_k_of_integers_nulls_and_other_sizes(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, None, "b"), (3, [0.0, 1.0], "c")], "id int, embedding array<float>, text string")
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "query_id int, embedding array<float>")
    assert [(r.query_id, r.id) for r in retrieval.top_k(q, v, 1).collect()] == [(7, 1)]
    with pytest.raises(Exception, match="vectors of 3 numbers"):
        retrieval.top_k(q, retrieval.check_dimension(v.filter("embedding is not null"), 3), 1).collect()
    stored = v.filter("id <> 2").selectExpr("id", "embedding", "text", "'c' as citation", "'t' as source_type", "'u' as source_url")
    asked = spark.createDataFrame([(1, "x")], "query_id int, question string")
    assert "a" in retrieval.retrieve(asked, stored, lambda ts: [[1.0, 0.0] for _ in ts], 2, 1).head().passages


def test_upkeep_writers(spark, tmp_path):
    path = str(tmp_path / "states")
    sync.append_state(spark.createDataFrame([("a", 1, "x")], "id string, at int, fp string"), path)
    sync.append_state(spark.createDataFrame([("a", 2, "y")], "id string, at int, fp string"), path, dry_run=True)
    sync.append_state(spark.createDataFrame([("a", 3, "z")], "id string, at int, fp string"), path)
    assert sync.latest_states(spark.read.parquet(path), "id", "at").select("fp").collect()[0][0] == "z"
    (tmp_path / "m.json").write_text('{"id": "x", "counts": {"new": 2}, "objects": [{"key": "k", "size": 3}]}')
    assert [r.key for r in sources.manifest(spark, str(tmp_path / "m.json"), sources.S3_MANIFEST, "objects").collect()] == ["k"]
    (tmp_path / "bad.json").write_text("{nope")
    assert sources.manifest(spark, str(tmp_path / "bad.json"), sources.S3_MANIFEST, "objects").count() == 0
    assert sources.manifest(spark, str(tmp_path / "none.json"), sources.S3_MANIFEST, "objects").count() == 0
    (tmp_path / "a.TXT").write_bytes(b"\xef\xbb\xbfhi\xff")
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    assert [(r.size, r.text) for r in sources.text_files(spark, str(tmp_path)).collect()] == [(6, "hi\ufffd")]
    target = str(tmp_path / "t")
    sync.write_touched(spark.createDataFrame([("a", 1), ("b", 2)], "collection string, x int"), target)
    sync.write_touched(spark.createDataFrame([("b", 3)], "collection string, x int"), target)
    assert sorted(r.x for r in spark.read.parquet(target).collect()) == [1, 3]
