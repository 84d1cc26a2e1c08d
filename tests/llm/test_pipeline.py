"""The pipeline: each stage does its job on all that the one before it kept."""

import corpus_pipeline as P
from corpusmill.llm import contamination, jaccard, quality
from corpusmill.llm.common import materialize

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    a = materialize(P.STAGES[0][1](spark, docs, SMALL), "t")
    verdict, _ = quality.supervise(quality.measured(docs))
    assert {r.doc_id for r in a.collect()} == {r.doc_id for r in verdict.filter("kept").collect()} and a.columns == columns
    b = materialize(P.STAGES[1][1](spark, a, SMALL), "t")
    groups = jaccard.jaccard_components(a, k=5, percent=80).collect()
    assert sorted(r.doc_id for r in b.collect()) == sorted({r.component_id for r in groups}) and b.columns == columns
    c = materialize(P.STAGES[2][1](spark, b, SMALL), "t")
    hit = contamination.find_contamination(b, bench).selectExpr("doc_id", f"{contamination.N_HIT} as n", "n_words").collect()
    assert {r.doc_id for r in c.collect()} == {r.doc_id for r in hit if not (r.n and 20 * r.n >= r.n_words)} and c.columns == columns
    d = materialize(P.STAGES[3][1](spark, c, SMALL), "t")
    assert d.columns == columns and 0 < d.count() and {r.doc_id for r in d.collect()} <= {r.doc_id for r in c.collect()}
    e = P.STAGES[4][1](spark, d, SMALL).collect()
    assert len(e) == d.count() and len({(r.shard, r.slot) for r in e}) == len(e)


def test_run_is_its_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SMALL), "t")
    want = P.STAGES[-1][1](spark, docs, SMALL)
    assert sorted(map(tuple, P.run(spark, SMALL).collect())) == sorted(map(tuple, want.collect()))


def test_stages_on_empty_tables_and_clashing_columns(spark):
    clash = "doc_id long, text string, lang string, source string, n_chars long, __id int, __text string, __hash long, __source int, __nth int, __position double, __row int, __w int, q string, doc string, k1 int, h1 int, block int, class string, position int, shard2 map<string,int>"
    rows = [(i, t, "en", None, 1, 5, "x", 6, 7, 8, 0.5, 9, 10, "q", "d", 11, 12, 13, "c", 14, {"a": 1}) for i, t in enumerate(["word " * 3, None, "", *(f"the one {i} and two of three {i} or four in five {i} six" for i in range(30))])]
    docs = spark.createDataFrame([*rows, rows[5], (None, *rows[6][1:])], clash)
    for name, stage in P.STAGES[:-1]:
        out = materialize(stage(spark, docs, SMALL), "t")
        assert out.columns == docs.columns, name
        assert {str(r[5:]) for r in out.collect()} <= {str(tuple(rows[0][5:]))}, name
        assert stage(spark, docs.filter("false"), SMALL).count() == 0, name
    assert len(materialize(P.STAGES[1][1](spark, docs, SMALL), "t").collect()) == len(rows)
    assert P.STAGES[-1][1](spark, docs, SMALL).count() == len(rows) + 2
    assert P.STAGES[-1][1](spark, docs.filter("false"), SMALL).count() == 0
