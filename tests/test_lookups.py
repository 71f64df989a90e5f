import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from termloom.functions.text import locale_order
from termloom.operators import rerank as K
from termloom.sources import lookups as L
from termloom.sources.results import Results
from termloom.sources.storage import stored


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def scanned(df) -> int:
    """Rows that the scans of a query gave, after row groups were skipped."""
    df.collect()

    def walk(node):
        below = [node.plan()] if "QueryStage" in node.nodeName() else [node.children().apply(k) for k in range(node.children().size())]
        return [node] + [x for child in below for x in walk(child)]

    top = df._jdf.queryExecution().executedPlan()
    nodes = walk(top.executedPlan() if "Adaptive" in top.nodeName() else top)
    return sum(n.metrics().apply("numOutputRows").value() for n in nodes if "Scan parquet" in n.nodeName())


@pytest.fixture(scope="module")
def releases(spark, tmp_path_factory):
    # code is spread over all files: neither order nor least and greatest values help
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("concept_id"), F.sha2(F.col("id").cast("string"), 256).alias("code"), F.when(F.col("id") % 2 == 0, "r1").otherwise("r2").alias("release_id"))
    path = str(tmp_path_factory.mktemp("keyed") / "t")
    return path, L.keyed(rows, path, "concept_id", "concept_id", "code", distinct=5_000, partitions=8)


def test_bloom_filters_skip_row_groups(spark, releases):
    path, rows = releases
    code = rows.where("concept_id = '777'").first().code
    found = L.looked_up(rows, "code", [code, code])
    assert [r.concept_id for r in found.collect()] == ["777"]
    assert 0 < scanned(L.looked_up(rows, "code", [code])) < 6_000  # of 20,000, in eight files or more
    assert scanned(L.looked_up(rows, "code", ["0" * 64])) == 0


def test_lists_of_any_length_give_the_same(spark, releases):
    _, rows = releases
    ids = [str(k) for k in range(0, 900, 3)] + ["none", None, "3"]
    short, long = L.looked_up(rows, "concept_id", ids, longest=1000), L.looked_up(rows, "concept_id", ids, longest=10)
    table = L.looked_up(rows, "concept_id", spark.createDataFrame([(x,) for x in ids], "x string"))
    same = sorted(tuple(r) for r in short.collect())
    assert len(same) == 300 and same == sorted(tuple(r) for r in long.collect()) == sorted(tuple(r) for r in table.collect())
    assert "LeftSemi" in plan(long) and "LeftSemi" not in plan(short)
    assert L.looked_up(rows, "concept_id", []).count() == 0 == L.looked_up(rows, "concept_id", [None]).count()


def test_releases_are_pruned_while_the_query_runs(spark, releases):
    _, rows = releases
    table = stored(spark.createDataFrame([("r1", "old"), ("r2", "current")], "release_id string, state string"), "states")
    found = L.in_release(rows, table, "state = 'current'")
    assert found.count() == 10_000 and {r.release_id for r in found.select("release_id").distinct().collect()} == {"r2"}
    assert "dynamicpruning" in plan(found)
    assert scanned(found) == 10_000 + 1  # and the one release


def test_counts_come_from_footers(spark, data):
    found = L.footers(spark, f"{data}/lineitem.parquet", "l_orderkey")
    assert "PushedAggregation: [COUNT(*)" in plan(found)
    rows = pq.read_table(f"{data}/lineitem.parquet", columns=["l_orderkey"])["l_orderkey"].to_pylist()
    assert tuple(found.first()) == (len(rows), min(rows), max(rows))
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_kept_results_run_out(spark, tmp_path):
    now, runs = [1000.0], []

    def ask():
        runs.append(1)
        return spark.range(len(runs)).withColumn("x", F.lit("a"))

    kept = Results(spark, f"file://{tmp_path}/kept", 600, lambda: now[0])
    request = {"q": "ñ", "limit": 5}
    assert kept.of(request, ask).count() == 1 == kept.of({"limit": 5, "q": "ñ"}, ask).count() and len(runs) == 1
    assert Results(spark, f"file://{tmp_path}/kept", 600, lambda: now[0]).of(request, ask).count() == 1 and len(runs) == 1
    assert kept.of({"q": "ñ", "limit": 6}, ask).count() == 2
    now[0] += 600
    assert kept.of(request, ask).count() == 3 and len(runs) == 3
    assert kept.forget(grace=60) == 0
    now[0] += 100
    assert kept.forget(grace=60) == 2 and kept.of(request, ask).count() == 3
    (tmp_path / "kept" / Results.fingerprint({"q": "lost"}) / f"at-{int(now[0] * 1000)}-x").mkdir(parents=True)  # a job that was lost
    assert kept.of({"q": "lost"}, ask).count() == 4


def test_failed_calls_keep_the_fused_order(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def service(query, texts):
        import uuid

        (log / f"{query}-{len(texts)}-{uuid.uuid4().hex}").touch()
        if query == "down":
            raise TimeoutError("no answer")
        if query == "odd":
            return [(99, 1.0)]
        if query == "nan":
            return [(0, float("nan"))]
        return [(k, float(len(x))) for k, x in enumerate(texts) if x != "left out"]

    rows = [(q, q, f"c{k}", float(10 - k), None if k == 2 else "left out" if k == 1 else "x" * k) for q in ("up", "down", "odd", "nan") for k in range(9)]
    fused = spark.createDataFrame(rows, "query_id string, query string, concept_id string, score double, text string")
    got = K.reranked(fused, service, pool=5, limit=7).orderBy("query_id", "place").collect()
    order = lambda q: [r.concept_id for r in got if r.query_id == q]
    assert order("up") == ["c4", "c3", "c0", "c2", "c1", "c5", "c6"]
    for q in ("down", "odd", "nan"):
        assert order(q) == [f"c{k}" for k in range(7)] and {r.outcome for r in got if r.query_id == q} == {"unavailable"} and all(r.relevance is None for r in got if r.query_id == q)
    names = [f.name for f in log.iterdir()]
    assert sum(n.startswith("up-5-") for n in names) == 1 and sum(n.startswith("down-5-") for n in names) == K.TRIES and all("-5-" in n for n in names)
    assert K.reranked(fused.where("false"), service, 5, 7).count() == 0
    with pytest.raises(ValueError, match="pool"):
        K.reranked(fused, service, 0, 7)


def test_what_the_service_reads(spark):
    rows = spark.createDataFrame([("a", "t", "a"), ("a", None, "a (t)"), (None, "t", None)], "term string, tag string, fsn string")
    assert [r[0] for r in rows.select(K.service_text()).collect()] == ["a (t)", "a — a (t)", "(t)"]


def test_locale_order(spark):
    words = ["ñu", "nz", "Ola", "na", "Ñandú", "árbol", "Arco", "arco", "zeta", "Éter", "eter"]
    rows = spark.createDataFrame([(w, x) for w in words for x in ("es", "en", None)], "term string, language string")
    got = [(r.term, r.language) for r in rows.orderBy("language", *locale_order(F.col("term"), F.col("language"))).collect()]
    assert [w for w, x in got if x == "es"] == ["árbol", "arco", "Arco", "eter", "Éter", "na", "nz", "Ñandú", "ñu", "Ola", "zeta"]
    assert [w for w, x in got if x == "en"] == ["árbol", "arco", "Arco", "eter", "Éter", "na", "Ñandú", "ñu", "nz", "Ola", "zeta"] == [w for w, x in got if x is None]
