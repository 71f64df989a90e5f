import pytest
from pyspark.sql import functions as F

from termloom.functions import text as X
from termloom.operators import search as S
from termloom.operators.evaluate import greedy_pairs
from termloom.operators.hierarchy import closure, closure_fixpoint
from termloom.operators.quality import harden
from termloom.operators.search import Tuning, match_tier
from termloom.sources import readers
from termloom.sources.views import tables
from termloom.streaming import telemetry as ST


def test_normalize_in_sql_and_python(spark):
    texts = ["Càncer  de MAMA", "día-á-día (trastorno)", "straße ñandú", "áb"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(X.normalize(F.col("t"))).collect()] == [X.normalize_text(t) for t in texts]


def test_lemmas_and_variants(spark):
    words = ["allergies", "cronicas", "lesiones", "tos", "critiques", "asthma", "basica"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(X.singular(F.col("w"))).collect()] == [X.singular_text(w) for w in words] == ["allergi", "cronico", "lesion", "tos", "critiqu", "asthma", "basico"]
    asked = ["Inflamatoris crónicas", "Diabetis tipus", "x", "", "lesiones óseas y cánceres de mama"]
    df = spark.createDataFrame([(w,) for w in asked], "w string")
    assert [r[0] for r in df.select(X.variants(F.col("w"))).collect()] == [X.query_variants(w) for w in asked]
    assert X.query_variants("inflamatoris") == ["inflamatoris", "inflamatori", "inflamatorios"]
    assert X.query_variants("Diabetis tipus")[0] == "diabetis tipus" and "diabetes tipus" in X.query_variants("Diabetis tipus")


def test_tags(spark):
    row = spark.createDataFrame([("Asthma (disorder) ",)], "t string").select(X.semantic_tag(F.col("t")), X.without_tag(F.col("t")), X.english_tag(F.lit("trastorno")), X.slug(F.lit("Body Structure"))).first()
    assert tuple(row) == ("disorder", "Asthma", "disorder", "body-structure")


def test_tiers(spark):
    df = spark.createDataFrame([("kidney disease", "kidney disease disorder", ["renal disease", "chronic renal disease stage 2"], "renal failure", "123456")], "t string, f string, s array<string>, d string, c string")
    tier = lambda q: df.select(match_tier(q, F.col("t"), F.col("f"), F.col("s"), F.col("d"), F.col("c"))).first()[0]
    asked = ("123456", "Kidney disease", "kidney", "renal disease", "kidney disease disorder", "kidneys disease", "kid", "chronic renal", "ney dis", "disorder", "renal failure", "disease kidney", "xyz")
    assert [tier(q) for q in asked] == [0, 1, 2, 3, 4, 1, 6, 7, 8, 9, 10, 11, 11]


def test_specificity_and_clauses(spark):
    df = spark.createDataFrame([("pain with nonacute fever", "pain disorder")], "t string, f string")
    assert df.select(S.specificity("acute pain", F.col("t"), F.col("f"))).first()[0] == 80 + 3.0 + 2 + 8 + 1.4
    assert S.plan_clauses("ab") == S.Clauses(False, 11, False, (), ()) and S.plan_clauses("abc").fuzzy and S.plan_clauses("1234").concept_id
    assert S.plan_clauses("red widgets").phrases == (("red widgets", 18, 15), ("red widget", 16, 13))


def test_rerank_keeps_what_the_pool_leaves_out(spark):
    fused = spark.createDataFrame([(str(k), 1.0 - k / 100, "aim" if k == 4 else "x") for k in range(30)], "concept_id string, score double, text string")
    got = [r.concept_id for r in S.rerank(fused, S.overlap_scorer, "text", "aim", 5, 20).collect()]
    assert got == ["4", "0", "1", "2", "3", *map(str, range(5, 20))]


def test_lookups_reach_the_stored_files(spark, data):
    search = tables(spark, data).search
    plan = S.exact_description(search, "hot rod", S.Filters())._jdf.queryExecution().toString()
    assert "EqualTo(normalized,hot rod)" in plan
    found = S.candidate_rows(search, "hot rod")
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "token" in plan.split("PushedFilters")[1][:400]
    every = {r.description_id for r in S.searchable(search.terms).where("normalized LIKE '%hot rod%'").collect()}
    assert every <= {r.description_id for r in found.collect()} and every


def test_embeddings_are_made_once(spark):
    rows = spark.createDataFrame([(1, "a b", None), (2, None, None), (3, "c", [1.0] * 16)], "k int, embed_text string, vector array<double>")
    out = {r.k: r.vector for r in S.embedded(rows, S.hashed_embedding, 16).collect()}
    assert out[1] == S.hashed_embedding(["a b"])[0] and out[2] is None and out[3] == [1.0] * 16


def test_tuning_is_clamped():
    assert Tuning.of(0, 0, 0, 1) == Tuning(0.55, 0.45, 1, 5)


def test_closure_takes_the_shortest_way_and_both_forms_agree(spark):
    edges = spark.createDataFrame([("d", "b"), ("d", "c"), ("b", "a"), ("c", "b"), ("e", "d")], "child string, parent string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert ("d", "b", 1) in rows(closure(edges, 4))
    assert rows(closure(edges, 6)) == rows(closure_fixpoint(edges))


def test_harden(spark):
    raw = spark.createDataFrame([(1, "TRUE"), (2, "no"), (3, None)], "concept_id long, active string")
    assert [tuple(r) for r in harden(raw).select("concept_id", "active").collect()] == [("1", True), ("2", False), ("3", False)]


def test_greedy_matching_prefers_equal_subject_and_polarity():
    facts = [{"phrase": "asthma", "assertion": "absent", "subject": "patient"}, {"phrase": "asthma", "assertion": "present", "subject": "patient"}]
    mentions = [{"phrase": "Asthma", "assertion": "present", "subject": "patient"}, {"phrase": "asthma attack", "assertion": "present", "subject": "family"}]
    assert greedy_pairs(facts, mentions) == [(0, 0), (1, 1)]
    same = [{"phrase": "asthma", "assertion": "historical", "subject": "patient"}, {"phrase": "asthma", "assertion": "absent", "subject": "patient"}]
    assert greedy_pairs([facts[0]], same) == [(0, 1)] and greedy_pairs(facts, []) == []


def test_map_snapshot_reader_and_sinks(spark, tmp_path):
    path = tmp_path / "map_Snapshot.txt"
    path.write_text("﻿id\tactive\trefsetId\treferencedComponentId\tmapTarget\tmapGroup\nx\t1\t447562003\t600001\tA1\t2\n")
    row = readers.read_map_snapshot(spark, str(path)).first()
    assert (row.concept_id, row.active, row.map_target, row.map_group, row.map_rule) == ("600001", True, "A1", 2, None)
    with pytest.raises(ValueError):
        readers.read_map_snapshot(spark, str(tmp_path / "map_Full.txt"))
    old, new = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]))
    assert sorted(map(tuple, readers.upserted(old, new, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, readers.by_priority(old, new, key="k").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert [tuple(r) for r in readers.deleted(old, new, "k").collect()] == [(1, "a")]


def test_upserts_refuse_a_key_twice(spark):
    old, new = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(2, "b"), (2, "c")], "k int, v string")
    with pytest.raises(Exception, match="several new rows have the key 2"):
        readers.upserted(old, new, "k").collect()


def test_releases_are_replaced_one_by_one(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = lambda *x: spark.createDataFrame(list(x), "k int, v string, release_id string")
    read = lambda: sorted(tuple(r) for r in spark.read.schema("k int, v string, release_id string").parquet(path).collect())
    readers.reset(rows((1, "a", "r1"), (2, "b", "r1"), (3, "c", "r2")), path)
    readers.upsert_release(spark, rows((2, "x", "r1"), (4, "y", "r1")), path, "k")
    assert read() == [(1, "a", "r1"), (2, "x", "r1"), (3, "c", "r2"), (4, "y", "r1")]
    readers.replace_release(rows((9, "z", "r2")), path)
    readers.clear_release(spark, path, "r1")
    readers.appended(rows((5, "n", "r2")).drop("release_id"), f"{path}/release_id=r2")
    assert read() == [(5, "n", "r2"), (9, "z", "r2")]


def test_captured_runs(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"n{k}-hybrid.json").write_text('{"note": "%d",\n "mentions": [{"id": "m"}]}' % k)
    (tmp_path / "n9-lexical.json").write_text('{"note": "9"}')
    got = readers.read_captured_runs(spark, str(tmp_path), "note string, mentions array<struct<id:string>>").orderBy("run").collect()
    assert [(r.run, r.note, len(r.mentions)) for r in got] == [(f"n{k}-hybrid.json", str(k), 1) for k in range(3)]


def test_map_members_are_fetched_by_page(spark):
    def fetch(concept, offset, limit):
        members = [{"refsetId": "447562003", "active": True, "referencedComponentId": concept, "effectiveTime": "20240101", "additionalFields": {"mapTarget": f"A{k}", "mapGroup": "1", "mapPriority": str(k), "mapRule": "TRUE"}} for k in range(int(concept) % 5)]
        return members[offset : offset + limit]

    ids = [str(600000 + k) for k in range(70)]
    rows = readers.map_member_source(spark, fetch, ids, page=2).collect()
    assert len(rows) == sum(int(x) % 5 for x in ids) and {r.map_target for r in rows if r.concept_id == "600004"} == {"A0", "A1", "A2", "A3"}
    assert {r.provenance for r in rows if r.concept_id == "600004"} == {"600004@0", "600004@2"}


def test_retired_tables_are_only_listed(spark):
    spark.range(1).write.mode("overwrite").saveAsTable("retired_one")
    assert readers.retired_tables(spark, ["retired_one", "other"]) == ["retired_one"] and spark.catalog.tableExists("retired_one")
    assert readers.retired_tables(spark, ["retired_one"], drop=True) == ["retired_one"] and not spark.catalog.tableExists("retired_one")


def test_long_value_lists_are_cut_from_plans(spark):
    df = spark.range(9).where(F.col("id").isin(*range(200)))
    text = readers.redacted_plan(df)
    assert "200 values" in text and "199" not in text


def test_stream_of_events(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), F.col("user_id").alias("actor_id"), "event_type", F.col("value").alias("duration_ms"))
    events.union(events.limit(50)).repartition(1).write.parquet(str(tmp_path / "in"))
    stream = ST.windowed_counts(ST.deduplicated(ST.read_events(spark, str(tmp_path / "in"), events.schema), "1 hour"), "1 day")
    query = ST.append_to(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert query.exception() is None
    out = spark.read.parquet(str(tmp_path / "out"))
    last = events.agg(F.max("at")).first()[0]
    closed = events.where(F.window("at", "1 day").end <= F.lit(last) - F.expr("INTERVAL 1 HOUR")).count()
    assert out.agg(F.sum("n")).first()[0] == closed > 0


def test_closure_joins_no_level_of_what_is_no_parent(spark, monkeypatch):
    """Leaves take over their parents' ancestors; a cycle's concepts are above themselves."""
    from termloom.operators import hierarchy

    seen, levels = [], hierarchy._levels
    monkeypatch.setattr(hierarchy, "_levels", lambda edges, limit: (seen.append({r.child for r in edges.collect()}), levels(edges, limit))[1])
    pairs = [("a", "r"), ("b", "a"), ("r", "b"), *((f"leaf{k}", p) for k in range(20) for p in ("a", "b"))]
    found = {tuple(r) for r in hierarchy.closure_fixpoint(spark.createDataFrame(pairs, "child string, parent string")).collect()}
    assert seen == [{"a", "b", "r"}]
    ring = {("a", "r", 1), ("a", "b", 2), ("a", "a", 3), ("b", "a", 1), ("b", "r", 2), ("b", "b", 3), ("r", "b", 1), ("r", "a", 2), ("r", "r", 3)}
    assert found == ring | {(f"leaf{k}", *x) for k in range(20) for x in (("a", 1), ("b", 1), ("r", 2))}
