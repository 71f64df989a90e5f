"""Keys as large tables have them: ids of different tables meet, and order lines share a number."""

from pathlib import Path

import duckdb
import pytest
from compare import assert_same

from termloom.plans import catalog

LINE = "SELECT * REPLACE (1::BIGINT AS l_orderkey, {part} AS l_partkey, 1 AS l_linenumber, {q}::DOUBLE AS l_quantity) FROM lineitem LIMIT 1"
FAR = "CASE {k} % 4 WHEN 0 THEN {k} WHEN 1 THEN {k} + 100000 ELSE {k} + 300000 END"
# odd customers get suppliers' ids, half of all get parts'; one part is 999999, and in the last folder one is the root
FOLDERS = {
    "far": {"customer": f"SELECT * REPLACE ({FAR.format(k='c_custkey')} AS c_custkey) FROM customer", "part": "SELECT * REPLACE (CASE p_partkey WHEN 7 THEN 399999 ELSE p_partkey END AS p_partkey) FROM part", "lineitem": "SELECT * REPLACE (CASE l_partkey WHEN 7 THEN 399999 ELSE l_partkey END AS l_partkey) FROM lineitem"},
    "tied": {"lineitem": f"({LINE.format(part=1, q=23)}) UNION ALL ({LINE.format(part=1, q=43)}) UNION ALL SELECT * FROM lineitem WHERE l_orderkey > 1"},
    "rooted": {"part": "SELECT * REPLACE (CASE p_partkey WHEN 7 THEN 300000 ELSE p_partkey END AS p_partkey) FROM part", "lineitem": "SELECT * REPLACE (CASE l_partkey WHEN 7 THEN 300000 ELSE l_partkey END AS l_partkey) FROM lineitem"},
}


@pytest.fixture(scope="module")
def folders(tmp_path_factory, data):
    made = {}
    for name, changed in FOLDERS.items():
        folder, source, con = tmp_path_factory.mktemp(name), duckdb.connect(), duckdb.connect()
        for f in Path(data).glob("*.parquet"):
            source.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
            (folder / f.name).symlink_to(f) if f.stem not in changed else source.execute(f"COPY ({changed[f.stem]}) TO '{folder / f.name}'")
            con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{folder / f.name}'")
        con.execute("SET threads = 1")  # of equals the first in the table
        made[name] = str(folder), con
    return made


@pytest.mark.parametrize("folder, name", [("tied", "coding_merge"), ("rooted", "coding_targets"), ("far", "release_diff_counts"), ("far", "release_diff_rows"), ("far", "rerank_pool"), ("far", "two_tier_labels"), ("far", "mapping_replace_refset"), ("far", "match_tiers")])
def test_query_equals_sql_where_keys_meet(folder, name, spark, folders):
    path, con = folders[folder]
    assert_same(catalog.QUERIES[name](spark, path), con, catalog.SQL[name])


def test_facts_are_shuffled_once_as_plain_lines(spark, data):
    plan = catalog.QUERIES["coding_covered"](spark, data)._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning(note_id" in line]
    assert shuffles and all("REPARTITION_BY_COL" in line for line in shuffles)


@pytest.mark.parametrize("name", ["evidence_nodes", "evidence_edges"])
def test_sentences_are_never_broadcast(name, spark, data):
    plan = catalog.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("folder", ["far", "rooted"])
def test_token_index_is_stored_by_concept_and_reads_as_by_description(folder, spark, folders):
    from termloom.operators.search import token_rows
    from termloom.sources.views import tables

    search = tables(spark, folders[folder][0]).search
    columns = ["token", "description_id", "concept_id", "tag", "concept_active", "term", "normalized", "display", "kind", "is_preferred", "term_rank"]
    rows = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert rows(search.index) == rows(search.tokens) == rows(token_rows(search.terms))
    # the stored rows keep a concept's descriptions together
    assert "inline(" in search.index._jdf.queryExecution().optimizedPlan().toString()


def test_names_are_shuffled_before_they_are_listed(spark, data):
    from termloom.operators.terms import concept_rows
    from termloom.sources.views import tables

    plan = concept_rows(tables(spark, data).names, ())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(concept_id" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_words_of_rows_that_share_an_id_count_together(spark, folders):
    path, con = folders["far"]
    assert_same(catalog.QUERIES["search_bm25_words"](spark, path), con, catalog.SQL["search_bm25_words"])
