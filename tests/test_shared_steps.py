"""Steps that many queries share: what is shuffled, stored and worked out once."""

from termloom.plans import catalog


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_tag_is_matched_once_and_ranks_are_stored(spark, data):
    assert optimized(catalog.QUERIES["diagnosis_rank"](spark, data)).count("^hallazgo$") == 1
    assert "Window" not in optimized(catalog.QUERIES["diagnosis_split"](spark, data))


def test_notes_list_plain_lines_and_equal_the_codings(spark, data):
    from termloom.sources.views import Tables

    t = Tables(spark, data)
    nested = t.notes.selectExpr("note_id", "inline(codings)")
    assert "codings" not in vars(t)  # so none are stored for it, nor shuffled with their names
    assert nested.exceptAll(t.codings.select(nested.columns)).isEmpty() and t.codings.select(nested.columns).exceptAll(nested).isEmpty()


def test_both_sides_of_a_difference_are_asked_in_one_pass(spark, data):
    plan = optimized(catalog.QUERIES["cohort_false_positive_negative"](spark, data))
    assert plan.count("Relation [") == 1 and "Aggregate" not in plan


def test_exact_nearest_rows_need_no_index(spark, data):
    from termloom.plans.catalog_text import vector_nearest_join
    from termloom.sources.views import Tables

    t = Tables(spark, data)
    assert vector_nearest_join(t).count() > 0 and "vectors" not in vars(t)


def test_mentions_of_a_sentence_meet_without_a_join(spark, data):
    assert optimized(catalog.QUERIES["linked_mentions"](spark, data)).count("Join") == 2  # parts with their types, lines with their parts


def test_rows_of_a_text_read_before_are_taken_from_columns(spark, data):
    from termloom.operators import notes as N

    found = N.phrases(spark.createDataFrame([(1, "Red bolt. Hot rod."), (2, None), (3, "Red bolt. Hot rod."), (4, "x" * 700 + " big gear")], "id long, text string").coalesce(1), "id", "text")
    assert "MapInArrow" in optimized(found)
    rows = [tuple(r) for r in found.collect()]
    assert [r[1:] for r in rows if r[0] == 1] == [r[1:] for r in rows if r[0] == 3] == N.phrases_of("Red bolt. Hot rod.")
    assert [r[1:] for r in rows if r[0] == 4] == N.phrases_of("x" * 700 + " big gear") and {r[0] for r in rows} == {1, 3, 4}


def test_an_expression_needs_neither_the_closure_nor_all_attributes(spark, data):
    from termloom.plans.catalog_hierarchy import EXPRESSIONS, space
    from termloom.sources.views import Tables

    t = Tables(spark, data)
    found = space(t).compile(EXPRESSIONS["ecl_refinement"][0])
    assert found.count() > 0 and not {"closure", "attributes"} & set(vars(t))
    # values of an attribute are stored before edges meet them; edges are read as they lie in the table
    assert {"values", "lineitem.parquet"} <= {part.split("-")[0] for f in found.inputFiles() for part in f.split("/")[-2:]}


def test_lineage_has_the_pairs_of_the_closure(spark):
    from termloom.operators import hierarchy

    pairs = [("a", "r"), ("b", "a"), ("r", "b"), ("a", "r"), ("x", "y"), ("z", None), *((f"leaf{k}", p) for k in range(5) for p in ("a", "b", "x"))]
    edges = spark.createDataFrame(pairs, "child string, parent string")
    inner = hierarchy.closure_of_parents(edges)
    found = {tuple(r) for r in hierarchy.lineage(edges, inner).collect()}
    assert {r.concept_id for r in inner.collect()} == {"a", "b", "r", "x"} and ("leaf0", "y") in found and ("a", "a") in found
    assert found == {(r.concept_id, r.ancestor_id) for r in hierarchy.closure_fixpoint(edges).collect()}
    assert sorted(map(str, hierarchy.taken_over(edges, inner).collect())) == sorted(map(str, hierarchy.closure_fixpoint(edges).collect()))


def test_pairs_of_the_closure_are_grouped_where_their_edges_lie(spark, data):
    from termloom.operators.hierarchy import taken_over
    from termloom.sources.views import Tables

    t = Tables(spark, data)
    plan = taken_over(t.edges, t.closure_of_parents)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan and not any("ancestor_id" in line and "Exchange hashpartitioning" in line for line in plan.splitlines())
