"""Hierarchy over a DAG of child and parent ids: closure, descendants, walks, paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import stored


def closure(edges: DataFrame, max_depth: int) -> DataFrame:
    """concept_id, ancestor_id, depth of the shortest way, for ways of up to max_depth levels: the
    depth is the caller's limit. closure_fixpoint has none.

    A chain of joins of known length: one lazy plan, no job per level. Where several ways
    meet, the shortest counts.
    """
    step = edges.select(F.col("child").alias("c"), F.col("parent").alias("p"))
    levels = [edges.select(F.col("child").alias("concept_id"), F.col("parent").alias("ancestor_id"), F.lit(1).alias("depth"))]
    for depth in range(2, max_depth + 1):
        last = levels[-1]
        levels.append(last.join(step, last.ancestor_id == step.c).select("concept_id", F.col("p").alias("ancestor_id"), F.lit(depth).alias("depth")))
    return reduce(DataFrame.unionByName, levels).groupBy("concept_id", "ancestor_id").agg(F.min("depth").alias("depth"))


def closure_fixpoint(edges: DataFrame, limit: int = 64) -> DataFrame:
    """The whole closure of a hierarchy of any depth: that of the concepts that are a parent, and what
    the others take over from it."""
    every = stored(edges.select("child", "parent").distinct(), "edges")
    return taken_over(every, closure_of_parents(every, limit))


def closure_of_parents(edges: DataFrame, limit: int = 64) -> DataFrame:
    """The closure of the concepts that are a parent. What is above a concept is its parents and what is
    above them, so only for these, which are few, levels are worked out."""
    parents = stored(edges.select(F.col("parent").alias("child")).distinct(), "parents")
    return stored(_levels(edges.select("child", "parent").join(parents, "child", "left_semi").distinct(), limit - 1), "closure-inner")


def taken_over(edges: DataFrame, inner: DataFrame) -> DataFrame:
    """The whole closure: that of the concepts that are a parent, and of each other concept its parents
    and their ancestors, in one step. Edges are shuffled by child before they become many pairs, which
    then are grouped where they are."""
    leaves = edges.join(inner.select(F.col("concept_id").alias("child")).distinct(), "child", "left_anti").repartition("child")
    own = F.array(F.struct(F.col("parent").alias("ancestor_id"), F.lit(1).alias("depth")))
    above = inner.groupBy(F.col("concept_id").alias("parent")).agg(F.collect_list(F.struct("ancestor_id", (F.col("depth") + 1).alias("depth"))).alias("above"))
    each = leaves.join(above, "parent", "left").select(F.col("child").alias("concept_id"), F.inline(F.concat(own, F.coalesce("above", F.array().cast("array<struct<ancestor_id:string,depth:int>>")))))
    return inner.unionByName(each.groupBy("concept_id", "ancestor_id").agg(F.min("depth").alias("depth")))


def lineage(edges: DataFrame, inner: DataFrame) -> DataFrame:
    """concept_id, ancestor_id of the whole closure, a pair once for each parent that it goes through.
    Nothing is stored or grouped: of one ancestor only the edges below it are read."""
    above = inner.select(F.col("concept_id").alias("parent"), "ancestor_id")
    through = edges.join(above, "parent").select(F.col("child").alias("concept_id"), "ancestor_id")
    return edges.select(F.col("child").alias("concept_id"), F.col("parent").alias("ancestor_id")).unionByName(through)


def _levels(edges: DataFrame, limit: int) -> DataFrame:
    """The closure, one level per job until no pair is new. Each level is stored by itself, so what
    is known is read again but never written twice."""
    step = stored(edges.select(F.col("child").alias("c"), F.col("parent").alias("p")), "step")
    levels = [step.select(F.col("c").alias("concept_id"), F.col("p").alias("ancestor_id"), F.lit(1).alias("depth"))]
    for depth in range(2, limit + 1):
        found = levels[-1].join(step, F.col("ancestor_id") == F.col("c")).select("concept_id", F.col("p").alias("ancestor_id"), F.lit(depth).alias("depth")).distinct()
        known = reduce(DataFrame.unionByName, levels)
        fresh = stored(found.join(known.select("concept_id", "ancestor_id"), ["concept_id", "ancestor_id"], "left_anti"), "level")
        if fresh.isEmpty():
            return known
        levels.append(fresh)
    raise ValueError(f"no end of the hierarchy within {limit + 1} levels")


def descendants(closed: DataFrame, concepts: DataFrame, concept_id: str, include_self: bool = True) -> DataFrame:
    """concept_id of active concepts under one; with include_self the concept itself, even if
    it is unknown or inactive."""
    active = concepts.where("active").select("concept_id")
    below = closed.where(F.col("ancestor_id") == concept_id).select("concept_id").join(active, "concept_id", "left_semi").where(F.col("concept_id") != concept_id)
    if not include_self:
        return below.distinct()
    own = concepts.sparkSession.range(1).select(F.lit(concept_id).alias("concept_id"))
    return below.unionByName(own).distinct()


def graph_lookup(closed: DataFrame, concepts: DataFrame, concept_id: str, up: bool, max_depth: int, limit: int) -> DataFrame:
    """Active concepts above or below one with hop counts; parents or children have depth 0."""
    this, other = ("concept_id", "ancestor_id") if up else ("ancestor_id", "concept_id")
    found = closed.where((F.col(this) == concept_id) & (F.col("depth") <= max_depth + 1)).select(F.col(other).alias("found"), (F.col("depth") - 1).alias("depth"))
    kept = found.join(concepts.where("active"), found["found"] == concepts["concept_id"]).select("concept_id", "name", "depth")
    return kept.orderBy("depth", "concept_id").limit(limit)


def ancestor_walk(edges: DataFrame, concepts: DataFrame, concept_id: str, max_depth: int, limit: int, fan_out: int = 24) -> DataFrame:
    """Level-by-level walk upwards; each node passes on at most fan_out parents; inactive ones count."""
    parents = edges.withColumn("k", F.row_number().over(Window.partitionBy("child").orderBy("parent"))).where(F.col("k") <= fan_out).select("child", "parent")
    levels = [parents.where(F.col("child") == concept_id).select(F.col("parent").alias("found"), F.lit(0).alias("depth"))]
    for depth in range(1, max_depth + 1):
        levels.append(levels[-1].join(parents, F.col("found") == F.col("child")).select(F.col("parent").alias("found"), F.lit(depth).alias("depth")))
    seen = reduce(DataFrame.unionByName, levels).groupBy("found").agg(F.min("depth").alias("depth"))
    return seen.join(concepts, seen["found"] == concepts["concept_id"]).select("concept_id", "name", "active", "depth").orderBy("depth", "concept_id").limit(limit)


def preferred_parent(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """child, parent: for each child the parent with fewest parents, then by name in locale order, then id."""
    n_parents = edges.groupBy("child").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("child", "of")
    named = edges.join(concepts.select(F.col("concept_id").alias("parent"), F.collate(F.lower("name"), "UNICODE").alias("parent_name")), "parent").join(n_parents, F.col("parent") == F.col("of"), "left")
    rank = F.row_number().over(Window.partitionBy("child").orderBy(F.coalesce("n", F.lit(0)), "parent_name", "parent"))
    return named.withColumn("k", rank).where("k = 1").select("child", "parent")


def primary_path(edges: DataFrame, concepts: DataFrame, closed: DataFrame, concept_id: str) -> DataFrame:
    """Chain of preferred parents from the concept upwards: step 0 is the concept. Only the edges
    of the concept and what lies above it are looked at; the way is as long as the hierarchy."""
    spark = edges.sparkSession
    own = spark.range(1).select(F.lit(concept_id).alias("child"))
    above = closed.where(F.col("concept_id") == concept_id)
    within = stored(edges.join(own.unionByName(above.select(F.col("ancestor_id").alias("child"))), "child", "left_semi"), "path-edges")
    chosen = stored(preferred_parent(within, concepts), "path-parents")
    longest = chosen.count()
    steps = [own.select(F.col("child").alias("concept_id"), F.lit(0).alias("step"))]
    for k in range(1, longest + 1):
        steps.append(steps[-1].join(chosen, F.col("concept_id") == F.col("child")).select(F.col("parent").alias("concept_id"), F.lit(k).alias("step")))
        if k % 8 == 0:
            steps[-1] = stored(steps[-1], "path")
            if steps[-1].isEmpty():
                break
    return reduce(DataFrame.unionByName, steps)


def subsumes(closed: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs of concept_id, other_id: whether the concept is the other or below it."""
    up = closed.select(F.col("concept_id"), F.col("ancestor_id").alias("other_id"), F.lit(True).alias("below"))
    return pairs.join(up, ["concept_id", "other_id"], "left").select("concept_id", "other_id", ((F.col("concept_id") == F.col("other_id")) | F.coalesce("below", F.lit(False))).alias("subsumed"))


def by_relation(closed: DataFrame, edges: DataFrame, concepts: DataFrame, concept_id: str, relation: str, cap: int) -> DataFrame:
    """descendants, children, parents, ancestors or self, at most cap ids in order of id."""
    if relation == "self":
        ids = concepts.where(F.col("concept_id") == concept_id).select("concept_id")
    elif relation == "descendants":
        ids = descendants(closed, concepts, concept_id)
    elif relation == "ancestors":
        ids = closed.where(F.col("concept_id") == concept_id).select(F.col("ancestor_id").alias("concept_id"))
    elif relation in ("children", "parents"):
        this, other = ("parent", "child") if relation == "children" else ("child", "parent")
        ids = edges.where(F.col(this) == concept_id).select(F.col(other).alias("concept_id"))
    else:
        raise ValueError(f"unknown relation {relation!r}")
    return ids.orderBy("concept_id").limit(cap)


def family_roots(ids: DataFrame, closed: DataFrame) -> DataFrame:
    """ids without those that have an ancestor among them."""
    covered = closed.join(ids.select(F.col("concept_id").alias("ancestor_id")), "ancestor_id", "left_semi").select("concept_id")
    return ids.join(covered, "concept_id", "left_anti")


def top_roots(closed: DataFrame, roots: dict[str, str], most: int = 12) -> DataFrame:
    """concept_id, area_tags: names of the configured roots above each concept, in order of id."""
    names = F.create_map(*(F.lit(x) for pair in roots.items() for x in pair))
    found = closed.where(F.col("ancestor_id").isin(*roots)).groupBy("concept_id").agg(F.slice(F.array_sort(F.collect_set("ancestor_id")), 1, most).alias("ids"))
    return found.select("concept_id", F.array_join(F.transform("ids", lambda x: names[x]), ",").alias("area_tags"))


def branch_caps(branches: DataFrame, per_branch: int, total: int) -> DataFrame:
    """branch (its order), concept_id: the first per_branch of each, first total over all."""
    own = F.row_number().over(Window.partitionBy("branch").orderBy("concept_id"))
    capped = branches.withColumn("place", own).where(F.col("place") <= per_branch)
    return capped.orderBy("branch", "place").limit(total)


MOST_NEIGHBOURS, MOST_PARENTS, MOST_RELATIONSHIPS, MOST_PREVIEWED = 24, 20, 40, 25
IS_A = "116680003"


def _first(df: DataFrame, key: str, other: str, most: int) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(other))).where(F.col("_k") <= most).drop("_k")


def with_neighbours(nodes: DataFrame, edges: DataFrame, most: int = MOST_NEIGHBOURS) -> DataFrame:
    """nodes (concept_id, ...) with parent_ids and child_ids, the first so many of each by id."""
    out = nodes
    for name, this, other in (("parent_ids", "child", "parent"), ("child_ids", "parent", "child")):
        own = edges.join(nodes.select(F.col("concept_id").alias(this)).distinct(), this, "left_semi")
        listed = _first(own, this, other, most).groupBy(this).agg(F.array_sort(F.collect_list(other)).alias(name)).withColumnRenamed(this, "concept_id")
        out = out.join(listed, "concept_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


def concept_view(ids: DataFrame, concepts: DataFrame, edges: DataFrame, attributes: DataFrame, child_limit: int = 20) -> DataFrame:
    """A row for each of ids (concept_id): parents, children and previewed relationships as sorted
    arrays. At most MOST_PARENTS parents and child_limit children by id, those unknown left out;
    of MOST_RELATIONSHIPS relationships the first MOST_PREVIEWED: is-a first, then by type's and
    destination's term. concepts: concept_id, name. attributes: source_id, type_id, destination_id."""
    named = lambda x: concepts.select(F.col("concept_id").alias(x), F.col("name").alias(f"{x}_name"))
    linked = lambda this, other, most, name: _first(edges.join(ids.select(F.col("concept_id").alias(this)), this, "left_semi"), this, other, most).join(named(other), other).groupBy(F.col(this).alias("concept_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.lower(f"{other}_name").alias("l"), other, f"{other}_name"))), lambda x: x[f"{other}_name"]).alias(name))
    defining = edges.select(F.col("child").alias("concept_id"), F.lit(IS_A).alias("type_id"), F.col("parent").alias("to_id"))
    others = attributes.select(F.col("source_id").alias("concept_id"), "type_id", F.col("destination_id").alias("to_id"))
    related = defining.unionByName(others).join(ids.select("concept_id"), "concept_id", "left_semi")
    order = Window.partitionBy("concept_id").orderBy("type_id", "to_id")
    kept = related.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= MOST_RELATIONSHIPS)
    labelled = kept.join(named("to_id"), "to_id", "left").join(concepts.select(F.col("concept_id").alias("_t"), F.col("name").alias("_type")), F.col("type_id") == F.col("_t"), "left")
    type_term = F.when(F.col("type_id") == IS_A, "Is a").otherwise(F.coalesce("_type", "type_id"))
    key = F.struct(F.when(F.col("type_id") == IS_A, 0).otherwise(1).alias("o"), type_term.alias("type_term"), F.coalesce("to_id_name", "to_id").alias("term"), "to_id", "type_id")
    preview = labelled.groupBy("concept_id").agg(F.slice(F.array_sort(F.collect_list(key)), 1, MOST_PREVIEWED).alias("relationships"), F.count(F.lit(1)).alias("relationship_count"))
    none = F.array().cast("array<string>")
    own = ids.select("concept_id").join(concepts.select("concept_id", "name", "active"), "concept_id")
    whole = own.join(linked("child", "parent", MOST_PARENTS, "parents"), "concept_id", "left").join(linked("parent", "child", child_limit, "children"), "concept_id", "left").join(preview, "concept_id", "left")
    return whole.withColumns({"parents": F.coalesce("parents", none), "children": F.coalesce("children", none), "relationship_count": F.coalesce("relationship_count", F.lit(0))})


def concept_summaries(ids: DataFrame, concepts: DataFrame, labels: DataFrame, closed: DataFrame) -> DataFrame:
    """A row for each of ids: term, tag, active and ancestor_ids, itself first. An unknown id is its
    own term and has no tag and no state. labels: concept_id, label."""
    up = closed.join(ids.select("concept_id"), "concept_id", "left_semi").groupBy("concept_id").agg(F.array_sort(F.collect_set("ancestor_id")).alias("_up"))
    joined = ids.select("concept_id").distinct().join(concepts.select("concept_id", "tag", "active"), "concept_id", "left").join(labels, "concept_id", "left").join(up, "concept_id", "left")
    return joined.select("concept_id", F.coalesce("label", "concept_id").alias("term"), "tag", "active", F.concat(F.array("concept_id"), F.coalesce("_up", F.array().cast("array<string>"))).alias("ancestor_ids"))


def unknown_ids(ids: DataFrame, concepts: DataFrame) -> DataFrame:
    """Those of ids that are no active concept: a request with any of them is to be refused."""
    return ids.select("concept_id").distinct().join(concepts.where("active"), "concept_id", "left_anti")
