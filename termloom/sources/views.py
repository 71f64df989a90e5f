"""Terminology and coded-record views over the order tables.

Identifiers are digit strings: root 900000, region 100000+, nation 200000+, customer 300000+,
supplier 400000+, brand 500000+, type 510000+, part 600000+. Parts have two parents, so the
hierarchy is a DAG. Notes are orders, their codings are order lines.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.hierarchy import closure_of_parents, lineage, taken_over
from ..operators.search import EXCLUDED_TAGS, SearchTables, searchable
from ..operators.terms import concept_rows, description_rows, root_areas
from ..operators.textindex import BeginningIndex, TextIndex, beginning_index, text_index
from ..operators.vectors import VectorIndex, vector_index
from .lookups import keyed
from .storage import clustered, shared_folder, spread, stored

ROOT, SUPPLIES, IS_A = "900000", "700001", "116680003"
TENANT, RELEASE_OLD, RELEASE_NEW = "demo", "20240101", "20240701"


def _id(base: int, key: Column) -> Column:
    return (F.lit(base) + key).cast("string")


_opened: dict[tuple[str, str], "Tables"] = {}


def tables(spark: SparkSession, folder: str) -> "Tables":
    """The session's views of a folder, each built once; those read often are stored in the shared folder."""
    return _opened.setdefault((spark.sparkContext.applicationId, folder), Tables(spark, folder))


@dataclass
class Tables:
    """One folder of Parquet tables; each view is a lazy plan."""

    spark: SparkSession
    folder: str

    @property
    def spread(self) -> int:
        """Partitions of a view that unites many small tables: as many as the session shuffles to."""
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def brands(self) -> DataFrame:
        number = F.regexp_extract("p_brand", "(\\d+)", 1).cast("int")
        return self.table("part").select("p_brand").distinct().select(_id(500000, number).alias("concept_id"), "p_brand")

    @cached_property
    def types(self) -> DataFrame:
        # a few distinct values, so one window over them is small whatever the table's size
        ranked = self.table("part").select("p_type").distinct().withColumn("k", F.row_number().over(Window.orderBy("p_type")))
        return ranked.select(_id(510000, F.col("k")).alias("concept_id"), "p_type")

    @cached_property
    def parts(self) -> DataFrame:
        """concept_id, brand_id, type_id, name of each part."""
        brand = _id(500000, F.regexp_extract("p_brand", "(\\d+)", 1).cast("int"))
        types = self.types.withColumnRenamed("concept_id", "type_id")  # as many rows as there are values of p_type
        return self.table("part").join(types, "p_type").select(_id(600000, F.col("p_partkey")).alias("concept_id"), brand.alias("brand_id"), "type_id", F.col("p_name").alias("name"), "p_size", "p_partkey", "p_brand")

    @cached_property
    def concepts(self) -> DataFrame:
        """concept_id, name, tag, active."""
        row = lambda df, base, key, name, tag, active=F.lit(True): df.select(_id(base, F.col(key)).alias("concept_id"), F.col(name).alias("name"), F.lit(tag).alias("tag"), active.alias("active"))
        parts = [
            self.spark.range(1).select(F.lit(ROOT).alias("concept_id"), F.lit("Everything").alias("name"), F.lit("root").alias("tag"), F.lit(True).alias("active")),
            row(self.table("region"), 100000, "r_regionkey", "r_name", "region"),
            row(self.table("nation"), 200000, "n_nationkey", "n_name", "nation"),
            row(self.table("customer"), 300000, "c_custkey", "c_name", "customer", F.col("c_acctbal") >= 0),
            row(self.table("supplier"), 400000, "s_suppkey", "s_name", "supplier"),
            self.brands.select("concept_id", F.col("p_brand").alias("name"), F.lit("brand").alias("tag"), F.lit(True).alias("active")),
            self.types.select("concept_id", F.col("p_type").alias("name"), F.lit("type").alias("tag"), F.lit(True).alias("active")),
            self.parts.select("concept_id", "name", F.lit("part").alias("tag"), F.lit(True).alias("active")),
        ]
        whole = parts[0]
        for more in parts[1:]:
            whole = whole.unionByName(more)
        return stored(whole.coalesce(self.spread), "concepts")

    @cached_property
    def edges(self) -> DataFrame:
        """child, parent."""
        row = lambda df, child, parent: df.select(child.alias("child"), parent.alias("parent"))
        parts = [
            row(self.table("region"), _id(100000, F.col("r_regionkey")), F.lit(ROOT)),
            row(self.table("nation"), _id(200000, F.col("n_nationkey")), _id(100000, F.col("n_regionkey"))),
            row(self.table("customer"), _id(300000, F.col("c_custkey")), _id(200000, F.col("c_nationkey"))),
            row(self.table("supplier"), _id(400000, F.col("s_suppkey")), _id(200000, F.col("s_nationkey"))),
            row(self.brands, F.col("concept_id"), F.lit(ROOT)),
            row(self.types, F.col("concept_id"), F.lit(ROOT)),
            row(self.parts, F.col("concept_id"), F.col("brand_id")),
            row(self.parts, F.col("concept_id"), F.col("type_id")),
        ]
        whole = parts[0]
        for more in parts[1:]:
            whole = whole.unionByName(more)
        return stored(whole.coalesce(self.spread), "edges")

    @cached_property
    def closure_of_parents(self) -> DataFrame:
        return closure_of_parents(self.edges)

    @cached_property
    def closure(self) -> DataFrame:
        """concept_id, ancestor_id, depth (parents 1)."""
        return stored(taken_over(self.edges, self.closure_of_parents), "closure")

    @cached_property
    def lineage(self) -> DataFrame:
        """concept_id, ancestor_id; pairs come more than once. For what asks for few ancestors."""
        return lineage(self.edges, self.closure_of_parents)

    def _supplied(self, lines: DataFrame) -> DataFrame:
        return lines.select(_id(400000, F.col("l_suppkey")).alias("source_id"), F.lit(SUPPLIES).alias("type_id"), _id(600000, F.col("l_partkey")).alias("destination_id"))

    @cached_property
    def supplied(self) -> DataFrame:
        """attributes as often as there are order lines: nothing is stored or grouped."""
        return self._supplied(self.table("lineitem"))

    @cached_property
    def attributes(self) -> DataFrame:
        """source_id, type_id, destination_id."""
        return stored(self._supplied(self.table("lineitem").select("l_suppkey", "l_partkey").distinct()), "attributes")

    @cached_property
    def descriptions(self) -> DataFrame:
        """concept_id, description_id, term, kind (synonym, fsn), language_code, tag, concept_active."""
        base = self.concepts.withColumn("language_code", F.when(F.col("concept_id").cast("long") % 2 == 0, "en").otherwise("es"))
        kinds = F.explode(F.array(F.struct(F.lit("synonym").alias("kind"), F.col("name").alias("term")), F.struct(F.lit("fsn").alias("kind"), F.concat("name", F.lit(" ("), "tag", F.lit(")")).alias("term"))))
        rows = base.select("concept_id", "language_code", "tag", "active", kinds.alias("d"))
        return rows.select("concept_id", F.concat_ws("-", "concept_id", F.col("d.kind")).alias("description_id"), F.col("d.term").alias("term"), F.col("d.kind").alias("kind"), "language_code", "tag", F.col("active").alias("concept_active"))

    @cached_property
    def names(self) -> DataFrame:
        """descriptions with more synonyms: the words turned round, and a definition. They lie by concept
        from before they are listed, so what groups them shuffles none."""
        concepts = self.concepts.repartition("concept_id").withColumn("language_code", F.when(F.col("concept_id").cast("long") % 2 == 0, "en").otherwise("es"))
        turned = F.array_join(F.reverse(F.split("name", " ")), " ")
        one = lambda kind, term, n: F.struct(F.lit(kind).alias("kind"), term.alias("term"), F.lit(n).alias("n"))
        found = F.array(one("synonym", F.col("name"), "1"), one("fsn", F.concat("name", F.lit(" ("), "tag", F.lit(")")), "2"), one("synonym", F.concat(turned, F.lit(" item")), "3"), one("synonym", turned, "4"), one("definition", F.concat(F.lit("A "), "tag", F.lit(" named "), "name"), "5"))
        rows = concepts.select("concept_id", "language_code", "tag", "active", F.explode(found).alias("d"))
        return rows.select("concept_id", F.concat_ws("-", "concept_id", "d.n").alias("description_id"), F.col("d.term").alias("term"), F.col("d.kind").alias("kind"), "language_code", "tag", F.col("active").alias("concept_active"), F.lit(RELEASE_NEW).alias("release_id"))

    @cached_property
    def search(self) -> SearchTables:
        """The projection of names, clustered by description, and its token index, by token."""
        roots = self.edges.where(F.col("parent") == ROOT).select(F.col("child").alias("concept_id"))
        rows = concept_rows(self.names, EXCLUDED_TAGS, root_areas(self.closure, roots), ("510000", "510001", "510002", "510003"))
        whole = stored(rows, "projected")
        return SearchTables(clustered(description_rows(whole), "terms", "normalized", "description_id", partitions=self.spread), concepts=whole, partitions=self.spread)

    @cached_property
    def text_index(self) -> TextIndex:
        """Postings with positions of the searchable rows of the projection."""
        return text_index(searchable(self.search.terms), "description_id", partitions=self.spread)

    @cached_property
    def beginnings(self) -> BeginningIndex:
        return beginning_index(searchable(self.search.terms), "description_id", "display", self.spread)

    @cached_property
    def keyed_releases(self) -> DataFrame:
        """Both releases, a folder each, in order of concept_id and with Bloom filters on it."""
        path = f"{shared_folder(self.spark)}/releases-{uuid.uuid4().hex}"
        return keyed(self.release_old.unionByName(self.release_new), path, "concept_id", "concept_id", partitions=self.spread)

    @cached_property
    def vectors(self) -> VectorIndex:
        return vector_index(self.table("embeddings"), "vec_id", "embedding")

    @cached_property
    def term_vectors(self) -> VectorIndex:
        """Preferred rows of parts, types and brands with a vector of their letters."""
        from ..plans.catalog_text import letter_counts

        rows = searchable(self.search.terms).where("is_preferred AND tag IN ('part', 'type', 'brand')")
        return vector_index(rows.select("description_id", "concept_id", letter_counts(F.col("normalized")).alias("vector")), "description_id", "vector")

    @cached_property
    def codings(self) -> DataFrame:
        """One row per order line: note_id and the coding's fields; many queries read it, so it is stored, in as many files as there are cores at least."""
        # row: a line's place in the table, which decides between equal line numbers of a note
        placed = self.table("lineitem").withColumn("row", F.struct("_metadata.file_name", "_metadata.row_index"))
        lines = spread(placed).join(self.parts.select("p_partkey", "concept_id", "brand_id", "type_id"), F.col("l_partkey") == F.col("p_partkey"))
        rows = lines.select(
            F.col("l_orderkey").alias("note_id"),
            "concept_id",
            F.array("concept_id", "brand_id", "type_id", F.lit(ROOT)).alias("ancestor_ids"),
            F.when(F.col("l_returnflag") == "A", "absent").when(F.col("l_returnflag") == "N", "present").otherwise("suspected").alias("assertion"),
            F.when(F.col("l_linestatus") == "O", "patient").otherwise("family").alias("subject"),
            F.when(F.col("l_discount") < 0.09, "accepted").otherwise("review").alias("status"),
            F.when(F.col("l_linenumber") % 2 == 0, "historical").otherwise("current").alias("temporality"),
            F.when(F.col("l_linenumber") % 3 == 0, "condition").when(F.col("l_linenumber") % 3 == 1, "procedure").otherwise("medication").alias("kind"),
            F.col("l_linenumber").alias("line"),
            "l_quantity",
            "l_shipdate",
            "row",
        )
        return stored(rows, "codings")

    @cached_property
    def notes(self) -> DataFrame:
        """One row per order with its codings nested; orders without lines have none."""
        # order lines are shuffled and listed as numbers; names and an order's facts are made of them after that
        flag = lambda condition, value: F.when(condition, value).otherwise(0)
        number = F.col("l_linenumber")
        flags = (
            F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2) + flag(F.col("l_linestatus") == "O", 4) + flag(F.col("l_discount") < 0.09, 8)
            + flag(number % 2 == 0, 16) + F.when(number % 3 == 0, 0).when(number % 3 == 1, 32).otherwise(64)
        )
        parts = self.parts.select("p_partkey", F.col("brand_id").cast("int").alias("brand"), F.col("type_id").cast("int").alias("type"))
        plain = spread(self.table("lineitem").select("l_orderkey", "l_partkey", flags.alias("flags"))).join(parts, F.col("l_partkey") == F.col("p_partkey"))
        lines = plain.select("l_orderkey", "l_partkey", "brand", "type", "flags").repartition("l_orderkey")
        listed = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_partkey", "brand", "type", "flags")).alias("lines"))
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate").join(listed, F.col("o_orderkey") == F.col("l_orderkey"), "left")

        def coding(x: Column) -> Column:
            own, brand, type_ = _id(600000, x["l_partkey"]), x["brand"].cast("string"), x["type"].cast("string")
            among = lambda mask, value: x["flags"].bitwiseAND(mask) == value
            return F.struct(
                own.alias("concept_id"),
                F.array(own, brand, type_, F.lit(ROOT)).alias("ancestor_ids"),
                F.when(among(3, 0), "absent").when(among(3, 1), "present").otherwise("suspected").alias("assertion"),
                F.when(among(4, 4), "patient").otherwise("family").alias("subject"),
                F.when(among(8, 8), "accepted").otherwise("review").alias("status"),
                F.when(among(16, 16), "historical").otherwise("current").alias("temporality"),
                F.when(among(96, 0), "condition").when(among(96, 32), "procedure").otherwise("medication").alias("kind"),
            )

        setting = F.when(F.col("o_orderpriority").startswith("1"), "emergency").when(F.col("o_orderpriority").startswith("2"), "inpatient").when(F.col("o_orderpriority").startswith("3"), "outpatient").otherwise("primary-care")
        none = F.array().cast(listed.schema["lines"].dataType)
        rows = orders.select(
            F.col("o_orderkey").alias("note_id"),
            F.lit(TENANT).alias("tenant_id"),
            F.when(F.col("o_orderkey") % 2 == 0, "en").otherwise("es").alias("language_code"),
            (F.col("o_orderkey") % 2 == 0).alias("synthetic"),
            (F.lit(20) + F.col("o_custkey") % 70).cast("int").alias("age"),
            F.when(F.col("o_custkey") % 3 == 0, "female").when(F.col("o_custkey") % 3 == 1, "male").otherwise("other").alias("sex"),
            setting.alias("setting"),
            F.col("o_orderdate").alias("occurred_at"),
            F.transform(F.coalesce("lines", none), coding).alias("codings"),
        )
        return stored(rows, "notes")

    @cached_property
    def release_old(self) -> DataFrame:
        return self._release(RELEASE_OLD)

    @cached_property
    def release_new(self) -> DataFrame:
        return self._release(RELEASE_NEW)

    def _release(self, release: str) -> DataFrame:
        """concept_id, active, definition_status, module_id, effective_time, release_id."""
        key = F.col("c_custkey")
        old = self.table("customer").select(key, _id(300000, key).alias("concept_id"), (F.col("c_acctbal") >= 0).alias("active"), F.lit("primitive").alias("definition_status"), F.lit("core").alias("module_id"), F.lit("20230101").alias("effective_time"))
        if release == RELEASE_NEW:
            new = self.table("supplier").select(F.lit(None).cast("long").alias("c_custkey"), _id(400000, F.col("s_suppkey")).alias("concept_id"), F.lit(True).alias("active"), F.lit("primitive").alias("definition_status"), F.lit("core").alias("module_id"), F.lit("20240601").alias("effective_time"))
            changed = old.where(key % 10 != 0).withColumns({"active": F.when(key % 7 == 0, ~F.col("active")).otherwise(F.col("active")), "module_id": F.when(key % 11 == 0, "extension").otherwise(F.col("module_id"))})
            old = changed.unionByName(new)
        return old.drop("c_custkey").withColumn("release_id", F.lit(release))

    @cached_property
    def mappings(self) -> DataFrame:
        """concept_id, refset_id, target_system, map_target, map_group, map_priority, map_rule, active."""
        return self.parts.select(
            "concept_id",
            F.lit("447562003").alias("refset_id"),
            F.lit("brand-codes").alias("target_system"),
            F.col("p_brand").alias("map_target"),
            (F.col("p_size") % 3 + 1).alias("map_group"),
            (F.col("p_size") % 5 + 1).alias("map_priority"),
            F.when(F.col("p_partkey") % 2 == 0, "TRUE").otherwise("IFA 248152002 | Female |").alias("map_rule"),
            (F.col("p_size") % 4 != 0).alias("active"),
        )

    @cached_property
    def telemetry(self) -> DataFrame:
        return self.table("events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"), F.col("user_id").alias("actor_id"), "event_type", F.col("value").alias("duration_ms"), F.col("props").alias("query_text"))
