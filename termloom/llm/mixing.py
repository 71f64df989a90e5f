"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Sources, in code point order and null last, weigh 5, 2, 1, 5, 2, 1, ... They share
SHARE_PERCENT of all words by weight, but none takes over MAX_COPIES times its own; what
that leaves over is shared again by weight among the rest, until all fit. That is the level
L with the sum of min(cap, L * weight) equal to the budget, found by one prefix sum over
the sources in order of cap / weight.

Within its source, ordered by size, each document expects target / source size copies. The
prefix sum of that is its rank times the ratio; with one offset added, drawn from a hash of
the source and the seed, the document is emitted once per integer boundary that it
crosses. Neighbours in size stand in for one another, so the words taken come near the
target.

Ranks are found without gathering any source in one task: documents are range-partitioned
by source, size and id; a row's global number is its partition's base plus its place there,
and its rank the difference to the number of its source's first row. The bases are prefix
sums over as many rows as there are partitions, the first rows over as many as there are
sources.

Defined cases: null text has size 0 and takes 0 words; a null source is a source of its
own, after all others; rows that repeat a doc_id are separate documents, ordered by a hash
of their text (of the whole row where documents are sampled), and so are rows with a null
one, after all others of their size; a very long text is one row of its size, which may
take its source up to two texts past the target; an empty table gives no rows; extra columns
are ignored by the report and kept by the sampled documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions, stored

WEIGHTS = (5, 2, 1)
SHARE_PERCENT, MAX_COPIES, SEED = 150, 2, "mix-1"
WORD = "[^\\x20\\x09-\\x0D]+"

_ROW = (1 << 33) - 1  # monotonically_increasing_id: partition number above, row number below


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, has_source, source_size, n_docs, target. sizes: a row per document: source, size."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(in_order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    placed = totals.withColumns({"weight": weight, "cap": MAX_COPIES * F.col("source_size")}).withColumns({"budget": F.sum("source_size").over(everything) * F.lit(SHARE_PERCENT / 100.0)})
    by_need = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    upto = placed.withColumns({"capped": F.coalesce(F.sum("cap").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "sharing": F.sum("weight").over(by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing))})
    # the first source that its share doesn't fill sets the level
    level = (F.col("budget") - F.col("capped")) / F.col("sharing")
    levelled = upto.withColumn("level", F.min(F.when(F.col("cap") >= level * F.col("weight"), F.struct((F.col("cap") / F.col("weight")).alias("need"), F.col("source").isNull().alias("last"), "source", level.alias("level")))).over(everything)["level"])
    target = F.when(F.col("level").isNull() | (F.col("cap") <= F.col("level") * F.col("weight")), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight"))
    return levelled.select("source", "source_size", "n_docs", target.alias("target"))


def offset(source: F.Column, seed: str = SEED) -> F.Column:
    """In [0, 1), from 32 bits of a hash of the source and the seed."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.when(source.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), source))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def row_mark(docs: DataFrame) -> Column:
    """Hash of all columns; maps, which have no hash of their own, by their JSON form."""
    hashed = lambda c, kind: F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kind or kind in ("variant", "interval") else F.col(f"`{c}`")
    return F.xxhash64(*(hashed(c, kind) for c, kind in docs.dtypes))


def ranked(docs: DataFrame, mark: Column) -> DataFrame:
    """doc_id, source, size, mark, row: stored, in order of source, size, id, mark."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), mark.alias("mark"))
    order = (F.col("source").asc_nulls_last(), "size", F.col("doc_id").asc_nulls_last(), "mark")
    spread = rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    return stored(spread.withColumn("row", F.monotonically_increasing_id()), "mix")


def copies(docs: DataFrame, mark: Column | None = None) -> DataFrame:
    """doc_id, mark, size, source, source_size, target, n_copies for every document. The mark,
    a hash of the text unless given, settles the order of rows with equal size and id."""
    rows = ranked(docs, F.xxhash64("text") if mark is None else mark)
    part = F.shiftright("row", 33)
    sizes = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    bases = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    sources = source_targets(rows.select("source", "size"))
    firsts = sources.withColumn("first", F.coalesce(F.sum("n_docs").over(Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumnRenamed("source", "own_source")
    numbered = rows.join(F.broadcast(bases), part == F.col("part")).join(firsts, F.col("source").eqNullSafe(F.col("own_source")))
    rank = F.col("base") + F.col("row").bitwiseAND(F.lit(_ROW)) - F.col("first")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = F.floor((rank + 1) * expected + offset(F.col("source"))) - F.floor(rank * expected + offset(F.col("source")))
    return numbered.select("doc_id", "mark", "size", "source", "source_size", "target", F.least(crossed, F.lit(MAX_COPIES)).cast("long").alias("n_copies"))


def digest(docs: DataFrame) -> DataFrame:
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("n_copies") * F.col("size")).alias("taken"))


def sample(docs: DataFrame) -> DataFrame:
    """docs with every row as often as the mix takes it.

    Rows are told apart by a hash of all their columns. Rows equal in everything may be given
    different numbers of copies; their sum goes out under one of them, which is the same mix.
    """
    key = ("_m_doc", "_m_mark")
    counted = copies(docs, row_mark(docs)).groupBy(F.col("doc_id").alias("_m_doc"), F.col("mark").alias("_m_mark")).agg(F.sum("n_copies").alias("_m_copies"), F.count(F.lit(1)).alias("_m_rows"))
    taken = stored(counted.where("_m_copies > 0"), "taken")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_m_row"), F.col("doc_id").cast("long").alias("_m_own"), row_mark(docs).alias("_m_hash"))
    met = lambda wanted: whole.join(wanted, F.col("_m_own").eqNullSafe(F.col("_m_doc")) & (F.col("_m_hash") == F.col("_m_mark")))
    emitted = lambda rows: rows.select("_m_row", F.explode(F.sequence(F.lit(1), F.col("_m_copies"))).alias("_m_copy")).select("_m_row.*")
    single, repeated = emitted(met(taken.where("_m_rows = 1"))), taken.where("_m_rows > 1")
    if repeated.isEmpty():
        return single
    one = met(repeated).groupBy(*key, "_m_copies").agg(F.any_value("_m_row").alias("_m_row"))
    return single.unionByName(emitted(one))
