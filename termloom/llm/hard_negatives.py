"""Hard negatives by vantage-point trees over norm-augmented vectors.

An inner product s with an anchor a becomes a distance: beside a row x stands the component
sqrt(M^2 - |x|^2), M the greatest norm of the tree's rows, and beside the anchor a zero, so
that d^2 = |a|^2 + M^2 - 2 s. A window of scores is then an annulus of distances, higher
scores are nearer, and one metric tree serves every anchor.

Rows are dealt by a hash into blocks of about BLOCK_ROWS, and each block is one tree, stored
as one row: a balanced tree that splits at the median distance from a vantage point and knows
the shell of distances of each side. Anchors are dealt into groups of about GROUP_ROWS. Every
tree meets every group once in each of two passes: a task reads a tree and streams the groups
past it.

Traversal takes all anchors of a group at once. The distances to the vantage points bound the
distances to every leaf from both sides; each anchor takes its leaves nearest first, skips
those outside its annulus, and stops when the next leaf is farther than the k-th row it
holds. Scores are exact integers; the bounds, in floating point, are widened by more than
their error, so nothing is lost. The first pass yields each anchor's positives, which set
the windows of the second. Results of a group from all trees are merged in a stream sorted
by group, so a task holds one group whatever the number of trees.

Defined cases: rows with a null vec_id, label or vector, or a null or non-finite component
take no part; exact repeats of a row count once; rows of an anchor's own vec_id are never its
partners; a vector that is shorter than others counts as padded with zeros, an empty one has
score 0 with all; equal scores go by smaller vec_id; an anchor without another row of its
label has no rows; a negative positive_score makes an empty window; an empty table gives an
empty result; extra columns are ignored; scores have to fit 64 bits.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import partitions, ranges, released, ship, stored

BLOCK_ROWS, GROUP_ROWS, LEAF_ROWS = 8192, 1024, 128
POSITIVES, NEGATIVES = 5, 3
#: Anchors are the rows whose vec_id this divides.
ANCHOR_EVERY = 50

NO_SCORE, NO_ID = np.iinfo(np.int64).min, np.iinfo(np.int64).max
PACKED = "is_anchor boolean, bin int, blob binary"
RESULTS = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _save(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _load(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as found:
        return dict(found)


def _narrow(vectors: np.ndarray) -> np.ndarray:
    """Integers in the smallest type that holds them."""
    most = int(np.abs(vectors).max(initial=0))
    return vectors.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def _quantized(column: pa.Array) -> np.ndarray:
    """floor(256 x) of list<float> rows, shorter rows padded with zeros."""
    sizes = np.diff(column.offsets.to_numpy()).astype(np.int64)
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * 256).astype(np.int64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), ranges(np.zeros(len(sizes), np.int64), sizes)] = flat
    return out


def _pad(vectors: np.ndarray, width: int) -> np.ndarray:
    return vectors if vectors.shape[1] == width else np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))


def _joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Rows of several packs as one, by vec_id, exact repeats once."""
    width = max(p["vectors"].shape[1] for p in parts)
    ids, labels = (np.concatenate([p[k] for p in parts]) for k in ("ids", "labels"))
    vectors = np.concatenate([_pad(p["vectors"].astype(np.int64), width) for p in parts])
    order = np.lexsort((labels, ids))
    ids, labels, vectors = ids[order], labels[order], vectors[order]
    repeats = np.flatnonzero(np.diff(ids) == 0) + 1
    if len(repeats):
        seen, keep = set(), np.ones(len(ids), bool)
        for k in np.union1d(repeats, repeats - 1).tolist():
            row = (ids[k], labels[k], vectors[k].tobytes())
            keep[k] = row not in seen
            seen.add(row)
        ids, labels, vectors = ids[keep], labels[keep], vectors[keep]
    return {"ids": ids, "labels": labels, "vectors": vectors}


def _deal(n_blocks: int, n_groups: int):
    """Arrow batches of (vec_id, label, embedding, block, group) to packs by block, and anchors to packs by group."""

    @released
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, labels, blocks, groups = (batch.column(k).to_numpy() for k in ("vec_id", "label", "block", "grp"))
            vectors = _quantized(batch.column("embedding"))
            out = []
            for is_anchor, bins in ((False, blocks), (True, np.where(ids % ANCHOR_EVERY == 0, groups, -1))):
                for k in np.unique(bins[bins >= 0]):
                    mine = bins == k
                    rows = _joined([{"ids": ids[mine], "labels": labels[mine].astype(np.int64), "vectors": vectors[mine]}])
                    out.append((is_anchor, int(k), _save(**(rows | {"vectors": _narrow(rows["vectors"])}))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.bool_(), pa.int32(), pa.binary()), strict=True)], names=["is_anchor", "bin", "blob"])

    return run


def build_tree(rows: dict[str, np.ndarray], leaf_rows: int = LEAF_ROWS) -> dict[str, np.ndarray]:
    """A vantage-point tree: rows in order of leaves, each leaf's by vec_id; leaf bounds; vantage points; and for each
    leaf the (node, least, greatest distance from the node's vantage point) of its ancestors, flat."""
    vectors = rows["vectors"]
    real = vectors.astype(np.float64)
    norms = (real**2).sum(axis=1)
    radius2 = float(norms.max(initial=0.0))
    lift = np.sqrt(radius2 - norms)
    points = np.column_stack([real, lift])
    vantage, leaves, paths = [], [], []
    waiting = [(np.arange(len(vectors)), [])]
    while waiting:
        mine, path = waiting.pop()
        if len(mine) <= leaf_rows:
            leaves.append(mine)
            paths.append(path)
            continue
        far = mine[np.argmax(((points[mine] - points[mine[0]]) ** 2).sum(axis=1))]
        apart = np.sqrt(((points[mine] - points[far]) ** 2).sum(axis=1))
        order = np.argsort(apart, kind="stable")
        half = len(mine) // 2
        node = len(vantage)
        vantage.append(points[far])
        for part in (order[:half], order[half:]):
            waiting.append((np.sort(mine[part]), [*path, (node, float(apart[part[0]]), float(apart[part[-1]]))]))
    order = np.concatenate(leaves)
    flat = [x for path in paths for x in path]
    return {
        "ids": rows["ids"][order], "labels": rows["labels"][order], "vectors": _narrow(vectors[order]),
        "edges": np.concatenate([[0], np.cumsum([len(x) for x in leaves])]), "radius2": np.array(radius2),
        "vantage": np.array(vantage).reshape(len(vantage), points.shape[1]), "path_edges": np.concatenate([[0], np.cumsum([len(x) for x in paths])]),
        "path_nodes": np.array([x[0] for x in flat], np.int64), "path_least": np.array([x[1] for x in flat]), "path_most": np.array([x[2] for x in flat]),
    }


def _score_bounds(tree: dict[str, np.ndarray], anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The greatest and the least score that a row of each leaf can have, a row for each anchor."""
    n_leaves = len(tree["edges"]) - 1
    own = (anchors**2).sum(axis=1)
    radius2 = float(tree["radius2"])
    near, far = np.zeros((len(anchors), n_leaves)), np.full((len(anchors), n_leaves), np.sqrt(own.max(initial=0)) + 2 * np.sqrt(radius2) + 1)
    if len(tree["vantage"]):
        points = tree["vantage"]
        apart = np.sqrt(np.maximum(0, own[:, None] + (points**2).sum(axis=1) - 2 * anchors @ points[:, :-1].T))
        for leaf in range(n_leaves):
            for k in range(tree["path_edges"][leaf], tree["path_edges"][leaf + 1]):
                d = apart[:, tree["path_nodes"][k]]
                np.maximum(near[:, leaf], np.maximum(tree["path_least"][k] - d, d - tree["path_most"][k]), out=near[:, leaf])
                np.minimum(far[:, leaf], d + tree["path_most"][k], out=far[:, leaf])
    scale = own[:, None] + radius2
    slack = 1e-6 * scale + 1  # far above the rounding of squares and roots
    return (scale - near**2) / 2 + slack, (scale - far**2) / 2 - slack


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows of a and b."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return (a.astype(object) @ b.astype(object).T).astype(np.int64)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k of the last axis by score, highest first, then smaller id."""
    order = np.lexsort((ids, -np.maximum(scores, NO_SCORE + 1)), axis=-1)[..., :k]
    return np.take_along_axis(scores, order, -1), np.take_along_axis(ids, order, -1)


def traverse(tree: dict[str, np.ndarray], anchors: dict[str, np.ndarray], least: np.ndarray, most: np.ndarray, k: int, same_label: bool) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids (anchor, window, k) of the first k rows of the tree in each anchor's windows least..most, of
    its own label or of others. NO_SCORE, NO_ID: no further row."""
    width = max(tree["vectors"].shape[1], anchors["vectors"].shape[1])
    rows, own = _pad(tree["vectors"].astype(np.int64), width), _pad(anchors["vectors"].astype(np.int64), width)
    points = tree["vantage"]
    if len(points) and points.shape[1] - 1 < width:  # zeros stand before the lifted component
        points = np.column_stack([_pad(points[:, :-1], width), points[:, -1]])
    top, bottom = _score_bounds(tree | {"vantage": points}, own.astype(np.float64))
    n, n_windows = least.shape
    scores, ids = np.full((n, n_windows, k), NO_SCORE), np.full((n, n_windows, k), NO_ID)
    going = np.flatnonzero((least <= most).any(axis=1))
    nearest = np.argsort(-top, axis=1, kind="stable")
    edges = tree["edges"]
    for turn in range(len(edges) - 1):
        wanted = np.maximum(least[going], scores[going, :, -1])  # what a row has to reach, by window
        leaf = nearest[going, turn]
        reached = top[going, leaf][:, None] >= wanted
        open_ = (least[going] <= most[going]) & reached
        on = open_.any(axis=1)  # the leaves to come are no nearer
        going, leaf, open_ = going[on], leaf[on], open_[on]
        if not len(going):
            break
        meets = (open_ & (bottom[going, leaf][:, None] <= most[going])).any(axis=1)
        at, leaf = going[meets], leaf[meets]
        by_leaf = np.argsort(leaf, kind="stable")
        at, leaf = at[by_leaf], leaf[by_leaf]
        starts = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]])) if len(leaf) else []
        for a, b in zip(starts, np.append(starts[1:], len(leaf)), strict=True):
            mine, part = at[a:b], slice(edges[leaf[a]], edges[leaf[a] + 1])
            found = _products(own[mine], rows[part])
            row_ids = tree["ids"][part]
            fits = ((tree["labels"][part] == anchors["labels"][mine, None]) == same_label) & (row_ids != anchors["ids"][mine, None])
            for w in range(n_windows):
                in_window = fits & (found <= most[mine, w, None]) & (found >= np.maximum(least[mine, w], scores[mine, w, -1])[:, None])
                better = np.flatnonzero(in_window.any(axis=1))
                if len(better):
                    to = mine[better]
                    some = np.concatenate([scores[to, w], np.where(in_window[better], found[better], NO_SCORE)], axis=1)
                    who = np.concatenate([ids[to, w], np.where(in_window[better], row_ids, NO_ID)], axis=1)
                    scores[to, w], ids[to, w] = best_of(some, who, k)
    return scores, ids


def _open_windows(anchors: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = len(anchors["ids"])
    return np.full((n, 1), NO_SCORE), np.full((n, 1), NO_ID)


def score_windows(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From half a positive's score to 95 % of it; from 1 to 0 where there is no positive."""
    real = scores != NO_SCORE
    safe = np.where(real, scores, 0)
    least = -(-safe // 2)
    most = 95 * (safe // 100) + 95 * (safe % 100) // 100
    return np.where(real, least, 1), np.where(real, most, 0)


@released
def _trees(batches):
    """Rows sorted by block to one row of a tree for each block."""
    yield from _by_bin(batches, lambda k, packs: (k, _save(**build_tree(_joined([_load(x) for x in packs])))))


@released
def _groups(batches):
    def made(k, packs):
        rows = _joined([_load(x) for x in packs])
        return k, _save(**(rows | {"vectors": _narrow(rows["vectors"])}))

    yield from _by_bin(batches, made)


def _by_bin(batches, made):
    """One row (bin, blob) for each run of equal bins."""
    now, packs = None, []
    for batch in batches:
        for k, blob in zip(batch.column("bin").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            if k != now:
                if packs:
                    yield _row(*made(now, packs))
                now, packs = k, []
            packs.append(blob)
    if packs:
        yield _row(*made(now, packs))


def _row(k: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([blob], pa.binary())], names=["bin", "blob"])


def _searched(k: int, same_label: bool):
    """(block, part: null for the tree and a group's number for anchors, blob), the tree first, to (bin: group, part 1, blob of results)."""

    @released
    def run(batches):
        block, tree = None, None
        for batch in batches:
            for at, part, blob in zip(*(batch.column(x).to_pylist() for x in ("block", "part", "blob")), strict=True):
                if part is None:
                    block, tree = at, _load(blob)
                    continue
                if at != block:
                    raise ValueError(f"anchors without the tree of block {at}")
                anchors = _load(blob)
                least, most = (anchors["least"], anchors["most"]) if "least" in anchors else _open_windows(anchors)
                scores, ids = traverse(tree, anchors, least, most, k, same_label)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([1], pa.int32()), pa.array([_save(scores=scores, ids=ids)], pa.binary())], names=["bin", "part", "blob"])

    return run


def _merged(batches, k: int, finish):
    """(bin, part, blob) sorted: a group's anchors (part 0), then its results from each tree (part 1); finish(bin, anchors, scores, ids)."""
    now, anchors, scores, ids = None, None, None, None
    for batch in batches:
        for at, part, blob in zip(*(batch.column(x).to_pylist() for x in ("bin", "part", "blob")), strict=True):
            if part == 0:
                if now is not None:
                    yield finish(now, anchors, scores, ids)
                now, anchors, scores, ids = at, _load(blob), None, None
                continue
            found = _load(blob)
            scores, ids = (found["scores"], found["ids"]) if scores is None else best_of(np.concatenate([scores, found["scores"]], -1), np.concatenate([ids, found["ids"]], -1), k)
    if now is not None:
        yield finish(now, anchors, scores, ids)


@released
def _with_windows(batches):
    def finish(k, anchors, scores, ids):
        least, most = score_windows(scores[:, 0])
        return _row(k, _save(**anchors, least=least, most=most, positive_scores=scores[:, 0], positive_ids=ids[:, 0]))

    yield from _merged(batches, POSITIVES, finish)


@released
def _rows(batches):
    def finish(k, anchors, scores, ids):
        a, p, r = np.nonzero(scores != NO_SCORE)
        columns = (anchors["ids"][a], anchors["positive_ids"][a, p], (r + 1).astype(np.int32), ids[a, p, r], anchors["positive_scores"][a, p], scores[a, p, r])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[x.split()[0] for x in RESULTS.split(", ")])

    yield from _merged(batches, NEGATIVES, finish)


def _pass(spark: SparkSession, trees: DataFrame, groups: DataFrame, n_blocks: int, k: int, same_label: bool) -> DataFrame:
    """(bin, part, blob): each group's anchors and its results from every tree, a group's rows together."""
    parts = partitions(spark)
    anchors = groups.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.col("bin").alias("part"), "blob")
    meeting = trees.select(F.col("bin").alias("block"), F.lit(None).cast("int").alias("part"), "blob").unionByName(anchors)
    dealt = _dealt(meeting, "block", min(n_blocks, 8 * parts))
    found = dealt.sortWithinPartitions("block", F.col("part").asc_nulls_first()).mapInArrow(_searched(k, same_label), "bin int, part int, blob binary")
    together = groups.select("bin", F.lit(0).alias("part"), "blob").unionByName(found)
    return _dealt(together, "bin", parts).sortWithinPartitions("bin", "part")


def _dealt(df: DataFrame, number: str, parts: int) -> DataFrame:
    """Rows of one number in one partition, numbers dealt in turn: the rows are few and large."""
    return df.repartitionById(parts, F.pmod(number, F.lit(parts)))


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, label, embedding of the rows that take part."""
    real = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(real).where(~bad).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")


def mine(rows: DataFrame) -> DataFrame:
    """For every anchor and each of its positives, the first negatives in the positive's window.

    rows: vec_id, label, embedding. Labels are compared as they come."""
    spark = rows.sparkSession
    ship(spark)
    clean = usable(rows)
    n, n_anchors = clean.agg(F.count("*"), F.count(F.when(F.col("vec_id") % ANCHOR_EVERY == 0, 1))).first()
    n_blocks, n_groups = max(1, -(-n // BLOCK_ROWS)), max(1, -(-n_anchors // GROUP_ROWS))
    dealt = clean.withColumns({"block": F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int"), "grp": F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(n_groups)).cast("int")})
    packs = stored(dealt.mapInArrow(_deal(n_blocks, n_groups), PACKED), "negatives-packs")
    gather = lambda anchors, bins: _dealt(packs.where(F.col("is_anchor") == anchors).select("bin", "blob"), "bin", bins).sortWithinPartitions("bin")
    parts = partitions(spark)
    trees = stored(gather(False, min(n_blocks, 8 * parts)).mapInArrow(_trees, "bin int, blob binary"), "negatives-trees")
    groups = stored(gather(True, min(n_groups, parts)).mapInArrow(_groups, "bin int, blob binary"), "negatives-anchors")
    windows = stored(_pass(spark, trees, groups, n_blocks, POSITIVES, True).mapInArrow(_with_windows, "bin int, blob binary"), "negatives-windows")
    return _pass(spark, trees, windows, n_blocks, NEGATIVES, False).mapInArrow(_rows, RESULTS)


def digest(rows: DataFrame) -> DataFrame:
    """The contract's rows: labels of every seventh vec_id move on by one first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", moved.alias("label"), "embedding"))
