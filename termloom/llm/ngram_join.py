"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its five-word shingles, held as 64-bit hashes; equal sets are one
node from the first shuffle on. Two sets link if they share 75 % of their union.

1. One pass counts sets and finds hot shingles, those in over HOT_SHARE of the documents of
   some task. There are at most 2 * mean set size / HOT_SHARE of them whatever the corpus
   size, and they come last in the order of shingles.
2. An inverted index: every task packs its shingles into one blob for each partition of the
   hash range. A partition counts the nodes of each shingle and sends on only those with two
   or more, to the partition of their node. A node that has too few of them to fill a
   prefix can't have a partner and is dropped.
3. Prefixes: in order of frequency, a set of n keeps its first n - ceil(0.75 n) + l shingles.
   Any partner shares l of them at least. Each node takes the l with the least estimated
   cost, posting lists to read plus candidates to verify; a pair uses the smaller of the two.
4. Stars: each posting list's least node meets all others of the list. That costs one row per
   posting and joins most copies; components give nodes labels.
5. Rest: only pairs with different labels are left. Lists of one label are dropped. In short
   lists the pairs are counted per shared shingle, as many as l asks for beyond what may be in
   long lists. A pair whose first shared shingle has a long list is found there: both sides
   must have enough of their sets from that shingle on, sizes must be near, so nodes that no
   other node of the list can meet are dropped before anything is compared. Texts that share
   nothing but boilerplate end there. What stays is compared in blocks of bounded volume, each
   node outside the largest component against everything in it, by counting shared shingles;
   a block returns a spanning forest. No list is cut off.
6. Every pair met has to share l prefix shingles before its whole sets are looked at.

Hashes decide equality of shingles; all counts of a pair are taken on the whole 64 bits.

Defined cases: texts with fewer than five words are one shingle; null, empty and blank texts
have none and link with nothing; a very long text is one set, held whole while it is its turn;
rows that repeat a doc_id are separate rows under the same id; of equal costs the smaller l is
taken; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import mix64, pack_planes, pack_sorted, partitions, ranges, released, ship, slices, stored, unpack_planes, unpack_sorted

WORDS, PERCENT = 5, 75
HOT_SHARE, HOT_LEAST = 0.01, 1000
MAX_MATCHES, VERIFY_COST = 8, 1 / 16
SHORT_LIST = 96
#: Shingles of the members, and of the outsiders, that a block holds at most, give or take one set.
BLOCK_MEMBERS, BLOCK_OUTSIDERS = 1 << 22, 1 << 20
HOT = (1 << 32) - 1

_FACTORS = mix64(np.arange(1, WORDS + 1).astype(np.uint64)) | np.uint64(1)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes, ascending, one after the other, and offsets."""
    n = len(texts)
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words = split.flatten()
    row = np.repeat(np.arange(n), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))
    full = pc.greater(pc.binary_length(words), 0)
    row = row[full.to_numpy(zero_copy_only=False)]
    coded = words.filter(full).dictionary_encode()
    if not len(row):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    by_word = pd.util.hash_array(np.array(coded.dictionary.to_pylist(), dtype=object), categorize=False)
    hashes = by_word[coded.indices.to_numpy(zero_copy_only=False)]
    counts = np.bincount(row, minlength=n)
    starts = np.concatenate([[0], np.cumsum(counts)])
    summed = np.zeros(len(hashes), np.uint64)
    for k in range(WORDS):
        m = len(hashes) - k
        summed[:m] += hashes[k:] * _FACTORS[k]
    summed = mix64(summed)
    # a window's first word has WORDS - 1 more of its row after it
    first = starts[row + 1] - np.arange(len(row)) >= WORDS
    short = np.flatnonzero((counts > 0) & (counts < WORDS))
    parts, sizes = [], np.zeros(n, np.int64)
    shorts = set(short.tolist())
    for i in range(n):
        a, b = starts[i], starts[i + 1]
        if i in shorts:
            own = np.array([np.sum(hashes[a:b] * _FACTORS[: b - a]) + np.uint64(b - a)], np.uint64)
            own = mix64(own)
        else:
            own = np.unique(summed[a:b][first[a:b]])
        parts.append(own)
        sizes[i] = len(own)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])


def node_of(own: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def needed(n):
    """Shingles that a partner of a set of n has to share with it."""
    return -(-PERCENT * n // 100)


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Ranges of the hash space, ascending with the hash."""
    return ((hashes.view(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


# ---- pass 1: sets and hot shingles

SETS = "doc_id long, n_shingles long, node long, mark long, token long, docs long"


@released
def _sets(batches):
    for batch in slices(batches, 12 << 20):
        flat, offsets = shingles(batch.column("text"))
        sizes = np.diff(offsets)
        nodes = [node_of(flat[a:b]) if b > a else None for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(nodes, pa.int64()), batch.column("mark"), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=["doc_id", "n_shingles", "node", "mark", "token", "docs"])
        tokens, counts = np.unique(flat, return_counts=True)
        often = counts >= max(8, HOT_SHARE * n)
        if k := int(often.sum()):
            none = pa.nulls(k, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(tokens[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], names=["doc_id", "n_shingles", "node", "mark", "token", "docs"])


def hot_shingles(found: DataFrame) -> np.ndarray:
    """Bounded, see the module: 8 bytes for each goes to the driver and to every task."""
    total = found.where("token is null").count()
    rows = found.where("token is not null").groupBy("token").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= max(HOT_LEAST, HOT_SHARE * total / 2)).select("token").toPandas()
    return np.sort(rows["token"].to_numpy(np.int64).view(np.uint64))


# ---- pass 2: inverted index, blobs of postings

BLOBS = "part int, kind int, tokens binary, nodes binary, more binary"
POSTINGS, NODES = 0, 1


def _blob(part, kind, tokens: bytes, nodes: bytes, more: bytes) -> tuple:
    return int(part), kind, tokens, nodes, more


def _blob_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "kind", "tokens", "nodes", "more"])


def _postings(parts: int, hot: np.ndarray):
    @released
    def run(batches):
        for batch in slices(batches, 12 << 20):
            flat, offsets = shingles(batch.column("text"))
            sizes = np.diff(offsets)
            nodes = np.array([node_of(flat[a:b]) if b > a else 0 for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.int64)
            _, first = np.unique(nodes, return_index=True)
            first = np.sort(first[sizes[first] > 0])
            if not len(first):
                continue
            nodes, at, sizes = nodes[first], ranges(offsets[first], sizes[first]), sizes[first]
            flat, doc = flat[at], np.repeat(np.arange(len(first)), sizes)
            is_hot = np.isin(flat, hot) if len(hot) else np.zeros(len(flat), bool)
            out = []
            # the nodes themselves, with their hot shingles
            by_part = part_of(nodes, parts)
            hot_counts = np.bincount(doc[is_hot], minlength=len(first))
            hot_starts, hot_flat = np.concatenate([[0], np.cumsum(hot_counts)]), flat[is_hot]
            for p in np.unique(by_part):
                k = np.flatnonzero(by_part == p)
                out.append(_blob(p, NODES, hot_flat[ranges(hot_starts[k], hot_counts[k])].tobytes(), nodes[k].tobytes(), np.stack([sizes[k], hot_counts[k]]).tobytes()))
            # all other shingles, by partition of the hash range
            flat, doc = flat[~is_hot], doc[~is_hot]
            order = np.argsort(flat)
            flat, doc = flat[order], doc[order]
            cuts = np.searchsorted(part_of(flat, parts), np.arange(parts + 1))
            for p in range(parts):
                a, b = cuts[p], cuts[p + 1]
                if b > a:
                    table, local = np.unique(doc[a:b], return_inverse=True)
                    out.append(_blob(p, POSTINGS, pack_sorted(flat[a:b]), nodes[table].tobytes(), pack_planes(local, 3)))
            yield _blob_batch(out)

    return run


def _frequencies(parts: int):
    """A partition of the hash range: sends shingles of two nodes or more to their nodes."""

    @released
    def run(batches):
        tokens, nodes = [], []
        for batch in batches:
            own = [r for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            for _, kind, t, n, more in own:
                if kind == POSTINGS:
                    tokens.append(unpack_sorted(t))
                    nodes.append(np.frombuffer(n, np.int64)[unpack_planes(more, 3).astype(np.int64)])
            if passed := [r for r in own if r[1] == NODES]:
                yield _blob_batch(passed)
        if not tokens:
            return
        token, node = np.concatenate(tokens), np.concatenate(nodes)
        del tokens, nodes
        order = np.argsort(token)
        token, node = token[order], node[order]
        same = token[1:] == token[:-1]
        shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        token, node = token[shared], node[shared]
        order = np.lexsort((node, token))
        token, node = token[order], node[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        token, node = token[new], node[new]
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
        counts = np.diff(np.concatenate([starts, [len(token)]]))
        often = np.repeat(counts, counts)
        token, node, often = token[often > 1], node[often > 1], often[often > 1]
        order = np.argsort(node.view(np.uint64))
        token, node, often = token[order], node[order], np.minimum(often[order], HOT - 1)
        cuts = np.searchsorted(part_of(node, parts), np.arange(parts + 1))
        rows = [_blob(p, POSTINGS, token[a:b].tobytes(), pack_sorted(node[a:b].view(np.uint64)), pack_planes(often[a:b], 4)) for p in range(parts) if (b := cuts[p + 1]) > (a := cuts[p])]
        for k in range(0, len(rows), 64):
            yield _blob_batch(rows[k : k + 64])

    return run


PREFIXES = "node long, n long, matches int, prefix array<long>, levels array<int>, common array<long>"


def choose_matches(often: np.ndarray, n: int, base: int) -> int:
    """The l of least estimated cost. often: frequencies in prefix order from the first shared
    shingle on, of which the first base are in the prefix of l = 1."""
    best, least = 1, None
    reads = np.concatenate([[0], np.cumsum(often.astype(np.float64) - 1)])
    for k in range(1, min(MAX_MATCHES, needed(n)) + 1):
        read = reads[min(base + k - 1, len(often))]
        cost = read + read / k * n * VERIFY_COST
        if least is None or cost < least:
            best, least = k, cost
    return best


@released
def _prefixes(batches):
    """A partition of the nodes: prefixes of those that can have a partner."""
    token, node, often, info = [], [], [], {}
    for batch in batches:
        for _, kind, t, n, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kind == POSTINGS:
                token.append(np.frombuffer(t, np.uint64))
                node.append(unpack_sorted(n).view(np.int64))
                often.append(unpack_planes(more, 4))
            else:
                sizes, hot_counts = np.frombuffer(more, np.int64).reshape(2, -1)
                ends = np.concatenate([[0], np.cumsum(hot_counts)])
                hot = np.frombuffer(t, np.uint64)
                for k, name in enumerate(np.frombuffer(n, np.int64).tolist()):
                    if name not in info:
                        info[name] = int(sizes[k])
                        if hot_counts[k]:
                            token.append(hot[ends[k] : ends[k + 1]])
                            node.append(np.full(hot_counts[k], name, np.int64))
                            often.append(np.full(hot_counts[k], HOT, np.uint64))
    if not token:
        return
    token, node, often = np.concatenate(token), np.concatenate(node), np.concatenate(often)
    order = np.lexsort((token, often, node))
    token, node, often = token[order], node[order], often[order]
    starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    out = []
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(node)], strict=True):
        n = info[int(node[a])]
        base = n - needed(n) + 1 - (n - (b - a))  # the prefix's places after the node's unshared shingles
        if base < 1:
            continue
        k = choose_matches(often[a:b], n, base)
        size = min(base + k - 1, b - a)
        levels = np.maximum(1, np.arange(size) - base + 2)
        signed = token[a:b].view(np.int64)
        out.append((int(node[a]), n, k, signed[:size], levels, signed))
        if len(out) == 256:
            yield _prefix_batch(out)
            out = []
    if out:
        yield _prefix_batch(out)


def _prefix_batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["node", "n", "matches", "prefix", "levels", "common"])


# ---- pairs

def similar(shared: F.Column, n_a: F.Column, n_b: F.Column) -> F.Column:
    return 100 * shared >= PERCENT * (n_a + n_b - shared)


def _ratio(n_a: F.Column, n_b: F.Column) -> F.Column:
    """No smaller set can reach the threshold."""
    return 100 * F.least(n_a, n_b) >= PERCENT * F.greatest(n_a, n_b)


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs a, b that share l prefix shingles and, by their whole sets, link."""
    side = lambda x: sets.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "matches", "prefix", "common")))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    met = F.size(F.array_intersect("prefix_a", "prefix_b")) >= F.least("matches_a", "matches_b")
    return both.where(met & similar(F.size(F.array_intersect("common_a", "common_b")), F.col("n_a"), F.col("n_b"))).select("a", "b")


def star_pairs(postings: DataFrame) -> DataFrame:
    """Every posting against the least node of its list, each pair once."""
    pivots = postings.groupBy("token").agg(F.min(F.struct("node", "n")).alias("pivot"), F.count(F.lit(1)).alias("m")).where("m > 1").select("token", "pivot")
    met = postings.join(pivots, "token").where(F.col("node") != F.col("pivot.node")).where(_ratio(F.col("n"), F.col("pivot.n")))
    return met.select(F.col("pivot.node").alias("a"), F.col("node").alias("b")).distinct()


def counted_pairs(short: DataFrame, long: DataFrame) -> DataFrame:
    """Pairs of different labels that share as many prefix shingles of short lists as the smaller
    l asks for, less those that may lie in long lists: a row in long for each of them."""
    beyond = long.groupBy("node").agg(F.count(F.lit(1)).alias("beyond"))
    rows = short.join(beyond, "node", "left").withColumn("beyond", F.coalesce("beyond", F.lit(0)))
    side = lambda x: rows.select("token", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "matches", "level", "label", "beyond")))
    l = F.least("matches_a", "matches_b")
    met = side("a").join(side("b"), "token").where((F.col("node_a") < F.col("node_b")) & (F.col("label_a") != F.col("label_b")) & _ratio(F.col("n_a"), F.col("n_b")) & (F.col("level_a") <= l) & (F.col("level_b") <= l))
    least = F.greatest(l - F.least("beyond_a", "beyond_b"), F.lit(1))
    shared = met.groupBy("node_a", "node_b").agg(F.count(F.lit(1)).alias("shared"), F.first(least).alias("least"))
    return shared.where("shared >= least").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def _compare_block(table: pa.Table) -> pa.Table:
    """Outsiders against everything in the block, by counts of shared shingles; a spanning forest
    of labels. What it holds is a small multiple of the sets in the block."""
    node, label, n = (table.column(c).to_numpy() for c in ("node", "label", "n"))
    role = table.column("outside").to_numpy(zero_copy_only=False)
    sets = table.column("common").combine_chunks()
    flat = sets.flatten().to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))])
    code, row = np.unique(flat, return_inverse=True)[1], np.repeat(np.arange(len(node)), np.diff(ends))
    order = np.argsort(code, kind="stable")
    holders, starts = row[order], np.searchsorted(code[order], np.arange(code.max(initial=-1) + 2))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    links = []
    for i in np.flatnonzero(role):
        own = code[ends[i] : ends[i + 1]]
        shared = np.bincount(holders[ranges(starts[own], starts[own + 1] - starts[own])], minlength=len(node))
        for j in np.flatnonzero((label != label[i]) & (100 * shared >= PERCENT * (n + n[i] - shared))).tolist():
            x, y = root(int(label[i])), root(int(label[j]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                links.append((int(node[i]), int(node[j])))
    a, b = zip(*links, strict=True) if links else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def meetable(long: DataFrame) -> DataFrame:
    """token, bucket, node, label, n of those nodes of long lists that may have a partner whose first
    shared shingle the list's is.

    long: token, node, label, n, rem (shared shingles from this one on), level. Two sets that
    link share 3/7 of their sizes' sum, and of both no more than rem is left to share: a node's
    partner has at most 7/3 rem - n shingles. Buckets hold sizes within a factor of 4/3, and each
    node also stands in the next one, so sizes near enough meet. Two rounds drop the nodes that
    are too large for all others' limits or whose limit all others exceed.
    """
    bucket = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4 / 3)) + F.lit(1e-9)).cast("int")
    rows = long.where("level = 1").select("token", F.explode(F.array(bucket, bucket + 1)).alias("bucket"), "node", "label", "n", F.floor((7 * F.col("rem") - 3 * F.col("n")) / 3).alias("most"))
    for _ in range(2):
        rows = stored(rows, "meetable")
        ends = rows.groupBy("token", "bucket").agg(F.min("n").alias("least_n"), F.max("most").alias("best"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("token", "bucket", "least_n", "best")
        rows = rows.join(ends, ["token", "bucket"]).where("least_n <= most AND best >= n").drop("least_n", "best")
    return rows


def block_links(long: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between labels inside the long lists, whose nodes meet by their list's major label and
    size: lists of one component are one block, not one for each of its shingles."""
    rows = stored(meetable(long), "long")
    by_label = rows.groupBy("token", "bucket", "label").agg(F.count(F.lit(1)).alias("c"))
    majors = by_label.groupBy("token", "bucket").agg(F.max_by("label", F.struct("c", "label")).alias("major"), F.count(F.lit(1)).alias("labels")).where("labels > 1").select("token", "bucket", "major")
    held = stored(rows.join(majors, ["token", "bucket"]).select("major", "bucket", "node", "label", "n").distinct().withColumn("outside", F.col("label") != F.col("major")), "held")
    key = ["major", "bucket"]
    sizes = held.groupBy(*key).agg(F.sum("n").alias("volume"), F.sum(F.when(F.col("outside"), F.col("n")).otherwise(0)).alias("beyond"))
    counted = held.join(sizes, key).withColumns({"across": F.ceil(F.col("volume") / BLOCK_MEMBERS), "down": F.ceil(F.col("beyond") / BLOCK_OUTSIDERS)})
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    place = lambda df, outside, x, y: df.select(*key, "node", "label", F.lit(outside).alias("outside"), x.cast("long").alias("x"), y.cast("long").alias("y"))
    stay = place(counted.withColumn("_y", F.explode(F.sequence(F.lit(0), F.col("down") - 1))), False, own("across"), F.col("_y"))
    move = place(counted.where("outside").withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("across") - 1))), True, F.col("_x"), own("down"))
    whole = stay.unionByName(move).join(sets.select("node", "n", "common"), "node")
    return whole.groupBy(*key, "x", "y").applyInArrow(_compare_block, "a long, b long")


def join_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node, mark (hash of the text), component_id, stays for every row.

    stays: the row has its component's first doc_id and mark, in order of id, nulls last, then
    mark; rows without words stay.
    """
    spark = docs.sparkSession
    ship(spark)
    parts = partitions(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    found = stored(texts.mapInArrow(_sets, SETS), "sets")
    hot = hot_shingles(found)
    index = texts.select("text").mapInArrow(_postings(parts, hot), BLOBS).repartitionById(parts, "part").mapInArrow(_frequencies(parts), BLOBS).repartitionById(parts, "part").mapInArrow(_prefixes, PREFIXES)
    sets = stored(index, "prefixes")
    postings = sets.select("node", "n", "matches", F.size("common").alias("size"), F.posexplode(F.arrays_zip(F.col("prefix").alias("token"), F.col("levels").alias("level"))).alias("k", "p")).select("node", "n", "matches", "p.token", "p.level", (F.col("size") - F.col("k")).alias("rem"))
    star_links = stored(verify(star_pairs(postings), sets), "links")
    first = components(star_links)
    labelled = stored(postings.join(first, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    by_label = labelled.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"))
    mixed = stored(by_label.groupBy("token").agg(F.sum("c").alias("m"), F.count(F.lit(1)).alias("labels")).where("labels > 1"), "mixed")
    in_mixed = labelled.join(mixed.select("token", "m"), "token")
    short, long = in_mixed.where(F.col("m") <= SHORT_LIST), in_mixed.where(F.col("m") > SHORT_LIST)
    more = verify(counted_pairs(short, long), sets).unionByName(block_links(long, sets))
    named = lambda x: first.select(F.col("node").alias(x), F.col("label").alias(f"l_{x}"))
    between = more.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("l_a", "a").alias("a"), F.coalesce("l_b", "b").alias("b"))
    second = components(between)
    over = second.select(F.col("node").alias("label"), F.col("label").alias("final"))
    known = first.join(over, "label", "left").select("node", F.coalesce("final", "label").alias("label"))
    alone = second.join(first.select("node"), "node", "left_anti").select("node", "label")
    final = known.unionByName(alone)
    rows = found.where("token is null").select("doc_id", "n_shingles", "node", "mark").join(final, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # stored, so that the join may split a component of many documents
    first_row = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark"))
    least = stored(rows.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"), first_row.alias("first")), "least")
    stays = F.col("first").isNull() | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark")))
    return rows.join(least, "label", "left").select("doc_id", "n_shingles", "node", "mark", F.coalesce("least", "doc_id").alias("component_id"), stays.alias("stays"))


def digest(docs: DataFrame) -> DataFrame:
    return join_components(docs).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: the first in order of doc_id, null ids last, then of
    a hash of the text, then of a hash of the whole row. Each row is judged by id and text, so of
    different texts under one id only the near copies go. Rows without words have no component
    and stay, repeated or not. The rows that repeat both id and text of one that stays are few
    and meet in a grouped minimum, combined before its shuffle.
    """
    named = join_components(docs.withColumn("doc_id", F.col("doc_id").cast("long")))
    keys = named.where("n_shingles > 0").groupBy(F.col("doc_id").alias("_j_doc"), F.col("mark").alias("_j_mark")).agg(F.first("stays").alias("stays"), F.count(F.lit(1)).alias("n"))
    judged = stored(keys.where("NOT stays OR n > 1"), "judged")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_j_row"))
    same = F.col("_j_row.doc_id").cast("long").eqNullSafe(F.col("_j_doc")) & (F.xxhash64("_j_row.text") == F.col("_j_mark"))
    single = whole.join(judged.select("_j_doc", "_j_mark"), same, "left_anti")
    repeated = judged.where("stays").select("_j_doc", "_j_mark")
    if repeated.isEmpty():
        return single.select("_j_row.*")
    one = whole.join(repeated, same).groupBy("_j_doc", "_j_mark").agg(F.min_by("_j_row", F.xxhash64(F.to_json("_j_row"))).alias("_j_row"))
    return single.unionByName(one.select("_j_row")).select("_j_row.*")
