"""Near-duplicates by an LSH forest over MinHash signatures, links confirmed on full shingle sets.

1. ``sketch``: each text becomes its distinct k-word shingles (64-bit hashes), a digest of that set
   and a MinHash signature. Texts with equal sets form one class; everything below works on classes,
   so copies never multiply pairs.
2. ``forest``: each of ``TREES`` sorted orders holds all classes by its own stretch of the signature,
   range-partitioned and sorted. Neighbours are compared by their longest common prefix (LCP): runs
   whose neighbours share ``DEPTHS[0]`` values form a region; a region of over ``REGION`` classes is cut
   where neighbours share less than one value more, and again (adaptive depth). Regions still crowded
   at the last depth are tied together unseen, as are those that a partition's edge cuts: this loses
   nothing and only makes more work for step 4.
3. ``region_edges``: in a region, neighbours in the order are compared first by whole signatures; only
   classes that are still apart from the region's largest group are compared with all others. A group
   is told by edges to its least member. The first ``FIRST`` orders are worked off alone, and what they
   join counts as one in the other orders, so that a large group is spelled out once and not 24 times.
   Connected components of the candidate edges are clusters: a pair that should be linked lies in one.
4. ``confirm``: a cluster is dealt at random into blocks of at most ``BLOCK`` classes, in which all pairs
   of full sets are compared exactly, twice with different blocks. Members that are still apart from
   their cluster's largest part are then compared with all its members, in pairs of larger blocks.
   Nothing is capped or sampled, and no pair is emitted but spanning links.
5. Connected components of the confirmed links give each document its component.

Chance of missing a pair of similarity 0.8: (1 - 0.8**3)**24 = 3e-8 in sparse regions and
(1 - 0.8**5)**24 = 7e-5 at the last depth, less for more similar pairs; longer chains make a lost
component rarer still. To this the filter of all trees adds the chance that fewer than ``SIMILAR`` of
all values agree, under 1e-9: the sum stays at these figures.

Defined results: a null or empty text, or one of white space, has no shingle, is linked with nothing
and is its own component; a text with fewer words than k has its whole sequence as one shingle; a row
with a null id takes part like any other, and is a component of null if no id is reachable; repeated
rows fall into one class; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import Scratch, Words, lean, text_chunks, text_of

TREES = 24
#: Orders worked off before the others.
FIRST = 2
DEPTHS = (3, 4, 5)
REGION = 512
#: Signatures that agree in a smaller share than this are not compared further (nearly 7 deviations below 0.8).
SIMILAR = 0.55
#: Blocks of a cluster, in classes and shingle bytes, and rounds of dealing; larger blocks for what is left.
BLOCK, BLOCK_BYTES = 256, 8 << 20
DEALS = 2
WIDE_BLOCK, WIDE_BYTES = 1024, 16 << 20
#: Keys (under 64 bytes a row) that may be broadcast to find their texts.
BROADCAST_ROWS = 1_000_000
SIGNATURE = TREES * DEPTHS[-1]

_rng = np.random.default_rng(4021)
_A = (_rng.integers(1, 2**32, SIGNATURE, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 2**32, SIGNATURE, dtype=np.uint64).astype(np.uint32)

def minhash(shingles: np.ndarray) -> np.ndarray:
    """Signature of a set of 64-bit hashes: for each function a 16-bit digest of its least value."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(SIGNATURE, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 1024):
        values = low[at : at + 1024, None] * _A
        values += _B
        np.minimum(best, values.min(0), out=best)
    return ((best * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype("<u2")


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, _, data, offsets in text_chunks(column):
        hashes, bounds = Words(data, offsets).shingles(k)
        for a, b in zip(bounds[:-1], bounds[1:]):
            own = np.sort(hashes[a:b])
            if len(own) > 1:
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            yield own


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, hash of the text, n_shingles, class digest and signature of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, classes, signatures = [], [], []
            for own in shingle_sets(batch.column(2), k):
                sizes.append(len(own))
                classes.append(digest(own) if len(own) else None)
                signatures.append(minhash(own).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(signatures, pa.binary())],
                names=["doc_id", "text_hash", "n_shingles", "class", "signature"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("text_hash"), text_of().alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, text_hash long, n_shingles long, class binary, signature binary")


def _text_hash() -> Column:
    return F.xxhash64(text_of())


def grouped(run: Callable[[list], pa.RecordBatch | None], key: str):
    """Function for mapInArrow: calls run with the rows (as lists of batches) of each key of sorted batches."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            if not len(keys):
                continue
            cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            for a, b in zip(cuts[:-1], cuts[1:]):
                if held and keys[a] != last:
                    if (out := run(held)) is not None:
                        yield out
                    held = []
                held.append(batch.slice(a, b - a))
                last = keys[a]
        if held and (out := run(held)) is not None:
            yield out

    return walk


def _longs(held: list[pa.RecordBatch], column: str) -> np.ndarray:
    return np.concatenate([x.column(column).to_numpy(zero_copy_only=False) for x in held])


def _bytes(held: list[pa.RecordBatch], column: str) -> list[bytes]:
    return [v for x in held for v in x.column(column).to_pylist()]


class Sets:
    """Union-find over 0 .. n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y

    def join_equal(self, names: np.ndarray) -> None:
        """Join places of equal names."""
        for places in np.split(np.argsort(names, kind="stable"), np.flatnonzero(np.diff(np.sort(names))) + 1):
            for p in places[1:].tolist():
                self.join(int(places[0]), p)

    def roots(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.up))], np.int64)


def _edges(a: list[int], b: list[int]) -> pa.RecordBatch | None:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]) if a else None


# --------------------------------------------------------------------------- the sorted orders

#: What a row of an order's walk says: a member of a region, a partition's first or last region, or a tie.
MEMBER, FIRST_REGION, LAST_REGION, TIE = range(4)
_WALK = "kind int, region long, node long, part long, place long, depth int, key binary"
_WALK_ARROW = pa.schema(
    [("kind", pa.int32()), ("region", pa.int64()), ("node", pa.int64()), ("part", pa.int64()), ("place", pa.int64()), ("depth", pa.int32()), ("key", pa.binary())]
)


def cut_regions(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, depths and crowding of the regions of a sorted stretch, from each row's LCP with the row before."""
    n = len(lcp)
    cut, depth = lcp < DEPTHS[0], np.full(n, DEPTHS[0])
    cut[0] = True
    for deeper in (*DEPTHS[1:], None):
        start = np.flatnonzero(cut)
        size = np.diff(np.append(start, n))
        crowded = size > REGION
        if deeper is None or not crowded.any():
            return start, depth[start], crowded
        inside = np.repeat(crowded, size)
        cut |= inside & (lcp < deeper)
        depth[inside] = deeper
    raise AssertionError


def walk_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Regions of one partition of the sorted orders; a run of neighbours is held until it ends."""
    base, place, number, width = TaskContext.get().partitionId() << 32, 0, 0, 1 + DEPTHS[-1]
    keys, nodes, parts = np.zeros((0, width), np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = True, None

    def emit(n: int) -> Iterator[pa.RecordBatch]:
        nonlocal place, number, first, last
        own = keys[:n]
        start, depth, crowded = cut_regions(_lcp(own))
        size = np.diff(np.append(start, n))
        ids = base + number + np.arange(len(start))
        least = np.minimum.reduceat(parts[:n], start)
        mixed = least != np.maximum.reduceat(parts[:n], start)
        out = []
        rows = np.flatnonzero(np.repeat(mixed & ~crowded, size))
        if len(rows):
            of = np.repeat(np.arange(len(start)), size)[rows]
            out.append((np.full(len(rows), MEMBER), ids[of], nodes[rows], parts[rows], place + rows, depth[of], [None] * len(rows)))
        for r in np.flatnonzero(mixed & crowded):
            others = np.unique(parts[start[r] : start[r] + size[r]])[1:]
            out.append((np.full(len(others), TIE), *(np.full(len(others), x) for x in (ids[r], least[r])), others, others * 0, others * 0, [None] * len(others)))
        edge = lambda r, kind, row: ([kind], [ids[r]], [least[r]], [least[r]], [place + row], [depth[r]], [own[row].tobytes()])
        if first:
            out.append(edge(0, FIRST_REGION, 0))
            first = False
        last = edge(len(start) - 1, LAST_REGION, n - 1)
        place, number = place + n, number + len(start)
        for x in out:
            yield _walk_batch(x)

    for batch in batches:
        if not batch.num_rows:
            continue
        fresh = np.empty((batch.num_rows, width), np.uint16)
        fresh[:, 0] = batch.column("t").to_numpy(zero_copy_only=False)
        fresh[:, 1:] = np.frombuffer(b"".join(batch.column("stretch").to_pylist()), ">u2").reshape(-1, width - 1)
        keys = np.concatenate([keys, fresh])
        nodes = np.concatenate([nodes, batch.column("node").to_numpy(zero_copy_only=False)])
        parts = np.concatenate([parts, batch.column("part").to_numpy(zero_copy_only=False)])
        whole = np.flatnonzero(_lcp(keys) < DEPTHS[0])[-1]
        if whole:
            yield from emit(whole)
            keys, nodes, parts = keys[whole:], nodes[whole:], parts[whole:]
    if len(keys):
        yield from emit(len(keys))
    if last:
        yield _walk_batch(last)


def _walk_batch(columns: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _WALK_ARROW)], schema=_WALK_ARROW)


def _lcp(keys: np.ndarray) -> np.ndarray:
    """Values of the stretch that each row shares with the row before; -1 where the tree is another."""
    same = np.zeros((len(keys), keys.shape[1]), np.int8)
    same[1:] = keys[1:] == keys[:-1]
    return np.cumprod(same, axis=1).sum(1) - 1


def cut_by_partitions(walked: DataFrame) -> tuple[list[tuple[int, int]], list[int]]:
    """Edges between the pieces of regions that a partition's edge cuts, and the ids of these pieces.

    Two rows a partition reach the driver.
    """
    width, edges, pieces = DEPTHS[-1], [], set()
    ends = walked.filter(F.col("kind").isin(FIRST_REGION, LAST_REGION)).select("kind", "region", "part", "depth", "key").collect()
    firsts = {r.region >> 32: r for r in ends if r.kind == FIRST_REGION}
    lasts = {r.region >> 32: r for r in ends if r.kind == LAST_REGION}
    order = sorted(firsts)
    for p, q in zip(order, order[1:]):
        x, y = lasts[p], firsts[q]
        a, b = (np.frombuffer(r.key, np.uint16) for r in (x, y))
        common = int(np.cumprod(a == b).sum()) - 1
        if common >= min(width, max(x.depth, y.depth)):
            edges.append((x.part, y.part))
            pieces |= {x.region, y.region}
    return edges, sorted(pieces)


def region_edges(held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
    """Edges from the least part of each group of similar signatures in a region to the group's others."""
    parts = _longs(held, "part")
    table = np.frombuffer(b"".join(_bytes(held, "signature")), "<u2").reshape(len(parts), SIGNATURE)
    need, sets = SIMILAR * SIGNATURE, Sets(len(parts))
    sets.join_equal(parts)
    for i in np.flatnonzero((table[1:] == table[:-1]).sum(1) >= need).tolist():
        sets.join(i, i + 1)
    root = sets.roots()
    largest = np.bincount(root).argmax()
    for i in np.flatnonzero(root != largest).tolist():
        others = np.flatnonzero(root != root[i])
        for j in others[(table[others] == table[i]).sum(1) >= need].tolist():
            sets.join(i, j)
    root, a, b = sets.roots(), [], []
    for r in np.unique(root):
        own = np.unique(parts[root == r])
        a += [int(own[0])] * (len(own) - 1)
        b += own[1:].tolist()
    return _edges(a, b)


def forest(nodes: DataFrame, trees: range, scratch: Scratch) -> DataFrame:
    """Candidate edges (a, b) between the parts of ``nodes`` (node, part, signature) by the given orders."""
    spark, width = nodes.sparkSession, 2 * DEPTHS[-1]
    stretch = F.expr(f"substring(signature, t * {width} + 1, {width})")
    rows = nodes.select("node", "part", "signature", F.explode(F.lit(list(trees))).alias("t")).select("t", stretch.alias("stretch"), "node", "part")
    rows = rows.repartitionByRange("t", "stretch", "node").sortWithinPartitions("t", "stretch", "node")
    walked = scratch.table(rows.mapInArrow(lean(walk_order), _WALK), "orders")
    between, pieces = cut_by_partitions(walked)
    members = walked.filter(F.col("kind") == MEMBER).select("region", "place", "node", "part")
    full = members.join(nodes.select("node", "signature"), "node").repartition("region").sortWithinPartitions("region", "place")
    edges = full.select("region", "part", "signature").mapInArrow(lean(grouped(region_edges, "region")), "a long, b long")
    edges = edges.unionByName(walked.filter(F.col("kind") == TIE).select(F.col("node").alias("a"), F.col("part").alias("b")))
    if pieces:
        cut = F.broadcast(spark.createDataFrame([(p,) for p in pieces], "region long"))  # two rows a partition at most
        torn = members.join(cut, "region")
        least = torn.groupBy("region").agg(F.min("part").alias("a"))
        edges = edges.unionByName(torn.join(least, "region").filter("part <> a").select("a", F.col("part").alias("b")))
        edges = edges.unionByName(spark.createDataFrame(between, "a long, b long"))
    return edges.distinct()


def clusters_of(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """node, cluster: components of the candidate edges of all orders, for nodes that have an edge."""
    alone = nodes.select("node", F.col("node").alias("part"), "signature")
    first = components(forest(alone, range(FIRST), scratch), scratch).withColumnRenamed("root", "_one")
    parted = scratch.table(nodes.join(first, "node", "left").select("node", "_one", F.coalesce("_one", "node").alias("part"), "signature"), "parted")
    second = components(forest(parted, range(FIRST, TREES), scratch), scratch).select(F.col("node").alias("part"), F.col("root").alias("_two"))
    both = parted.select("node", "part", "_one").join(second, "part", "left").filter("_one IS NOT NULL OR _two IS NOT NULL")
    return both.select("node", F.coalesce("_two", "part").alias("cluster"))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root: the least node of each connected component of the edges (a, b).

    Least labels spread along edges and then along themselves (pointer jumping), so the number of
    rounds grows with the logarithm of the longest path. Only sums and minima are shuffled.
    """
    both = scratch.table(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    step = scratch.child()
    labels = step.table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"), "labels")
    while True:
        before, step = step, scratch.child()
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        lower = step.table(lower, "lower")
        up = lower.select(F.col("node").alias("root"), F.col("root").alias("top"))
        jumped = step.table(lower.join(up, "root").select("node", F.least("root", "top").alias("root"), "was"), "labels")
        changed = jumped.filter("root <> was").limit(1).count()
        labels = jumped.select("node", "root")
        before.drop()
        if not changed:
            return labels


# ------------------------------------------------------------------------------- confirmation


def common_sizes(sets: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets at ``rows`` with all sets, by products over shared shingles."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    fresh = np.concatenate([[True], values[1:] != values[:-1]])
    number = np.cumsum(fresh) - 1
    shared = np.bincount(number)[number] > 1
    number, owner = np.cumsum(fresh[shared]) - 1, owner[shared]
    out, bits = np.zeros((len(rows), len(sets)), np.int64), 1 << 12
    for low in range(0, int(number[-1]) + 1 if len(number) else 0, bits):
        a, b = np.searchsorted(number, [low, low + bits])
        dense = np.zeros((len(sets), min(bits, int(number[b - 1]) - low + 1)), np.float32)
        dense[owner[a:b], number[a:b] - low] = 1
        out += (dense[rows] @ dense.T).astype(np.int64)
    return out


def spanning_links(held: list[pa.RecordBatch], percent: int) -> pa.RecordBatch | None:
    """Links that join parts of a block further: rows whose ``all`` is true are compared with every row."""
    nodes, first = np.unique(_longs(held, "node"), return_index=True)
    packed, parts = _bytes(held, "shingles"), _longs(held, "part")[first]
    sets = [np.frombuffer(packed[i], "<u8") for i in first]
    full = np.unique(_longs(held, "node")[_longs(held, "all").astype(bool)])
    rows = np.searchsorted(nodes, full)
    if len(nodes) < 2 or not len(rows):
        return None
    sizes, common = np.array([len(x) for x in sets], np.int64), common_sizes(sets, rows)
    found, a, b = Sets(len(nodes)), [], []
    found.join_equal(parts)
    for at, i in enumerate(rows.tolist()):
        inter = common[at]
        for j in np.flatnonzero((inter > 0) & (100 * inter >= percent * (sizes[i] + sizes - inter))).tolist():
            if i != j and found.join(i, j):
                a.append(int(nodes[i]))
                b.append(int(nodes[j]))
    return _edges(a, b)


def sets_of(docs: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """The columns of ``members`` (with id, text_hash and class) and each one's sorted shingles."""
    kept = [c for c in members.columns if c not in ("id", "text_hash", "class")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # repeated rows of one text give its set once
        for batch in batches:
            wanted, nodes = batch.column("class").to_pylist(), batch.column("node").to_pylist()
            # Sets are let go in small batches: they are larger than their texts.
            keep, found, total = [], [], 0
            for at, own in enumerate(shingle_sets(batch.column("text"), k)):
                if nodes[at] not in seen and digest(own) == wanted[at]:
                    seen.add(nodes[at])
                    keep.append(at)
                    found.append(own.tobytes())
                    total += own.nbytes
                if keep and (total > 8 << 20 or at + 1 == len(wanted)):
                    part = batch.take(pa.array(keep))
                    yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array(found, pa.binary())], names=[*kept, "shingles"])
                    keep, found, total = [], [], 0

    small = members.count() <= BROADCAST_ROWS
    wanted = members.withColumnsRenamed({"id": "_id", "text_hash": "_hash"})
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), _text_hash().alias("text_hash"), text_of().alias("text"))
    same = texts["id"].eqNullSafe(wanted["_id"]) & (texts["text_hash"] == wanted["_hash"])
    rows = texts.join(F.broadcast(wanted) if small else wanted, same).select(*kept, "class", "text")
    types = dict(members.dtypes)
    return rows.mapInArrow(lean(run), ", ".join(f"{c} {types[c]}" for c in kept) + ", shingles binary")


def _by_block(rows: DataFrame, percent: int, *block: str) -> DataFrame:
    dealt = rows.withColumn("key", F.xxhash64("cluster", *block)).select("key", "node", "part", "all", "shingles")
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(lean(grouped(lambda held: spanning_links(held, percent), "key")), "a long, b long")


def confirm(docs: DataFrame, members: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) that span the links within clusters: 100 * intersection >= percent * union.

    members: node, cluster, id and text_hash of a row with the class's text, class, n_shingles.
    """
    per = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), (8 * F.sum("n_shingles")).alias("bytes"))
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("long")
    members = scratch.table(members.join(per, "cluster").filter("size > 1").withColumn("blocks", blocks), "members")
    slim = members.select("node", "cluster", "id", "text_hash", "class", "blocks", F.col("node").alias("part"), F.lit(1).alias("all"))
    deal = lambda rows, n: _by_block(sets_of(docs, rows, k).withColumn("own", F.pmod(F.xxhash64("node", F.lit(n)), "blocks")), percent, "own")
    links = scratch.table(deal(slim, 0), "links")
    large = slim.filter("blocks > 1")
    if not large.limit(1).count():
        return links
    for n in range(1, DEALS):
        links = links.unionByName(scratch.table(deal(large, n), "links"))
    inside = links.join(large.select(F.col("node").alias("a")), "a", "left_semi")
    parts = components(inside, scratch)
    named = members.filter("blocks > 1").join(parts, "node", "left").withColumn("part", F.coalesce("root", "node")).drop("root")
    named = scratch.table(named, "parts")
    each = named.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("n"))
    main = each.groupBy("cluster").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most")).filter("n > most")
    apart = named.join(main.select("cluster", "main"), "cluster").withColumn("rest", F.col("part") != F.col("main"))
    rest = apart.groupBy("cluster").agg(F.count_if("rest").alias("n"), (8 * F.sum(F.when(F.col("rest"), F.col("n_shingles")))).alias("b"))
    wide = lambda n, b: F.ceil(F.greatest(F.col(n) / WIDE_BLOCK, F.col(b) / WIDE_BYTES)).cast("long")
    apart = apart.join(rest, "cluster").withColumns({"rests": wide("n", "b"), "alls": wide("size", "bytes")})
    apart = scratch.table(apart.select("node", "cluster", "id", "text_hash", "class", "part", "rest", "rests", "alls"), "apart")
    if not apart.limit(1).count():
        return links
    rows = sets_of(docs, apart, k)
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    place = lambda i, j, full: F.struct(i.alias("i"), j.alias("j"), F.lit(full).alias("all"))
    as_rest = F.when(F.col("rest"), F.transform(upto("alls"), lambda j: place(own("rests"), j, 1))).otherwise(F.array().cast("array<struct<i:bigint,j:bigint,all:int>>"))
    as_any = F.transform(upto("rests"), lambda i: place(i, own("alls"), 0))
    rows = rows.withColumn("_at", F.explode(F.concat(as_rest, as_any))).select("node", "cluster", "part", "shingles", "_at.*")
    return links.unionByName(scratch.table(_by_block(rows, percent, "i", "j"), "links"))


def grouped_rows(docs: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """For each row: doc_id, text_hash, n_shingles, and the group's keeper (keep_id, keep_hash; null without shingles).

    The keeper is the group's row of the least id, nulls last, and then of the least hash of the text.
    """
    with scratch.child() as own:
        sketched = scratch.table(sketch(docs, k), "sketch")
        least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "text_hash"))
        classes = sketched.filter("class IS NOT NULL").groupBy("class").agg(
            least.alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")
        )
        nodes = own.table(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
        members = nodes.select("node", "class", "n_shingles", "rep.id", "rep.text_hash").join(clusters_of(nodes, own), "node")
        linked = components(confirm(docs, members, k, percent, own), own)
        named = nodes.select("node", "class", "rep").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
        keepers = named.groupBy("root").agg(F.min("rep").alias("keep"))
        by_class = named.join(keepers, "root").select("class", F.col("keep.id").alias("keep_id"), F.col("keep.text_hash").alias("keep_hash"))
        by_class = scratch.table(by_class, "keepers")
    return sketched.select("doc_id", "text_hash", "n_shingles", "class").join(by_class, "class", "left").drop("class")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """For each row: doc_id, n_shingles, component_id (least id reachable by links) and kept."""
    rows = grouped_rows(docs, k, percent, scratch or Scratch(docs.sparkSession))
    component = F.when(F.col("keep_hash").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """One document of each group, with the columns of ``docs``: the keeper of ``grouped_rows``.

    Rows are told apart by id and text, so that of rows with one id but different texts, or with null ids,
    only copies go. Of rows equal in both one stays, whatever its other columns. Rows without shingles all
    stay. Verdicts are taken on slim rows; texts stay in the scan while the keys to drop can be broadcast.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows = grouped_rows(docs, k, percent, scratch).filter("keep_hash IS NOT NULL")
    is_keeper = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_hash") == F.col("keep_hash"))
    counted = rows.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), is_keeper.alias("_keeper")).agg(F.count(F.lit(1)).alias("_n"))
    gone = scratch.table(counted.filter("NOT _keeper OR _n > 1"), "gone")
    sizes = {r["_keeper"]: r["n"] for r in gone.groupBy("_keeper").agg(F.count(F.lit(1)).alias("n")).collect()}
    keyed = docs["doc_id"].cast("long").eqNullSafe(gone["_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["_hash"])
    out = docs.join(F.broadcast(gone) if sum(sizes.values()) <= BROADCAST_ROWS else gone, keyed, "left_anti")
    if sizes.get(True):
        repeated = docs.join(gone.filter("_keeper"), keyed, "left_semi")
        out = out.unionByName(repeated.dropDuplicates(["doc_id", "text"]))
    return out
