"""SimHash near-duplicates: vantage-point trees over fingerprints.

**Fingerprints.**  Every whole text is lower-cased (A-Z), cut into words and
word shingles; a fingerprint bit is 1 if it is 1 in over half of the shingles'
XXH64 values.  A text without words has fingerprint zero and is linked like any
other; null counts as the empty text.

**Bands and trees.**  Two fingerprints within ``k`` bits differ by at most
``k // bands`` bits in one of ``bands`` disjoint groups of bits, so there is one
vantage-point tree a band, over the distance within the band (a pseudo-metric:
the triangle bounds hold, and the ring widths to bounds ratio is far better than
with all 64 bits).  So recall rests on the bands, and a tree deals a band's
fingerprints to tasks.  Every fingerprint has a home leaf in each tree, and by the
triangle bound it can have neighbours only in the few leaves whose rings its own
ring, widened by the radius, overlaps.  It is sent as a query to those with a
larger number than its home (the others send theirs to it).  A task that gets a
leaf goes on with vantage points below it until blocks are small, then compares
whole fingerprints.

Trees are as deep as leaves of ``LEAF`` fingerprints ask for, up to ``DEEPEST``
levels: the first ``STAGE`` are fitted on a sample on the driver, further ones on
samples of the leaves by the tasks, so each level is fitted on as many points, and
what is broadcast is at most ``2 ** DEEPEST`` vantage points a tree (10 MB).  Leaves
as deep as that hold single values of a band, more or less, whose fan-out is that
of the values within the radius.

**Large groups.**  Copies collapse to one fingerprint before anything is sent.
Fingerprints within ``k`` bits of a *dense* cluster of sample points (clusters
with over ``DENSE`` of the sample) are linked to it at once.  All of a cluster's
members are one component already, so where they fill a leaf they are never
compared with each other; they lie, salted, in blocks of their own, where only
the fingerprints outside the cluster look for links.  Thus a group with a third of
all rows costs linear work and no task holds it whole.  Smaller clusters that
crowd a block are united around pivots first, and only what stays outside the
largest is compared with the rest.

Tasks emit a spanning forest of what they find (never all pairs), and
:mod:`docmill.llm.components` contracts the forests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.components import connected
from docmill.llm.runtime import looked_up, map_texts, scratch, written

#: Sample points that trees are fitted on, and the share of them that makes a cluster dense.
SAMPLE = 4096
DENSE = 1 / 256
#: Leaves of a tree: at least so many (a power of two), more if leaves would hold over LEAF fingerprints.
LEAVES, LEAF = 256, 8192
#: Levels fitted at a time, levels at most, and the sample of a leaf for each leaf to be made below it.
STAGE, DEEPEST, PER_LEAF = 8, 20, 16
#: Members of a dense cluster in a block; fewer in a leaf, or than one in SALTED of all, are dealt like the others.
BLOCK, SALTED = 2048, 65536
#: A block with more pairs is united around so many pivots first.
CROWDED, PIVOTS = 1 << 24, 16
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(data: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """The fingerprint of a text's UTF-8 bytes, unsigned."""
    words = (data or b"").lower().split()  # bytes: lower() and split() know ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    h, ones, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(starts)
    stops = ends[shingle - 1 :].tolist()
    for i in range(0, total, 65536):
        block = np.array([h(joined[s:e], seed) for s, e in zip(starts[i : i + 65536], stops[i : i + 65536], strict=True)], np.uint64)
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``(id, fp)`` for every row; ``fp`` is the fingerprint as a bigint."""

    def start():
        return lambda data: (signed(fingerprint(data, shingle)),)

    return map_texts(docs, start, "fp bigint", [id_col], text_col, ["fp"])


def bands_of(k: int) -> tuple[list[np.uint64], int]:
    """Masks of the bands and the radius within one of them."""
    n = k // 2 + 1
    edges = [64 * i // n for i in range(n + 1)]
    return [np.uint64(((1 << b) - 1) ^ ((1 << a) - 1)) for a, b in zip(edges, edges[1:], strict=False)], k // n


class Tree:
    """A vantage-point tree of fixed depth, stored as a heap of points and radii."""

    def __init__(self, points: np.ndarray, mask: np.uint64, radius: int, depth: int) -> None:
        self.mask, self.radius, self.depth = mask, radius, depth
        self.vantage = np.zeros((1 << depth) - 1, np.uint64)
        self.inner = np.full((1 << depth) - 1, 64, np.int16)
        groups = [points]
        for node in range((1 << depth) - 1):
            group = groups[node]
            if len(group) > 1:
                self.vantage[node], self.inner[node] = self._choose(group)
            near = np.bitwise_count((group ^ self.vantage[node]) & mask) <= self.inner[node]
            groups += [group[near], group[~near]]

    def _choose(self, group: np.ndarray) -> tuple[np.uint64, int]:
        """Of some candidates, the point and ring whose halves are evenest and whose overlap is least."""
        best = (np.inf, group[0], 64)
        for v in group[:: max(1, len(group) // 8)][:8]:
            counts = np.bincount(np.bitwise_count((group ^ v) & self.mask), minlength=65)
            below = np.cumsum(counts)
            for ring in range(64):
                if 0 < below[ring] < len(group):
                    overlap = below[min(64, ring + self.radius)] - (below[ring - self.radius] if ring >= self.radius else 0)
                    cost = abs(2 * below[ring] / len(group) - 1) + 0.5 * overlap / len(group)
                    best = min(best, (cost, v, ring), key=lambda x: x[0])
        return best[1], best[2]

    def home(self, fps: np.ndarray) -> np.ndarray:
        """The home leaf of each fingerprint."""
        node = np.zeros(len(fps), np.int64)
        for _ in range(self.depth):
            near = np.bitwise_count((fps ^ self.vantage[node]) & self.mask) <= self.inner[node]
            node = 2 * node + 2 - near
        return node - ((1 << self.depth) - 1)

    def deepened(self, extra: int, leaves: np.ndarray, vantage: np.ndarray, inner: np.ndarray) -> None:
        """Put trees of ``extra`` levels, a row each, below some of the leaves; the others' members go left."""
        n = 1 << self.depth
        below, rings = np.zeros((n, (1 << extra) - 1), np.uint64), np.full((n, (1 << extra) - 1), 64, np.int16)
        below[leaves], rings[leaves] = vantage, inner
        for level in range(extra):
            own = slice((1 << level) - 1, (2 << level) - 1)
            self.vantage = np.concatenate([self.vantage, below[:, own].ravel()])
            self.inner = np.concatenate([self.inner, rings[:, own].ravel()])
        self.depth += extra

    def route(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For fingerprints: (row, leaf, is it the home leaf) of every leaf that may hold neighbours."""
        row, node, home = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.ones(len(fps), bool)
        for _ in range(self.depth):
            d = np.bitwise_count((fps[row] ^ self.vantage[node]) & self.mask).astype(np.int16)
            near = d <= self.inner[node]
            left, right = d - self.radius <= self.inner[node], d + self.radius > self.inner[node]
            row, node, home = (
                np.concatenate([row[left], row[right]]),
                np.concatenate([2 * node[left] + 1, 2 * node[right] + 2]),
                np.concatenate([(home & near)[left], (home & ~near)[right]]),
            )
        return row, node - ((1 << self.depth) - 1), home


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite the sets of a[i] and b[i]; ``parent`` holds roots before and after."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def find_links(fps: np.ndarray, members: np.ndarray, queries: np.ndarray, k: int, mask: np.uint64, radius: int) -> np.ndarray:
    """Roots of the forest that the pairs (query, member) within ``k`` bits make of ``fps``.

    Goes on with vantage points (within the band, then over all bits) while a
    block has many pairs and a ring divides it.
    """
    parent = np.arange(len(fps))
    todo = [(members, queries, mask, radius)]
    while todo:
        m, q, at, r = todo.pop()
        if not len(m) or not len(q):
            continue
        if len(m) > 64 and len(m) * len(q) > 1 << 20:
            split = None
            for v in fps[m[:: max(1, len(m) // 4)][:4]]:
                dm = np.bitwise_count((fps[m] ^ v) & at).astype(np.int16)
                ring = int(np.median(dm))
                inside = dm <= ring
                if inside.all():
                    ring -= 1
                    inside = dm <= ring
                if inside.any() and not inside.all():
                    split = v, ring, inside
                    break
            if split:
                v, ring, inside = split
                dq = np.bitwise_count((fps[q] ^ v) & at).astype(np.int16)
                left, right = dq - r <= ring, dq + r > ring
                if left.mean() + right.mean() < 1.9:
                    todo += [(m[inside], q[left], at, r), (m[~inside], q[right], at, r)]
                    continue
            if at != ALL:
                todo.append((m, q, ALL, k))
                continue
            if len(m) * len(q) > CROWDED:
                rest = _around_pivots(fps, m, q, k, parent)
                if rest is not None:
                    todo += rest
                    continue
        step = max(1, (1 << 20) // len(m))
        for i in range(0, len(q), step):
            part = q[i : i + step]
            x, y = np.nonzero(np.bitwise_count(fps[part][:, None] ^ fps[m][None, :]) <= k)
            unite(parent, part[x], m[y])
    return parent


def _around_pivots(fps: np.ndarray, m: np.ndarray, q: np.ndarray, k: int, parent: np.ndarray) -> list[tuple] | None:
    """Unite what lies around some pivots; the pairs still to be compared, or None where that spares little.

    Pairs within the largest set need no comparison: they are united already.
    """
    apart = np.arange(len(m))
    for _ in range(PIVOTS):
        if not len(apart):
            break
        pivot = m[apart[len(apart) // 2]]
        near = np.concatenate([x[np.bitwise_count(fps[x] ^ fps[pivot]) <= k] for x in (m, q)])
        unite(parent, np.full(len(near), pivot), near)
        apart = np.nonzero(parent[m] != np.bincount(parent[m]).argmax())[0]
    largest = np.bincount(parent[m]).argmax()
    out, others = m[parent[m] != largest], q[parent[q] != largest]
    if 2 * (len(out) * len(q) + (len(m) - len(out)) * len(others)) > len(m) * len(q):
        return None
    return [(out, q, ALL, k), (m[parent[m] == largest], others, ALL, k)]


def near_links(distinct: DataFrame, k: int = 4) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints (column ``fp``, no repeats).

    They connect exactly the fingerprints that chains of pairs within ``k`` bits connect.
    """
    spark = distinct.sparkSession
    total = distinct.count()
    sample = np.array([r.fp for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    masks, radius = bands_of(k)
    # dense clusters of the sample: their points become one component, members lie in blocks of their own
    every = np.arange(len(sample))
    roots = find_links(sample, every, every, k, ALL, k) if len(sample) else every
    sizes = np.bincount(roots, minlength=len(sample)) if len(sample) else every
    dense = sizes >= max(16, DENSE * len(sample))
    hot = sample[dense[roots]] if len(sample) else sample
    hot_root = roots[dense[roots]] if len(sample) else roots
    depth = min(DEEPEST, max(LEAVES.bit_length() - 1, int(np.ceil(np.log2(max(1, total / LEAF))))))
    points = sample[~dense[roots]] if len(sample) and not dense.all() else sample
    trees = [Tree(points, mask, radius, min(depth, STAGE)) for mask in masks]
    while trees[0].depth < depth:
        _deepen(distinct, total, trees, min(STAGE, depth - trees[0].depth))
    cluster_ids = {int(r): i for i, r in enumerate(np.unique(hot_root))}
    hot_id = np.array([cluster_ids[int(r)] for r in hot_root], np.int64)
    root_fp = {i: int(sample[r].view(np.int64)) for r, i in cluster_ids.items()}

    def clusters(fps: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """The dense cluster of each fingerprint (-1: none), and links of those near several."""
        own = np.full(len(fps), -1)
        more = []
        for i in range(0, len(fps) if len(hot) else 0, 256):
            near = np.bitwise_count(fps[i : i + 256, None] ^ hot[None, :]) <= k
            at = near.any(axis=1)
            own[i : i + 256][at] = hot_id[near.argmax(axis=1)[at]]
            for c in range(1, len(root_fp)) if len(root_fp) > 1 else ():
                also = near[:, hot_id == c].any(axis=1) & (own[i : i + 256] != c)
                more += [(int(x), c) for x in np.nonzero(also)[0] + i]
        return own, more

    labelled = distinct
    hot_leaves: dict[tuple[int, int], dict[int, int]] = {}
    if len(hot):

        def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                own, more = clusters(fps)
                extra = [[] for _ in range(len(fps))]
                for x, c in more:
                    extra[x].append(root_fp[c])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.int32()), pa.array(extra, pa.list_(pa.int64()))], ["fp", "cluster", "also"])

        labelled = written(distinct.select("fp").mapInArrow(label, "fp bigint, cluster int, also array<bigint>"), "clusters")

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fps, own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(1).to_numpy()
                out = []
                for t, tree in enumerate(trees):
                    keys, n = np.unique(tree.home(fps) * len(root_fp) + own, return_counts=True)
                    out += [(t, int(x) // len(root_fp), int(x) % len(root_fp), int(c)) for x, c in zip(keys, n, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], ["t", "leaf", "cluster", "n"])

        counted = labelled.where("cluster >= 0").select("fp", "cluster").mapInArrow(count, "t bigint, leaf bigint, cluster bigint, n bigint")
        many = max(BLOCK, total // SALTED)
        for r in counted.groupBy("t", "leaf", "cluster").agg(F.sum("n").alias("n")).where(F.col("n") >= many).collect():  # at most trees x SALTED rows
            hot_leaves.setdefault((r.t, r.leaf), {})[r.cluster] = -(-r.n // many)

    n_trees, n_leaves = len(trees), 1 << depth
    blocks: list[dict[int, list[tuple[int, int, int]]]] = [{} for _ in trees]  # of a tree's leaf: cluster, first block and how many
    following = n_trees * n_leaves
    for (t, leaf), found in sorted(hot_leaves.items()):
        for c, n in sorted(found.items()):
            blocks[t].setdefault(leaf, []).append((c, following, n))
            following += n
    # a tree's salted (leaf, cluster) pairs, as numbers
    salted = [np.array(sorted(x * len(root_fp) + c for x, found in own.items() for c, _, _ in found), np.int64) for own in blocks]
    salted_leaves = [np.array(sorted(own), np.int64) for own in blocks]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 8192):
                yield from sent(whole.slice(at, 8192))

    def sent(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        own = batch.column(1).to_numpy() if batch.num_columns > 1 else np.full(len(fps), -1)
        salt = fps * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
        for t, tree in enumerate(trees):
            row, leaf, home = tree.route(fps)
            at_home = np.zeros(len(fps), np.int64)
            at_home[row[home]] = leaf[home]
            # members that fill a leaf lie in blocks of their own; everything else is dealt alike
            apart = (own >= 0) & np.isin(at_home * max(1, len(root_fp)) + own, salted[t])
            take = ~apart[row] & (home | (leaf > at_home[row]))
            parts = [(t * n_leaves + leaf[take], row[take], home[take])]
            hot_here = np.isin(leaf, salted_leaves[t])
            for x in np.unique(leaf[hot_here]):
                there = leaf == x
                for c, first, n in blocks[t][int(x)]:
                    m = row[there & home & apart[row] & (own[row] == c)]
                    parts.append((first + (salt[m] % np.uint64(n)).astype(np.int64), m, np.ones(len(m), bool)))
                    q = row[there & np.where(apart[row], own[row] > c, own[row] != c)]
                    parts += [(np.full(len(q), first + i), q, np.zeros(len(q), bool)) for i in range(n)]
            block, rows, member = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(fps[rows].view(np.int64)), pa.array(member)], ["block", "fp", "member"])

    def compare(group: pa.Table) -> pa.Table:
        block = group.column("block")[0].as_py()
        fps = group.column("fp").to_numpy().view(np.uint64)
        member = group.column("member").to_numpy()
        plain = block < n_trees * n_leaves
        mask = masks[block // n_leaves] if plain else ALL
        every, m = np.arange(len(fps)), np.nonzero(member)[0]
        parent = find_links(fps, m, every if plain else np.nonzero(~member)[0], k, mask, radius if plain else k)
        linked = np.nonzero(parent != every)[0]
        return pa.table({"a": fps[linked].view(np.int64), "b": fps[parent[linked]].view(np.int64)})

    shipped = labelled.select("fp", *(["cluster"] if len(hot) else [])).mapInArrow(send, "block bigint, fp bigint, member boolean")
    links = shipped.groupBy("block").applyInArrow(compare, "a bigint, b bigint")
    if len(hot):
        names = F.element_at(F.array(*[F.lit(root_fp[i]) for i in range(len(root_fp))]), F.col("cluster") + 1)
        held = labelled.where("cluster >= 0")
        links = links.union(held.select(F.col("fp").alias("a"), names.alias("b")))
        links = links.union(held.select(F.col("fp").alias("a"), F.explode("also").alias("b")))
    return links


def _deepen(distinct: DataFrame, total: int, trees: list[Tree], extra: int) -> None:
    """Fit ``extra`` levels below the trees' leaves, each on a sample of its own, by the tasks."""
    share = min(1.0, PER_LEAF * 2.0 ** (trees[0].depth + extra) / max(1, total))
    ticket = F.shiftrightunsigned(F.xxhash64("fp", F.lit(1)), 11) / F.lit(float(1 << 53))

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for t, tree in enumerate(trees):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), t)), pa.array(tree.home(fps)), batch.column(0)], ["t", "leaf", "fp"])

    def fitted(group: pa.Table) -> pa.Table:
        t, fps = group.column("t")[0].as_py(), np.sort(group.column("fp").to_numpy().view(np.uint64))
        own = Tree(fps, trees[t].mask, trees[t].radius, extra)
        return pa.table({"t": [t], "leaf": [group.column("leaf")[0].as_py()], "vantage": [own.vantage.tobytes()], "inner": [own.inner.tobytes()]})

    drawn = distinct.where(ticket < share).select("fp").mapInArrow(homes, "t bigint, leaf bigint, fp bigint")
    made = drawn.groupBy("t", "leaf").applyInArrow(fitted, "t bigint, leaf bigint, vantage binary, inner binary").toArrow()  # a row a leaf
    size = (1 << extra) - 1
    each = made.column("t").to_numpy()
    for t, tree in enumerate(trees):
        mine = made.filter(pa.array(each == t))
        matrix = lambda name, kind: np.frombuffer(b"".join(mine.column(name).to_pylist()), kind).reshape(-1, size)  # noqa: B023, E731
        tree.deepened(extra, mine.column("leaf").to_numpy(), matrix("vantage", np.uint64), matrix("inner", np.int16))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, shingle: int = 4) -> DataFrame:
    """``(id, fp, fingerprint, component_id)`` for every row of ``docs``.

    ``component_id`` is the smallest id that chains of links reach, the row's own
    included.  Null texts count as empty; rows with a null id take part, and get
    a null component only if no id is reachable.  Repeated rows give repeated
    rows; texts may be of any length; an empty table gives no rows; further columns
    are left alone.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_"))
    with scratch(spark):
        prints = written(fingerprints(docs, "id_", "text_", shingle), "fingerprints", keep=True)
        distinct = written(prints.groupBy("fp").agg(F.min("id_").alias("first_id"), F.count("*").alias("n")), "distinct")
        labels = connected(near_links(distinct.select("fp"), k))
        rooted = written(distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", "n", F.coalesce("root", "fp").alias("root")), "rooted")
        sums = rooted.agg(F.count("*").alias("fps"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
        heads = written(rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("size")), "heads")
        classes = written(looked_up(rooted, heads, ["root"], "size", sums.fps).select("fp", "component_id", "n"), "classes", keep=True)
    found = looked_up(prints, classes, ["fp"], "n", sums.rows)
    name = "id_" if id_col.lower() in ("fp", "fingerprint", "component_id") else id_col
    return found.select(F.col("id_").alias(name), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
