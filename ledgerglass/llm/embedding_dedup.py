"""Embedding near-dedup by NN-descent.

Vectors with equal components are one node. Every node keeps a list of its best
neighbours so far. A round joins each list with its nodes' reverse neighbours
and compares the members of what results with each other: neighbours of
neighbours become neighbours. The lists start from random hyperplane buckets.
Rounds end when hardly any list changes any more, whatever the number of edges
above the threshold, as a node that has one finds it through the others.

Lists lose edges above the threshold when better ones fill them, so what such
edges connect is kept beside the lists: all of them from the buckets, and a tree
of those in each neighbourhood of a round. The groups that the kept edges connect
are compared exactly in blocks, and no pair is emitted; a link is missed only if
no edge that was ever found connects its groups. An audit compares a bounded
sample with all vectors; while its recall, for a node and for nodes with about
as many links, is below the target, rounds with longer lists and new buckets
follow, and when they end below it, an error is raised.

The audit allows for a few pairs of vectors that are near no others and so are
neighbours of no neighbour. Where none may be missed, `exact` compares all nodes
instead, block by block: that makes lists, groups and audit needless.
All edges that count are verified in double precision, or above the threshold by
more than single precision can be wrong.
"""

from __future__ import annotations

import hashlib
import logging
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, join_by_size, tidy, written
from .ngram_join import _forest, _groups_in_order

_log = logging.getLogger(__name__)

LIST = 8
#: Rounds end when a smaller share of all list entries is new, or after so many.
SETTLED, MAX_ROUNDS = 0.005, 12
BUCKET_BITS, TABLES = 10, 32
BLOCK_VECTORS = 1024
#: Of the comparison of all nodes: the bytes of a block, the blocks that there are at least, the distances of blocks in one shuffle, and the rows and columns that are compared at once.
BLOCK_BYTES, LEAST_BLOCKS, DISTANCES, TILE = 32 << 20, 9, 2, (512, 1024)
AUDIT = 128
EDGE = "u binary, v binary, sim float"
#: Edges found in single precision count from this much below the threshold.
SLACK = 1e-3
#: Nodes with about as many links that the audit's sample must have for a recall of their own.
STRATUM = 16


def _nodes(vectors: DataFrame) -> DataFrame:
    """vectors (id, embedding) -> id, node (16 bytes; null if the vector cannot be compared), unit (float64 bytes)."""

    def scan(batches):
        for batch in batches:
            node, unit = [], []
            for row in batch.column("embedding").to_pylist():
                x = np.array([math.nan if v is None else v for v in row], dtype=np.float64) if row else np.zeros(1)
                scale = np.abs(x).max()
                if not np.isfinite(x).all() or scale == 0:
                    node.append(None)
                    unit.append(None)
                    continue
                x = x / scale
                x /= np.sqrt(x @ x)
                node.append(hashlib.md5(x.tobytes()).digest())
                unit.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(node, pa.binary()), pa.array(unit, pa.binary())], names=["id", "node", "unit"])

    return vectors.mapInArrow(scan, f"id {dict(vectors.dtypes)['id']}, node binary, unit binary")


def _buckets(nodes: DataFrame, tables: int, seed: int) -> DataFrame:
    """Starting edges: in each table, neighbours in the order of a projection inside a bucket of equal signs, and of equal length."""

    def scan(batches):
        for batch in batches:
            units = batch.column("unit").to_pylist()
            names = batch.column("node")
            by_width: dict[int, list[int]] = {}
            for i, u in enumerate(units):
                by_width.setdefault(len(u), []).append(i)
            for width, rows in by_width.items():
                x = np.frombuffer(b"".join(units[i] for i in rows), dtype=np.float64).reshape(len(rows), -1)
                for t in range(tables):
                    r = np.random.default_rng((seed, t)).normal(size=(x.shape[1], BUCKET_BITS + 1))
                    y = x @ r
                    code = ((y[:, :-1] > 0) << np.arange(BUCKET_BITS)).sum(axis=1) + (((width << 8) + t) << BUCKET_BITS)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(rows)), pa.array(code.astype(np.int64)), pa.array(y[:, -1])], names=["node", "bucket", "place"])

    rows = nodes.select("node", "unit").mapInArrow(scan, "node binary, bucket long, place double")

    # a bucket may be as large as a group of near copies, so it is ordered by a sort of all rows, not gathered
    def chain(batches):
        last: list[tuple] = []
        for batch in batches:
            out = []
            for node, bucket in zip(batch.column("node").to_pylist(), batch.column("bucket").to_pylist(), strict=True):
                out += [(node, other) for other, b in last if b == bucket]
                last = [*last[-1:], (node, bucket)]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())], names=["u", "v"])

    ordered = rows.repartitionByRange("bucket", "place").sortWithinPartitions("bucket", "place", "node")
    return ordered.mapInArrow(chain, "u binary, v binary").where("u != v").distinct()


def _similarity(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs (u, v) -> EDGE."""
    half = nodes.select("node", "unit")
    rows = pairs.join(half.toDF("u", "x"), "u").join(half.toDF("v", "y"), "v")

    def scan(batches):
        for batch in batches:
            sim = np.array([np.frombuffer(x) @ np.frombuffer(y) if len(x) == len(y) else -1.0 for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)], dtype=np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(sim)], names=["u", "v", "sim"])

    return rows.mapInArrow(scan, EDGE)


def _best(edges: DataFrame, length: int) -> DataFrame:
    """The `length` best distinct neighbours of every node, and all edges with `kept`, of edges (u, v, sim, kept, old) said in any direction: u, v, sim, kept, old, rank."""
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim", "kept", "old")
    both = edges.select("u", "v", "sim", "kept", "old").union(back).groupBy("u", "v").agg(F.max("sim").alias("sim"), F.max("kept").alias("kept"), F.max("old").alias("old"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    return both.withColumn("rank", rank).where((F.col("rank") <= length) | F.col("kept"))


def _local_join(graph: DataFrame, nodes: DataFrame, threshold: float, length: int) -> DataFrame:
    """Neighbours of neighbours: members of a node's neighbourhood that are nearer to each other than their lists' ends, as EDGE; `kept` is a tree over those above the threshold, whatever the lists hold."""
    back = graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim")
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.xxhash64("u", "v")))
    back = back.withColumn("rank", rank).where(F.col("rank") <= length).select("u", "v")
    around = graph.select("u", "v").union(back).distinct()
    ends = graph.groupBy("u").agg(F.min("sim").alias("end"), F.count(F.lit(1)).alias("n"))
    ends = ends.select(F.col("u").alias("v"), F.when(F.col("n") >= length, F.col("end")).otherwise(-2.0).cast("float").alias("end"))
    info = nodes.select(F.col("node").alias("v"), "unit").join(ends, "v")
    members = around.join(info, "v").select("u", "v", "unit", "end")
    # the order by node lets neighbourhoods of one group choose the same tree
    dealt = members.repartition("u").sortWithinPartitions("u", "v")

    def scan(batches):
        for _, g in _groups_in_order(batches, ["v", "unit", "end"], ["u"]):
            n = len(g["v"])
            if n < 2 or len({len(x) for x in g["unit"]}) > 1:
                continue
            x = np.frombuffer(b"".join(g["unit"])).reshape(n, -1)
            end = np.array(g["end"])
            sim = x @ x.T
            kept = np.zeros((n, n), dtype=bool)
            for i, j in _forest(sim >= threshold - SLACK):
                kept[min(i, j), max(i, j)] = True
            i, j = np.nonzero(np.triu((sim > end[:, None]) | (sim > end[None, :]) | kept, 1))
            yield pa.RecordBatch.from_arrays([pa.array([g["v"][k] for k in i], pa.binary()), pa.array([g["v"][k] for k in j], pa.binary()), pa.array(sim[i, j].astype(np.float32)), pa.array(kept[i, j])], names=["u", "v", "sim", "kept"])

    return dealt.mapInArrow(scan, f"{EDGE}, kept boolean")


def neighbour_graph(nodes: DataFrame, threshold: float, length: int, tables: int, seed: int, known: DataFrame | None = None, max_rounds: int = MAX_ROUNDS) -> tuple[DataFrame, DataFrame]:
    """The graph (u, v, sim) after rounds that end when the last one changed less than SETTLED of all list entries, and edges (u, v) that connect all that was ever found above the threshold."""
    edges = _similarity(_buckets(nodes, tables, seed), nodes)
    edges = edges if known is None else edges.union(known)
    best = written(_best(edges.withColumns({"kept": F.col("sim") >= threshold - SLACK, "old": F.lit(True)}), length), "graph")
    near = best.where("kept and u < v").select("u", "v")
    graph = best.where(F.col("rank") <= length).select("u", "v", "sim")
    for round_ in range(max_rounds):
        again = graph.withColumns({"kept": F.lit(False), "old": F.lit(True)}).union(_local_join(graph, nodes, threshold, length).withColumn("old", F.lit(False)))
        best = written(_best(again, length), "graph")
        near = near.union(best.where("kept and u < v").select("u", "v"))
        graph = best.where(F.col("rank") <= length).select("u", "v", "sim")
        entries, fresh = best.where(F.col("rank") <= length).agg(F.count(F.lit(1)), F.count_if(~F.col("old"))).first()
        _log.info("neighbour lists, round %d: %d of %d entries are new", round_ + 1, fresh, entries)
        if fresh <= SETTLED * entries:
            break
    else:
        _log.warning("neighbour lists have not settled in %d rounds; the audit decides", max_rounds)
    return graph, near.distinct()


def _exact(groups: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """groups (node, component) -> a, b, n as in the n-gram join: counts of linked vectors, and trees of links."""
    sizes = written(groups.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK_VECTORS).cast("int").alias("parts")), "group-sizes")
    rows = groups.join(sizes, "component").join(nodes, "node")
    rows = rows.select(F.xxhash64("component").alias("group"), "node", "copies", "unit", "parts", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("block"))
    pairs = F.expr("explode(transform(sequence(0, parts - 1), x -> struct(least(x, block) as first, greatest(x, block) as second)))")
    rows = rows.select("group", "node", "copies", "unit", "block", pairs.alias("p")).select("group", "p.first", "p.second", "block", "node", "copies", "unit")
    dealt = rows.repartition("group", "first", "second").sortWithinPartitions("group", "first", "second")

    def scan(batches):
        for (_, first, second), g in _groups_in_order(batches, ["block", "node", "copies", "unit"], ["group", "first", "second"]):
            block, copies = np.array(g["block"]), np.array(g["copies"], dtype=np.int64)
            x = np.frombuffer(b"".join(g["unit"])).reshape(len(block), -1)
            linked = x @ x.T >= threshold
            np.fill_diagonal(linked, False)
            if first != second:
                linked &= block[:, None] != block[None, :]
            n = linked @ copies
            hit, tree = np.flatnonzero(n), _forest(linked)
            a = [g["node"][i] for i in hit] + [g["node"][i] for i, _ in tree]
            b = [None] * len(hit) + [g["node"][j] for _, j in tree]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array([int(n[i]) for i in hit] + [None] * len(tree), pa.int64())], names=["a", "b", "n"])

    return dealt.mapInArrow(scan, "a binary, b binary, n long")


def _links(checked: DataFrame) -> DataFrame:
    """The links (node, n) in what `_exact` or `_all_pairs` gives."""
    return written(checked.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n")), "links")


def _tree(u: np.ndarray, v: np.ndarray, label: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Places of edges (u, v) that connect what all of them connect, and the labels after: nodes with the same label are connected already."""
    place = np.flatnonzero(label[u] != label[v])
    if not len(place):
        return [], label
    known, ends = np.unique(np.concatenate([label[u[place]], label[v[place]]]), return_inverse=True)
    a, b = ends[: len(place)], ends[len(place) :]
    top = np.arange(len(known))
    chosen: list[int] = []
    while True:
        # of the edges that still connect two trees one for each tree that meets a smaller one
        low, high = np.minimum(top[a], top[b]), np.maximum(top[a], top[b])
        apart = np.flatnonzero(low != high)
        if not len(apart):
            break
        one = np.full(len(known), -1)
        one[high[apart]] = apart
        one = one[one >= 0]
        top[high[one]] = low[one]
        chosen += place[one].tolist()
        while (top[top] != top).any():
            top = top[top]
    renamed = np.arange(len(label))
    renamed[known] = known[top]
    return chosen, renamed[label]


def _pairs(block: np.ndarray, copies: np.ndarray, x: np.ndarray, owner: int, same: bool, threshold: float) -> tuple[np.ndarray, list[int], list[int]]:
    """Linked copies of each node, and edges (u, v) that connect what the links connect: of the owner's block with the other one, or with itself (`same`).

    Products are of single precision, those near the threshold are worked out again in double.
    """
    n, label, wide = np.zeros(len(block), dtype=np.int64), np.arange(len(block)), x.astype(np.float32)
    down = np.flatnonzero(block == owner)
    across = down if same else np.flatnonzero(block != owner)
    first, second = wide[down], wide[across]
    a: list[int] = []
    b: list[int] = []
    for r in range(0, len(down), TILE[0]):
        for c in range(r // TILE[1] * TILE[1] if same else 0, len(across), TILE[1]):
            sim = first[r : r + TILE[0]] @ second[c : c + TILE[1]].T
            hit = np.flatnonzero(sim.ravel() >= threshold - SLACK)
            if not len(hit):
                continue
            u, v = np.divmod(hit, sim.shape[1])
            sure = sim.ravel()[hit] >= threshold + SLACK
            u, v = down[r + u], across[c + v]
            if same:
                once = u < v
                u, v, sure = u[once], v[once], sure[once]
            for i in range(0, len(unsure := np.flatnonzero(~sure)), TILE[1]):
                k = unsure[i : i + TILE[1]]
                sure[k] = np.einsum("ij,ij->i", x[u[k]], x[v[k]]) >= threshold
            u, v = u[sure], v[sure]
            np.add.at(n, u, copies[v])
            np.add.at(n, v, copies[u])
            chosen, label = _tree(u, v, label)
            a += u[chosen].tolist()
            b += v[chosen].tolist()
    return n, a, b


def _all_pairs(nodes: DataFrame, threshold: float) -> DataFrame:
    """nodes -> a, b, n as `_exact` gives them, of all pairs of nodes, written.

    The work grows with the square of the nodes. A task holds two blocks, and gives no
    more rows than twice their nodes. There is an odd number of blocks, so that each pair of them has
    one owner, from which the other is at most half of them away; the pairs go by their
    distance, at most DISTANCES of them at once, so that only so many copies of
    the table are shuffled at a time, however many blocks there are.
    """
    size = nodes.agg(F.sum(F.octet_length("unit"))).first()[0] or 0
    blocks = max(LEAST_BLOCKS, math.ceil(size / BLOCK_BYTES)) | 1
    rows = nodes.select("node", "copies", "unit", F.octet_length("unit").alias("width"), F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("block"))

    def scan(batches):
        for (_, far, owner), g in _groups_in_order(batches, ["block", "node", "copies", "unit"], ["width", "far", "owner"]):
            block, copies = np.array(g["block"]), np.array(g["copies"], dtype=np.int64)
            x = np.frombuffer(b"".join(g.pop("unit"))).reshape(len(block), -1)
            n, a, b = _pairs(block, copies, x, owner, far == 0, threshold)
            for part in ([(i, None, n[i]) for i in np.flatnonzero(n)], [(i, j, None) for i, j in zip(a, b, strict=True)]):
                yield pa.RecordBatch.from_arrays([pa.array([g["node"][i] for i, _, _ in part], pa.binary()), pa.array([None if j is None else g["node"][j] for _, j, _ in part], pa.binary()), pa.array([None if k is None else int(k) for _, _, k in part], pa.int64())], names=["a", "b", "n"])

    parts = []
    for first in range(0, blocks // 2 + 1, DISTANCES):
        last = min(first + DISTANCES - 1, blocks // 2)
        owners = F.expr(f"explode(flatten(transform(sequence({first}, {last}), d -> array_distinct(array(struct(d AS far, block AS owner), struct(d AS far, pmod(block - d, {blocks}) AS owner))))))")
        dealt = rows.withColumn("o", owners).select("width", "o.far", "o.owner", "block", "node", "copies", "unit")
        # a task for each pair of blocks, however few bytes they have
        dealt = dealt.repartitionById((last - first + 1) * blocks, F.col("owner") + blocks * (F.col("far") - first)).sortWithinPartitions("width", "far", "owner")
        parts.append(written(dealt.mapInArrow(scan, "a binary, b binary, n long"), "pairs"))
        # else the shuffle stays until the driver happens to collect its garbage; Spark lets go of it at the second time
        for _ in range(2):
            tidy(nodes.sparkSession)
    return reduce(DataFrame.union, parts)


def audit(nodes: DataFrame, links: DataFrame, threshold: float, sample: int = AUDIT, graph: DataFrame | None = None) -> float:
    """Share of its links that was found for a node of a bounded sample, on average: links (node, n) against a comparison with all nodes. The least of all nodes with links and of those with 2^k to 2^(k+1) - 1, if there are enough.

    Where links are rare a sample of all nodes would hold none: a third of it is of nodes
    with links, and a third of those whose best neighbour so far is nearest below the threshold.
    """
    order = F.xxhash64(F.lit("audit"), "node")
    names = nodes.select("node").orderBy(order).limit(sample // 3 if graph is not None else sample)
    if graph is not None:
        below = graph.groupBy(F.col("u").alias("node")).agg(F.max("sim").alias("best")).where(F.col("best") < threshold)
        names = names.union(links.select("node").orderBy(order).limit(sample // 3)).union(below.orderBy(F.desc("best"), "node").limit(sample // 3).select("node")).distinct()
    # at most `sample` vectors
    chosen = nodes.join(names, "node", "left_semi").select("node", "unit").collect()
    if not chosen:
        return 1.0
    shared = nodes.sparkSession.sparkContext.broadcast([(bytes(r.node), bytes(r.unit)) for r in chosen])

    def scan(batches):
        names = [n for n, _ in shared.value]
        total = np.zeros(len(names), dtype=np.int64)
        for batch in batches:
            units, copies = batch.column("unit").to_pylist(), batch.column("copies").to_numpy()
            for width in {len(u) for u in units}:
                mine = [k for k, (_, u) in enumerate(shared.value) if len(u) == width]
                rows = [i for i, u in enumerate(units) if len(u) == width]
                if mine:
                    q = np.frombuffer(b"".join(shared.value[k][1] for k in mine)).reshape(len(mine), -1)
                    x = np.frombuffer(b"".join(units[i] for i in rows)).reshape(len(rows), -1)
                    total[mine] += (x @ q.T >= threshold).T @ copies[rows]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(total)], names=["node", "n"])

    truth = nodes.select("unit", "copies").mapInArrow(scan, "node binary, n long").groupBy("node").agg(F.sum("n").alias("true"))
    # a node meets itself and its copies in the comparison
    both = truth.join(nodes.select("node", "copies"), "node").join(links, "node", "left").select((F.col("true") - F.col("copies")).alias("true"), F.coalesce("n", F.lit(0)).alias("n"))
    # at most `sample` rows
    return recall([(r.n, r.true) for r in both.collect()])


def recall(counts: list[tuple[int, int]]) -> float:
    """The audit's figure of the nodes' links (found, true)."""
    strata: dict[int, list[float]] = {}
    for n, true in counts:
        if true > 0:
            strata.setdefault(int(true).bit_length(), []).append(min(n, true) / true)
    shares = [x for s in strata.values() for x in s]
    return min((float(np.mean(s)) for s in [shares, *(s for s in strata.values() if len(s) >= STRATUM)] if s), default=1.0)


def _searched(nodes: DataFrame, threshold: float, target: float, length: int, tables: int, max_audits: int) -> tuple[DataFrame, DataFrame]:
    """a, b, n as `_exact` gives them, of the groups that the search finds, and the links (node, n) in it."""
    graph = groups = None
    for round_ in range(max_audits):
        graph, near = neighbour_graph(nodes, threshold, length, tables, round_, graph)
        near = near.toDF("a", "b")
        if groups is not None:
            near = near.union(groups)
        groups = written(components(near), "groups")
        checked = written(_exact(groups, nodes, threshold), "checked")
        links = _links(checked)
        found = audit(nodes, links, threshold, graph=graph)
        _log.info("audit: %.4f of the links of sampled nodes were found", found)
        if found >= target:
            return checked, links
        length, tables = 2 * length, 2 * tables
    raise RuntimeError(f"the audit found {found:.3f} of the links, not {target}, after {max_audits} rounds")


def link(vectors: DataFrame, threshold: float = 0.9, target: float = 0.95, length: int = LIST, tables: int = TABLES, max_audits: int = 3, vec_id: str = "vec_id", embedding: str = "embedding", exact: bool = False) -> DataFrame:
    """One row per row of `vectors`: vec_id, n_links, component_id.

    Vectors of different lengths, and such that are null, zero or have null or
    non-finite components, link with nothing (of different lengths: not with each
    other). Equal vectors link. Rows with the same id are vectors of their own; a
    null id is a component's name only if all its ids are null. With `exact` all nodes
    are compared, so that no link is missed; nothing else but the threshold counts then.
    """
    rows = written(_nodes(vectors.select(F.col(vec_id).alias("id"), F.col(embedding).alias("embedding"))), "vectors")
    nodes = rows.where("node is not null").groupBy("node").agg(F.first("unit").alias("unit"), F.min("id").alias("low"), F.count(F.lit(1)).alias("copies"))
    nodes = written(nodes, "nodes")
    if exact:
        checked = _all_pairs(nodes, threshold)
        links = _links(checked)
    else:
        checked, links = _searched(nodes, threshold, target, length, tables, max_audits)
    reach = components(checked.where("n is null").select("a", "b"))
    named = reach.join(nodes.select("node", "low"), "node")
    named = named.join(named.groupBy("component").agg(F.min("low").alias("component_id")), "component").select("node", "component_id")
    info = nodes.select("node", "low", "copies").join(links, "node", "left").join(named, "node", "left")
    info = written(info.select("node", F.coalesce("component_id", "low").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "nodes-linked")
    out = join_by_size(rows.select("id", "node"), info, "node", "left", 48 * info.count())
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))


def digest(vectors: DataFrame, exact: bool = False) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    return link(vectors, exact=exact).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
