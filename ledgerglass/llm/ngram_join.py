"""N-gram Jaccard join by chosen paths.

Sets are the distinct `n`-word shingles of a text; two texts are linked when the
Jaccard similarity of their sets is at least `threshold`. Texts with one set are
one *class* throughout. The steps:

1. Every class is embedded by MinHash into `SIZE` tokens (coordinate, minimum).
2. Chosen paths: at a node of the recursion a hash of the path picks each
   coordinate with probability 1 / (threshold * SIZE); a set goes on under the
   token it has there. Similar sets share a path with constant probability,
   others fall apart. Buckets of at most `LEAF` sets are leaves, larger ones
   are split again, down to `DEPTH`; there, what is left shares so many tokens
   that it is taken for a group of near copies. `runs_for` gives the number of
   independent runs that meet the target recall at the threshold itself, for
   pairs whose buckets are split down to `DEPTH`; all others are found more often.
3. Leaves are brute-forced on the embedded sets, with a margin of four standard
   errors below the threshold; that gives candidate groups. At each level a set
   is looked up once with all its buckets, however many there are. If runs have
   to be repeated, buckets whose sets all lie in one group already are left out,
   as they have nothing to add.
4. Candidate groups are verified exactly on the whole shingle sets, in blocks:
   a large group is cut into blocks of `BLOCK_SETS` sets, and each pair of
   blocks is a task's work of bounded size. Only counts and one tree of links
   per block pair leave a task, never all pairs.

All pairs inside a candidate group are verified, so a link is missed only if
its two texts lie in different groups. How often that happens is audited: a
bounded sample of sets is held against all others by sketch, and runs go on
until the share of surely similar partners in the same group reaches `AUDITED`.
"""

from __future__ import annotations

import hashlib
import logging
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytescan import U, blocks, mix, row_grams, signed, words
from .common import components, discard, join_by_size, small_batches, written

SIZE = 64
LEAF = 128
FIRST_DEPTH, DEPTH = 3, 5
#: A block of the exact comparison holds about so many sets, and about so many elements, whichever is reached first.
BLOCK_SETS, BLOCK_ELEMENTS = 384, 1 << 20
#: The audit's sample, the recall it asks for, and how many times the runs may be repeated to get there.
SAMPLE, AUDITED, REPEATS = 256, 0.98, 4

_log = logging.getLogger(__name__)


def runs_for(recall: float, depth: int = DEPTH, threshold: float = 0.8) -> int:
    """Runs after which a pair at the threshold shared a path of `depth` tokens with probability `recall`.

    Of the pair's tokens m of SIZE are equal, binomially spread around the
    threshold; on the way down it keeps m / (threshold * SIZE) common paths per
    node on average, and the chance that one is left after d levels follows from
    s -> 1 - exp(-s * m / (threshold * SIZE)). Runs are independent given m.
    """
    cases = []
    for m in range(SIZE + 1):
        alive = 1.0
        for _ in range(depth):
            alive = 1 - math.exp(-alive * m / (threshold * SIZE))
        cases.append((math.comb(SIZE, m) * threshold**m * (1 - threshold) ** (SIZE - m), 1 - alive))
    runs = 1
    while sum(p * lost**runs for p, lost in cases) > 1 - recall:
        runs += 1
    return runs


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each text; a text of fewer words is one shingle, one without words none."""
    _, _, h, at = words(data, offsets)
    grams = row_grams(h, n)
    out = []
    for i in range(len(offsets) - 1):
        a, b = at[i], at[i + 1]
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(row_grams(h[a:b], int(b - a)) ^ U(b - a))
        else:
            out.append(grams[:0])
    return out


_SEED_A = mix(np.arange(1, SIZE + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
_SEED_B = mix(np.arange(1, SIZE + 1, dtype=U) * U(0xC2B2AE3D27D4EB4F))


def embed(s: np.ndarray) -> np.ndarray:
    """MinHash: for each coordinate the least of a multiplied and shifted hash of the set's elements, 32 bits of it."""
    out = np.full(SIZE, U(2**64 - 1))
    with np.errstate(over="ignore"):
        for i in range(0, len(s), 4096):
            part = s[i : i + 4096, None] * _SEED_A + _SEED_B
            np.minimum(out, part.min(axis=0), out=out)
    return (out >> U(32)).astype(np.uint32)


def _embedded(docs: DataFrame, n: int) -> DataFrame:
    """docs (id, t1, text) -> id, t1, set_key (16 bytes, null for a text without words), sig, size (of the set)."""

    def scan(batches):
        for batch in batches:
            keys, sigs, sizes = [], [], []
            for _, data, offsets in blocks(batch.column("text")):
                for s in shingle_sets(data, offsets, n):
                    keys.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
                    sigs.append(embed(s).tobytes() if len(s) else None)
                    sizes.append(len(s))
            arrays = [batch.column("id"), batch.column("t1"), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "t1", "set_key", "sig", "size"])

    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType), T.StructField("t1", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("sig", T.BinaryType()), T.StructField("size", T.LongType())])
    return docs.mapInArrow(scan, schema)


def _step(path: np.ndarray, owner: np.ndarray, sig: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """One level down: the paths that go on, and the sets on them."""
    with np.errstate(over="ignore"):
        chance = mix(path[:, None] + _SEED_B)
        row, coordinate = np.nonzero(chance < U(int(2**64 / (threshold * SIZE))))
        owner = owner[row]
        token = sig[owner, coordinate].astype(U) + (coordinate.astype(U) << U(32))
        return mix(path[row] * U(0xD6E8FEB86659FD93) + mix(token)), owner


def _paths(rows: DataFrame, threshold: float, runs: range | None = None) -> DataFrame:
    """rows (number, sig, group[, large]) -> number, path, group, one level further down from each path in `large`; with `runs`, FIRST_DEPTH levels from their roots."""

    def scan(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint32).reshape(-1, SIZE)
            if runs is not None:
                owner = np.repeat(np.arange(len(sig)), len(runs))
                path = np.tile(mix(np.array(runs, dtype=U) + U(0x1234567)), len(sig))
            else:
                large = batch.column("large")
                owner, path = large.value_parent_indices().to_numpy(), large.flatten().to_numpy().view(U)
            for _ in range(1 if runs is None else FIRST_DEPTH):
                path, owner = _step(path, owner, sig, threshold)
            taken = pa.array(owner)
            yield pa.RecordBatch.from_arrays([batch.column("number").take(taken), pa.array(signed(path)), batch.column("group").take(taken)], names=["number", "path", "group"])

    return rows.mapInArrow(scan, "number long, path long, group long")


def _groups_in_order(batches, columns: list[str], keys: list[str]):
    """Rows of a partition sorted by `keys`, one group at a time, as lists of columns; a group may span batches."""
    held: dict[str, list] = {}
    current = None
    for batch in batches:
        key = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        data = {c: batch.column(c).to_pylist() for c in columns}
        i = 0
        while i < len(key):
            j = i
            while j < len(key) and key[j] == key[i]:
                j += 1
            if key[i] != current:
                if current is not None:
                    yield current, held
                current, held = key[i], {c: [] for c in columns}
            for c in columns:
                held[c] += data[c][i:j]
            i = j
    if current is not None:
        yield current, held


def _brute_force(leaves: DataFrame, threshold: float) -> DataFrame:
    """leaves (path, set_key, sig), at most LEAF sets a path -> candidate links (a, b): one tree over the sets that look similar."""
    least = (threshold - 4 * math.sqrt(threshold * (1 - threshold) / SIZE)) * SIZE

    def scan(batches):
        a, b = [], []
        for _, g in _groups_in_order(batches, ["set_key", "sig"], ["path"]):
            sig = np.frombuffer(b"".join(g["sig"]), dtype=np.uint32).reshape(-1, SIZE)
            equal = (sig[:, None, :] == sig[None, :, :]).sum(axis=2)
            for i, j in _forest(equal >= least):
                a.append(g["set_key"][i])
                b.append(g["set_key"][j])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    dealt = leaves.repartition("path").sortWithinPartitions("path")
    return dealt.mapInArrow(scan, "a binary, b binary")


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric boolean matrix."""
    n = len(linked)
    todo = np.ones(n, dtype=bool)
    out = []
    for root in range(n):
        if not todo[root]:
            continue
        todo[root] = False
        front = [root]
        while front:
            i = front.pop()
            new = np.flatnonzero(linked[i] & todo)
            todo[new] = False
            out += [(i, int(j)) for j in new]
            front += new.tolist()
    return out


def _shared(rows: DataFrame) -> DataFrame:
    """rows (set_key, path, group) on paths that sets of different groups share, with n, content and low of the path.

    Nearly all paths have one set. One shuffle serves the count and the rows, and only
    what is left is written. `set_key` may be whatever stands for a set.
    """
    # nothing is null; said here, for both readers of the shuffle, or a later join says it for one of them, and there are two shuffles
    dealt = rows.select("path", "set_key", "group").where("path is not null and set_key is not null and `group` is not null").repartition("path")
    size = dealt.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("set_key").cast("decimal(38,0)")).alias("content"), F.min("set_key").alias("low"), (F.min("group") != F.max("group")).alias("mixed"))
    return dealt.join(size.where("n > 1 and mixed").drop("mixed").hint("merge"), "path")


def _sharing(sets: DataFrame, buckets: DataFrame, last: bool) -> DataFrame:
    """Those of sets (number, set_key, sig, group) that lie in buckets, as `_shared` has them by number, with `leaves` and `large`.

    `leaves` are small buckets, by a number that buckets with the same sets have in
    common, as these need one look; `large` are the paths of the others, at the last
    depth the sets they are linked with. A set comes once, not once a path.
    """
    small = F.col("n") <= LEAF
    places = buckets.groupBy("number", "group").agg(F.collect_set(F.when(small, F.xxhash64("n", "content"))).alias("leaves"), F.collect_set(F.when(~small, F.col("low" if last else "path"))).alias("large"))
    return sets.join(places, ["number", "group"])


def _candidates(classes: DataFrame, threshold: float, runs: range) -> tuple[DataFrame, list[DataFrame]]:
    """classes (set_key, sig, group) -> links (a, b) that these runs find between sets of different groups, and the tables to discard when the links are read.

    On the paths a set goes by a number of 64 bits; sets that have one number are
    looked at together. Only the sets on paths that are shared at a depth are looked
    up at the next one.
    """
    known = classes.withColumn("number", F.xxhash64("set_key"))
    rows = _paths(known.select("number", "sig", "group"), threshold, runs)
    links, used = [], []
    for depth in range(FIRST_DEPTH, DEPTH + 1):
        buckets = _shared(rows.withColumnRenamed("number", "set_key")).withColumnRenamed("set_key", "number")
        known = written(_sharing(known.select("number", "set_key", "sig", "group"), buckets, depth == DEPTH), "sharing")
        used.append(known)
        links.append(written(_brute_force(known.select(F.explode("leaves").alias("path"), "set_key", "sig"), threshold), "links"))
        large = known.where(F.size("large") > 0)
        if large.isEmpty():
            break
        if depth == DEPTH:
            ends = large.select(F.col("set_key").alias("a"), F.explode("large").alias("low"))
            links.append(ends.join(known.select(F.col("number").alias("low"), F.col("set_key").alias("b")), "low").select("a", "b"))
        else:
            rows = _paths(large.select("number", "sig", "group", "large"), threshold)
    edges = links[0]
    for x in links[1:]:
        edges = edges.union(x)
    return edges, used + links


def _grouped(classes: DataFrame, groups: DataFrame | None) -> DataFrame:
    """classes (set_key, sig) with `group`, a number for the group that a set lies in so far, its own without one."""
    own = F.xxhash64("set_key")
    if groups is None:
        return classes.select("set_key", "sig", own.alias("group"))
    known = groups.select(F.col("node").alias("set_key"), F.xxhash64("component").alias("found"))
    return written(join_by_size(classes, known, "set_key", "left", 48 * known.count()).select("set_key", "sig", F.coalesce("found", own).alias("group")), "grouped")


def audit(grouped: DataFrame, threshold: float, sample: int = SAMPLE) -> tuple[float, int]:
    """Recall of the groups (set_key, sig, group) by node, and the number of nodes it was measured on.

    At most `sample` sets, half of them from groups of several, are held against
    all sets; partners whose sketches agree by two standard errors more than the
    threshold asks for count as surely similar. 1.0 if no sampled set has one.
    """
    several = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("set_key").alias("set_key")).where("n > 1")
    order = F.xxhash64(F.lit("audit"), "set_key")
    linked = grouped.join(F.broadcast(several.orderBy(order).limit(sample // 2).select("set_key")), "set_key")
    # at most `sample` rows of some 300 bytes each
    rows = linked.union(grouped.orderBy(order).limit(sample - sample // 2)).collect()
    if not rows:
        return 1.0, 0
    held = np.frombuffer(b"".join(bytes(r.sig) for r in rows), dtype=np.uint32).reshape(-1, SIZE)
    groups = np.array([r.group for r in rows], dtype=np.int64)
    least = (threshold + 2 * math.sqrt(threshold * (1 - threshold) / SIZE)) * SIZE

    def scan(batches):
        near, same = np.zeros(len(held), np.int64), np.zeros(len(held), np.int64)
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint32).reshape(-1, SIZE)
            group = batch.column("group").to_numpy()
            for i in range(len(held)):
                close = (sig == held[i]).sum(axis=1) >= least
                near[i] += close.sum()
                same[i] += (close & (group == groups[i])).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(held))), pa.array(near), pa.array(same)], names=["i", "near", "same"])

    counts = grouped.select("sig", "group").mapInArrow(scan, "i long, near long, same long").groupBy("i").agg(F.sum("near").alias("near"), F.sum("same").alias("same"))
    # a set is similar to itself
    recall, nodes = counts.where("near > 1").agg(F.avg((F.col("same") - 1) / (F.col("near") - 1)), F.count(F.lit(1))).first()
    return (1.0 if recall is None else recall), nodes


def candidate_groups(classes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """classes (set_key, sig) -> (node, component): groups of at least two classes that may hold links.

    Runs go on beyond the number that the target recall asks for until the audit agrees.
    """
    need = runs_for(recall, DEPTH, threshold)
    groups, grouped = None, _grouped(classes, None)
    for last in range(need, need * REPEATS + 1, need):
        edges, used = _candidates(grouped, threshold, range(last - need, last))
        if groups is not None:
            edges = edges.union(groups.select(F.col("node").alias("a"), F.col("component").alias("b")))
        groups = written(components(edges.where("a != b")), "groups")
        discard(grouped, *used)
        grouped = _grouped(classes, groups)
        found, nodes = audit(grouped, threshold)
        _log.info("chosen paths: %d runs, recall %.4f by %d sampled sets", last, found, nodes)
        if found >= AUDITED:
            discard(grouped)
            return groups
    raise RuntimeError(f"recall is {found:.3f} after {last} runs, below {AUDITED}")


def _verify(members: DataFrame, threshold: float) -> DataFrame:
    """members (group, first, second, block, set_key, copies, elements), a task's rows sorted by block pair ->
    rows (a, b, n): n documents linked with class a, b null; and trees of links a - b, n null.
    """

    def scan(batches):
        for (_, first, second), g in _groups_in_order(batches, ["block", "set_key", "copies", "elements"], ["group", "first", "second"]):
            block = np.array(g["block"])
            copies = np.array(g["copies"], dtype=np.int64)
            sets = [np.frombuffer(e, dtype=U) for e in g["elements"]]
            sizes = np.array([len(s) for s in sets])
            common = _intersections(sets)
            linked = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9
            np.fill_diagonal(linked, False)
            if first != second:
                linked &= block[:, None] != block[None, :]
            n = linked @ copies
            hit = np.flatnonzero(n)
            tree = _forest(linked)
            a = [g["set_key"][i] for i in hit] + [g["set_key"][i] for i, _ in tree]
            b = [None] * len(hit) + [g["set_key"][j] for _, j in tree]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array([int(n[i]) for i in hit] + [None] * len(tree), pa.int64())], names=["a", "b", "n"])

    return members.mapInArrow(scan, "a binary, b binary, n long")


def _intersections(sets: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0-1 matrices over the elements that at least two sets have."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values, index, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    number = np.cumsum(shared) - 1
    keep = shared[index]
    owner, column = owner[keep], number[index[keep]]
    out = np.zeros((n, n), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = int(shared.sum())
    for start in range(0, total, width):
        lo, hi = np.searchsorted(column, (start, start + width))
        m = np.zeros((n, min(width, total - start)), dtype=np.float32)
        m[owner[lo:hi], column[lo:hi] - start] = 1
        out += m @ m.T
    return out


def join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.995, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, set_key, class_id, n_links.

    `class_id` is the smallest doc_id reachable by links, `n_links` the number of
    other documents linked directly, documents with the same set of shingles
    among them. Texts without words link with nothing. Rows with the same id are
    documents of their own; a null id is never a class_id unless nothing else is there.
    """
    small_batches(docs.sparkSession)
    rows = written(_embedded(docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("t1"), F.col(text).alias("text")), n), "embedded")
    classes = rows.where("set_key is not null").groupBy("set_key").agg(F.min("id").alias("low"), F.min(F.struct(F.col("id").isNull(), "id", "t1")).alias("at"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"), F.first("size").alias("size"))
    classes = written(classes, "classes")
    groups = candidate_groups(classes.select("set_key", "sig"), threshold, recall)
    near = 48 * groups.count()  # what one row for each class in a group takes
    found = join_by_size(classes.withColumnRenamed("set_key", "node"), groups, "node", "inner", near)
    found = written(found.select("node", "component", "low", "at", "copies", "size"), "found")
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("size") / BLOCK_ELEMENTS))
    cut = written(found.groupBy("component").agg(parts.cast("int").alias("parts")).where("parts > 1"), "cut")
    # one document of each class brings the elements
    chosen = join_by_size(found, cut, "component", "left", 32 * cut.count()).withColumn("parts", F.coalesce("parts", F.lit(1)))
    chosen = chosen.select("node", "component", "parts", F.col("at.id").alias("at_id"), F.col("at.t1").alias("at_t1"), "copies", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("block"))
    members = _elements(docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("t1"), F.col(text).alias("text")), chosen, n)
    pairs = F.expr("explode(transform(sequence(0, parts - 1), x -> struct(least(x, block) as first, greatest(x, block) as second)))")
    members = members.select("component", "block", "node", "copies", "elements", pairs.alias("p"))
    members = members.select(F.xxhash64("component").alias("group"), "p.first", "p.second", "block", F.col("node").alias("set_key"), "copies", "elements")
    dealt = members.repartition("group", "first", "second").sortWithinPartitions("group", "first", "second")
    checked = written(_verify(dealt, threshold), "checked")
    linked = checked.where("n is not null").groupBy(F.col("a").alias("set_key")).agg(F.sum("n").alias("n"))
    reach = components(checked.where("n is null").select("a", "b"))
    lows = join_by_size(reach, found.select("node", "low"), "node", "inner", near).groupBy("component").agg(F.min("low").alias("class_id"))
    named = join_by_size(reach, lows, "component", "inner", near).select(F.col("node").alias("set_key"), "class_id")
    named = join_by_size(named, linked, "set_key", "inner", near)  # who has a link is in a tree
    info = join_by_size(classes.select("set_key", "low", "copies"), named, "set_key", "left", near)
    info = written(info.select("set_key", F.coalesce("class_id", "low").alias("class_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes-linked")
    discard(groups, found, cut, checked)
    out = join_by_size(rows.select("id", "set_key"), info, "set_key", "left", 48 * info.count())
    return out.select(F.col("id").alias("doc_id"), "set_key", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _elements(docs: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    """`chosen` with the shingle sets of its classes, made from one document of each class."""
    kept = [f for f in chosen.schema.fields if not f.name.startswith("at_")]
    on = (F.col("t1") == F.col("at_t1")) & F.col("id").eqNullSafe(F.col("at_id"))
    found = join_by_size(docs, chosen, on, "inner", 96 * chosen.count()).select(*(f.name for f in kept), "text")

    def scan(batches):
        for batch in batches:
            node = batch.column("node").to_pylist()
            keep, elements = [], []
            for first, data, offsets in blocks(batch.column("text")):
                for i, s in enumerate(shingle_sets(data, offsets, n)):
                    raw = s.tobytes()
                    if hashlib.md5(raw).digest() == node[first + i]:
                        keep.append(first + i)
                        elements.append(raw)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name).take(take) for f in kept), pa.array(elements, pa.binary())], names=[*(f.name for f in kept), "elements"])

    # rows with the same id and text bring a set twice
    return found.mapInArrow(scan, T.StructType([*kept, T.StructField("elements", T.BinaryType())])).dropDuplicates(["node"])


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links, kept (the class's document with the smallest id) of every row."""
    out = join(docs)
    return out.select("doc_id", "class_id", "n_links", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """`docs` with one document of each class: the one with the smallest id.

    Texts without words stay. Of rows with one id and text the first stays; rows
    with one id and different texts stay or go together, and stay if one of them does.
    """
    marked = join(docs)
    ids = marked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.bool_and(F.col("set_key").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("doomed"))
    ids = written(ids.where("doomed or rows > 1").withColumnRenamed("doc_id", "some_id"), "ids")
    doomed, twice = ids.where("doomed"), ids.where("not doomed and some_id is not null")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.col("text").alias("words"))  # other columns may have any names
    on = F.col("id").eqNullSafe(F.col("some_id"))
    kept = join_by_size(rows, doomed.select("some_id"), on, "left_anti", 24 * doomed.count())
    if twice.isEmpty():
        return kept.select("row.*")
    size = 24 * twice.count()
    again = join_by_size(kept, twice.select("some_id"), on, "left_semi", size)
    has_words = F.coalesce(F.col("words"), F.lit("")).rlike(r"[0-9A-Za-z]|[^\x00-\x7F]")
    again = again.where(has_words).dropDuplicates(["id", "words"]).union(again.where(~has_words))
    return join_by_size(kept, twice.select("some_id"), on, "left_anti", size).union(again).select("row.*")
