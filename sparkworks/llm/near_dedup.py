"""Near-duplicate documents by chosen-path set similarity join (operator 6).

A document is its set of distinct five-word shingles; two are linked when
their sets' Jaccard similarity is 0.75 or more.

Documents with equal sets form a class, and one member stands for it.  Its
sketch holds the least shingle hash under each of 64 hash functions
("minwise tokens").  Every tree of the join starts with all classes in one
node.  A node picks each of the 64 places with probability 1 / (0.75 * 64)
(a root) or ``BRANCHING`` times that (a node below), and a class goes to one
child per picked place, named by its token there; so two classes at the
threshold share one child of a root and 1.5 of another node on average, and
dissimilar ones seldom share any.  A place is picked once on a path.  A node of at most ``node_limit`` classes (and ``node_shingles``
shingles, which bounds what a task holds) is compared exhaustively; a larger
one branches again, by one place at least, while that is of use: where its
children together hold as many pairs as it does, or nearly, its classes are
about as like one another as those that are sought.  Such a node is compared
as it is, in blocks that share hubs, and what these leave unconnected once more
in tiles, where every pair meets.  Of such nodes those that have half of their
classes in a larger one are one with it, so a group is compared once, not once
for each node that it has come to.  Independent trees, each with its own choices,
bring the share of links found to the target: a pair at the threshold is in a
common root child with probability 1 - 0.25 ** (places picked by all roots).
As nodes below the roots pass on more than one child of a pair on average, the
pair's nodes do not die out with depth, which those of a factor of 1 do.

Exhaustive comparison first estimates all pairs of a node from the sketches,
then confirms candidates on the full sets, most similar first, and passes over
pairs that confirmed links of the node already connect: a node of m classes
yields m - 1 links at most, and none of its pairs leaves the task.  Nodes with
the same classes are compared once.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkworks.llm.common import few, partitions, small, squeezed, tidy, unsqueeze
from sparkworks.llm.common import settle_unsized as settle
from sparkworks.llm.components import components
from sparkworks.llm.textnum import Words, gram_hashes, mix, run_starts, uniform, word_chunks

SHINGLE = 5
PLACES = 64
#: A large node whose children would, at the usual number of places, hold this share of its pairs is compared as it is.
GAIN = 0.9
#: Children below the roots that two classes at the threshold share on average; above 1, or deep pairs are lost.
BRANCHING = 1.5
#: Tiles have few classes beside the texts: the ids of up to so many, of some 40 bytes, are broadcast to select their texts.
FEW = 100_000
#: More tasks than any shuffle has parts: a table stays in the parts that it was dealt into.
AS_DEALT = 1 << 30
_KEYS = np.random.default_rng(6).integers(1, 1 << 63, (2, PLACES), dtype=np.uint64) | np.uint64(1)


# --- sets and sketches -------------------------------------------------------


def shingle_sets(words: Words) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a chunk."""
    grams = gram_hashes(words.hash, SHINGLE)
    out = []
    for a, b in zip(words.at[:-1].tolist(), words.at[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(grams[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(gram_hashes(words.hash[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), PLACES) least hashes; the sets are not empty."""
    out = np.empty((len(sets), PLACES), np.uint32)
    if not sets:
        return out
    flat = np.concatenate(sets)
    first = np.cumsum([0] + [len(s) for s in sets[:-1]])
    for k in range(PLACES):
        out[:, k] = np.minimum.reduceat(((flat ^ _KEYS[0, k]) * _KEYS[1, k]) >> np.uint64(32), first)
    return out


def set_key(values: np.ndarray) -> int:
    """A 64-bit name of a set; 0 is that of the empty set alone."""
    if not len(values):
        return 0
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True) or 1


def _emit_sketches(carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in word_chunks(batch["text"], lower=True):
                sets = shingle_sets(words)
                full = [k for k, s in enumerate(sets) if len(s)]
                rows: list[bytes | None] = [None] * len(sets)
                for k, sketch in zip(full, sketches([sets[k] for k in full]), strict=True):
                    rows[k] = sketch.tobytes()
                found = [pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.int64()), pa.array(rows, pa.binary())]
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([own["id"], *found, *(own[c] for c in carried)], ["id", "n_shingles", "set", "sketch", *carried])

    return tidy(run)


# --- trees -------------------------------------------------------------------


def picked_places(nodes: np.ndarray, threshold: float, share: float = 1.0) -> np.ndarray:
    """Which places each node picks, as a (nodes, PLACES) mask; two classes at the threshold share ``share`` children on average."""
    keys = mix(nodes.astype(np.uint64))[:, None] + np.arange(PLACES, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    return uniform(keys.ravel(), 1).reshape(keys.shape) < share / (threshold * PLACES)


def branched_places(nodes: np.ndarray, threshold: float, used: np.ndarray | None = None) -> np.ndarray:
    """The places that nodes branch by: those picked, or one by hash where none is, so that no node ends without a child.

    ``used`` has the places of a node's path as bits.  They are not picked
    again, for a child by one of them is the node itself; the others are
    picked so much more often.
    """
    if used is None:
        used = np.zeros(len(nodes), np.uint64)
    free = (used[:, None] >> np.arange(PLACES, dtype=np.uint64)) & np.uint64(1) == 0
    open_ = np.maximum(free.sum(axis=1), 1)
    keys = mix(nodes.astype(np.uint64))[:, None] + np.arange(PLACES, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    picked = free & (uniform(keys.ravel(), 1).reshape(keys.shape) < BRANCHING / (threshold * open_[:, None]))
    bare = np.flatnonzero(~picked.any(axis=1) & free.any(axis=1))
    if len(bare):
        turn = (mix(nodes[bare].astype(np.uint64) ^ np.uint64(0xB4A5)) % open_[bare].astype(np.uint64)).astype(np.int64)
        picked[bare, ((np.cumsum(free[bare], axis=1) == turn[:, None] + 1) & free[bare]).argmax(axis=1)] = True
    return picked


def child_keys(node: np.ndarray, place: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(mix(node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64)) + token.astype(np.uint64))


def root_keys(trees: int) -> np.ndarray:
    return mix(np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x51A7))


#: Columns of a level: a node, a class in it and its shingles, the node's path, its parent and how many classes that has.
LEVEL = ["node", "set", "size", "used", "parent", "was"]
_LEVEL = "node long, set long, size int, used long, parent long, was long"


def _sketch_table(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), PLACES)


def _grow_roots(trees: int, threshold: float):
    roots = root_keys(trees)
    tree, place = np.nonzero(picked_places(roots, threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = _sketch_table(batch["sketch"])
            keys = np.concatenate([child_keys(np.full(len(table), roots[t]), np.full(len(table), p), table[:, p]) for t, p in zip(tree, place, strict=True)] or [np.zeros(0, np.uint64)])
            sets, sizes = (np.tile(batch[c].to_numpy(), len(tree)) for c in ("set", "n_shingles"))
            used = np.repeat(np.uint64(1) << place.astype(np.uint64), len(table)).view(np.int64)
            none = pa.array(np.zeros(len(keys), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sets), pa.array(sizes.astype(np.int32)), pa.array(used), none, none], LEVEL)

    return run


def _grow(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table, node = _sketch_table(batch["sketch"]), batch["node"].to_numpy().view(np.uint64)
            used = batch["used"].to_numpy().view(np.uint64)
            nodes, first, inverse = np.unique(node, return_index=True, return_inverse=True)
            row, place = np.nonzero(branched_places(nodes, threshold, used[first])[inverse])
            keys = child_keys(node[row], place, table[row, place])
            path = used[row] | (np.uint64(1) << place.astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(pa.array(batch[c].to_numpy()[row]) for c in ("set", "size")), pa.array(path.view(np.int64)), *(pa.array(batch[c].to_numpy()[row]) for c in ("node", "n"))], LEVEL)

    return run


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by ``key``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch[key].to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(values, values[-1]))
        if held and (last or held[-1][key][-1].as_py() != values[0]):
            lead = int(np.searchsorted(values, held[-1][key][-1].as_py(), "right")) if held[-1][key][-1].as_py() == values[0] else 0
            yield pa.Table.from_batches([*held, batch.slice(0, lead)])
            held = []
            if last > lead:
                yield pa.Table.from_batches([batch.slice(lead, last - lead)])
            held.append(batch.slice(last))
        elif last:
            yield pa.Table.from_batches([batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


# --- comparison of small nodes -----------------------------------------------


def estimates(table: np.ndarray, least: float, rows: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, later rows, share of equal tokens) where that share is at least ``least``, for all or the first ``rows`` rows."""
    n = len(table)
    rows = n if rows is None else rows
    step = max(1, (1 << 22) // (max(n, 1) * PLACES))
    for a in range(0, rows, step):
        same = (table[a : min(a + step, rows), None, :] == table[None, a:, :]).sum(axis=2, dtype=np.int32) / PLACES
        for k in range(len(same)):
            near = np.flatnonzero(same[k, k + 1 :] >= least) + a + k + 1
            if len(near):
                yield a + k, near, same[k, near - a]


def _prune(least: float):
    """Drop classes without a likely partner in their node; name what is left by its classes.

    Where classes have labels, a partner has another label.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "node"):
            nodes, sets = table["node"].to_numpy(), table["set"].to_numpy()
            tokens = _sketch_table(table["sketch"].combine_chunks())
            labels = table["label"].to_numpy() if "label" in table.column_names else None
            cuts = np.append(run_starts(nodes), len(nodes))
            out_node, out_set, out_label = [], [], []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                mark = np.zeros(b - a, bool)
                if labels is None:
                    order, rows, label = np.arange(b - a), b - a, np.arange(b - a)
                else:
                    # Those of the most frequent label come last: no two of them need be compared.
                    names, label, n = np.unique(labels[a:b], return_inverse=True, return_counts=True)
                    order, rows = np.argsort(label == n.argmax(), kind="stable"), b - a - int(n.max())
                    label = label[order]
                for k, near, _ in estimates(tokens[a:b][order], least, rows):
                    near = near[label[near] != label[k]]
                    if len(near):
                        mark[k] = True
                        mark[near] = True
                if mark.any():
                    own = sets[a:b][order][mark]
                    by = np.argsort(own)
                    own = own[by]
                    out_set.append(own)
                    if labels is not None:
                        out_label.append(labels[a:b][order][mark][by])
                    out_node.append(np.full(len(own), np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), np.int64)[0]))
            if out_node:
                found = [pa.array(np.concatenate(x)) for x in (out_node, out_set, out_label) if x]
                yield pa.RecordBatch.from_arrays(found, ["node", "set", "label"][: len(found)])

    return run


def _emit_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in small(whole)):
        for a, b, words in word_chunks(unsqueeze(batch["text"]), lower=True):
            own = batch.slice(a, b - a)
            sets = shingle_sets(words)
            right = pa.array([set_key(s) == k for s, k in zip(sets, own["set"].to_pylist(), strict=True)])  # an id may stand for several texts
            more = [c for c in ("label",) if c in batch.schema.names]
            found = pa.RecordBatch.from_arrays([own["set"], own["nodes"], pa.array([s.tobytes() for s in sets], pa.binary()), *(own[c] for c in more)], ["set", "nodes", "shingles", *more])
            yield found.filter(right)


def common(left: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many values each of the other sorted sets shares with ``left``."""
    flat = np.concatenate(others)
    at = np.searchsorted(left, flat)
    hit = left[np.minimum(at, len(left) - 1)] == flat
    first = np.cumsum([0] + [len(x) for x in others[:-1]])
    return np.add.reduceat(hit.astype(np.int64), first)


def spanning_links(sets: list[np.ndarray], least: float, percent: int, batch: int = 16, labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what all links of the node connect, each confirmed on the full sets.

    Sets of one label are connected already, and no links between them are sought.
    """
    order = label = np.arange(len(sets))
    rows = len(sets)
    if labels is not None:
        # Those of the most frequent label come last: no two of them need be compared.
        _, label, n = np.unique(labels, return_inverse=True, return_counts=True)
        order, rows = np.argsort(label == n.argmax(), kind="stable"), rows - int(n.max())
        sets = [sets[i] for i in order]
    label = label[order]
    size = np.array([len(s) for s in sets])
    links = []
    for k, near, share in estimates(sketches(sets), least, rows):
        apart = label[near] != label[k]
        near, share = near[apart], share[apart]
        if not len(near):
            continue
        lo, hi = np.minimum(size[near], size[k]), np.maximum(size[near], size[k])
        near, share = near[100 * lo >= percent * hi], share[100 * lo >= percent * hi]
        near = near[np.argsort(-share, kind="stable")]
        while len(near := near[label[near] != label[k]]):
            now, near = near[:batch], near[batch:]
            both = common(sets[k], [sets[j] for j in now])
            for j, c in zip(now.tolist(), both.tolist(), strict=True):
                if label[j] != label[k] and 100 * c >= percent * (size[k] + size[j] - c):
                    links.append((order[k], order[j]))
                    label[label == label[j]] = label[k]
    return links


def _confirm(least: float, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "node"):
            nodes, keys = table["node"].to_numpy(), table["set"].to_numpy()
            values = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
            labels = table["label"].to_numpy() if "label" in table.column_names else None
            cuts = np.append(run_starts(nodes), len(nodes))
            found: list[tuple[int, int]] = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                found += [(keys[a + i], keys[a + j]) for i, j in spanning_links(values[a:b], least, percent, labels=None if labels is None else labels[a:b])]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    return run


# --- the operator ------------------------------------------------------------


def near_links(classes: DataFrame, texts: DataFrame, percent: int = 75, trees: int = 6, node_limit: int = 4096, node_shingles: int = 4_000_000, depth_limit: int = 24) -> DataFrame:
    """Confirmed links (a, b) between classes that connect all classes which links connect.

    ``classes`` has set, sketch, n_shingles and the id of a member, ``texts`` ids and texts.  Nodes
    that branching does not part (or that are left after ``depth_limit`` branchings) are split by
    rank into blocks, each with the node's 64 first classes besides.  What is not connected then
    meets in tiles, so that no pair goes uncompared and no task gets an unbounded group.
    """
    threshold = percent / 100
    least = threshold - 4 * (threshold * (1 - threshold) / PLACES) ** 0.5
    fitting, crowds = grown(classes, threshold, trees, node_limit, node_shingles, depth_limit)
    n = classes.count()
    tasks = few(classes, n * _roots(trees, threshold))
    if crowds is None:
        return _compare(fitting, classes, texts, least, percent, tasks)
    many = few(classes, crowds.count())
    crowds = merged(crowds, many)
    links = settle(_compare(fitting.unionByName(_blocks(crowds, node_limit, node_shingles)), classes, texts, least, percent, tasks))
    found = components(links, about=n).select(F.col("node").alias("set"), F.col("component").alias("label"))
    labelled = settle(crowds.join(found, "set", "left").withColumn("label", F.coalesce("label", "set")).coalesce(many))
    open_ = settle(tiles(labelled, node_limit, node_shingles, many).coalesce(max(many, tasks)))
    if open_.isEmpty():
        return links
    return links.unionByName(_compare(open_, classes, texts, least, percent, tasks))


def _roots(trees: int, threshold: float) -> int:
    """How many root children a class goes to."""
    return int(picked_places(root_keys(trees), threshold).sum())


def grown(classes: DataFrame, threshold: float, trees: int, node_limit: int, node_shingles: int, depth_limit: int, rows: list[int] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(nodes that fit a task, nodes that branching does not part): rows (node, set), and (node, set, size) or None.

    ``rows`` gets the number of rows of each level.
    """
    tasks = few(classes, classes.count() * _roots(trees, threshold))
    level = classes.select("set", "sketch", "n_shingles").coalesce(tasks).mapInArrow(_grow_roots(trees, threshold), _LEVEL)
    fitting: DataFrame | None = None
    crowds: DataFrame | None = None
    above: DataFrame | None = None
    for depth in range(depth_limit + 1):
        level = settle(level)
        if rows is not None:
            rows.append(level.count())
        sizes = settle(level.groupBy("node").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"), F.expr("bit_xor(xxhash64(set))").alias("who"), F.any_value("parent").alias("parent"), F.any_value("used").alias("used"), F.max("was").alias("was")).filter("n > 1").coalesce(tasks))
        if above is not None:
            # What a place holds on average, and as many places as a node picks on average.
            pairs = sizes.groupBy("parent").agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("held"), F.count_distinct("used").alias("places"), F.max("was").alias("was"))
            usual = F.col("held") / F.col("places") * (BRANCHING / threshold)
            stuck = settle(pairs.filter(usual >= GAIN * F.col("was") * (F.col("was") - 1)).select(F.col("parent").alias("node")).coalesce(tasks))
            if not stuck.isEmpty():
                crowd = settle(above.join(stuck, "node").select("node", "set", "size").coalesce(tasks))
                crowds = crowd if crowds is None else crowds.unionByName(crowd)
                sizes = settle(sizes.join(stuck.withColumnRenamed("node", "parent"), "parent", "left_anti").coalesce(tasks))
        # Two classes are compared whatever their size.
        small_enough = (F.col("n") <= 2) | ((F.col("n") <= node_limit) & (F.col("shingles") <= node_shingles))
        fits = level.join(_once(sizes.filter(small_enough)).select("node"), "node").select("node", "set")
        fitting = fits if fitting is None else fitting.unionByName(fits)
        large = sizes.filter(~small_enough).select("node", "n")
        held = large.agg(F.sum("n")).first()[0]
        if held is None:
            break
        above = level.join(large, "node").select("node", "set", "size", "used", "n")
        if depth == depth_limit:
            crowd = settle(above.select("node", "set", "size").coalesce(tasks))
            crowds = crowd if crowds is None else crowds.unionByName(crowd)
        # Equal nodes are one only where they are compared: while they branch, each is a chance of its own.
        tasks = few(classes, math.ceil(held * BRANCHING / threshold))
        level = above.join(classes.select("set", "sketch"), "set").coalesce(tasks).mapInArrow(_grow(threshold), _LEVEL)
    return fitting, crowds


def merged(crowds: DataFrame, tasks: int = AS_DEALT) -> DataFrame:
    """Large nodes, where those with half of their classes in a larger one are one with it: node, set, size, n, shingles.

    What is settled is left in at most ``tasks`` parts.
    """
    rows = settle(crowds.distinct().coalesce(tasks))
    of_node = rows.groupBy("node").agg(F.count("*").alias("n"))
    placed = rows.select("node", "set").join(of_node, "node")
    homes = settle(placed.groupBy("set").agg(F.max(F.struct("n", "node")).alias("home")).select("set", F.col("home.node").alias("home")).coalesce(tasks))
    votes = placed.join(homes, "set").groupBy("node", "n", "home").agg(F.count("*").alias("m"))
    goes = votes.filter((F.col("home") != F.col("node")) & (2 * F.col("m") >= F.col("n"))).groupBy("node").agg(F.max(F.struct("m", "home")).alias("to"))
    found = components(goes.select(F.col("node").alias("a"), F.col("to.home").alias("b")), about=1).select("node", F.col("component").alias("whole"))
    one = rows.join(found, "node", "left").select(F.coalesce("whole", "node").alias("node"), "set", "size").distinct()
    one = settle(one.coalesce(tasks))
    return one.join(one.groupBy("node").agg(F.count("*").alias("n"), F.sum("size").alias("shingles")), "node")


def _once(sizes: DataFrame) -> DataFrame:
    """One node of those with the same classes."""
    return sizes.groupBy("n", "shingles", "who").agg(F.min("node").alias("node")).select("node", "n", "shingles")


def _compare(nodes: DataFrame, classes: DataFrame, texts: DataFrame, least: float, percent: int, tasks: int = AS_DEALT) -> DataFrame:
    """Links (a, b) that connect what all links within the nodes connect; where classes have labels, all between different ones."""
    parts = partitions(classes)
    labels = [c for c in nodes.columns if c == "label"]
    more = "".join(f", {c} long" for c in labels)
    with_sketch = nodes.join(classes.select("set", "sketch"), "set").select(*nodes.columns, "sketch")
    pruned = with_sketch.repartition(parts, "node").sortWithinPartitions("node").mapInArrow(_prune(least), f"node long, set long{more}")
    pruned = settle(pruned.distinct().coalesce(tasks))
    texts = squeezed(texts)
    wanted = pruned.groupBy("set").agg(F.collect_list("node").alias("nodes"), *(F.min(c).alias(c) for c in labels)).join(classes.select("set", "id"), "set")
    if labels:
        wanted = settle(wanted.coalesce(tasks))
        if wanted.count() <= FEW:
            texts = texts.join(F.broadcast(wanted.select("id")), "id", "left_semi")
    shingles = texts.join(wanted, "id").select("set", "nodes", "text", *labels).mapInArrow(_emit_sets, f"set long, nodes array<long>, shingles binary{more}").dropDuplicates(["set"])
    dealt = shingles.select(F.explode("nodes").alias("node"), "set", "shingles", *labels).repartition(parts, "node").sortWithinPartitions("node", "set")
    return dealt.mapInArrow(_confirm(least, percent), "a long, b long")


def _blocks(rows: DataFrame, limit: int, shingles: int) -> DataFrame:
    """Too large nodes as blocks within the limits, chosen by hash, that share the node's least 64 hashes."""
    own = rows.withColumn("rank", F.xxhash64("set", "node"))
    # The hubs are those under a bound that leaves about 64 of n.
    share = (F.col("rank").cast("double") / F.lit(2.0**64)) + 0.5
    blocks = F.greatest(F.ceil(F.col("n") / (limit - 128)), F.ceil(F.col("shingles") / shingles)).cast("int")
    hubs = own.filter(share < F.lit(64.0) / F.col("n")).select("node", "set", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    rest = own.select("node", "set", F.pmod(F.xxhash64("node", "set", F.lit(1)), blocks).cast("int").alias("block"))
    return hubs.unionByName(rest).distinct().select(F.xxhash64("node", "block").alias("node"), "set")


def tiles(rows: DataFrame, limit: int, shingles: int, tasks: int = AS_DEALT) -> DataFrame:
    """(node, set, label): tiles in which any two classes of a large node with different labels meet.

    Where one label has nearly all classes, the others, half a tile of them at
    most, meet each part of it: these tiles have two rows a class.  Other nodes
    are cut into parts by hash, with one tile for each two parts.
    """
    each = rows.groupBy("node", "label").agg(F.count("*").alias("m"), F.sum("size").alias("s"))
    sums = each.groupBy("node").agg(F.max(F.struct("m", "s", "label")).alias("top"), F.sum("m").alias("n"), F.sum("s").alias("shingles"), F.count("*").alias("labels")).filter("labels > 1")
    thin = (2 * (F.col("n") - F.col("top.m")) <= limit) & (2 * (F.col("shingles") - F.col("top.s")) <= shingles)
    parts = F.greatest(F.when(thin, 1).otherwise(2), F.ceil(2 * F.col("n") / limit), F.ceil(2 * F.col("shingles") / shingles)).cast("int")
    sums = settle(sums.select("node", F.col("top.label").alias("top"), thin.alias("thin"), parts.alias("parts")).coalesce(tasks))
    own = rows.select("node", "set", "label").join(sums, "node").withColumn("part", F.pmod(F.xxhash64("node", "set", F.lit(2)), F.col("parts")).cast("int"))
    to = F.when(F.col("thin") & (F.col("label") == F.col("top")), F.array("part")).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    met = own.withColumn("other", F.explode(to)).filter(F.col("thin") | (F.col("other") != F.col("part")))
    tile = F.when(F.col("thin"), F.xxhash64("node", "other")).otherwise(F.xxhash64("node", F.least("part", "other"), F.greatest("part", "other")))
    return met.select(tile.alias("node"), "set", "label")


def near_dedup(df: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", trees: int = 6, node_limit: int = 4096, depth_limit: int = 24) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least id reachable by links) and kept.

    Texts are lower-cased (A-Z) and split at ASCII white space.  A text of
    fewer than five words is one shingle; one without words (or null) has no
    shingles and no links.  Rows that repeat an id are compared like others.
    Rows without an id are not compared: their component is null, and all are
    kept.  An empty table gives no rows; other columns are ignored.
    """
    out = _assigned(df, percent, id_col, text_col, trees, node_limit, depth_limit)
    name = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("doc_id"), "n_shingles", name.alias("component_id"), F.col("id").eqNullSafe(name).alias("kept"))


def drop_near_duplicates(df: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", trees: int = 6, node_limit: int = 4096, depth_limit: int = 24) -> DataFrame:
    """The rows of ``df`` less all but one of each group that links connect.

    The row with the least id stays, of several with that id the one whose
    text has the least digest; rows that repeat both id and text stay or go
    together.  Rows without an id or without shingles all stay.
    """
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    out = _assigned(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), digest.alias("digest")), percent, "doc_id", "text", trees, node_limit, depth_limit, ["digest"])
    first = out.filter("component is not null").groupBy("component").agg(F.min(F.struct("id", "digest")).alias("first")).select("first.*")
    stay = first.unionByName(out.filter("component is null").select("id", "digest"))
    return df.join(stay, df[id_col].eqNullSafe(stay["id"]) & (digest == stay["digest"]), "left_semi")


def _assigned(df: DataFrame, percent: int, id_col: str, text_col: str, trees: int, node_limit: int, depth_limit: int, carried: list[str] | None = None) -> DataFrame:
    """Per row: id, n_shingles, what is carried, its component's name and least id (null without id or shingles)."""
    carried = carried or []
    plain = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *carried)
    kind = plain.schema["id"].dataType.simpleString()
    more = "".join(f", {c} {plain.schema[c].dataType.simpleString()}" for c in carried)
    rows = settle(plain.mapInArrow(_emit_sketches(carried), f"id {kind}, n_shingles long, set long, sketch binary{more}"))
    plain = plain.select("id", "text")
    # One member of each class stands for it, and its text is read again for the comparison.
    n = rows.count()
    tasks = few(df, n)
    classes = settle(rows.filter("set <> 0 and id is not null").groupBy("set").agg(F.min("id").alias("id"), F.min("sketch").alias("sketch"), F.min("n_shingles").alias("n_shingles")).coalesce(tasks))
    links = settle(near_links(classes, plain, percent, trees, node_limit, depth_limit=depth_limit))
    found = components(links, about=n)
    named = classes.select("set", "id").join(found.withColumnRenamed("node", "set"), "set", "left").select("set", "id", F.coalesce("component", "set").alias("component"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    of_set = settle(named.join(least, "component").select("set", "component", "component_id").coalesce(tasks))
    # Rows without an id or shingles have no set to meet.
    own = F.when(F.col("id").isNotNull() & (F.col("set") != 0), F.col("set"))
    return rows.select("id", "n_shingles", own.alias("set"), *carried).join(of_set, "set", "left").select("id", "n_shingles", *carried, "component", "component_id")
