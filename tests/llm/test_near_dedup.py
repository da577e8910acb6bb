import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkworks.llm import near_dedup as n
from sparkworks.llm.common import settle
from sparkworks.llm.components import components


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def expected(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if sets[a][0] is not None and sets[b][0] is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                old, new = label[a], label[b]
                label = [new if v == old else v for v in label]
    least = {}
    for k, (i, _) in enumerate(sets):
        least[label[k]] = min(least.get(label[k], i), i) if i is not None else None
    return sorted(((i, len(s), least[label[k]], i == least[label[k]]) for k, (i, s) in enumerate(sets)), key=repr)


def copies(rng, groups, size):
    out = []
    for g in range(groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([12, 60, 200]))]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 40))):
                own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
            out.append((len(out), " ".join(own)))
    return out


def test_against_brute_force(spark, odd, odd_rows, none):
    got = sorted((tuple(r) for r in n.near_dedup(odd).collect()), key=repr)
    assert got == expected([r[:2] for r in odd_rows])
    assert n.near_dedup(none).count() == 0


def test_groups_of_copies(spark):
    rows = copies(random.Random(1), 12, 15)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in n.near_dedup(df).collect()), key=repr) == expected(rows)


def test_large_nodes_branch(spark):
    """A tiny node limit sends groups through several levels and at last into blocks; nearly all components stay whole."""
    rows = copies(random.Random(2), 2, 200)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in n.near_dedup(df, node_limit=140, depth_limit=2).collect()), key=repr)
    want = expected(rows)
    same = sum(a == b for a, b in zip(got, want, strict=True))
    assert same >= 0.9 * len(want)


def test_whole_groups_across_batches():
    keys = [1, 1, 2, 2, 2, 3, 4, 4, 4, 4, 5]
    for size in (1, 2, 3, 4, 20):
        batches = [pa.RecordBatch.from_pydict({"k": keys[a : a + size], "v": list(range(a, min(a + size, len(keys))))}) for a in range(0, len(keys), size)]
        tables = list(n.whole_groups(iter(batches), "k"))
        assert [v for t in tables for v in t["v"].to_pylist()] == list(range(len(keys)))
        seen = [set(t["k"].to_pylist()) for t in tables]
        assert sum(map(len, seen)) == 5


def test_recall_of_roots():
    assert 0.25 ** n.picked_places(n.root_keys(6), 0.75).sum() < 1e-6
    tokens = np.arange(3 * n.PLACES, dtype=np.uint32).reshape(3, -1)
    assert list(n.estimates(tokens, 0.5)) == []


def test_components_of_a_long_path(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1001), (5, 5), (None, 3), (1001, 1000)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(301)} | {1000: 1000, 1001: 1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture
def estimates_of(monkeypatch):
    """The estimates of size of what a module settles, as decimal digits."""

    def watch(module):
        digits, real = [], module.settle

        def settle(df):
            said = re.search(r"sizeInBytes=([\d.]+)(?:E\+(\d+))?", df._jdf.queryExecution().optimizedPlan().stats().simpleString())
            digits.append(int(said[2] or 0))
            return real(df)

        monkeypatch.setattr(module, "settle", settle)
        return digits

    return watch


def test_rounds_of_components_do_not_multiply_estimates(spark, estimates_of):
    """Estimates of a join are products: carried from round to round their digits double, to gigabytes of the driver's memory."""
    from sparkworks.llm import components as c

    digits = estimates_of(c)
    ids = list(range(300))
    random.Random(4).shuffle(ids)
    found = c.components(spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "a long, b long"))
    assert {r["component"] for r in found.collect()} == {0}
    assert len(digits) > 20 and max(digits) < 100


def test_levels_do_not_multiply_estimates(spark, estimates_of):
    digits = estimates_of(n)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 32, n.PLACES, dtype=np.uint64)
    tokens = np.where(rng.random((300, n.PLACES)) < 0.55, base, rng.integers(0, 1 << 32, (300, n.PLACES), dtype=np.uint64)).astype(np.uint32)
    rows = []
    n.grown(n.settle(spark.createDataFrame([(k, x.tobytes(), 400) for k, x in enumerate(tokens)], "set long, sketch binary, n_shingles long")), 0.75, 2, 8, 10**9, 24, rows)
    assert len(rows) > 4 and max(digits) < 100


def test_components_of_a_small_table_take_few_tasks(spark):
    """A session's 211 parts make 211 tasks a stage of a large table alone; each task costs the driver memory and a file or two."""
    session, context = spark.newSession(), spark.sparkContext
    session.conf.set("spark.sql.shuffle.partitions", "211")
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    edges = session.createDataFrame([(k, k + 1) for k in range(300)], "a long, b long")
    context.setJobGroup("small components", "")
    try:
        assert {r["component"] for r in components(edges).collect()} == {0}
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("small components") for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(info.numCompletedTasks for info in map(tracker.getStageInfo, stages) if info)
    print("tasks", tasks)
    assert len(stages) > 20 and tasks < 2500


def test_close_copies_above_node_shingles(spark):
    """A group of very close copies too large for a node stays whole, whatever places its nodes pick."""
    rng = random.Random(4)
    base = [f"v{rng.randrange(9000)}" for _ in range(4000)]
    rows = []
    for k in range(40):
        own = list(base)
        own[k * 90] = f"e{k}"
        rows.append((k, " ".join(own)))
    plain = spark.createDataFrame(rows, "id long, text string")
    classes = settle(plain.mapInArrow(n._emit_sketches([]), "id long, n_shingles long, set long, sketch binary"))
    found = components(n.near_links(classes, plain, node_shingles=100_000)).collect()
    assert len(found) == 40 and len({r["component"] for r in found}) == 1


def test_pairs_of_an_unparted_node_meet(spark):
    """Pairs far from all hubs of a node are found though they are in different blocks."""
    rng = random.Random(5)
    rows = []
    for k in range(60):
        base = [f"p{k}y{rng.randrange(3000)}" for _ in range(100)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join([*base[:-1], "changed"]))]
    shared = spark.createDataFrame(rows, "doc_id long, text string")
    plain = shared.select(shared.doc_id.alias("id"), "text")
    classes = settle(plain.mapInArrow(n._emit_sketches([]), "id long, n_shingles long, set long, sketch binary"))
    crowd = classes.selectExpr("7L as node", "set", "set as label", "cast(n_shingles as int) as size")
    found = n._compare(n.tiles(crowd, 4096, 2000), classes, plain, 0.5, 75)
    ids = {r["set"]: r["id"] for r in classes.collect()}
    assert {tuple(sorted((ids[r["a"]], ids[r["b"]]))) for r in found.collect()} == {(2 * k, 2 * k + 1) for k in range(60)}


def test_every_node_branches():
    nodes = n.root_keys(2000)
    assert (~n.picked_places(nodes, 0.75).any(axis=1)).sum() > 300
    assert n.branched_places(nodes, 0.75).any(axis=1).all()


def test_recall_in_deep_nodes():
    """Of pairs at the threshold nearly all are still together in some node after many branchings."""
    rng = np.random.default_rng(1)
    roots = n.root_keys(6)
    tree, place = np.nonzero(n.picked_places(roots, 0.75))
    lost = 0
    for _ in range(300):
        agree, token = rng.random(n.PLACES) < 0.75, rng.integers(0, 1 << 32, n.PLACES, dtype=np.uint64)
        nodes, p, t = roots, place, tree
        for _ in range(25):
            m = agree[p]
            nodes = np.unique(n.child_keys(nodes[t[m]], p[m], token[p[m]]))[:300]
            if not len(nodes):
                lost += 1
                break
            t, p = np.nonzero(n.branched_places(nodes, 0.75))
    assert lost <= 6


def test_rows_that_stay(spark, odd, none):
    """One row of each group, also where ids repeat."""
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    rows = [(1, a), (5, a + " more"), (5, b), (7, b + " more"), (5, b + " and"), (None, a), (8, None), (8, ""), (9, "few"), (10, "few")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as digest", "2 as component", "3 as id")
    got = n.drop_near_duplicates(df)
    assert got.columns == df.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr)
    fives = [t for i, t in kept if i == 5]
    assert len(fives) == 1 and fives[0] in (b, b + " and")
    assert sorted((x for x in kept if x[0] != 5), key=repr) == sorted([(1, a), (None, a), (8, None), (8, ""), (9, "few")], key=repr)
    assert n.drop_near_duplicates(none).count() == 0


def test_tiles_of_one_label_and_few_others(spark):
    """Rows of the common label are copied once, and each of the others meets all of them and one another."""
    rows = [(1, k, 9 if k < 900 else k, 10) for k in range(905)] + [(2, k, 5, 10) for k in range(50)]
    crowd = spark.createDataFrame(rows, "node long, set long, label long, size int")
    got = n.tiles(crowd, 100, 10_000).collect()
    assert {r["set"] for r in got} == set(range(905))
    groups = {}
    for r in got:
        groups.setdefault(r["node"], set()).add(r["set"])
    assert sum(len(g & set(range(900))) for g in groups.values()) == 900
    assert all(set(range(900, 905)) <= g and len(g) < 110 for g in groups.values())


def test_nodes_that_share_most_classes_are_one(spark):
    a, b, c = range(0, 1000), range(400, 1100), range(5000, 5600)
    crowds = spark.createDataFrame([(k, s, 3) for k, own in ((1, a), (2, b), (3, c), (4, range(990, 1400))) for s in own], "node long, set long, size int")
    found = {}
    for r in n.merged(crowds).collect():
        found.setdefault((r["node"], r["n"], r["shingles"]), set()).add(r["set"])
    assert {frozenset(v) for v in found.values()} == {frozenset(range(1100)), frozenset(c), frozenset(range(990, 1400))}
    assert all(k[1] == len(v) and k[2] == 3 * len(v) for k, v in found.items())


def test_paths_use_a_place_once():
    nodes = n.root_keys(3000)
    used = np.arange(3000, dtype=np.uint64) * np.uint64(0x1234567) | np.uint64(1 << 63)
    picked = n.branched_places(nodes, 0.75, used)
    bits = (used[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    assert picked.any(axis=1).all() and not (picked & (bits == 1)).any()
    assert abs(picked.sum(axis=1).mean() - 2.1) < 0.2
    full = np.full(3, (1 << 64) - 1, np.uint64)
    assert not n.branched_places(nodes[:3], 0.75, full).any()


def crowd_of(spark, size, alike, seed):
    """Classes whose tokens agree with those of one text as often as its near copies' do."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 32, n.PLACES, dtype=np.uint64)
    tokens = np.where(rng.random((size, n.PLACES)) < alike, base, rng.integers(0, 1 << 32, (size, n.PLACES), dtype=np.uint64)).astype(np.uint32)
    rows = [(k + 1, x.tobytes(), 400) for k, x in enumerate(tokens)]
    return spark.createDataFrame(rows, "set long, sketch binary, n_shingles long"), tokens


@pytest.mark.parametrize("size,alike", [(6_000, 0.82), (6_000, 0.87), (10_000, 0.82), (20_000, 0.82), (20_000, 0.87)])
def test_groups_of_near_copies_do_not_grow(spark, size, alike):
    classes, _ = crowd_of(spark, size, alike, size)
    rows = []
    fitting, crowds = n.grown(settle(classes), 0.75, 6, 4096, 4_000_000, 24, rows)
    assert max(rows) <= 4 * rows[0] and len(rows) <= 3
    fits = fitting.groupBy("node").agg(F.count("*").alias("m")).agg(F.sum("m"), F.sum(F.col("m") * F.col("m"))).first()
    whole = n.merged(crowds)
    one = whole.groupBy("node").agg(F.count("*").alias("m")).collect()
    assert len(one) == 1 and 0.99 * size <= one[0]["m"] <= size
    blocks = n._blocks(whole, 4096, 4_000_000).groupBy("node").agg(F.count("*").alias("m")).agg(F.sum("m"), F.sum(F.col("m") * F.col("m"))).first()
    # At worst nothing is linked yet when the tiles are made.
    worst = n.tiles(whole.withColumn("label", F.col("set")), 4096, 4_000_000).groupBy("node").agg(F.count("*").alias("m")).agg(F.sum("m"), F.sum(F.col("m") * F.col("m")), F.max("m")).first()
    copies = (blocks[0] + worst[0] + (fits[0] or 0)) / size
    print(size, alike, "rows by level", rows, "copies of a set", round(copies, 1), "of all pairs", round((blocks[1] + worst[1] + (fits[1] or 0)) / size**2, 2))
    assert copies <= 11.5 and worst[0] <= 10 * size and worst[1] <= 2.2 * size**2 and worst[2] <= 4096 * 1.2


def test_recall_at_the_threshold_whatever_the_depth(spark):
    """Pairs at the threshold, planted among classes that are somewhat alike, meet in a node that is compared."""
    rng = np.random.default_rng(12)
    base = rng.integers(0, 1 << 32, n.PLACES, dtype=np.uint64)
    pairs, size = 400, 1600
    first = np.where(rng.random((size, n.PLACES)) < 0.55, base, rng.integers(0, 1 << 32, (size, n.PLACES), dtype=np.uint64))
    second = np.where(rng.random((pairs, n.PLACES)) < 0.75, first[:pairs], rng.integers(0, 1 << 32, (pairs, n.PLACES), dtype=np.uint64))
    tokens = np.concatenate((first, second)).astype(np.uint32)
    classes = settle(spark.createDataFrame([(k, x.tobytes(), 400) for k, x in enumerate(tokens)], "set long, sketch binary, n_shingles long"))
    for limit in (400, 100, 30):
        rows = []
        fitting, crowds = n.grown(classes, 0.75, 6, limit, 10**9, 24, rows)
        nodes = {}
        for r in (fitting if crowds is None else fitting.unionByName(crowds.select("node", "set"))).collect():
            nodes.setdefault(r["node"], set()).add(r["set"])
        met = sum(any(k in g and size + k in g for g in nodes.values()) for k in range(pairs))
        print("limit", limit, "rows by level", rows, "met", met, "of", pairs)
        assert met >= 0.95 * pairs


def test_labels_of_a_node_are_connected_already():
    """Tiles give links between labels alone; links within them had come to one a class and tile."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(3000)}" for _ in range(200)]
    sets = [np.unique(np.array([hash(tuple(w[k : k + 5])) & (1 << 63) - 1 for k in range(196)], np.uint64)) for j in range(30) for w in [[*base[: 170 + j], *(f"e{j}" for _ in range(30 - j))]]]
    assert len(n.spanning_links(sets, 0.5, 75)) == 29
    labels = np.array([5] * 20 + [3] * 9 + [4])
    links = n.spanning_links(sets, 0.5, 75, labels=labels)
    assert len(links) == 2 and {frozenset(labels[[a, b]].tolist()) for a, b in links} <= {frozenset(x) for x in ((3, 4), (3, 5), (4, 5))}
    assert not n.spanning_links(sets, 0.5, 75, labels=np.zeros(30, np.int64))
