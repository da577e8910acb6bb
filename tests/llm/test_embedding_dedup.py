import numpy as np

from sparkworks.llm.embedding_dedup import embedding_dedup, plan_tables


def expected(rows, least=0.95):
    good, label = [], list(range(len(rows)))
    for _, v in rows:
        a = np.array([np.nan if x is None else x for x in v], float) if v is not None else np.zeros(0)
        good.append(a if len(a) and np.isfinite(a).all() and np.abs(a).max() > 0 else None)
    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if good[i] is not None and good[j] is not None and len(good[i]) == len(good[j]):
                a, b = good[i] / np.abs(good[i]).max(), good[j] / np.abs(good[j]).max()
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= least:
                    links[i] += 1
                    links[j] += 1
                    old, new = label[i], label[j]
                    label = [new if x == old else x for x in label]
    name = {c: min((rows[k][0] for k in range(len(rows)) if label[k] == c and rows[k][0] is not None), default=None) for c in label}
    return sorted(((i, links[k], name[label[k]], i == name[label[k]]) for k, (i, _) in enumerate(rows)), key=repr)


def test_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(8):
        centre = rng.normal(size=16)
        rows += [(len(rows) + k, (centre + rng.normal(size=16) * s).astype(np.float32).tolist()) for k, s in enumerate([0, 0.02, 0.1, 0.2, 0.25, 0.3])]
    rows += [(100, rows[0][1]), (101, rows[0][1]), (102, [2 * x for x in rows[0][1]]), (103, None), (104, []), (105, [0.0] * 16), (106, [None] + [1.0] * 15), (107, [float("nan")] * 16), (108, [float("inf")] * 16)]
    rows += [(109, [1.0, 2.0]), (110, [1.0, 2.001]), (None, rows[0][1]), (100, rows[5][1]), (111, [-0.0] * 15 + [1e-30]), (112, [0.0] * 15 + [1e30])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, class int, unit string").repartition(3)
    for tile in (2048, 4):
        assert sorted((tuple(r) for r in embedding_dedup(df, tile=tile).collect()), key=repr) == expected(rows)
    assert embedding_dedup(df.limit(0)).count() == 0


def test_planned_recall():
    for n in (10, 50_000, 10**9):
        bits, tables = plan_tables(n, 0.95, 1e-5)
        alike = 1 - np.arccos(0.95) / np.pi
        assert (1 - alike**bits) ** tables <= 1e-5
