import numpy as np
from pyspark.sql import functions as F

from variantlake.llm import ann, components, pigeonhole

SCHEMA = "vec_id long, embedding array<float>, n_links string"


def vectors(spark, x, extra=()):
    rows = [(i, [float(v) for v in r], "") for i, r in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, SCHEMA)


ODD = [(9001, None, ""), (9002, [0.0] * 16, ""), (9003, [float("nan")] * 16, ""), (9004, [1.0, None] * 8, ""), (9005, [float("inf")] * 16, ""), (9006, [], ""), (9007, [1.0] * 7, ""), (None, [1.0] * 16, "")]


def test_nearest_is_exact_on_few_and_recalls_on_many(spark, work):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[100:140] = x[100]  # equal vectors: ties
    got = {}
    for r in ann.nearest(vectors(spark, x, ODD), F.col("vec_id") % 20 == 0, 20, work).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    d = x.astype(np.float64)
    hits = []
    assert set(got) == set(range(0, 3000, 20))
    for q, found in got.items():
        found.sort()
        s = d @ d[q]
        order = [i for i in np.lexsort((np.arange(len(s)), -s)) if i != q][:20]
        assert [r for r, _, _ in found] == list(range(1, 21)) and q not in [v for _, v, _ in found]
        assert all(abs(s[v] - sc) < 1e-9 for _, v, sc in found)
        hits.append(len({v for _, v, _ in found} & set(order)) / 20)
    assert np.mean(hits) >= 0.9


def test_nearest_small_and_empty(spark, work):
    df = vectors(spark, np.eye(3, 16) + 0.5, ODD)
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(df, F.col("vec_id") == 0, 20, work).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2)]
    assert ann.nearest(df.limit(0), F.lit(True), 5, work).collect() == []


def test_links_equal_all_pairs(spark, work):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 40))
    x[50:120] = x[50] + rng.normal(size=(70, 40)) * 0.22  # around the threshold
    x[200:230] = x[200]
    x[300:320] *= 3
    x = x.astype(np.float32)
    rows = [(k, [1.0] * 5 if k == 9007 else v, n) for k, v, n in ODD]
    got = {r.vec_id: r for r in pigeonhole.link_near(vectors(spark, x, rows), work).collect()}
    d = x.astype(np.float64)
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    near = d @ d.T >= 0.95
    np.fill_diagonal(near, False)
    root = np.arange(500)
    for _ in range(500):
        root = np.array([min([root[i], *root[near[i]]]) for i in range(500)])
    for i in range(500):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum(), root[i], root[i] == i)
    assert near.sum() > 500 and {got[k].n_links for k, _, _ in rows} == {0} and got[9002].component_id == 9002
    assert len(got) == 508 and pigeonhole.link_near(vectors(spark, x[:0]), work).collect() == []


def test_other_lengths_search_and_link_among_themselves(spark, work):
    rng = np.random.default_rng(9)
    long, short = rng.normal(size=(60, 16)), rng.normal(size=(8, 5))
    short[1], long[2] = short[0] * 2, long[40]
    rows = [(i, [float(v) for v in x], "") for i, x in enumerate(long)] + [(100 + i, [float(v) for v in x], "") for i, x in enumerate(short)] + [(0, [float(v) for v in short[0]], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links string")
    links = {r.vec_id: (r.n_links, r.component_id) for r in pigeonhole.link_near(df, work).collect()}
    assert links[100] == (2, 0) and links[101] == (2, 0) and links[0] == (2, 0) and links[2] == (1, 2) and links[40] == (1, 2) and links[103] == (0, 103) and len(links) == 68
    found = {}
    for r in ann.nearest(df, F.col("vec_id").isin(3, 103), 20, work).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    s = short @ short[3]
    want = sorted(((-v, 100 + i) for i, v in enumerate(s) if i != 3)) + []
    assert [v for _, v, _ in sorted(found[103]) if v >= 100] == [v for _, v in want] and len(found[103]) == 8 and len(found[3]) == 20


def test_crowded_cells_are_cut(spark, work, monkeypatch):
    monkeypatch.setattr(pigeonhole, "HOME_ROWS", 16)
    monkeypatch.setattr(pigeonhole, "VISITOR_ROWS", 32)
    rng = np.random.default_rng(3)
    x = (rng.normal(size=16) + rng.normal(size=(150, 16)) * 0.15).astype(np.float32)
    d = x.astype(np.float64)
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    near = (d @ d.T >= 0.95).sum(1) - 1
    got = {r.vec_id: r.n_links for r in pigeonhole.link_near(vectors(spark, x), work).collect()}
    assert [got[i] for i in range(150)] == near.tolist()


def test_components(spark, work):
    chain = [(i, i + 1) for i in range(60)] + [(100, 100), (201, 200), (200, 201), (None, 5)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(chain, "a long, b long"), work).collect()}
    assert got == {**{i: 0 for i in range(61)}, 200: 200, 201: 200}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), work).collect() == []


def test_queue_and_blocks_equal_plain_loops(spark, work, monkeypatch):
    import heapq

    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8))
    forest = ann.Forest(x, 4, trees=3)
    q = rng.normal(size=(21, 8))
    got = forest.visits(q, 1.6)
    for row, own in zip(got, q):  # one queue over all trees' pending branches
        margins, out = forest.directions @ own - forest.cuts, set()
        heap = [(0.0, t, 0) for t in range(3)]
        while len(out) < round(1.6 * 16):
            cost, t, i = heapq.heappop(heap)
            while i < forest.inner:
                m = margins[t, i]
                near = 2 * i + 1 + (m >= 0)
                heapq.heappush(heap, (cost + m * m, t, 4 * i + 3 - near))
                i = near
            out.add(t * 16 + i - forest.inner)
        assert set(np.flatnonzero(row)) == out
    x[::7] *= 1e30  # beyond what single precision multiplies
    x[40:60] = np.round(x[40:60])  # ties
    leaves = forest.leaves(x)
    monkeypatch.setattr(ann, "PIECE", 50)
    block = ann.Block(np.arange(21), q, np.packbits(got, axis=1))
    best = ann.Best(block, 6)
    for i in range(0, 400, 130):
        best.add(np.arange(i, min(400, i + 130)), x[i:i + 130], leaves[i:i + 130] + np.arange(3) * 16)
    found = best.table().to_pandas()
    for i in range(21):
        seen = np.flatnonzero(got[i][leaves + np.arange(3) * 16].any(1))
        s = (x[seen] * q[i]).sum(1)
        order = np.lexsort((seen, -s))[:6]
        own = found[found["query"] == i]
        assert list(own["rep"]) == list(seen[order]) and np.allclose(own["score"], s[order], rtol=1e-12)


def test_nearest_shuffles_no_more_than_in_proportion(spark, monkeypatch):
    from variantlake.llm.common import Workspace

    monkeypatch.setattr(ann, "QUERY_BLOCK", 10)
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled(n):
        x = np.random.default_rng(n).normal(size=(n, 16))
        before = store.executorSummary("driver").totalShuffleWrite()
        assert len(ann.nearest(vectors(spark, x), F.col("vec_id") % 20 == 0, 5, Workspace(spark, f"moved-{n}")).collect()) == n // 20 * 5
        return store.executorSummary("driver").totalShuffleWrite() - before

    assert shuffled(2400) < 6 * shuffled(600)  # four times the rows; every candidate went to every block of queries
