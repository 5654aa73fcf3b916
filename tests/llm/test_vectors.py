import numpy as np
import pytest

from bibliome.llm import vectors as V


def brute(ids, x, k, least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    out = set()
    for i in range(len(ids)):
        near = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[i, j], ids[j]))[:k]
        out |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in near if s[i, j] >= least}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if y is None else float(y) for y in v], "x", 1) for i, v in rows], "facts_id bigint, vector array<float>, v string, id int")


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 96))
    x = np.vstack([c + 0.45 * rng.normal(size=(rng.integers(1, 14), 96)) for c in centres] + [rng.normal(size=(120, 96))])
    return (x * rng.uniform(0.2, 9, size=(len(x), 1))).astype(np.float32)


def test_pairs_equal_brute_force(spark, clustered):
    x = np.vstack([clustered, np.repeat(clustered[:1], 9, axis=0) * np.arange(1, 10)[:, None], clustered[5:7]])
    ids = list(range(100, 100 + len(x)))
    odd = [(1, None), (2, [0.0] * 96), (3, [1.0] * 48), (4, [float("nan")] * 96), (5, [float("inf")] + [1.0] * 95), (6, [None] + [1.0] * 95), (7, [])]
    got = {tuple(r) for r in V.similar_pairs(frame(spark, [*zip(ids, x.tolist(), strict=True), *odd]), "facts_id", "vector").collect()}
    want = brute(ids, x.astype(float), 5, 0.8)
    assert len(want) > 150 and got == want


def test_copies_rank_each_other_by_id(spark):
    v = [1.0] + [0.0] * 95
    got = {(r.id, r.other) for r in V.similar_rows(frame(spark, [(i, v) for i in range(8)]), "facts_id", "vector").collect()}
    assert got == {(i, j) for i in range(8) for j in [j for j in range(8) if j != i][:5]}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5] * 96)]])
def test_nothing_to_find(spark, rows):
    assert V.similar_pairs(frame(spark, rows), "facts_id", "vector").count() == 0
    assert V.search_by_lists(frame(spark, rows), frame(spark, rows), "facts_id", "vector").count() == 0


@pytest.mark.parametrize("cell_rows", [1000, 12])
def test_search_recall(spark, clustered, monkeypatch, cell_rows):
    monkeypatch.setattr(V, "CELL_ROWS", cell_rows)
    ids = np.arange(len(clustered))
    df = frame(spark, zip(ids.tolist(), clustered.tolist(), strict=True))
    got = V.search_by_lists(df, df.where("facts_id % 20 = 0"), "facts_id", "vector").collect()
    u = clustered / np.linalg.norm(clustered, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    hits = sum(r.other in np.argsort(-s[r.id])[:5] for r in got)
    assert len(got) == 5 * len(ids[ids % 20 == 0]) and hits / len(got) >= 0.95
    assert all(abs(r.similarity - s[r.id, r.other]) < 1e-4 for r in got)


def test_codes_approximate_and_a_beam_finds_the_nearest_sums():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(1, 96)) + 0.2 * rng.normal(size=(700, 96)), rng.normal(size=(300, 96))]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    coarse = V.coarse_books(x, 40_000)
    books = (*coarse, *V.fine_books(x, coarse, 4))
    codes, norms = V.encode(x, books)
    made = sum(c[codes[:, m]] for m, c in enumerate(books))
    assert np.allclose((made**2).sum(1), norms, atol=1e-4)
    assert ((x - made) ** 2).sum(1).mean() < ((x - x.mean(0)) ** 2).sum(1).mean() * 0.6
    assert np.allclose(V.scores(V.tables(x[:5], books), codes, norms), x[:5] @ made.T - 0.5 * norms, atol=1e-4)
    sums = (coarse[0][:, None] + coarse[1][None]).reshape(-1, 96)
    want = ((x[:, None] - sums[None]) ** 2).sum(2).argsort(1)[:, :3]
    assert (V.cells_of(x, coarse, 3) == want).mean() > 0.99


def test_placing_a_row_costs_the_same_however_many_lists_there_are():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 96)).astype(np.float32)
    few, many = (tuple(rng.normal(size=(k, 96)).astype(np.float32) for _ in range(3)) for k in (4, 300))
    assert V.cells_of(x, few, 4).max() < 64 and V.cells_of(x, many, 4).max() > 300 * 300  # 27 million lists, none of them made


def dense_and_groups(rng):
    groups = np.repeat(rng.normal(size=(300, 96)), 5, axis=0) + 0.45 * rng.normal(size=(1500, 96))
    dense = rng.normal(size=(1, 96)) + 0.4 * rng.normal(size=(700, 96))
    return np.vstack([groups, dense, rng.normal(size=(300, 96))]).astype(np.float32)


def pairs_and_truth(spark, x, **options):
    ids = list(range(len(x)))
    got = {tuple(r) for r in V.similar_pairs(frame(spark, zip(ids, x.tolist(), strict=True)), "facts_id", "vector", **options).collect()}
    return got, brute(ids, np.rint(x / np.abs(x).max(1, keepdims=True) * 32767).astype(float), 5, 0.8)


def test_recall_of_lists_with_a_dense_region_of_distinct_vectors(spark, monkeypatch):
    monkeypatch.setattr(V, "CELL_ROWS", 12)
    monkeypatch.setattr(V, "BLOCK_ROWS", 500)
    got, want = pairs_and_truth(spark, dense_and_groups(np.random.default_rng(5)))
    assert len(want) > 4000 and len(got & want) / len(want) >= 0.95 and len(got - want) / len(got) < 0.05


def test_crowded_lists_are_quantised_anew(spark, monkeypatch):
    monkeypatch.setattr(V, "CELL_ROWS", 12)
    monkeypatch.setattr(V, "BLOCK_ROWS", 200)
    rng = np.random.default_rng(5)
    x = dense_and_groups(rng)
    reps = V.usable_vectors(frame(spark, zip(range(len(x)), x.tolist(), strict=True)), "facts_id", "vector", 96)
    index = V.built(reps, len(x), dim=96, k=5, min_sim=0.8, recall=0.995, fine=4, single=False)
    assert len(index.tiers) > 1 and len(index.tiers[0].crowded)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    row, key = V.keys_of(u, index.tiers)
    assert set(row) == set(range(len(x))) and not np.isin(key, np.concatenate([t.crowded for t in index.tiers[:-1]])).any()
    n = dict(zip(*np.unique(key, return_counts=True), strict=True))
    assert {k: -(-int(c) // 200) for k, c in n.items() if c > 200} == index.blocks  # the rest is compared in blocks


def test_no_pair_is_lost_among_many_cells_or_in_a_dense_region(spark, monkeypatch):
    monkeypatch.setattr(V, "CELL_ROWS", 12)
    monkeypatch.setattr(V, "BLOCK_ROWS", 900)
    got, want = pairs_and_truth(spark, dense_and_groups(np.random.default_rng(5)), recall=1.0)
    assert len(want) > 4000 and got == want
