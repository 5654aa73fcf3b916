import itertools
import random

import pytest

from bibliome.llm import matching as X

A = [
    (1, "Towards genetic enzymes: lessons from α-jesubadone in Port Quessel.", "Zuhuhivik DJ, Kujarerov M, de Nohuvotil W", "2022", "10.1000/a1"), (2, "Towards genetic enzymes: lessons from α-jesubadone in Port Quessel.", "Zuhuhivik DJ, Kujarerov M, de Nohuvotil W", "2022", "10.1000/a1"),
    (3, "Towards genetic enzymes: lessons from α-jesubadone in Port Quessel: part II", "Zuhuhivik DJ, Kujarerov M", "2023", None), (4, "Introduction", "Aaronbek A", "2020", None), (5, "Introduction", "Zemivakas B", "2020", None),
    (6, "Modelling behaviour of tumours in a cohort of 7 samples", None, None, None), (7, None, "Nobody N", "2000", None), (8, "", None, None, "10.1000/x"),
]
W = [
    (11, "https://doi.example/10.1000/A1", "<i>Towards</i> Genetic Enzymes: Lessons From -jesubadone In Port Quessel*", "Dan Zuhuhivik; M. Kujarerov; et al.", 2023), (12, None, "Article: Towards genteic enzymes: lessons from alpha-jesubadone in Port Quessel", "Kujarerov Mia; Dan Zuhuhivik", 2022),
    (13, "10.1000/a1", "Towards genetic enzymes: lessons from α-jesubadone in Port Quessel: part II", "Dan Zuhuhivik; Mia Kujarerov", 2023), (14, None, "Towards genetic enzymes: lessons from α-jesubadone in Port Quessel – a protocol", "Dan Zuhuhivik; Mia Kujarerov", 2022),
    (15, None, "Introduction", "Boris Zemivakas", 2020), (16, None, "Introduction", None, 2020), (17, None, "Modeling behavior of tumors in cohort of 7 samples", "Someone Else", 2019), (18, None, "Modelling behaviour of tumours in a cohort of 8 samples", None, 2019), (19, None, None, None, None),
    (20, None, "Towards genetic enzymes", "Dan Zuhuhivik; M. Kujarerov; W. de Nohuvotil", 2022),
]


NAMES = [f"{p}{q}" for p in ("Karlo", "Bimen", "Tusav", "Welor", "Zunif", "Hopek", "Dargy", "Milux", "Sefot", "Nivac") for q in ("witz", "berga", "mons", "dahlq", "ruegg", "ptoun")]


def frames(spark, a, w):
    return (
        spark.createDataFrame([(i, t, p, y, d, "k", 1) for i, t, p, y, d in a], "article_id bigint, title string, author_string string, pub_year string, doi string, kind string, id int"),
        spark.createDataFrame([(i, d, t, p, y, "v") for i, d, t, p, y in w], "work_id bigint, doi string, title string, authors string, publication_year int, venue_name string"),
    )


def test_matches(spark):
    got = {(r.article_id, r.work_id): r.confidence for r in X.matched(*frames(spark, A, W)).collect()}
    assert set(got) == {(a, w) for a in (1, 2) for w in (11, 12, 20)} | {(3, 13), (5, 15), (6, 17)}
    assert all(0.5 < c <= 1 for c in got.values())


@pytest.mark.parametrize(("a", "w"), [([], []), (A, []), ([], W)])
def test_empty(spark, a, w):
    assert X.matched(*frames(spark, a, w)).count() == 0


def test_many_equal_titles_stay_linear(spark):
    a = [(i, "Editorial notes on the state of the field", f"{NAMES[i]} Q", "2020", None) for i in range(60)]
    w = [(i, None, "Editorial notes on the state of the field", f"Quentin {NAMES[i]}", 2020) for i in range(60)]
    got = {(r.article_id, r.work_id) for r in X.matched(*frames(spark, a, w)).collect()}
    assert got == {(i, i) for i in range(60)}


@pytest.mark.parametrize(("raw", "want"), [("The <b>Behaviour</b> &amp; β-Colour", "behavior and color"), ("[Article: Modelling Catalogues", "modeling catalogues"), (None, None)])
def test_folding(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "t string").select(X.folded_title(__import__("pyspark").sql.functions.col("t")).alias("x")).first().x
    assert got == want


def total_of(edges):
    """The greatest total of one-to-one pairs, by trying all."""
    best = 0.0
    for n in range(len(edges) + 1):
        for some in itertools.combinations(edges, n):
            if len({a for a, _, _ in some}) == n == len({w for _, w, _ in some}):
                best = max(best, sum(c for _, _, c in some))
    return best


@pytest.mark.parametrize("seed", range(25))
def test_assignment_has_the_greatest_total(seed):
    rng = random.Random(seed)
    ends = [(f"a{i}", f"w{j}") for i in range(4) for j in range(4)]
    edges = [(a, w, round(rng.uniform(0.5, 1), 4)) for a, w in rng.sample(ends, 9)]
    got = X.assigned(edges)
    assert len({a for a, _, _ in got}) == len(got) == len({w for _, w, _ in got}) and set(got) <= set(edges)
    assert abs(sum(c for *_, c in got) - total_of(edges)) < 1e-9


def test_one_to_one_over_components(spark, monkeypatch):
    edges = [("a1", "w1", 0.9), ("a1", "w2", 0.8), ("a2", "w1", 0.85), ("a3", "w3", 0.7), ("a4", "w4", 0.9), ("a4", "w5", 0.9)]
    df = spark.createDataFrame(edges, "a string, w string, confidence double")
    assert {tuple(r) for r in X.one_to_one(df).collect()} == {("a1", "w2", 0.8), ("a2", "w1", 0.85), ("a3", "w3", 0.7), ("a4", "w4", 0.9)}
    monkeypatch.setattr(X, "LARGE", 2)  # pair by pair: the best pair first, so less in total
    assert {tuple(r) for r in X.one_to_one(df).collect()} == {("a1", "w1", 0.9), ("a3", "w3", 0.7), ("a4", "w4", 0.9)}


def test_copies_fill_no_window_and_match_each(spark):
    title = "Seasonal changes of krill stocks around a southern island over ten years"
    a = [(i, title, "Olsen B, Berg A", "2021", None) for i in range(40)] + [(100, title + " of warm currents", "Olsen B", "2021", None)]
    w = [(i, None, title.upper(), "Bo Olsen; Anna Berg", 2021) for i in range(30)]
    got = {(r.article_id, r.work_id) for r in X.matched(*frames(spark, a, w)).collect()}
    assert got == {(i, j) for i in range(40) for j in range(30)}


def test_letter_counts_rule_out_no_like_titles(spark):
    base = "quantitative imaging of early lesions in the rabbit eye"
    rows = [(1, base, None, "2020", None), (2, base.replace("early", "erly").replace("rabbit", "rabibt"), None, "2020", None), (3, "a wholly different thing about soil fungi and their roots", None, "2020", None)]
    a, w = frames(spark, rows, [])
    r, _ = X.distinct_records(X.records(a, w))
    got = {(p.x, p.y) for p in X.neighbours(X.sort_keys(r)).collect()}
    assert (1, 2) in got and (1, 3) not in got


@pytest.mark.parametrize("seed", range(10))
def test_signatures_bound_the_edits(seed):
    rng = random.Random(seed)
    a = "".join(rng.choice("abcdefgh 7細胞") for _ in range(rng.randint(0, 60)))
    b, edits = list(a), rng.randint(0, 9)
    for _ in range(edits):
        at = rng.randint(0, len(b))
        b[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "q"])
    counts, bits = X.signatures([a, "".join(b), ""])
    assert abs(counts[0].astype(int) - counts[1]).sum() <= 2 * edits and int(X.np.bitwise_count(bits[0] ^ bits[1]).sum()) <= 4 * edits


def test_large_components_are_assigned_exactly(spark):
    rng, n = random.Random(4), 230  # 52,900 pairs; the planted ones are as good as their ends allow, all others less
    u, v = [rng.randint(3000, 5000) for _ in range(n)], [rng.randint(3000, 5000) for _ in range(n)]
    edges = [(f"a{i:03d}", f"w{j:03d}", (u[i] + v[j] - (rng.randint(1, 400) if i != j else 0)) / 10_000) for i in range(n) for j in range(n)]
    got = {(r.a, r.w) for r in X.one_to_one(spark.createDataFrame(edges, "a string, w string, confidence double")).collect()}
    assert got == {(f"a{i:03d}", f"w{i:03d}") for i in range(n)}


@pytest.mark.parametrize("seed", range(10))
def test_equal_confidences_have_the_greatest_total(seed):
    rng = random.Random(seed)
    edges = [(f"a{i}", f"w{j}", rng.choice([0.5, 0.9, 0.9])) for i, j in rng.sample([(i, j) for i in range(5) for j in range(4)], 10)]
    got = X.assigned(edges)
    assert len({a for a, _, _ in got}) == len(got) == len({w for _, w, _ in got}) and set(got) <= set(edges)
    assert abs(sum(c for *_, c in got) - total_of(edges)) < 1e-9
