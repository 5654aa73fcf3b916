import datetime as dt
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bibliome.llm import survivor as S

T = dt.datetime(2024, 1, 1)
REC = "record_id bigint, source_key string, source_id string, paper_id string, payload string, fetched_at timestamp, stored_at timestamp"
PRI = "source_key string, field_name string, priority int"
TRUST = {"pubmed": 50, "europepmc": 40, "arxiv": 10}


def run(spark, recs):
    df = spark.createDataFrame([(i, s, "x", p, j if isinstance(j, str) or j is None else json.dumps(j), t, T) for i, s, p, j, t in recs], REC)
    pri = spark.createDataFrame([(s, f, v) for s, v in TRUST.items() for f in S.FIELDS], PRI)
    out = S.survivors(df, pri).collect()
    assert len({(r.paper_id, r.field_name) for r in out}) == len(out)
    return {(r.paper_id, r.field_name): r.record_id for r in out}


def test_order_of_precedence(spark):
    whole = "We saw it. It was good."
    got = run(spark, [
        (1, "pubmed", "p", {"title": "A long ti…", "abstract": "We saw it. It w", "doi": "10.", "pub_date": "n.d."}, T),
        (2, "arxiv", "p", {"title": "A long title", "abstract": whole, "doi": "10.1/x", "created": "2024-01-01"}, T),
        (3, "arxiv", "p", {"title": "A  LONG title.", "abstract": f"<p>{whole}</p>", "doi": " ", "created": None}, T + dt.timedelta(1)),
        (4, "europepmc", "p", {"title": "N/A", "abstractText": "[No abstract available]"}, T),
        (5, "pubmed", "q", {"title": "only one"}, T), (6, "pubmed", None, {"title": "no paper"}, T), (7, "pubmed", None, {"title": "no paper"}, T),
        (8, "pubmed", "r", "{broken", T), (9, "other", "r", {"title": "X"}, T), (10, "arxiv", "r", None, T),
        (11, "pubmed", "s", {"title": "Same"}, T), (12, "pubmed", "s", {"title": "Same"}, T),
    ])
    assert got == {("p", "title"): 3, ("p", "abstract"): 3, ("p", "doi"): 2, ("p", "pub_date"): 2, ("r", "title"): 9, ("s", "title"): 11}


def test_cut_without_mark_is_told_by_the_others(spark):
    got = run(spark, [(1, "pubmed", "p", {"title": "Long-term model of marine prot"}, T), (2, "arxiv", "p", {"title": "Long-term model of marine proteins in sediments"}, T), (3, "arxiv", "p", {"title": "Long-term model of marine proteins in sediments"}, T)])
    assert got == {("p", "title"): 2}


def test_crowded_paper_equals_the_rule(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    full = " ".join(words) + "."
    recs = []
    for i in range(400):
        n = rng.randrange(10, len(full))
        text = rng.choice([full, full.upper(), full[:n] + "...", full[:n].rstrip(".") + " [truncated]", "See PDF", ""])
        recs.append((i, rng.choice(list(TRUST)), "hot", {"title": "T", "abstractText" if False else "abstract": text}, T + dt.timedelta(minutes=rng.randrange(50))))
    recs = [(i, "pubmed" if s == "europepmc" else s, p, j, t) for i, s, p, j, t in recs]
    ok = [r for r in recs if r[3]["abstract"].lower() == full]
    best = min(ok, key=lambda r: (-TRUST[r[1]], -r[4].timestamp(), r[0]))
    first = min(recs, key=lambda r: (-TRUST[r[1]], -r[4].timestamp(), r[0]))
    assert run(spark, recs) == {("hot", "abstract"): best[0], ("hot", "title"): first[0]}


def test_crowded_papers_vote_as_the_others_do(spark, monkeypatch):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(9)]
    recs = []
    for i in range(240):
        title = " ".join(rng.choice([w, w, w, f"x{rng.randrange(4)}"]) for w in words[: rng.randrange(5, 10)])
        recs.append((i, rng.choice(list(TRUST)), f"p{i % 2}", {"title": title, "abstract": title[:30] + rng.choice([".", "...", ""])}, T + dt.timedelta(minutes=rng.randrange(50))))
    df = spark.createDataFrame([(i, s, "x", p, json.dumps(j), t, T) for i, s, p, j, t in recs], REC)
    pri = spark.createDataFrame([(s, f, v) for s, v in TRUST.items() for f in S.FIELDS], PRI)
    crowded = sorted(map(tuple, S.survivors(df, pri).collect()))
    monkeypatch.setattr(S, "CHUNK", 1000)
    assert crowded == sorted(map(tuple, S.survivors(df, pri).collect())) and len(crowded) == 4


def test_empty(spark):
    assert run(spark, []) == {}


tokens = st.lists(st.sampled_from("abcdef"), min_size=1, max_size=8)


@settings(max_examples=150, deadline=None)
@given(st.lists(tokens, min_size=1, max_size=6))
def test_alignment_keeps_every_value(values):
    columns = [{t: 1.0} for t in values[0]]
    for v in values[1:]:
        columns = S.align(columns, v, 1.0)
    assert sum(sum(c.values()) for c in columns) == sum(map(len, values))
    for v in values:  # each value's tokens stand in some columns, in order
        at = -1
        for t in v:
            at = next(i for i in range(at + 1, len(columns)) if t in columns[i])


@settings(max_examples=100, deadline=None)
@given(tokens, st.integers(1, 7))
def test_consensus_of_prefixes_is_the_whole(full, n):
    cut = full[: min(n, len(full))]
    assert S.consensus([(full, 1.0, False), (cut, 5.0, True)]) == full
    assert S.stops_short(cut, full) == (len(cut) < len(full))


@pytest.mark.parametrize(("value", "cut"), [("Done.", False), ("Done.</p>", False), ("Done (p < 0.05).", False), ("Not do", True), ("Done. …(more)", True), ("Done. [...]", True), ("Done...", True), ("So “said” he.”", False)])
def test_marks(spark, value, cut):
    from pyspark.sql import functions as F

    assert spark.range(1).select(S.marked_cut(F.lit("abstract"), S._plain(F.lit(value))).alias("x")).first().x is cut


def test_a_frequent_last_word_does_not_carry_a_cut_value_to_the_end():
    top = "the law of the sea and the ships of the north".split()
    assert S._ends(top, "a law of the".split()) == 4 and S._ends(top, "the law of".split()) == 3 and S._ends(top, "ships of the north".split()) == 11


def test_consensus_finds_planted_cuts_that_nothing_marks(spark):
    """Titles cut in the middle, without a mark, in the most trusted source: of 40 all are told by the others."""
    words = "deep marine sediment records of the early holocene in three northern basins and their shelves".split()
    rows, cut = [], set()
    for p in range(60):
        full = " ".join(words[p % 5 :] + [f"site {p}"])
        for r, source in enumerate(("openalex", "europepmc", "pubmed", "arxiv")):
            short = source == "openalex" and p < 40
            title = " ".join(full.split()[: 4 + p % 6]) if short else full
            if short:
                cut.add(p * 10 + r)
            rows.append((p * 10 + r, source, f"s{p}", f"p{p}", '{"title": "%s"}' % title, None, None))
    records = spark.createDataFrame(rows, "record_id bigint, source_key string, source_id string, paper_id string, payload string, fetched_at timestamp, stored_at timestamp")
    priority = spark.createDataFrame([("openalex", "title", 9), ("europepmc", "title", 5), ("pubmed", "title", 4), ("arxiv", "title", 1)], "source_key string, field_name string, priority int")
    got = {r.record_id for r in S.survivors(records, priority).where("field_name = 'title'").collect()}
    assert not got & cut and got == {p * 10 + (1 if p < 40 else 0) for p in range(60)}
