import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bibliome.operators.shred import CHILDREN, PAYLOAD, Shredder, child_tables, places, read_record, rebuild

REC = {
    "authorList": {"author": [{"fullName": "A B", "authorAffiliationDetailsList": {"authorAffiliation": [{"affiliation": "x"}, None, "y"]}}, None, {"collectiveName": "The C"}]},
    "authorIdList": {"authorId": {"type": "ORCID", "value": "1"}},
    "journalInfo": {"issue": "2", "journal": {"title": "J"}},
    "fullTextUrlList": [{"url": "u"}, {}],
}


def children(rec):
    s = Shredder(PAYLOAD)
    s.write(rec)
    return {(label, int(p), int(q)) for label in CHILDREN for t in [rebuild(s, label)] for p, q in zip(t["pos"], t["sub_pos"], strict=True)}


def test_places_and_null_members():
    assert children(REC) == {
        ("author", 1, 0), ("author", 3, 0), ("affiliation", 1, 1), ("affiliation", 1, 3), ("author_id", 1, 0), ("journal_info", 1, 0), ("full_text_url", 1, 0), ("full_text_url", 2, 0),
    }


@pytest.mark.parametrize("wrap", [lambda r: r, lambda r: [r], lambda r: {"result": r}, lambda r: {"hitCount": 1, "resultList": {"result": [r]}}, lambda r: json.dumps(r), lambda r: json.dumps([r])])
def test_envelopes(wrap):
    assert read_record("\ufeff" + json.dumps(wrap(REC))) == REC


@pytest.mark.parametrize("bad", [None, "", "{", '"x"', "3", "[]", "null", "{'a': 1}"])
def test_unreadable(bad):
    assert not read_record(bad)


@pytest.mark.parametrize("empty", [None, "", {}, [], {"author": []}, {"author": None}])
def test_empty_lists(empty):
    assert children({"authorList": empty, "journalInfo": {} if empty == {} else None}) == set()


leaf = st.one_of(st.none(), st.text(max_size=3))
aff = st.one_of(st.none(), st.text(min_size=1, max_size=3), st.fixed_dictionaries({}, optional={"affiliation": leaf}))
author = st.one_of(st.none(), st.fixed_dictionaries({"fullName": leaf}, optional={"authorAffiliationDetailsList": st.one_of(st.none(), st.fixed_dictionaries({"authorAffiliation": st.lists(aff, max_size=4)}))}))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(author, max_size=4), max_size=5))
def test_levels_rebuild_any_nesting(batch):
    s = Shredder(PAYLOAD)
    for authors in batch:
        s.write({"authorList": {"author": authors}})
    a, f = rebuild(s, "author"), rebuild(s, "affiliation")
    assert [(int(r), int(p), n) for r, p, n in zip(a["record"], a["pos"], a["fullName"], strict=True)] == [(r, i, x.get("fullName")) for r, xs in enumerate(batch) for i, x in enumerate(xs, 1) if x is not None]
    want = [
        (r, i, k, v if isinstance(v, str) else v.get("affiliation"))
        for r, xs in enumerate(batch) for i, x in enumerate(xs, 1) if x is not None for k, v in enumerate((x.get("authorAffiliationDetailsList") or {}).get("authorAffiliation") or [], 1) if v is not None
    ]
    assert [(int(r), int(p), int(q), v) for r, p, q, v in zip(f["record"], f["pos"], f["sub_pos"], f["affiliation"], strict=True)] == want


def test_levels_of_one_column():
    s = Shredder(PAYLOAD)
    s.write(REC)
    record, first, second, _, index = places(s.columns["authorList.authorAffiliationDetailsList.affiliation"])
    assert list(zip(first.tolist(), second.tolist(), strict=True)) == [(1, 1), (1, 2), (1, 3), (2, 0), (3, 0)]
    assert record.tolist() == [0] * 5 and index.tolist() == [0, -1, 1, -1, -1]


def test_table_with_clashing_columns(spark, rows):
    df = spark.createDataFrame([(1, json.dumps(REC), "x"), (2, None, "y"), (3, "{broken", "z"), (1, json.dumps(REC), "x")], "article_id bigint, payload string, child string")
    out = child_tables(df, "article_id", "payload", ("author",)).select("parent_id", "child", "pos", "full_name", "collective_name")
    assert rows(out) == sorted([(1, "author", 1, "A B", None), (1, "author", 3, None, "The C")] * 2, key=repr)
    assert child_tables(df.limit(0), "article_id", "payload", CHILDREN).count() == 0
