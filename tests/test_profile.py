import pytest

from bibliome.functions.embedding import HashedWords
from bibliome.plans import profile as P


def test_build_and_issues():
    d = P.Draft(texts=(("Deep Sea", "low"), ("deep  sea", "high"), ("", "low"), ("Law", "odd")), unwanted=("LAW", "Tax"), fields=("medicine", "alchemy"), papers=(1, 2), freshness="never")
    b = P.build(d, HashedWords(16), {1: [1.0, 0.0]})
    keys = {i.key: i for i in b.profile.interests}
    assert set(keys) == {"text-deep-sea", "text-law", "not-tax", "paper-1"} and keys["text-deep-sea"].weight == 2.0 and keys["not-tax"].negative and keys["paper-1"].horizon == "short"
    assert set(b.issues) == {"empty interest", "unknown importance: odd", "wanted and unwanted: LAW", "unknown field: alchemy", "unknown freshness: never", "no vector for paper 2"}
    assert P.summary(b.profile) == {"interests": ["text-deep-sea", "text-law"], "current": ["paper-1"], "unwanted": ["not-tax"], "fields": ["medicine"], "blocked": []}


def test_refine():
    d = P.refined(P.Draft(), [("add", "a"), ("add", "b"), ("raise", "a"), ("raise", "a"), ("unwant", "b"), ("block", "T1"), ("freshness", "newest"), ("field", "medicine"), ("lower", "zz")])
    assert d.texts == (("a", "high"),) and d.unwanted == ("b",) and d.blocked_topics == ("T1",) and d.freshness == "newest" and d.fields == ("medicine",)
    with pytest.raises(ValueError):
        P.refined(d, [("fly", "a")])
    assert "nothing to go by" in P.build(P.Draft(), HashedWords(8)).issues
