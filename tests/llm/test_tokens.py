import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bibliome.llm import packing as P
from bibliome.llm.tokens import TOKENIZERS, Automaton, automaton, decoded, encoded

FILE = f"{TOKENIZERS}/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(FILE), reason="no tokenizer files")


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return t


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text(public, text):
    a = automaton(FILE)
    ids = a.encode(text)
    assert ids == public.encode(text, add_special_tokens=False).ids and a.decode(ids) == text


@pytest.mark.parametrize("text", ["<|endoftext|>", "a" * 5000, " " * 300, "aaaa aa\n\n\n x", "don't we'll I'M", "​﻿ﬁ", "🧪🧬🔬 👩‍🔬", "a\x00b", "结果表明" * 500, "ＦＵＬＬ　ＷＩＤＴＨ", "x" * 3 + "é" * 2000])
def test_odd_texts(public, text):
    assert automaton(FILE).encode(text) == public.encode(text, add_special_tokens=False).ids


def merge_by_rank(word, merges):
    parts = [bytes([b]) for b in word]
    rank = {m: i for i, m in enumerate(merges)}
    while True:
        best = min(((rank[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in rank), default=None)
        if best is None:
            return parts
        pair = merges[best[0]]
        out, i = [], 0
        while i < len(parts):
            if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                out.append(parts[i] + parts[i + 1])
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_automaton_of_random_merges(data):
    pieces, merges = [b"a", b"b", b"c"], []
    for _ in range(data.draw(st.integers(0, 10))):
        m = (data.draw(st.sampled_from(pieces)), data.draw(st.sampled_from(pieces)))
        if m[0] + m[1] not in pieces:
            merges.append(m)
            pieces.append(m[0] + m[1])
    a = Automaton({p: i for i, p in enumerate(pieces)}, merges)
    word = data.draw(st.text("abc", min_size=1, max_size=14)).encode()
    assert [a.bytes_of[i] for i in a.encode_bytes(word)] == merge_by_rank(word, merges)


def test_frames(spark, public):
    texts = [None, "", " ", "Levels of κ rose.", "<|endoftext|>"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, ids int")
    ids = encoded(df, "doc_id", "text")
    got = {r.id: r.ids for r in ids.collect()}
    assert got == {i: public.encode(t, add_special_tokens=False).ids if t else [] for i, t in enumerate(texts)}
    assert {r.id: r.text for r in decoded(ids, "id", "ids").collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert encoded(df.limit(0), "doc_id", "text").count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=0, max_size=40))
def test_fill_keeps_every_item_once(sizes):
    from collections import Counter

    boxes = P.fill(sizes, [Counter({f"w{s % 5}": 1, "x": 1}) for s in sizes], {"x": 0.1}, 1.0, 2.0, 50)
    assert sorted(i for b in boxes for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 50 for b in boxes)
    assert len(boxes) <= 2 * max(1, -(-sum(sizes) // 50))


def test_neighbours_share_a_box():
    from collections import Counter

    terms = [Counter(sea=2, fish=1), Counter(law=2, court=1), Counter(sea=1, fish=2), Counter(law=1, court=2)]
    assert [sorted(b) for b in P.fill([5, 5, 5, 5], terms, {}, 1.0, 3.0, 10)] == [[0, 2], [1, 3]]


def test_packed(spark):
    text = "marine samples and proteins in sediments "
    rows = [(i, text * (i % 13)) for i in range(200)] + [(500, text * 900), (501, None), (502, ""), (503, "same"), (503, "same")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = P.packed(df, "doc_id", "text", capacity=256).collect()
    n = {r.id: len(r.ids) for r in encoded(df.where("doc_id <> 503"), "doc_id", "text").collect()}
    used, spans = {}, {}
    for r in out:
        used[r.container] = used.get(r.container, 0) + r.last_token - r.first_token
        spans.setdefault(r.doc_id, []).append((r.first_token, r.last_token))
    assert max(used.values()) <= 256 and len({(r.container, r.place) for r in out}) == len(out)
    for i, total in n.items():
        s = sorted(spans[i])
        assert s[0][0] == 0 and s[-1][1] == total and all(a[1] == b[0] for a, b in zip(s, s[1:], strict=False)) and (len(s) == 1 or total > 256)
    assert len(spans[503]) == 2
    assert sum(used.values()) / (len(used) * 256) > 0.95
    assert P.packed(df.limit(0), "doc_id", "text").count() == 0
