import random

import pytest

from bibliome.llm import names as N


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("Mebijuner PT", ("mebijuner", "", "pt")), ("Mebijuner P T", ("mebijuner", "", "pt")), ("Mebijuner PT.", ("mebijuner", "", "pt")), ("Philippa T Mebijuner", ("mebijuner", "philippa", "pt")), ("P. T. Mebijuner", ("mebijuner", "", "pt")),
        ("Mebijuner, Philippa T", ("mebijuner", "philippa", "pt")), ("Dr Anna von Bb", ("vonbb", "anna", "a")), ("van der Bb Anna", ("vanderbb", "anna", "a")), ("al-Vejo KB", ("alvejo", "", "kb")), ("AL-VEJO KB", ("alvejo", "", "kb")),
        ("Quir. Dedaviros", ("dedaviros", "quir", "q")), ("Nisunégren J", ("nisunegren", "", "j")), ("Aa-Bb Cc D", ("aabbcc", "", "d")), ("Solo", ("solo", "", "")),
    ],
)
def test_readings(name, want):
    assert N.readings(name)[0] == want


def test_ambiguous_and_empty():
    assert [r[0] for r in N.readings("Alexander Paharabek")] == ["paharabek", "alexander"]
    assert N.readings("") == N.readings("...") == N.readings("Dr") == []


def test_segment_join_equals_brute_force(spark):
    rng = random.Random(2)
    base = ["".join(rng.choices("abcde", k=rng.randrange(5, 9))) for _ in range(60)]
    bent = []
    for w in base:
        i = rng.randrange(len(w))
        bent.append(rng.choice([w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + "y" + w[i + 1 :], w[: i - 1] + w[i : i + 1] + w[i - 1 : i] + w[i + 1 :] if i else w]))
    left = [(rng.choice("gh"), w) for w in bent + base[:10]]
    right = [(rng.choice("gh"), w) for w in base]
    df = lambda rows: spark.createDataFrame(rows, "grp string, word string")
    got = {tuple(r) for r in N.segment_join(df(left), df(right), "grp", "word").collect()}
    want = {(g, a, b) for g, a in left for h, b in right if g == h and a != b and len(a) >= 5 and N.slip(a, b)}
    assert want and want <= got
    assert all(len(set(a) ^ set(b)) <= 2 and abs(len(a) - len(b)) <= 1 for _, a, b in got)


def test_slip():
    assert N.slip("abcd", "abdc") and N.slip("abcd", "abc") and N.slip("abcd", "abcde") and N.slip("abcd", "axcd") and N.slip("a", "a")
    assert not N.slip("abcd", "badc") and not N.slip("abcd", "ab")


ART = "article_id bigint, author_string string, payload string, name string, class int"
NOT = "notice_id bigint, subject string, reason string, author string, institution string, kind string"


def linked(spark, strings, authors, orgs, payloads=()):
    a = spark.createDataFrame([(i, s, payloads[i] if i < len(payloads) else None, "x", 1) for i, s in enumerate(strings)] or [], ART)
    n = spark.createDataFrame([(i, None, None, x, y, "k") for i, (x, y) in enumerate([*[(v, None) for v in authors], *[(None, v) for v in orgs]])] or [], NOT)
    return {tuple(r) for r in N.variant_names(a, n).collect()}


def test_people(spark):
    got = linked(spark, ["Jorasomar R, Bofoloholt FB.", "JORASOMAR R, Jorasomar K.", None, "Jorasomar R, Bofolohotl F", "Paharabek AM, Paharabek A"], ["Robert Jorasomar;Bob Jorasomar;Jorasomar, Robert", "Paharabek Alexander", "Robert P Bofoloholt", "Alexander Q Xx;Katherine Jorasomar"], [])
    people = {(a, b) for _, a, b in got}
    r = ["Bob Jorasomar", "JORASOMAR R", "Jorasomar R", "Jorasomar, Robert", "Robert Jorasomar"]
    assert {(a, b) for i, a in enumerate(sorted(r)) for b in sorted(r)[i + 1 :]} <= people
    assert ("Jorasomar K", "Katherine Jorasomar") in people and not any({a, b} & {"Jorasomar K"} and {a, b} & set(r) for a, b in people)
    assert {("Paharabek A", "Paharabek AM"), ("Paharabek A", "Paharabek Alexander"), ("Paharabek AM", "Paharabek Alexander")} <= people
    assert not any("Robert P Bofoloholt" in p for p in people)


def test_payload_tells_what_was_mistyped(spark):
    p = '{"authorList": {"author": [{"fullName": "Bofolohotl F", "firstName": "Fred", "lastName": "Bofoloholt"}, {"fullName": "Bofoloholt F", "firstName": "Fred", "lastName": "Bofoloholt"}, {"collectiveName": "The Group"}]}}'
    assert ("person", "Bofoloholt F", "Bofolohotl F") in linked(spark, [None], [], [], [p])


def test_organisations(spark):
    places = [f"Town{c}ville" for c in "abcdefgh"]
    base = [x for p in places for x in (f"University of {p}, {p}, Norway", f"{p} General Hospital, {p}, Chile", f"{p} Institute of Marine Biology, {p}, Norway", f"Dept. of Physics, Univ {p}, {p}, Chile", f"General Hospital {p}, {p}, Chile")]
    p = places[0]
    more = [f"Univ. of {p}", f"Universidad de {p}", f"Unviersity of {p}, Norway", f"Hospital General de {p}", f"{p} Gen. Hosp.", f"Institute of Marine Biology ({p})", "University of Twonaville", "Nowhere at all"]
    got = {(a, b) for k, a, b in linked(spark, [], [], base + more) if k == "organisation"}
    same = lambda a, b: (min(a, b), max(a, b)) in got
    u = f"University of {p}, {p}, Norway"
    assert same(u, f"Univ. of {p}") and same(u, f"Universidad de {p}") and same(u, f"Unviersity of {p}, Norway") and same(u, f"Dept. of Physics, Univ {p}, {p}, Chile") and same(u, "University of Twonaville")
    h = f"{p} General Hospital, {p}, Chile"
    assert same(h, f"Hospital General de {p}") and same(h, f"{p} Gen. Hosp.") and same(h, f"General Hospital {p}, {p}, Chile") and not same(h, u)
    assert same(f"{p} Institute of Marine Biology, {p}, Norway", f"Institute of Marine Biology ({p})") and not any("Nowhere at all" in x for x in got)
    assert not same(u, f"University of {places[1]}, {places[1]}, Norway")


def test_nothing(spark):
    assert linked(spark, [], [], []) == set() and linked(spark, [None, ""], [None], [None, ";"]) == set()


@pytest.mark.parametrize(("a", "b"), [("chen", "chn"), ("chen", "chan"), ("chen", "cehn"), ("chen", "hcen"), ("chen", "chne"), ("roux", "rouxs"), ("lee", "lea"), ("martinez", "matrinez"), ("martinez", "martniez"), ("wang", "awang")])
def test_one_slip_shares_a_segment(a, b):
    assert N.probes(a) & set(N.segments(b)) and N.probes(b) & set(N.segments(a))


def test_short_names_are_compared(spark):
    known = spark.createDataFrame([("x", k) for k in ("chen", "wang", "roux", "li")], "g string, k string")
    asked = spark.createDataFrame([("x", k) for k in ("chne", "wagn", "rouxx", "lli", "ng")], "g string, k string")
    assert {(r.k, r.known) for r in N.segment_join(asked, known, "g", "k").collect()} == {("chne", "chen"), ("wagn", "wang"), ("rouxx", "roux")}


def test_a_town_that_ends_the_address_is_no_country(spark):
    towns = [f"Town{c}ia" for c in "abcdefgh"]
    names = [f"Institute of Physics, {t}, Norland" for t in towns] + [f"{h} of Physics, Kelburg" for h in ("Institute", "Inst", "Instituto", "Institut", "Inst.")] + ["Institute of Physics, Kelburg, Norland"]
    g = N.gazetteer(spark.createDataFrame([(n,) for n in names], "name string"))
    assert g.countries == frozenset({"norland"})
    assert {N.institution(n, g)[2] for n in names if "Kelburg" in n} == {"kelburg"}
    assert N.institution("Institute of Physics, Norland", g)[2] == "norland"


def classes_of(spark, names):
    return {r.name: r["class"] for r in N.organisation_classes(spark.createDataFrame([(n, 1) for n in names], "name string, n bigint")).collect()}


def test_a_slip_of_a_slip_is_followed_to_the_town(spark):
    names = ["University of Kelburgton, Kelburgton, Norland", "Univ Kelburgton, Kelburgton, Norland", "University of Kelburgtan", "Univ. of Kelburgtan", "University of Kelpurgtan", "University of Morvale"]
    got = classes_of(spark, names)
    assert len({got[n] for n in names[:5]}) == 1 and got[names[5]] != got[names[0]] and got[names[0]].endswith("|kelburgton")


def test_steps_are_followed_to_their_end(spark):
    moved = [("g", "a", "b"), ("g", "b", "c"), ("h", "b", "x"), ("h", "c", "a"), ("k", "p", "q"), ("k", "q", "p"), ("k", "r", "q"), (None, "n", "m")]
    df = lambda rows: spark.createDataFrame(rows, "grp string, word string, target string")
    want = {("g", "a", "c"), ("g", "b", "c"), ("h", "b", "x"), ("h", "c", "a"), ("k", "p", "p"), ("k", "q", "p"), ("k", "r", "p")}
    assert {tuple(r) for r in N.followed(df(moved[:-1]), "grp", "word").collect()} == want
    assert {tuple(r) for r in N.followed(df(moved[:1]), "grp", "word").collect()} == set(moved[:1])


def test_a_frequent_slip_of_a_kind_of_institution_is_read(spark):
    towns = [f"Town{c}ville" for c in "abcdefgh"]
    names = [f"{t} {h} of Physics, {t}, Norland" for t in towns for h in ("Institute", "Instiute")] + [f"Institute of Physics {t}, {t}, Norland" for t in towns]
    got = classes_of(spark, names)
    assert len(got) == len(names) and len(set(got.values())) == len(towns)
    assert all(got[f"{t} Institute of Physics, {t}, Norland"] == got[f"{t} Instiute of Physics, {t}, Norland"] for t in towns)


def test_a_town_in_many_short_names_is_no_kind_of_institution(spark):
    towns = [f"Town{c}ville" for c in "abcdefgh"]
    names = [f"{h}, {t}, Norland" for t in towns for h in (f"University of {t}", f"{t} General Hospital", f"{t} Institute of Marine Biology")]
    more = ["Univ Kelburg", "Kelburg University", "Universidad de Kelburg", "U of Kelburg", "University of Kelburg, Norland", "University of Kelburg, Kelburg, Norland"]
    got = classes_of(spark, names + more)
    assert len({got[n] for n in more}) == 1


def test_names_without_any_place_meet_by_their_words(spark):
    towns = [f"Town{c}ville" for c in "abcdefgh"]
    names = [f"{t} Institute of Marine Biology, {t}, Norland" for t in towns]
    more = ["Institute of Marine Biology", "Inst. of Mar. Biol.", "Institute for Marine Biology"]
    got = classes_of(spark, [*names, *more, "University", "Univ.", "University Hospital"])
    assert len({got[n] for n in more}) == 1 and not {got[n] for n in more} & {got[n] for n in names}
    assert not {"University", "Univ.", "University Hospital"} & got.keys()
