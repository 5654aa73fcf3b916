import pytest

from bibliome.operators.unpack import KNOWN, NAMES, NOTICE_POLICY, QUOTED, notice_values, packed_values

CASES = [
    ("author", "A B;C D;", ["A B", "C D"]),
    ("author", ";A B;;C D", ["A B", "C D"]),
    ("author", "A B | C D // E F", ["A B", "C D", "E F"]),
    ("author", "//A B // C D", ["A B", "C D"]),
    ("author", "A B\r\nC D\tE F；G H", ["A B", "C D", "E F", "G H"]),
    ("author", "• A B • C D", ["A B", "C D"]),
    ("author", "(1) A B; (2) C D", ["A B", "C D"]),
    ("author", "A Bb, C Dd and E Ff", ["A Bb", "C Dd", "E Ff"]),
    ("author", "A Bb & C Dd", ["A Bb", "C Dd"]),
    ("author", "Bb, Anna", ["Bb, Anna"]),
    ("author", "van der Bb, Anna C", ["van der Bb, Anna C"]),
    ("author", "Anna Bb,Carl Dd", ["Anna Bb", "Carl Dd"]),
    ("author", "Bb, Anna;Dd, Carl", ["Bb, Anna", "Dd, Carl"]),
    ("author", '\u00a0 "A B" ;  C D ', ["A B", "C D"]),
    ("reason", 'X;"Disputed ""Pilot"" Sample";Y', ["X", 'Disputed "Pilot" Sample', "Y"]),
    ("reason", '"P; Q";R', ["P; Q", "R"]),
    ("reason", r"P\; Q;R", ["P; Q", "R"]),
    ("reason", '["X", "Disputed \\"Pilot\\" Sample"]', ["X", 'Disputed "Pilot" Sample']),
    ("reason", 'The "odd" one;R', ['The "odd" one', "R"]),
    ("reason", '5" wide;R', ['5" wide', "R"]),
    ("institution", "Inst X, Town, Land", ["Inst X, Town, Land"]),
    ("institution", '"Inst X, Town, Land", "Univ Y"', ["Inst X, Town, Land", "Univ Y"]),
    ("institution", "School of Law and Arts, Univ Y", ["School of Law and Arts, Univ Y"]),
    ("institution", '(2) Group', ["(2) Group"]),
    ("institution", None, []),
    ("institution", " \u00a0", []),
    ("institution", ";", []),
    ("institution", '""', []),
]


@pytest.fixture(scope="module")
def unpacked(spark):
    df = spark.createDataFrame([(i, f, c) for i, (f, c, _) in enumerate(CASES)], "row_id bigint, field_name string, cell string")
    out = {}
    for r in packed_values(df, policy=NOTICE_POLICY).collect():
        out.setdefault(r.row_id, {})[r.pos] = r.item
    return out


@pytest.mark.parametrize("i", range(len(CASES)), ids=[repr(c[1]) for c in CASES])
def test_cell(unpacked, i):
    found = unpacked.get(i, {})
    assert [found[p] for p in sorted(found)] == CASES[i][2]
    assert sorted(found) == list(range(1, len(found) + 1))


def test_known_values_decide_about_commas(spark):
    cells = ["Withdrawn, No Detail;Unclear", "Withdrawn, No Detail", "Unclear, Late", "Late;Unclear", "Odd, Thing"]
    df = spark.createDataFrame([(i, "reason", c) for i, c in enumerate(cells)], "row_id bigint, field_name string, cell string")
    found = {}
    for r in packed_values(df, policy={"reason": KNOWN}).orderBy("row_id", "pos").collect():
        found.setdefault(r.row_id, []).append(r.item)
    assert found == {0: ["Withdrawn, No Detail", "Unclear"], 1: ["Withdrawn, No Detail"], 2: ["Unclear", "Late"], 3: ["Late", "Unclear"], 4: ["Odd, Thing"]}


def test_round_trip_of_quoted_values(spark):
    values = ["a;b", 'say "x"', "c|d", "plain", "e, f", "tab\tin"]
    cell = ";".join('"' + v.replace('"', '""') + '"' for v in values)
    df = spark.createDataFrame([(1, "institution", cell)], "row_id bigint, field_name string, cell string")
    assert [r.item for r in packed_values(df, policy={"institution": QUOTED}).orderBy("pos").collect()] == values


def test_long_repeated_and_empty(spark):
    long = ";".join(f"Name {i} Xx" for i in range(3000))
    df = spark.createDataFrame([(1, "author", long), (2, "author", "A B;A B")], "row_id bigint, field_name string, cell string")
    out = packed_values(df, policy={"author": NAMES})
    assert out.where("row_id = 1").count() == 3000
    assert [r.item for r in out.where("row_id = 2").collect()] == ["A B", "A B"]
    assert packed_values(df.limit(0), policy={"author": NAMES}).count() == 0


def test_clashing_columns_are_left_alone(spark):
    df = spark.createDataFrame([(7, "s", None, "A B", "I", "x", 3)], "notice_id bigint, subject string, reason string, author string, institution string, item string, pos int")
    assert {tuple(r) for r in notice_values(df).collect()} == {(7, "subject", 1, "s"), (7, "author", 1, "A B"), (7, "institution", 1, "I")}
