import pytest

from bibliome.llm import mojibake as M

SOUND = [
    "As lições NÃO SÃO equivalentes às crianças", "Il s’agit d’évaluer l’effet des forêts", "Für Flüsse zeigte sich ein größerer Einfluss der Bäume", "Kết quả cho thấy bệnh nhân", "结果表明，患者与植物之间存在关联。",
    "Исследование образцов проводилось", "On κ-nipekudone at Ãlvar-type resolution", "A “Âme” of São Verano – naïve", "at ™-marked sites in Dvořice", "Łomnik hills, Çorvak plain, Île-Morvenne, Zürlach, Vådsund", "±5 °C and 3 µg ≤ 4", "ÂM TÍNH: không tìm thấy", "plain ASCII &amp; nothing",
]
DAMAGED = ["La fiabilité des données reste à démontrer", "Die Bäume wurden über 9 Jahre untersucht", "Полученные данные требуют проверки", "结果表明，样本与植物之间存在关联", "α-wagaros – a trial in Zürlach", "“Spatial” models at Dvořice"]


def garble(text, chain):
    out = []
    for b in text.encode("utf-8"):
        try:
            out.append(bytes([b]).decode(chain))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(i, "S", t, None, "x") for i, t in enumerate(SOUND * 8)]
    bad = {}
    for chain in ("cp1252", "cp1250", "mac_roman", "cp437", "cp1251"):
        for t in DAMAGED:
            bad[1000 + len(bad)] = (garble(t, chain), t)
    bad[2000] = (garble(garble(DAMAGED[0], "cp1252"), "cp1252"), DAMAGED[0])
    bad[2001] = ("".join(f"&#{ord(c)};" if ord(c) > 127 else c for c in garble(DAMAGED[1], "cp1252")), DAMAGED[1])
    bad[2002] = ("in Z�rlach", None)
    bad[2003] = (SOUND[0] + " " + garble("é já às", "cp1252"), SOUND[0] + " é já às")
    rows += [(i, None if i % 2 else "S", None, t, "x") for i, (t, _) in bad.items()] + [(1, "S", t, "", "x") for t in SOUND[:1]]
    df = spark.createDataFrame(rows, "preprint_id bigint, src string, title string, abstract_text string, chain string")
    found = {(r.id, r.field) for r in M.damaged_texts(df, "preprint_id", "src", ("title", "abstract_text")).collect()}
    fixed = {r.id: r.restored for r in M.repaired_texts(df, "preprint_id", "src", ("title", "abstract_text")).collect()}
    return found, fixed, bad


def test_found(judged):
    found, _, bad = judged
    assert {i for i, f in found} == set(bad) and all(f == "abstract_text" for _, f in found)


def test_restored(judged):
    _, fixed, bad = judged
    wrong = {i: (bad[i][0], fixed.get(i), bad[i][1]) for i in bad if fixed.get(i) != bad[i][1]}
    assert len(wrong) <= 2, wrong  # cp1250 shares most runs with cp1252 and may read one letter the other way


def test_empty(spark):
    df = spark.createDataFrame([], "preprint_id bigint, src string, title string")
    assert M.damaged_texts(df, "preprint_id", "src", ("title",)).count() == 0


def test_runs_and_entities():
    assert M.runs_of("Ã©")["cp1252"] == {("Ã©", "é"): 1} and M.runs_of("NÃO") == {} and M.runs_of("abc") == {}
    assert M.unescaped("&#195;&#169; &#38; &#xC3;") == "Ã© &#38; Ã"


def test_gbk_runs_are_cut_to_characters():
    text = "données très étudiées à Zürlach"
    bad = "é à ü".encode().decode("gbk", "replace")
    run = "éàüé".encode().decode("gbk")
    assert M.units("gbk", run, "éàüé") == [(run[0], "é"), (run[1], "à"), (run[2], "ü"), (run[0], "é")] and bad
    long = "études".replace("tudes", "é" * 400)
    assert set(M.runs_of(long.encode().decode("gbk"))["gbk"]) == {(run[0], "é")} and text


def test_as_many_layers_as_there_are():
    text, deep = "Bäume größerer Flüsse", "Bäume größerer Flüsse"
    for _ in range(5):
        deep = garble(deep, "cp1252")
    model = M.Model({c: 50.0 for c in "äöüß"}, {}, {("", ""): {M.CLEAN: 0.5} | {c: 0.5 / len(M.CHAINS) for c in M.CHAINS}})
    chains, plain = model.repair("S", "t", deep)
    assert plain == text and len(chains.split("+")) == 5
