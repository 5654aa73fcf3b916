"""Text that was decoded with the wrong character encoding: found and, where nothing was lost, restored.

Bytes of UTF-8 read as some other encoding turn every character into a run of two to four telltale characters. Whether a run is
damage or merely looks like it is a latent question: per source and field an encoding chain is estimated by expectation-
maximisation, pooling how often each run stands in sound text and how plausible the character is that it would decode to. A text
is repaired by the chain of greatest posterior, layer by layer where it was damaged more than once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibliome.session import cut_lineage

#: Encodings that UTF-8 bytes may have been read as. Bytes a code page leaves open pass as control characters.
CHAINS = ("cp1252", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "koi8_r", "gbk")
CLEAN, LOSSY = "clean", "lossy"
#: Share of the runs of a damaged text that are damage.
_RHO = 0.9
#: Estimation goes on until no prior moves by more than this, or for so many rounds.
_STILL, _ROUNDS = 1e-4, 25
#: A chain's least prior; rarer ones would never be believed on the evidence of one run.
_FLOOR = 0.003
_ENTITY = re.compile(r"&#(\d{2,7}|x[0-9a-fA-F]{2,6});")
#: The first byte of a character whose second one was lost to a blank.
_ORPHAN = re.compile(r"(?<=[^\d\s]\s)[ÃÅÄÎÏÐÑ] (?=[a-z])")


@lru_cache(maxsize=None)
def _bytes_of(chain: str) -> dict[str, int]:
    out = {}
    for b in range(128, 256):
        out[bytes([b]).decode("latin-1")] = b if b < 160 and chain in ("cp1252", "cp1250", "cp1251") else None
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(chain)] = b
        except UnicodeDecodeError:
            pass
    return {c: b for c, b in out.items() if b is not None}


@lru_cache(maxsize=None)
def _pattern(chain: str) -> re.Pattern:
    """Runs that this encoding may have made of one character."""
    if chain == "gbk":
        return re.compile("[一-鿿-]+[�]?")
    of = _bytes_of(chain)

    def group(lo: int, hi: int) -> str:
        return "[" + "".join(re.escape(c) for c, b in of.items() if lo <= b <= hi) + "]"

    tail = group(0x80, 0xBF)
    return re.compile(f"{group(0xC2, 0xDF)}{tail}|{group(0xE0, 0xEF)}{tail}{tail}|{group(0xF0, 0xF4)}{tail}{tail}{tail}")


def _decode(chain: str, run: str) -> str | None:
    try:
        if chain == "gbk":
            return run.rstrip("�").encode("gbk").decode("utf-8")
        of = _bytes_of(chain)
        return bytes(of[c] for c in run).decode("utf-8")
    except (UnicodeError, KeyError):
        return None


def unescaped(text: str) -> str:
    """Numeric character references as characters."""
    if "&#" not in text:
        return text

    def char(m: re.Match) -> str:
        n = int(m[1][1:], 16) if m[1][0] == "x" else int(m[1])
        return chr(n) if 127 < n < 0x110000 and not 0xD800 <= n < 0xE000 else m[0]

    return _ENTITY.sub(char, text)


def units(chain: str, run: str, dec: str) -> list[tuple[str, str]]:
    """A run cut wherever a character of it and one of what it decodes to end at the same byte: (part, character it decodes to), so
    that parts are of one or two characters and their number doesn't grow with the length of texts."""
    if chain != "gbk":
        return [(run, dec)]
    out, at, start, here, there = [], 0, 0, 0, 0
    run = run.rstrip("�")
    for n, c in enumerate(dec, 1):
        there += len(c.encode())
        while here < there and at < len(run):
            here += len(run[at].encode("gbk"))
            at += 1
        if here == there:
            out.append((run[start:at], dec[len("".join(d for _, d in out)) : n]))
            start = at
    return out


def runs_of(text: str) -> dict[str, Counter]:
    """Per chain, how often each (run, character it decodes to) occurs."""
    out: dict[str, Counter] = {}
    if text.isascii():
        return out
    for chain in CHAINS:
        found = Counter()
        for m in _pattern(chain).finditer(text):
            dec = _decode(chain, m[0])
            if dec and dec != m[0] and (chain != "gbk" or not all("一" <= c <= "鿿" for c in dec)):
                found.update(units(chain, m[0], dec))
        if found:
            out[chain] = found
    return out


class Model:
    """What EM knows: how often characters stand in sound text, how often runs do, and how likely each chain is by source and field."""

    def __init__(self, chars: dict[str, float], sound: dict[str, float], prior: dict[tuple[str, str], dict[str, float]]) -> None:
        self.chars, self.sound, self.prior = chars, sound, prior

    def gain(self, run: str, dec: str) -> float:
        """Log of how much better the run is explained as damage than as sound text."""
        likely = min(self.chars.get(c, 0.0) for c in dec) + (1.0 if all(c.isalpha() or c in "–—‘’“”…•°±·™≤≥−×" for c in dec) else 0.2)
        raw = self.sound.get(run, 0.0) + 0.05
        return math.log((1 - _RHO) + _RHO * likely / raw)

    def posterior(self, source: str, field: str, evidence: dict[str, list[tuple[str, str, int]]]) -> dict[str, float]:
        prior = self.prior.get((source, field)) or self.prior[("", "")]
        score = {CLEAN: math.log(prior.get(CLEAN, 0.5))}
        for chain, runs in evidence.items():
            score[chain] = math.log(prior.get(chain, 1e-4)) + sum(self.gain(r, d) * min(n, 3) for r, d, n in runs)
        top = max(score.values())
        odds = {c: math.exp(v - top) for c, v in score.items()}
        return {c: v / sum(odds.values()) for c, v in odds.items()}

    def repair(self, source: str, field: str, text: str) -> tuple[str, str]:
        """(chains applied, text), the most probable chain at a time, for as long as one is more probable than none."""
        plain, chains = unescaped(text), []
        while True:  # every layer taken off leaves fewer characters
            evidence = {c: [(r, d, n) for (r, d), n in f.items()] for c, f in runs_of(plain).items()}
            if not evidence:
                break
            post = self.posterior(source, field, evidence)
            chain = max(post, key=post.get)
            if chain == CLEAN:
                break
            good = {r for r, d, _ in evidence[chain] if self.gain(r, d) > 0}

            def mended(m: re.Match) -> str:
                dec = _decode(chain, m[0])  # noqa: B023
                return m[0] if dec is None else "".join(d if r in good else r for r, d in units(chain, m[0], dec))  # noqa: B023

            after = _pattern(chain).sub(mended, plain)
            if after == plain:
                break
            plain = after
            chains.append(chain)
        return "+".join(chains), plain if chains else text


_EVIDENCE = "id bigint, source string, field string, lossy boolean, chain array<string>, run array<string>, dec array<string>, n array<int>"
_STAT = "kind string, source string, field string, key string, weight double"


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, source, field, text -> the evidence of texts that have any."""
    for b in batches:
        rows = []
        for i, source, field, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if text.isascii() and "&#" not in text:
                continue
            plain = unescaped(text)
            found = runs_of(plain)
            lossy = "�" in plain or _ORPHAN.search(plain) is not None
            if found or lossy:
                flat = [(c, r, d, n) for c, f in found.items() for (r, d), n in f.items()]
                rows.append((i, source, field, lossy, *[[x[k] for x in flat] for k in range(4)]))
        if rows:
            kinds = [pa.int64(), pa.string(), pa.string(), pa.bool_(), *[pa.list_(pa.string())] * 3, pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["id", "source", "field", "lossy", "chain", "run", "dec", "n"])


def _char_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts by character beyond ASCII, and by source and field."""
    chars, texts = Counter(), Counter()
    for b in batches:
        for _, source, field, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            texts[(source, field)] += 1
            if text.isascii():
                continue
            chars.update(c for c in set(text) if not c.isascii())
    yield _stats([("char", "", "", c, float(n)) for c, n in chars.items()] + [("texts", s, f, "", float(n)) for (s, f), n in texts.items()])


def _stats(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 4 + [pa.float64()]
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["kind", "source", "field", "key", "weight"])


def _evidence_of(chain: list, run: list, dec: list, n: list) -> dict[str, list[tuple[str, str, int]]]:
    out: dict[str, list[tuple[str, str, int]]] = {}
    for c, r, d, k in zip(chain, run, dec, n, strict=True):
        out.setdefault(c, []).append((r, d, k))
    return out


def _expect(model: Model):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sound, chains = Counter(), Counter()
        for b in batches:
            for _, source, field, _, chain, runs, dec, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not chain:
                    continue
                post = model.posterior(source, field, _evidence_of(chain, runs, dec, n))
                for c, p in post.items():
                    chains[(source, field, c)] += p
                for r in set(runs):
                    sound[r] += post[CLEAN]
        yield _stats([("sound", "", "", r, w) for r, w in sound.items()] + [("chain", s, f, c, w) for (s, f, c), w in chains.items()])

    return run


def _totals(df: DataFrame) -> list:
    """Statistics summed over all partitions: at most one number per character, run of one character, or source, field and chain."""
    return df.groupBy("kind", "source", "field", "key").agg(F.sum("weight").alias("weight")).collect()


def long_texts(df: DataFrame, id_col: str, source_col: str, fields: tuple[str, ...]) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields]))
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(source_col, F.lit("")).alias("source"), each.alias("x")).select("id", "source", "x.field", "x.text").where("text IS NOT NULL AND text <> ''")


def fit(texts: DataFrame, evidence: DataFrame) -> Model:
    chars: dict[str, float] = {}
    texts_by: dict[tuple[str, str], float] = {}
    for r in _totals(texts.mapInArrow(_char_counts, _STAT)):
        if r.kind == "char":
            chars[r.key] = r.weight
        else:
            texts_by[(r.source, r.field)] = r.weight
    start = {CLEAN: 0.9} | {c: 0.1 / len(CHAINS) for c in CHAINS}
    runs = evidence.select(F.explode(F.array_distinct("run")).alias("r")).groupBy("r").count().collect()
    model = Model(chars, {r["r"]: 0.5 * r["count"] for r in runs}, {("", ""): start} | dict.fromkeys(texts_by, start))
    for _ in range(_ROUNDS):
        sound: dict[str, float] = {}
        by: dict[tuple[str, str], Counter] = {k: Counter() for k in texts_by}
        for r in _totals(evidence.mapInArrow(_expect(model), _STAT)):
            if r.kind == "sound":
                sound[r.key] = r.weight
            else:
                by[(r.source, r.field)][r.key] += r.weight
        prior = {}
        for key, n in texts_by.items():
            damaged = sum(w for c, w in by[key].items() if c != CLEAN)
            prior[key] = {CLEAN: (n - damaged + 5) / (n + 6)} | {c: max(_FLOOR, by[key].get(c, 0.0) / (n + 6)) for c in CHAINS}
        before, model = model.prior, Model(chars, sound, {("", ""): start} | prior)
        if all(abs(p - before[key].get(c, 0.0)) <= _STILL for key, of in prior.items() for c, p in of.items()):
            break
    return model


def damaged_texts(df: DataFrame, id_col: str, source_col: str, fields: tuple[str, ...]) -> DataFrame:
    """(id, field, chain, probability, lossy): texts more probably damaged than sound.

    A null, empty or ASCII text without character references is sound. A replacement character is damage that can't be undone.
    Equal texts are judged alike within a source and field; other columns don't matter; an empty table gives no row.
    """
    texts = long_texts(df, id_col, source_col, fields)
    evidence = cut_lineage(texts.mapInArrow(_gather, _EVIDENCE))
    model = fit(texts, evidence)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, source, field, lossy, chain, runs, dec, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                post = model.posterior(source, field, _evidence_of(chain, runs, dec, n)) if chain else {CLEAN: 1.0}
                best = max(post, key=post.get)
                if lossy or post[CLEAN] < 0.5:
                    out.append((i, field, LOSSY if best == CLEAN else best, 1.0 if lossy else 1 - post[CLEAN], lossy))
            if out:
                kinds = [pa.int64(), pa.string(), pa.string(), pa.float64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["id", "field", "chain", "probability", "lossy"])

    return evidence.mapInArrow(judge, "id bigint, field string, chain string, probability double, lossy boolean")


def repaired_texts(df: DataFrame, id_col: str, source_col: str, fields: tuple[str, ...]) -> DataFrame:
    """(id, field, chain, restored): damaged texts and, where nothing was lost, what they were; restored is null otherwise."""
    texts = long_texts(df, id_col, source_col, fields)
    evidence = cut_lineage(texts.mapInArrow(_gather, _EVIDENCE))
    model = fit(texts, evidence)

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, source, field, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if text.isascii() and "&#" not in text:
                    continue
                plain = unescaped(text)
                lossy = "�" in plain or _ORPHAN.search(plain) is not None
                chain, restored = model.repair(source, field, text)
                if lossy or chain:
                    out.append((i, field, chain or LOSSY, None if lossy else restored))
            if out:
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["id", "field", "chain", "restored"])

    return texts.mapInArrow(mend, "id bigint, field string, chain string, restored string")
