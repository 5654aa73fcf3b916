"""A reader's draft made a profile: texts, fields and papers become weighted interests; small data, on the driver."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from bibliome.functions.embedding import Encoder
from bibliome.functions.taxonomy import SLUGS
from bibliome.operators.recommend import Interest, Profile

#: What a reader's words for importance, freshness and kind of publication weigh.
IMPORTANCE = {"low": 0.5, "normal": 1.0, "high": 2.0}
FRESHNESS = {"any": 0.25, "balanced": 0.5, "newest": 0.9}
STAGE = {"reviewed": 0.0, "both": 1.0, "preprints": 2.0}
MOST = 16


@dataclass(frozen=True)
class Draft:
    """What a reader wrote: texts with their importance, texts of no interest, fields, papers by id, and choices."""

    texts: tuple[tuple[str, str], ...] = ()
    unwanted: tuple[str, ...] = ()
    fields: tuple[str, ...] = ()
    papers: tuple[int, ...] = ()
    freshness: str = "balanced"
    stage: str = "both"
    blocked_topics: tuple[str, ...] = ()


@dataclass(frozen=True)
class Built:
    profile: Profile
    issues: tuple[str, ...] = field(default=())


def key_of(prefix: str, text: str, most: int = 40) -> str:
    return f"{prefix}-{_fold(text).replace(' ', '-')[:most]}"


def _fold(text: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()
    return " ".join(re.sub(r"[\W_]+", " ", plain).split())


def validated(d: Draft) -> tuple[Draft, tuple[str, ...]]:
    """The draft without blanks, repeats (the stronger importance stays) and contradictions, with everything that was wrong."""
    issues: list[str] = []
    kept: dict[str, tuple[str, str]] = {}
    for text, importance in d.texts:
        if importance not in IMPORTANCE:
            issues.append(f"unknown importance: {importance}")
            importance = "normal"
        k = _fold(text)
        if not k:
            issues.append("empty interest")
        elif k not in kept or IMPORTANCE[importance] > IMPORTANCE[kept[k][1]]:
            kept[k] = (text.strip(), importance)
    both = [u for u in d.unwanted if _fold(u) in kept]
    issues += [f"wanted and unwanted: {u}" for u in both]
    unknown = [f for f in d.fields if f not in SLUGS.values()]
    issues += [f"unknown field: {f}" for f in unknown]
    for name, table in (("freshness", FRESHNESS), ("stage", STAGE)):
        if getattr(d, name) not in table:
            issues.append(f"unknown {name}: {getattr(d, name)}")
            d = replace(d, **{name: Draft.__dataclass_fields__[name].default})
    clean = replace(d, texts=tuple(kept.values()), unwanted=tuple(u for u in dict.fromkeys(d.unwanted) if _fold(u) and u not in both), fields=tuple(f for f in dict.fromkeys(d.fields) if f not in unknown))
    if not clean.texts and not clean.papers and not clean.fields:
        issues.append("nothing to go by")
    return clean, tuple(issues)


def build(d: Draft, encoder: Encoder, papers: Mapping[int, Sequence[float]] | None = None) -> Built:
    """Each distinct text is encoded once, in one call; papers without a vector are left out and told."""
    clean, issues = validated(d)
    texts = [*(t for t, _ in clean.texts), *clean.unwanted]
    vectors = encoder.encode(texts) if texts else []
    made = [Interest(key_of("text", t), tuple(map(float, v)), IMPORTANCE[w]) for (t, w), v in zip(clean.texts, vectors, strict=False)]
    made += [Interest(key_of("not", t), tuple(map(float, v)), 1.0, negative=True) for t, v in zip(clean.unwanted, vectors[len(clean.texts) :], strict=True)]
    for p in clean.papers:
        v = (papers or {}).get(p)
        if v is None:
            issues += (f"no vector for paper {p}",)
        else:
            made.append(Interest(f"paper-{p}", tuple(map(float, v)), 1.0, "short"))
    if len(made) > MOST:
        issues += (f"only {MOST} interests are used",)
    profile = Profile(tuple(made[:MOST]), fields=clean.fields, blocked_topics=clean.blocked_topics, preprint_appetite=STAGE[clean.stage], freshness_appetite=FRESHNESS[clean.freshness])
    return Built(profile, issues)


def refined(d: Draft, actions: Sequence[tuple[str, str]]) -> Draft:
    """The draft after actions in their order: add, drop, raise, lower, unwant, field, block, freshness."""
    levels = list(IMPORTANCE)
    for verb, what in actions:
        texts = dict(d.texts)
        if verb == "add":
            texts.setdefault(what, "normal")
        elif verb == "drop":
            texts.pop(what, None)
        elif verb in ("raise", "lower") and what in texts:
            texts[what] = levels[min(len(levels) - 1, max(0, levels.index(texts[what]) + (1 if verb == "raise" else -1)))]
        elif verb == "unwant":
            texts.pop(what, None)
            d = replace(d, unwanted=(*d.unwanted, what))
        elif verb == "field":
            d = replace(d, fields=(*d.fields, what))
        elif verb == "block":
            d = replace(d, blocked_topics=(*d.blocked_topics, what))
        elif verb == "freshness":
            d = replace(d, freshness=what)
        elif verb not in ("raise", "lower"):
            raise ValueError(f"unknown action: {verb}")
        d = replace(d, texts=tuple(texts.items()))
    return d


def summary(p: Profile) -> dict[str, list[str]]:
    """What the profile says, by section, the weightier first."""
    by = lambda some: [i.key for i in sorted(some, key=lambda i: (-i.weight, i.key))]
    return {"interests": by(i for i in p.positive if i.horizon != "short"), "current": by(i for i in p.positive if i.horizon == "short"), "unwanted": by(p.negative), "fields": sorted(p.fields), "blocked": sorted(p.blocked_topics)}
