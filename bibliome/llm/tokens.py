"""Encoding of texts with a public byte-level BPE tokenizer, by a tokenization automaton.

The merges are compiled, one gadget after another in order of rank, into a deterministic automaton over tokens. Its states are
"the last token read was t"; an arc labelled x leaves state t exactly if no merge would have joined the end of t with the start
of x before both were whole. Each byte string is the label sequence of one path only, so a word is encoded by following arcs
from its start, position by position, and decoded by emitting arc labels. Arcs are worked out when first asked for and kept.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the tokenizer files are, by default.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the public pattern that splits text into words before the merges.
SPLIT = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
_FAR = 1 << 60
#: Words and arcs one worker keeps.
_KEPT = 400_000


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write bytes as: printable Latin-1 as itself, the rest from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """The deterministic automaton of an ordered list of merges over a vocabulary of byte strings."""

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]]) -> None:
        self.ids = vocabulary
        self.bytes_of = {i: b for b, i in vocabulary.items()}
        self.rank: dict[tuple[int, int], int] = {}
        size = max(vocabulary.values()) + 1
        #: A token's start pieces and end pieces, each with the rank of the merge that used it up; bytes have themselves alone.
        self.starts: list[tuple[tuple[int, int], ...]] = [((i, _FAR),) for i in range(size)]
        self.ends: list[tuple[tuple[int, int], ...]] = [((i, _FAR),) for i in range(size)]
        self._made = np.zeros(size, bool)
        for rank, (left, right) in enumerate(merges):
            self._add_gadget(rank, left, right)
        self.back: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for b, i in vocabulary.items():
            if len(b) == 1 or self._made[i]:
                self._enter(b, i)
        self.arcs: dict[int, bool] = {}
        self.size = size
        self.words: dict[str, tuple[int, ...]] = {}

    def _add_gadget(self, rank: int, left: bytes, right: bytes) -> None:
        """The gadget of one merge: the path left-right is replaced by one arc, whose state is entered as left and left as right."""
        a, b = self.ids[left], self.ids[right]
        whole = all(len(p) == 1 or self._made[i] for p, i in ((left, a), (right, b)))
        if not whole or not self._meet(a, b):  # a part never comes about, or an earlier merge always parts the two
            return
        self.rank.setdefault((a, b), rank)
        made = self.ids.get(left + right)
        if made is None or self._made[made]:
            return
        self._made[made] = True
        self.starts[made] = (*((t, rank if r == _FAR else r) for t, r in self.starts[a]), (made, _FAR))
        self.ends[made] = (*((t, rank if r == _FAR else r) for t, r in self.ends[b]), (made, _FAR))

    def _enter(self, b: bytes, token: int) -> None:
        """Tokens by their bytes from the last to the first, so that those that end at a place are found in one walk."""
        node = 0
        for x in reversed(b):
            nxt = self.back[node].get(x)
            if nxt is None:
                nxt = self.back[node][x] = len(self.back)
                self.back.append({})
                self.token_at.append(-1)
            node = nxt
        self.token_at[node] = token

    def arc(self, state: int, token: int) -> bool:
        """Whether the token may follow: no merge of an end piece of the one with a start piece of the other came first."""
        key = state * self.size + token
        known = self.arcs.get(key)
        if known is None:
            known = self._meet(state, token)
            if len(self.arcs) > _KEPT:
                self.arcs.clear()
            self.arcs[key] = known
        return known

    def _meet(self, left: int, right: int) -> bool:
        """Whether the two can stand side by side: no end piece of the one was merged with a start piece of the other in time."""
        rank = self.rank
        for e, used in self.ends[left]:
            for s, taken in self.starts[right]:
                r = rank.get((e, s))
                if r is not None and r < used and r <= taken:
                    return False
        return True

    def encode_bytes(self, w: bytes) -> tuple[int, ...]:
        whole = self.ids.get(w)
        if whole is not None and (len(w) == 1 or self._made[whole]):
            return (whole,)
        n = len(w)
        last, before = [-1] * (n + 1), [0] * (n + 1)
        back, token_at, arc = self.back, self.token_at, self.arc
        for i in range(1, n + 1):
            node, j, found = 0, i, []
            while j:
                node = back[node].get(w[j - 1])
                if node is None:
                    break
                j -= 1
                if token_at[node] >= 0:
                    found.append((j, token_at[node]))
            for j, t in reversed(found):
                if j == 0 or (last[j] >= 0 and arc(last[j], t)):
                    last[i], before[i] = t, j
                    break
        out, i = [], n
        while i:
            out.append(last[i])
            i = before[i]
        return tuple(reversed(out))

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        words = self.words
        for w in SPLIT.findall(text):
            ids = words.get(w)
            if ids is None:
                ids = self.encode_bytes(w.encode("utf-8", "replace"))
                if len(words) > _KEPT:
                    words.clear()
                if len(w) < 64:
                    words[w] = ids
            out.extend(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def automaton(path: str) -> Automaton:
    """The automaton of a tokenizer file; compiled once in each worker."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    of = _byte_of_char()
    raw = {t: bytes(of[c] for c in t) for t in model["vocab"] if all(c in of for c in t)}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return Automaton({raw[t]: i for t, i in model["vocab"].items() if t in raw}, [(raw[a], raw[b]) for a, b in merges])


def encoded(df: DataFrame, id_col: str, text_col: str, *, tokenizer: str = "byte_bpe_50k", path: str = TOKENIZERS) -> DataFrame:
    """(id, ids): every row's text as token ids, without special tokens.

    A null or an empty text gives an empty list; strings that look like special tokens are ordinary text; texts are encoded
    whole, however long; repeated rows are encoded alike. One narrow stage.
    """
    file = f"{path}/{tokenizer}.json"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(file)
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                lists = [a.encode(t) if t else [] for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(lists) + 1, np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                flat = np.fromiter((i for x in lists for i in x), np.int32, offsets[-1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["id", "ids"])

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id bigint, ids array<int>")


def decoded(df: DataFrame, id_col: str, ids_col: str, *, tokenizer: str = "byte_bpe_50k", path: str = TOKENIZERS) -> DataFrame:
    """(id, text): token ids as text; an empty list gives an empty text, a null one null."""
    file = f"{path}/{tokenizer}.json"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(file)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else a.decode(x) for x in b.column(1).to_pylist()], pa.string())], ["id", "text"])

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id bigint, text string")
