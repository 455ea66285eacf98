"""Byte-level BPE data shared by the encoder and the counter: vocabulary, merge ranks, pre-tokeniser.

Only the merge table of a published tokenizer file is read; nothing is trained here.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import regex

#: Fixed value: the published pre-tokeniser pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# The tokenizers library takes these as white space (Python's \\s has four control characters more). Letters and
# numbers follow the regex module's Unicode tables; they differ from the library's only on code points that its
# older tables leave unassigned.
_space = r"\t-\r\x20\x85\p{Z}"
_general = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_space}\p{{L}}\p{{N}}]+|[{_space}]+(?![^{_space}])|[{_space}]+"
)
# Texts of ASCII and Latin letters only, most of a European corpus, split alike by the faster standard module.
_latin = "A-Za-zÀ-ÖØ-öø-ɏ"
_unusual = re.compile(rf"[^\t\n\r -~{_latin}]")
_simple = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?[0-9]+| ?[!-/:-@\[-`{-~]+|\s+(?!\S)|\s+")


def pieces(text: str) -> list[str]:
    """The words that merges never cross, in order; together they are the text."""
    return (_general if _unusual.search(text) else _simple).findall(text)


def byte_letters() -> dict[int, str]:
    """The vocabulary file's letter for each byte: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@dataclass(frozen=True)
class MergeTable:
    """first: id of each byte; merges: (left id, right id) -> rank << 20 | merged id; special: whole-text strings."""

    first: list[int]
    merges: dict[tuple[int, int], int]
    bytes_of: dict[int, bytes]
    special: dict[str, int]


def load_merges(path: str) -> MergeTable:
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    vocab = model["model"]["vocab"]
    letters = byte_letters()
    back = {c: b for b, c in letters.items()}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    return MergeTable(
        first=[vocab[letters[b]] for b in range(256)],
        merges={(vocab[a], vocab[b]): r << 20 | vocab[a + b] for r, (a, b) in enumerate(pairs)},
        bytes_of={i: bytes(back[c] for c in w) for w, i in vocab.items()} | {i: s.encode() for s, i in special.items()},
        special=special,
    )


def special_splitter(special: dict[str, int]) -> re.Pattern | None:
    """Splits a text at special strings (kept as odd elements), longest first."""
    if not special:
        return None
    return re.compile("(" + "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)) + ")")


class TwoAges(dict):
    """A bounded memo: entries not asked for during a whole filling are forgotten.

    The bound is on memory only; a forgotten word is computed again, with the same result.
    """

    def __init__(self, compute, limit: int = 400_000):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, word):
        got = self.old.get(word)
        if got is None:
            got = self.compute(word)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        if len(word) <= 64:
            self[word] = got
        return got


def merge_list(word: bytes, table: MergeTable) -> tuple[list[int], list[int], int]:
    """Heap-and-linked-list merging: pop the lowest-rank adjacent pair (leftmost first) until none is left.

    Returns the symbols, the links to each symbol's right neighbour (len(word) ends the list) and the number of merges.
    A heap entry is rank << 52 | position << 20 | merged id; entries whose pair has since changed are passed over.
    """
    n, merges = len(word), table.merges
    symbols = [table.first[b] for b in word]
    right, left = list(range(1, n + 1)), list(range(-1, n))
    heap = []
    for i in range(n - 1):
        v = merges.get((symbols[i], symbols[i + 1]))
        if v is not None:
            heap.append(v >> 20 << 52 | i << 20 | v & 0xFFFFF)
    heapify(heap)
    done = 0
    while heap:
        e = heappop(heap)
        i = e >> 20 & 0xFFFFFFFF
        j = right[i]
        if symbols[i] < 0 or j >= n or merges.get((symbols[i], symbols[j]), -1) != e >> 52 << 20 | e & 0xFFFFF:
            continue
        symbols[i], symbols[j] = e & 0xFFFFF, -1
        k = right[i] = right[j]
        left[k] = i
        done += 1
        if k < n:
            v = merges.get((symbols[i], symbols[k]))
            if v is not None:
                heappush(heap, v >> 20 << 52 | i << 20 | v & 0xFFFFF)
        h = left[i]
        if h >= 0:
            v = merges.get((symbols[h], symbols[i]))
            if v is not None:
                heappush(heap, v >> 20 << 52 | h << 20 | v & 0xFFFFF)
    return symbols, right, done
