"""Values of texts put together from their context-free units, found for many texts at once.

A unit is a run of white space with the run of other characters after it. For byte-level BPE with its usual split
pattern, a match never crosses from a non-space to a space, and how a unit splits depends on the unit alone, so what is
known of a text (its ids, or its counts by prefix) is what is known of its units joined. ``UnitTable`` keeps the values of
units: it cuts the bytes of a batch of texts, packs units of up to 16 bytes into two numbers, and looks these up in a hash
table that compares the whole unit; longer ones go by a dictionary. Only units not met before are evaluated.

Tokenizers of another kind, and texts that hold strings of added tokens, are given to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from quillmesh.llm.tiktoken_codec import SPACE

EXACT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
WIDE_SPACE = re.compile("[\x85\xa0  -     　]")
ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Entries and slots of a table, and the values after which it starts anew.
ENTRIES, SLOT_BITS, MOST_VALUES = 1 << 20, 21, 1 << 24
PACKED = 16
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def split_units(text: str) -> list[str]:
    return EXACT.findall(text)


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def unit_bounds(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The bytes of all texts, where units begin and the number of units before each text and after the last."""
    parts = [text.encode() for text in texts]
    data = b"".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
    space = ASCII_SPACE[np.frombuffer(data, np.uint8)]
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    firsts = ends - np.fromiter(map(len, parts), np.int64, len(parts))
    begins[firsts[firsts < ends]] = True
    for first, end, text in zip(firsts.tolist(), ends.tolist(), texts, strict=True):
        if not text.isascii() and WIDE_SPACE.search(text):  # white space of several bytes joins its neighbours
            at = np.cumsum([first] + [len(unit.encode()) for unit in split_units(text)])
            begins[first:end] = False
            begins[at[:-1]] = True
    starts = np.flatnonzero(begins)
    return data, starts, np.searchsorted(starts, np.append(firsts, len(data)))


class UnitTable:
    """unit -> values, where evaluate(units) gives the values of all of them joined and how many each has."""

    def __init__(self, evaluate: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], kind):
        self.evaluate, self.kind = evaluate, kind
        self.clear()

    def clear(self) -> None:
        self.size = 1  # entry 0 is none
        self.low, self.high, self.lengths = np.zeros(ENTRIES, np.uint64), np.zeros(ENTRIES, np.uint64), np.full(ENTRIES, 255, np.uint8)
        self.slots = np.zeros(1 << SLOT_BITS, np.int32)
        self.begin, self.count = np.zeros(ENTRIES, np.int64), np.zeros(ENTRIES, np.int64)
        self.pool, self.used = np.zeros(1 << 16, self.kind), 0
        self.long: dict[bytes, int] = {}

    def values(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The values of all texts joined, and the number of values before each text and after the last."""
        data, starts, units = unit_bounds(texts)
        if not len(starts):
            return np.zeros(0, self.kind), np.zeros(len(texts) + 1, np.int64)
        parts, sizes = [], []
        for at in range(0, len(starts), ENTRIES // 4):
            found = self._entries(data, starts[at : at + ENTRIES // 4], starts[at + ENTRIES // 4] if at + ENTRIES // 4 < len(starts) else len(data))
            count = self.count[found]
            before = np.cumsum(count) - count
            parts.append(self.pool[np.repeat(self.begin[found] - before, count) + np.arange(int(count.sum()))])
            sizes.append(count)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])[units]

    def _entries(self, data: bytes, starts: np.ndarray, end: int) -> np.ndarray:
        """The entry of each unit; those not there yet are evaluated."""
        sizes = np.diff(starts, append=end)
        if self.size + len(starts) >= ENTRIES or self.used > MOST_VALUES:
            self.clear()
        base = int(starts[0])
        padded = np.frombuffer(data[base:end] + bytes(PACKED + 8), np.uint8)
        words = np.ndarray((len(padded) - 8,), "<u8", padded, strides=(1,))
        packed = np.flatnonzero(sizes <= PACKED)
        at, size = starts[packed] - base, sizes[packed]
        low = words[at] & MASKS[np.minimum(size, 8)]
        high = words[at + 8] & MASKS[np.maximum(size - 8, 0)]
        out = np.zeros(len(starts), np.int64)
        out[packed] = found = self._find(low, high, size)
        fresh = np.flatnonzero(found == 0)
        units: list[str] = []
        if len(fresh):
            order = fresh[np.lexsort((size[fresh], high[fresh], low[fresh]))]
            differs = np.concatenate([[True], (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1]) | (size[order][1:] != size[order][:-1])])
            named = order[differs]
            entries = self.size + np.arange(len(named))
            out[packed[order]] = entries[np.cumsum(differs) - 1]
            self._insert(entries, low[named], high[named], size[named])
            units += [data[s : s + n].decode() for s, n in zip((at[named] + base).tolist(), size[named].tolist(), strict=True)]
        following = self.size + len(units)
        for i in np.flatnonzero(sizes > PACKED).tolist():
            unit = data[starts[i] : starts[i] + sizes[i]]
            entry = self.long.get(unit)
            if entry is None:
                entry = self.long[unit] = following
                following += 1
                units.append(unit.decode())
            out[i] = entry
        if units:
            self._evaluate(units)
        return out

    def _evaluate(self, units: list[str]) -> None:
        values, counts = self.evaluate(units)
        if self.used + len(values) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(2 * (self.used + len(values)), self.kind)])
        self.pool[self.used : self.used + len(values)] = values
        place = slice(self.size, self.size + len(units))
        self.count[place] = counts
        self.begin[place] = self.used + np.cumsum(counts) - counts
        self.used += len(values)
        self.size += len(units)

    @staticmethod
    def _slot(low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        mixed = (low ^ (high + size.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed ^ mixed >> np.uint64(29)) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Entries of units, 0 for none: slots one after another until the unit or an empty one."""
        out = np.zeros(len(low), np.int32)
        slot, left = self._slot(low, high, size), np.arange(len(low))
        while len(left):
            entry = self.slots[slot]
            same = (self.low[entry] == low[left]) & (self.high[entry] == high[left]) & (self.lengths[entry] == size[left])
            out[left[same]] = entry[same]
            on = ~same & (entry > 0)
            slot, left = (slot[on] + 1) & ((1 << SLOT_BITS) - 1), left[on]
        return out

    def _insert(self, entries: np.ndarray, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> None:
        self.low[entries], self.high[entries], self.lengths[entries] = low, high, size
        slot, left = self._slot(low, high, size), entries
        while len(left):
            empty = self.slots[slot] == 0
            self.slots[slot[empty]] = left[empty]
            on = self.slots[slot] != left
            slot, left = (slot[on] + 1) & ((1 << SLOT_BITS) - 1), left[on]


@lru_cache(maxsize=1)
def encoder_for(path: str) -> UnitEncoder:
    """One encoder a worker: its table serves all its tasks."""
    return UnitEncoder(path)


class UnitEncoder:
    #: Units given to the library in one string; it keeps what one call returns until it is read.
    JOINED = 2000

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = tokenizer(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre = spec.get("pre_tokenizer") or {}
        self.added = [token["content"] for token in spec.get("added_tokens", [])]
        self.by_unit = not any(c.isspace() for token in self.added for c in token) and spec.get("normalizer") is None and spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec["model"].get("dropout")
        self.merges = spec["model"].get("merges", []) if self.by_unit else []
        self.table = UnitTable(self._evaluate, np.uint32)
        if self.by_unit:  # a letter of the vocabulary stands for each byte
            names = self.tokenizer.get_vocab(with_added_tokens=False)
            self.widths = np.zeros(max(names.values()) + 1, np.int64)
            self.widths[list(names.values())] = list(map(len, names))

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [found.ids for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _evaluate(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units: those of white space and a word are encoded as one text and told apart by the tokens' bytes."""
        counts = np.zeros(len(units), np.int64)
        pieces: list[np.ndarray | None] = [None] * len(units)
        spaced = np.array([unit[0] in " \n\t\r" and not unit.isspace() for unit in units])
        chained, alone = np.flatnonzero(spaced), np.flatnonzero(~spaced)
        for at, ids in zip(alone.tolist(), self._library([units[i] for i in alone.tolist()]), strict=True):
            pieces[at] = np.array(ids, np.uint32)
        for first in range(0, len(chained), self.JOINED):
            part = chained[first : first + self.JOINED].tolist()
            sizes = np.array([len(units[i].encode()) for i in part])
            ids = np.array(self._library(["".join([units[i] for i in part])])[0], np.uint32)
            cuts = np.searchsorted(np.cumsum(self.widths[ids]), np.cumsum(sizes)) + 1
            begin = 0
            for i, end in zip(part, cuts.tolist(), strict=True):
                pieces[i] = ids[begin:end]
                begin = end
        counts[:] = list(map(len, pieces))
        return np.concatenate(pieces), counts

    def whole(self, text: str) -> bool:
        return not self.by_unit or any(token in text for token in self.added)

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text as uint32."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        plain = []
        for i, text in enumerate(texts):
            if text:
                if self.whole(text):
                    out[i] = np.array(self._library([text])[0], np.uint32)
                else:
                    plain.append(i)
        ids, bounds = self.table.values([texts[i] for i in plain])
        for i, a, b in zip(plain, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            out[i] = ids[a:b]
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_many([text])[0]
