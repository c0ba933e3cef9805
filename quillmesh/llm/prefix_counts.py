"""Token counts by prefix dynamic programming: the exact number of tokens of every prefix of a text.

A byte-pair encoding is valid exactly if each pair of neighbouring tokens is, so the encoding of a prefix ends in the one
token t whose left neighbour, the last token of the prefix before t, goes with it: count[i] = count[i - len(t)] + 1. The
dynamic programme runs over the pieces that the split pattern makes, with an automaton that finds the tokens ending at each
byte; pieces of a unit (white space and the word after it) do not depend on what stands before, so the counts of units met
before are looked up and joined. What is stored per text is one signed
byte per character: the change of the count when that character is added. From it any prefix's count, the longest prefix
within a budget and the count of the whole text follow without encoding again.

Defined cases: null texts count as empty. Texts with strings of added tokens are cut at them as the library does (such a
string is one token; a prefix that ends inside it counts its characters as ordinary text). Tokenizers that are not
byte-level BPE give no prefix table (null) and are counted by the library whole. Ids may be null or repeated; only the id
and text columns are read.
"""

from __future__ import annotations

import gc
import re
from functools import lru_cache
from operator import sub

import numpy as np
from pyspark.sql import DataFrame

from quillmesh.llm.common import grouped_batches, map_rows
from quillmesh.llm.tiktoken_codec import vocabulary_path
from quillmesh.llm.units import UnitEncoder, UnitTable

TOKENIZER_FILE = "byte_bpe_50k.json"
LIMIT_TOKENS = 1024
#: Pairs of tokens that are known to stay apart or not.
PAIR_ENTRIES = 1_000_000


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class PrefixCounter:
    def __init__(self, path: str):
        import ahocorasick
        import public_tokenizers
        import regex

        self.units = UnitEncoder(path)
        self.split = regex.compile(public_tokenizers.PATTERN)
        raw = {letter: byte for byte, letter in enumerate(byte_letters())}
        spelled = lambda token: bytes(raw[c] for c in token)
        names = self.units.tokenizer.get_vocab(with_added_tokens=False) if self.units.by_unit else {}
        self.tokens = sorted(map(spelled, names))
        self.finder = ahocorasick.Automaton()
        for number, token in enumerate(self.tokens):
            self.finder.add_word(token.decode("latin-1"), (len(token), number))
        self.finder.make_automaton()
        self.marks = re.compile("|".join(map(re.escape, sorted(self.units.added, key=len, reverse=True)))) if self.units.added else None
        merges = [tuple(map(spelled, m.split(" ") if isinstance(m, str) else m)) for m in self.units.merges]
        self.ranks = {pair: rank for rank, pair in enumerate(merges)}
        self.halves = {left + right: (left, right, rank) for rank, (left, right) in reversed(list(enumerate(merges)))}
        self.pairs: dict[int, bool] = {}
        self.ends: dict[int, list] = {}
        self.starts: dict[int, list] = {}
        self.table = UnitTable(self._evaluate, np.int8)

    def _spine(self, token: bytes, side: int) -> list[tuple[bytes, int, float]]:
        """A token and the parts it grew from at one side: (part, rank that made it, rank that took it up), latest first."""
        out, taken = [], float("inf")
        while True:
            left, right, rank = self.halves.get(token, (b"", b"", -1))
            out.append((token, rank, taken))
            if rank < 0:
                return out
            token, taken = (right if side else left), rank

    def _goes(self, left: int, right: int) -> bool:
        """Whether two tokens, each encoding its own text, stay apart when their texts are joined.

        Goes back through the parts that touched at the boundary; a merge across it wins if it comes before both
        parts are taken up, or at the same rank as the right one's, as equal ranks merge from the left.
        """
        ends = self.ends.get(left)
        if ends is None:
            ends = self.ends[left] = self._spine(self.tokens[left], 1)
        starts = self.starts.get(right)
        if starts is None:
            starts = self.starts[right] = self._spine(self.tokens[right], 0)
        i = j = 0
        ranks = self.ranks
        while True:
            a, made_a, taken_a = ends[i]
            b, made_b, taken_b = starts[j]
            rank = ranks.get((a, b))
            if rank is not None and rank < taken_a and rank <= taken_b:
                return False
            if made_a > made_b:
                i += 1
            elif made_b >= 0:
                j += 1
            else:
                return True

    def _piece(self, piece: str) -> list[int]:
        """counts[i]: tokens of the first i characters of a piece, taken as one piece.

        The automaton gives the tokens that end at each byte; the one that goes with what stands before it is the last
        token of that prefix.
        """
        data = piece.encode()
        n = len(data)
        pairs = self.pairs
        if len(pairs) >= PAIR_ENTRIES:
            pairs.clear()
        counts, last, done = [0] * (n + 1), [0] * (n + 1), 0
        for end, (size, token) in self.finder.iter(data.decode("latin-1")):
            end += 1
            if end > done:
                before = end - size
                if before:
                    pair = last[before] << 32 | token
                    apart = pairs.get(pair)
                    if apart is None:
                        apart = pairs[pair] = self._goes(last[before], token)
                    if not apart:
                        continue
                if end != done + 1:
                    break
                counts[end], last[end], done = counts[before] + 1, token, end
        if done < n:
            raise ValueError(f"no encoding of {piece[:40]!r} ends at byte {done + 1}")
        if n == len(piece):
            return counts
        return [0, *(counts[end] for end in range(1, n + 1) if end == n or data[end] & 0xC0 != 0x80)]

    def _unit(self, unit: str) -> list[int]:
        """Counts of the prefixes of a unit, the empty one first."""
        word = unit.lstrip("\t\n\x0b\x0c\r \x85\xa0                　")
        blank = len(unit) - len(word)
        counts = [0] if not blank else [0, 1] if blank == 1 and unit[0] == " " else self._piece(unit[:blank])
        before = done = 0
        for piece in self.split.findall(unit) if word else ():
            inside = self._piece(piece)
            begin, done = done, done + len(piece)
            if done > blank:
                first = max(blank - begin, 0)
                if begin >= blank and piece in ("'re", "'ve", "'ll"):
                    counts += [before + 1, before + 2, before + inside[3]]  # a cut contraction is a quotation mark and a letter
                else:
                    counts += [before + c for c in inside[first + 1 :]]
            before += inside[-1]
        return counts

    def _evaluate(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Changes of the count with each character of the units."""
        out: list[int] = []
        for unit in units:
            counts = self._unit(unit)
            out += map(sub, counts[1:], counts)
        return np.frombuffer(_narrow(np.array(out, np.int64)), np.int8), np.fromiter(map(len, units), np.int64, len(units))

    def changes_of_all(self, texts: list[str | None]) -> list[bytes]:
        """Of each text one signed byte per character; their running sum is the count of each prefix."""
        if not self.units.by_unit:
            raise ValueError("prefix tables are for byte-level BPE")
        texts = [text or "" for text in texts]
        marked = {i for i, text in enumerate(texts) if self.marks is not None and self.units.whole(text)}
        values, bounds = self.table.values(["" if i in marked else text for i, text in enumerate(texts)])
        data, ends = values.tobytes(), bounds.tolist()
        return [self._marked(texts[i]) if i in marked else data[a:b] for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True))]

    def changes(self, text: str | None) -> bytes:
        return self.changes_of_all([text])[0]

    def _marked(self, text: str) -> bytes:
        """The changes of a text with added tokens, which the library cuts out."""
        out, start = [], 0
        plain = lambda part: self.table.values([part])[0]
        for found in self.marks.finditer(text):
            kept = plain(text[start : found.start()])
            size = found.end() - found.start()
            total = int(kept.sum(dtype=np.int64))
            running = np.cumsum(plain(text[start : found.end()]), dtype=np.int64)[-size:]
            running[-1] = total + 1
            out += [kept.tobytes(), _narrow(np.diff(np.concatenate([[total], running])))]
            start = found.end()
        out.append(plain(text[start:]).tobytes())
        return b"".join(out)

    def count(self, text: str | None) -> int:
        if self.units.by_unit:
            return count_at(self.changes(text))
        return len(self.units.encode(text))


@lru_cache(maxsize=1)
def counter_for(path: str) -> PrefixCounter:
    """One counter a worker: its caches serve all its tasks, and hold no cycles for the collector to look for."""
    gc.set_threshold(500_000, 50, 1000)
    return PrefixCounter(path)


def _narrow(steps: np.ndarray) -> bytes:
    if len(steps) and (steps.min() < -128 or steps.max() > 127):
        raise ValueError("a count changes by more than a signed byte holds")
    return steps.astype(np.int8).tobytes()


def count_at(changes: bytes, end: int | None = None) -> int:
    """Tokens of the first ``end`` characters (all where None)."""
    return int(np.frombuffer(changes, np.int8)[:end].sum(dtype=np.int64))


def longest_within(changes: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    fits = np.flatnonzero(np.cumsum(np.frombuffer(changes, np.int8), dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def prefix_table(docs: DataFrame, tokenizer_path: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, prefix binary): the table that answers truncation and budget questions."""
    path = tokenizer_path or vocabulary_path(TOKENIZER_FILE)
    kind = docs.schema[id_column].dataType.simpleString()

    def rows(source):
        if path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            for key, text in source:
                yield key, len((text or "").encode()), len(pieces.encode(text or "", num_threads=1)), None
            return
        counter = counter_for(path)
        if not counter.units.by_unit:
            yield from ((key, len((text or "").encode()), counter.count(text), None) for key, text in source)
            return
        for batch in grouped_batches(source, 2000, 1, 1_000_000):
            for (key, text), table in zip(batch, counter.changes_of_all([text for _, text in batch]), strict=True):
                yield key, len((text or "").encode()), count_at(table), table

    return map_rows(docs.select(id_column, text_column), rows, f"{id_column} {kind}, n_bytes bigint, n_tokens bigint, prefix binary", flush=500)
