"""Language identification by segmentation-marginalised unigrams.

The pieces of a public sentence-piece vocabulary (a file, its path a parameter) are the fixed vocabulary; each language
has its own probabilities of them. A word, with a mark for its beginning, has the probability of all its segmentations
together, summed by a forward pass. The probabilities come from expectation-maximisation over the counts of words by
language: forward and backward passes give every piece's expected number of uses. A text's score for a language is the
log probability of its words and of the language; the posterior of the best language is the score returned.

Only sequences of letters count, lower-cased and whole, however long; pieces with a capital can't stand in them and have
no probability. A letter outside the vocabulary is an unknown piece. The sums are rescaled every ``RESCALE`` characters, and
no piece is less likely than ``LEAST_CHANCE``, so they neither underflow nor overflow. Word counts cover all training rows
and stay distributed; what comes to the driver is one number for each piece and language.

Defined cases: a null text, or one without a letter, is ``und`` with score 0. Without training rows every text is. Ties go
to the language first in order. Repeated rows and null ids stay; only id, text and lang are read, lang in training alone.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import grouped_batches, map_rows, materialise
from quillmesh.llm.tiktoken_codec import vocabulary_path
from quillmesh.llm.units import UnitTable

PIECES_FILE = "piece_bpe_32k.model"
UNKNOWN_LANGUAGE = "und"
ROUNDS, SMOOTHING, LEAST_CHANCE = 2, 0.1, 1e-15
SCALE, RESCALE = 1e3, 6
CELLS = 120_000
FEW, STRETCH = 4, 4096  # words of a lattice whose pieces are summed together, and characters at a time
WORDS = re.compile(r"[^\W\d_]+")
BEGIN = "▁"
FLUSH_TYPES = 200_000


@lru_cache(maxsize=2)
def pieces(path: str) -> dict[str, int]:
    """piece -> number; 0 is the unknown letter."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    kept = sorted({name for name in names if name == name.lower()} | {BEGIN})
    return {name: i for i, name in enumerate(kept, 1)}


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def has_letter(words: list[str]) -> bool:
    return any(c.isalpha() for word in words for c in word)


class PieceTable:
    """Finds pieces by a hash of their characters, for many words at once.

    A piece's hash is a polynomial in its code points; the leading bits give its slot, and the whole hash is compared.
    Pieces whose slot is taken go to a further table of slots.
    """

    BITS = 20
    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, vocabulary: dict[str, int]):
        self.longest = max(map(len, vocabulary), default=1)
        self.hashes = np.zeros(len(vocabulary) + 1, np.uint64)
        for piece, number in vocabulary.items():
            value = 0
            for c in piece:
                value = (value * int(self.BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            self.hashes[number] = value
        self.tables: list[np.ndarray] = []
        left = np.arange(1, len(self.hashes))
        while len(left):
            table = np.zeros(1 << self.BITS, np.int32)
            slots = self._slots(self.hashes[left], len(self.tables))
            table[slots[::-1]] = left[::-1]
            self.tables.append(table)
            left = left[table[slots] != left]

    def _slots(self, hashes: np.ndarray, number: int) -> np.ndarray:
        return (hashes * np.uint64(2 * number + 0xD6E8FEB86659FD93) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes, -1 for none."""
        out = np.full(len(hashes), -1, np.int32)
        for number, table in enumerate(self.tables):
            found = table[self._slots(hashes, number)]
            hit = (found > 0) & (self.hashes[found] == hashes)
            out[hit] = found[hit]
        return out


@lru_cache(maxsize=2)
def piece_table(path: str) -> PieceTable:
    return PieceTable(pieces(path))


def lattices(words: list[str], table: PieceTable):
    """Yields (places in words, ids) for words of about one length; ids[j, k, w]: the piece of k + 1 characters that ends at j.

    Words end at the last j, and are filled up before their mark with a filler piece; -1 is no piece.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    ordered = sizes[order]
    first = 0
    while first < len(order):
        least = int(ordered[first])
        end = min(int(np.searchsorted(ordered, least + least // 8, "right")), first + max(1, CELLS // (least + 1)))
        part, n = order[first:end], int(ordered[end - 1]) + 1
        first = end
        marked = np.array([(BEGIN + words[i]).rjust(n, "\0") for i in part.tolist()], f"<U{n}")
        codes = np.ascontiguousarray(marked.view(np.uint32).reshape(len(part), n).T)
        letters = codes.astype(np.uint64) + np.uint64(1)
        width = min(table.longest, n)
        ids = np.full((n, width, len(part)), -1, np.int32)
        value = np.zeros_like(letters)
        for k in range(width):  # pieces of k + 1 characters, from every place
            value = value[: n - k] * table.BASE + letters[k:]
            found = table.find(value.reshape(-1)).reshape(value.shape)
            ids[k:, k] = np.maximum(found, 0) if not k else found  # any single letter is a piece, if an unknown one
        ids[:, 0][codes == 0] = len(table.hashes)
        yield part, ids


def used_pieces(ids: np.ndarray) -> np.ndarray:
    """Whether any word has a piece that ends at j with k + 1 characters."""
    return (ids >= 0).any(axis=2)


def filled(chances: np.ndarray) -> np.ndarray:
    """The pieces' probabilities with those of the filler, which changes no sum, and of no piece."""
    return np.vstack([np.maximum(chances, LEAST_CHANCE), np.full((1, chances.shape[1]), 1 / SCALE), np.zeros((1, chances.shape[1]))])


def _weighed(ids: np.ndarray, chances) -> np.ndarray:
    """Scaled probabilities of the pieces of a stretch, the longest first."""
    found = chances(ids)
    powers = SCALE ** np.arange(1.0, ids.shape[1] + 1)
    return (found * powers.reshape(1, -1, *(1,) * (found.ndim - 2)))[:, ::-1]


def _forward_few(ids: np.ndarray, chances, keep: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """``forward`` for few words: all pieces that end at a character at once, in stretches of ``STRETCH`` characters."""
    n, width = ids.shape[:2]
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    held = scale = None
    for first in range(0, n, STRETCH):
        terms = _weighed(ids[first : first + STRETCH], chances)
        sums = np.zeros((width + len(terms), *terms.shape[2:]))
        if held is None:
            sums[width - 1], scale = 1.0, np.zeros(terms.shape[2:])
        else:
            sums[:width] = held
        for at, term in enumerate(terms):
            j = first + at
            total = sums[width + at] = (term * sums[at : at + width]).sum(axis=0)
            if keep or j == n - 1:
                kept.append((total.copy(), scale))
            if j % RESCALE == RESCALE - 1:
                scale = scale + np.log(total)
                sums[at + 1 : at + width + 1] /= total.copy()
        held = sums[len(terms) :].copy()
    return kept


def _backward_few(ids: np.ndarray, chances) -> list[tuple[np.ndarray, np.ndarray]]:
    """``backward`` for few words, likewise."""
    n, width = ids.shape[:2]
    sums = np.zeros((n + width, *chances(ids[0, 0]).shape))
    sums[n - 1], scale = 1.0, np.zeros(sums.shape[1:])
    kept = [(sums[n - 1].copy(), scale)]
    lengths = np.arange(width)
    for last in range(n - 2, -1, -STRETCH):
        first = max(last - STRETCH + 1, 0)
        ends = np.arange(first, last + 1)[:, None] + 1 + lengths
        begun = np.where((ends < n)[:, :, None], ids[np.minimum(ends, n - 1), lengths], -1)
        terms = _weighed(begun, chances)[:, ::-1]
        for j in range(last, first - 1, -1):
            total = sums[j] = (terms[j - first] * sums[j + 1 : j + 1 + width]).sum(axis=0)
            kept.append((total.copy(), scale))
            if j % RESCALE == 0:
                scale = scale + np.log(total)
                sums[j : j + width] /= total.copy()
    return kept[::-1]


def forward(ids: np.ndarray, chances, used: np.ndarray, keep: bool = True) -> list[tuple[np.ndarray, np.ndarray]]:
    """(sum, logarithm of its scale) up to each character, or up to the last only; chances(ids) gives probabilities, 0 for -1."""
    if ids.shape[2] <= FEW:
        return _forward_few(ids, chances, keep)
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    window: list[np.ndarray] = []  # the last sums, latest first, in one scale
    scale = 0.0
    for j in range(len(ids)):
        total = 0.0
        for k in range(min(j + 1, ids.shape[1])):
            if used[j, k]:
                term = chances(ids[j, k]) * SCALE ** (k + 1)
                total = total + (term * np.exp(-scale) if j == k else window[k] * term)
        if keep or j == len(ids) - 1:
            kept.append((total, scale + np.zeros_like(total)))
        window = [total, *window[: ids.shape[1] - 1]]
        if j % RESCALE == RESCALE - 1:
            scale = scale + np.log(total)
            window = [sums / total for sums in window]
    return kept


def backward(ids: np.ndarray, chances, used: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(sum, logarithm of its scale) over the segmentations of what follows each character."""
    if ids.shape[2] <= FEW:
        return _backward_few(ids, chances)
    n = len(ids)
    one = np.ones_like(chances(ids[0, 0]))
    kept, window, scale = [(one, np.zeros_like(one))], [one], np.zeros_like(one)
    for j in range(n - 2, -1, -1):
        total = 0.0
        for k in range(min(ids.shape[1], n - 1 - j)):
            if used[j + 1 + k, k]:
                total = total + chances(ids[j + 1 + k, k]) * SCALE ** (k + 1) * window[k]
        kept.append((total, scale))
        window = [total, *window[: ids.shape[1] - 1]]
        if j % RESCALE == 0:
            scale = scale + np.log(total)
            window = [sums / total for sums in window]
    return kept[::-1]


def expected_uses(words: list[str], weights: np.ndarray, langs: np.ndarray, padded: np.ndarray, table: PieceTable) -> np.ndarray:
    """Expected uses (filled pieces, languages) of the pieces in words of a weight and a language each."""
    sums = np.zeros(padded.shape)
    for places, ids in lattices(words, table):
        lang, used = langs[places], used_pieces(ids)
        chance = lambda at, lang=lang: padded[at, lang]
        ahead, behind = forward(ids, chance, used), backward(ids, chance, used)
        all_log = np.log(ahead[-1][0]) + ahead[-1][1]
        cells, uses = [], []
        for j, k in np.argwhere(used).tolist():
            before, before_log = ahead[j - k - 1] if j > k else (1.0, 0.0)
            cells.append(ids[j, k].astype(np.int64) * len(padded[0]) + lang)
            uses.append(chance(ids[j, k]) * SCALE ** (k + 1) * before * behind[j][0] * np.exp(before_log + behind[j][1] - all_log) * weights[places])
            if len(cells) * len(lang) > 2_000_000:
                sums += _gathered(cells, uses, sums)
                cells, uses = [], []
        if cells:
            sums += _gathered(cells, uses, sums)
    return sums


def _gathered(cells: list[np.ndarray], uses: list[np.ndarray], like: np.ndarray) -> np.ndarray:
    cell, use = np.concatenate(cells), np.concatenate(uses)
    real = cell >= 0
    return np.bincount(cell[real], use[real], minlength=like.size).reshape(like.shape)


def word_counts(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """(lang, word, n) over all rows with a language."""

    def rows(source):
        held: dict[str, Counter] = {}
        for text, lang in source:
            held.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, held.values())) > FLUSH_TYPES:
                yield from ((lang, word, n) for lang, counts in held.items() for word, n in counts.items())
                held = {}
        yield from ((lang, word, n) for lang, counts in held.items() for word, n in counts.items())

    counted = map_rows(docs.where(F.col(lang_column).isNotNull()).select(text_column, lang_column), rows, "lang string, word string, n bigint", flush=20_000)
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Model:
    """Languages, their log prior and the pieces' probabilities (numbers, languages)."""

    def __init__(self, path: str, languages: list[str], prior: np.ndarray, chances: np.ndarray):
        self.path, self.languages, self.prior, self.chances = path, languages, prior, chances
        self._scorer: Scorer | None = None

    def scorer(self) -> Scorer:
        """One scorer a worker: its cache serves all its tasks."""
        if self._scorer is None:
            self._scorer = Scorer(self)
        return self._scorer

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language."""
        padded = filled(self.chances)
        out = np.empty((len(words), len(self.languages)))
        for places, ids in lattices(words, piece_table(self.path)):
            ((last, scale),) = forward(ids, lambda at: padded[at], used_pieces(ids), keep=False)
            out[places] = np.log(last) + scale - len(ids) * np.log(SCALE)
        return out


def train(docs: DataFrame, pieces_path: str | None = None, rounds: int = ROUNDS, text_column: str = "text", lang_column: str = "lang") -> Model:
    path = pieces_path or vocabulary_path(PIECES_FILE)
    spark = docs.sparkSession
    shares = {row[0]: row[1] for row in docs.where(F.col(lang_column).isNotNull()).groupBy(lang_column).count().collect()}
    languages = sorted(shares)
    if not languages:
        return Model(path, [], np.zeros(0), np.zeros((0, 0)))
    number = {lang: i for i, lang in enumerate(languages)}
    size = len(pieces(path)) + 1
    counted = materialise(word_counts(docs, text_column, lang_column), "language-words")
    chances = np.full((size, len(languages)), 1 / size)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(chances)

        def expected(source, shared=shared):
            padded = filled(shared.value)
            sums = np.zeros(padded.shape)
            for batch in grouped_batches(source, 50_000, 1, 1_000_000):
                langs = np.array([number[lang] for lang, _, _ in batch])
                weights = np.array([float(n) for _, _, n in batch])
                sums += expected_uses([word for _, word, _ in batch], weights, langs, padded, piece_table(path))
            at = np.argwhere(sums[:size] > 0)
            yield from ((int(p), int(g), float(sums[p, g])) for p, g in at)

        uses = map_rows(counted, expected, "piece int, lang int, uses double", flush=50_000).groupBy("piece", "lang").agg(F.sum("uses").alias("uses")).toPandas()
        fresh = np.full((size, len(languages)), SMOOTHING)
        fresh[uses["piece"].to_numpy(), uses["lang"].to_numpy()] += uses["uses"].to_numpy()
        chances = fresh / fresh.sum(axis=0)
        shared.unpersist()
    prior = np.log(np.array([shares[lang] for lang in languages], float) / sum(shares.values()))
    return Model(path, languages, prior, chances)


class Scorer:
    """Scores texts with a table of the words met before."""

    def __init__(self, model: Model):
        self.model = model
        self.table = UnitTable(self._evaluate, np.float32)

    def _evaluate(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        scores = self.model.word_scores([unit.lstrip(" ") for unit in units])
        return scores.reshape(-1), np.full(len(units), scores.shape[1])

    def posteriors(self, groups: list[list[str]]) -> np.ndarray:
        """Of each list of words, the probability of each language."""
        width = len(self.model.languages)
        values, bounds = self.table.values([" ".join(words) for words in groups])
        sums = np.zeros((len(groups), width))
        held = np.flatnonzero(np.diff(bounds))
        if len(held):
            sums[held] = np.add.reduceat(values.reshape(-1, width).astype(np.float64), bounds[held] // width, axis=0)
        sums += self.model.prior
        sums -= sums.max(axis=1, keepdims=True)
        sums = np.exp(sums)
        return sums / sums.sum(axis=1, keepdims=True)


def predict_rows(model: Model, source):
    """(other columns..., language, score) for rows whose last column is the text."""
    scorer = model.scorer()
    for batch in grouped_batches(source, 2000, -1, 1_000_000):
        groups = [words_of(row[-1]) for row in batch]
        sums = scorer.posteriors(groups) if model.languages else None
        for at, (row, words) in enumerate(zip(batch, groups, strict=True)):
            if sums is None or not has_letter(words):
                yield *row[:-1], UNKNOWN_LANGUAGE, 0.0
            else:
                best = int(sums[at].argmax())
                yield *row[:-1], model.languages[best], float(sums[at, best])


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_column].dataType.simpleString()
    return map_rows(docs.select(id_column, text_column), lambda source: predict_rows(shared.value, source), f"{id_column} {kind}, lang_pred string, score double")
