"""Language identification by cross-parsing entropy.

One suffix automaton per language holds a bounded sample of its labelled text.
A text is parsed into the longest phrases that the automaton knows; the
language that needs the fewest phrases per letter wins. Words are parsed one
by one, each with its leading space, so a phrase never crosses a word's end,
the distinct words of a run of texts are parsed together in numpy and a
document is the sum over its words, whatever its length. Ties go to the language whose phrases are more
frequent in its sample, then to the smaller name.

Learned: text and language of documents whose crc32(id) mod 3 is not 1. The
sample has at most ``docs_per_language`` documents a language in hash order,
and of each up to ``pieces_per_document`` pieces of ``piece_chars`` characters,
drawn by hash from the whole text. Every letter of a language's sample is known
to its parser: the ``dense`` most frequent ones of that language by a table, the
others by a sorted list of transitions. A worker holds about
``docs_per_language * pieces_per_document * piece_chars`` letters a language;
more than ``max_languages`` languages are an error. Language, source and id are
no inputs of a prediction.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
so is every text when nothing can be learned; a null id is not held out and not
learned from; repeated rows get equal results; very long texts are read whole;
other input columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paddock.llm.decontaminate import NOT_ALNUM
from paddock.llm.text import Words, map_batches, pieces, utf8

UNKNOWN = "und"
NOT_LETTER = NOT_ALNUM.copy()
NOT_LETTER[48:58] = True


@dataclass(frozen=True)
class LanguageModel:
    docs_per_language: int = 64
    pieces_per_document: int = 4
    piece_chars: int = 250
    max_languages: int = 200  # what the driver and the workers can hold; more are an error, none is left out
    dense: int = 126  # letters of a language that its table has a column for
    longest: int = 64  # letters parsed in one go where no space comes


class SuffixAutomaton:
    """All substrings of a text; longest known phrases of a word."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.long, self.count = [-1], [0], [0]
        last = 0
        for ch in text:
            cur = self._state({}, self.long[last] + 1, 1)
            p = last
            while p >= 0 and ch not in self.next[p]:
                self.next[p][ch] = cur
                p = self.link[p]
            if p < 0:
                self.link[cur] = 0
            else:
                q = self.next[p][ch]
                if self.long[p] + 1 == self.long[q]:
                    self.link[cur] = q
                else:
                    twin = self._state(dict(self.next[q]), self.long[p] + 1, 0)
                    self.link[twin] = self.link[q]
                    while p >= 0 and self.next[p].get(ch) == q:
                        self.next[p][ch] = twin
                        p = self.link[p]
                    self.link[q] = self.link[cur] = twin
            last = cur
        for state in sorted(range(1, len(self.next)), key=self.long.__getitem__, reverse=True):
            self.count[self.link[state]] += self.count[state]  # occurrences of a state's phrases
        self.size = max(1, len(text))

    def _state(self, arrows: dict[str, int], long: int, count: int) -> int:
        self.next.append(arrows)
        self.link.append(0)
        self.long.append(long)
        self.count.append(count)
        return len(self.next) - 1

    def table(self, alphabet: dict[str, int], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Transitions of the alphabet's letters as a dense table (state, letter) -> state, 0 where there is
        none; those of all other letters as sorted keys (state, code point) and their states."""
        out = np.zeros((len(self.next), width), dtype=np.int32)
        rare = []
        for state, arrows in enumerate(self.next):
            for ch, to in arrows.items():
                if ch in alphabet:
                    out[state, alphabet[ch]] = to
                else:
                    rare.append((state << 21 | ord(ch), to))
        rare.sort()
        keys = np.array([k for k, _ in rare], dtype=np.int64)
        return out, keys, np.array([to for _, to in rare], dtype=np.int32)


def letters(text: str) -> str:
    """Lower-case words of letters, each with a leading space."""
    return "".join(c if c.isalpha() else " " for c in text.lower())


def normalised(text: str) -> str:
    return " " + " ".join(letters(text).split())


@lru_cache(maxsize=1)
def letter_mask() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


class Parser:
    """Cross-parses of words in all languages of a sample."""

    def __init__(self, samples: tuple[tuple[str, str], ...], dense: int):
        self.codes, self.tables, self.rare, self.weights, self.sizes = [], [], [], [], []
        for _, text in samples:
            frequent = Counter(text)
            frequent.pop(" ", None)
            # 0 is any other letter, 1 the space before a word
            known = {c: i + 2 for i, (c, _) in enumerate(sorted(
                frequent.items(), key=lambda x: (-x[1], x[0]))[:dense])} | {" ": 1}
            codes = np.zeros(0x110000, dtype=np.int16)
            for c, i in known.items():
                codes[ord(c)] = i
            automaton = SuffixAutomaton(text)
            table, keys, to = automaton.table(known, len(known) + 1)
            self.codes.append(codes)
            self.tables.append(table)
            self.rare.append((keys, to))
            self.weights.append(np.log(np.maximum(automaton.count, 1)) - math.log(automaton.size))
            self.weights[-1][0] = 0.0
            self.sizes.append(automaton.size)

    def step(self, j: int, state: np.ndarray, code: np.ndarray, point: np.ndarray) -> np.ndarray:
        """States of language j after one more letter, 0 where no phrase goes on with it."""
        then = np.where(code > 0, self.tables[j][state, code], 0)
        keys, to = self.rare[j]
        other = np.flatnonzero(code == 0)
        if len(keys) and len(other):
            wanted = state[other].astype(np.int64) << 21 | point[other]
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            then[other] = np.where(keys[at] == wanted, to[at], 0)
        return then

    def parse(self, words: list[bytes], longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Letters (word), phrases and log frequencies (word, language) of distinct words."""
        text = b"\n".join(words).decode("utf-8").lower() + "\n"
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        owner = np.cumsum(points == 10) - (points == 10)
        letter = letter_mask()[points]
        place = np.arange(len(points))
        begin = np.flatnonzero(letter & ~np.concatenate([[False], letter[:-1]]))
        # a run longer than ``longest`` letters is parsed in parts
        since = place - np.maximum.accumulate(np.where(np.isin(place, begin), place, 0))
        start = np.flatnonzero(letter & (since % longest == 0))
        stop = np.flatnonzero(letter & (~np.concatenate([letter[1:], [False]]) | (since % longest == longest - 1))) + 1
        order = np.argsort(start - stop, kind="stable")
        start, size, run_owner = start[order], (stop - start)[order], owner[start[order]]
        phrases = np.zeros((len(words), len(self.tables)))
        likely = np.zeros((len(words), len(self.tables)))
        for j, weight in enumerate(self.weights):
            codes = self.codes[j][points]
            state = np.full(len(start), self.tables[j][0, 1])
            count, odds = np.zeros(len(start)), np.zeros(len(start))
            for step in range(int(size[0]) if len(size) else 0):
                k = int(np.searchsorted(-size, -step))  # runs longer than ``step``
                ch, point, now = codes[start[:k] + step], points[start[:k] + step], state[:k]
                then = self.step(j, now, ch, point)
                miss = np.flatnonzero(then == 0)
                old = now[miss]
                count[miss] += old > 0
                odds[miss] += weight[old]
                again = self.step(j, np.zeros_like(old), ch[miss], point[miss])
                count[miss] += again == 0  # an unknown letter is a phrase of its own
                odds[miss] -= np.where(again == 0, math.log(2 * self.sizes[j]), 0.0)
                then[miss] = again
                state[:k] = then
            count += state > 0
            odds += weight[state]
            phrases[:, j] = np.bincount(run_owner, weights=count, minlength=len(words))
            likely[:, j] = np.bincount(run_owner, weights=odds, minlength=len(words))
        return np.bincount(owner[letter], minlength=len(words)), phrases, likely


@lru_cache(maxsize=2)
def parser(samples: tuple[tuple[str, str], ...], dense: int) -> Parser:
    """The parser of a sample, once per worker."""
    return Parser(samples, dense)


def predict(texts: pa.Array, samples: tuple[tuple[str, str], ...],
            model: LanguageModel) -> tuple[list[str], np.ndarray]:
    """Language and score of every text."""
    rows = len(texts)
    data, offsets = utf8(texts)
    words = Words(data, offsets, NOT_LETTER)
    hashes = words.hashes(lower=True)
    _, where, place = np.unique(hashes, return_index=True, return_inverse=True)
    raw, n = data.tobytes(), len(samples)
    distinct = [raw[a:b] for a, b in zip(words.start[where].tolist(), words.end[where].tolist(), strict=True)]
    count, phrases, likely = parser(samples, model.dense).parse(distinct, model.longest)
    total = np.bincount(words.row, weights=count[place], minlength=rows)
    sums = np.stack([np.bincount(words.row, weights=phrases[place, j], minlength=rows) for j in range(n)], axis=1) \
        if n else np.zeros((rows, 0))
    odds = np.stack([np.bincount(words.row, weights=likely[place, j], minlength=rows) for j in range(n)], axis=1) \
        if n else np.zeros((rows, 0))
    names, score = [], np.zeros(rows)
    for row in range(rows):
        if not total[row] or not n:
            names.append(UNKNOWN)
            continue
        # equal divisor for all languages: phrases per letter
        rate = sums[row] / total[row]
        best = min(range(n), key=lambda j: (rate[j], -round(odds[row, j], 6), samples[j][0]))
        names.append(samples[best][0])
        score[row] = 1 / np.exp(np.maximum(sums[row, best] - sums[row], -50)).sum()
    return names, score


def language_samples(docs: DataFrame, model: LanguageModel) -> tuple[tuple[str, str], ...]:
    """(language, normalised text) of the learned sample; bounded by the model's limits."""
    learned = docs.filter("lang IS NOT NULL AND text IS NOT NULL AND crc32(CAST(id AS STRING)) % 3 <> 1").select(
        "lang", "text", F.xxhash64("id").alias("h"), "id")
    # pieces of the whole text, the first by hash
    size, most = model.piece_chars, model.pieces_per_document
    drawn = learned.withColumn("parts", F.expr(
        f"slice(array_sort(transform(sequence(0, int((length(text) - 1) / {size})), "
        f"i -> struct(xxhash64(h, i) AS r, i AS i))), 1, {most})")).withColumn(
        "parts", F.expr(f"transform(parts, p -> substring(text, p.i * {size} + 1, {size}))")).drop("text")
    # the rank limit is applied before the shuffle too, so a frequent language sends few rows
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id", "parts"))
    chosen = drawn.withColumn("rank", rank).filter(F.col("rank") <= model.docs_per_language)
    rows = chosen.select("lang", "parts").limit(model.docs_per_language * model.max_languages + 1).collect()
    texts: dict[str, list[str]] = {}
    for r in rows:
        texts.setdefault(r.lang, []).extend(normalised(p) for p in r.parts)
    if len(rows) > model.docs_per_language * model.max_languages or len(texts) > model.max_languages:
        raise ValueError(f"more than {model.max_languages} languages to learn")
    return tuple((lang, "".join(sorted(t))) for lang, t in sorted(texts.items()))


def identify(docs: DataFrame, model: LanguageModel = LanguageModel(), *, id_col: str = "doc_id",
             text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id, ``held_out``, ``lang_pred`` and ``score``. A narrow map after the sample."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                       F.col(lang_col).cast("string").alias("lang"))
    samples = language_samples(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                names, score = predict(part.column("text"), samples, model)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(score)],
                    [id_col, "held_out", "lang_pred", "score"])

    held_out = F.coalesce(F.crc32(F.col("id").cast("string")) % 3 == 1, F.lit(False))
    kind = docs.schema["id"].dataType.simpleString()
    return map_batches(docs.select("id", held_out.alias("held_out"), "text"), run,
                       f"{id_col} {kind}, held_out boolean, lang_pred string, score double")
