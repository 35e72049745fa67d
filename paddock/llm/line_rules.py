"""Quality rules, line first.

Every line is judged on its own (punctuation, navigation, boilerplate); failed
lines are removed; a document that loses too much of its text is rejected.
Base counts of the whole text (symbols, repeated lines, repeated 8-word
windows) reject a document before that.

Defined results: a null or blank text has 0 words and fails the base; lines
without a word are neither kept nor counted; equal lines are judged alike;
very long texts are handled whole; input columns other than ``id_col`` and
``text_col`` are ignored, so clashing names do no harm; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.text import ASCII_LOWER, Words, gather, map_batches, pieces, shingles, span_hashes, utf8


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules and of the document rules."""

    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    symbols: bytes = b"#*$%&|<>"
    terminal: bytes = b".!?:;\"')"
    navigation: bytes = b"|<>"
    max_symbol_words_percent: int = 30
    max_upper_percent: int = 70
    max_digit_percent: int = 50
    short_line_words: int = 3
    max_lost_percent: int = 50
    boilerplate: tuple[str, ...] = ("cookie", "javascript", "lorem ipsum", "terms of use", "privacy policy",
                                    "all rights reserved", "click here", "sign in", "subscribe")


# Verdict of a line: 0 kept, else the rule that failed it.
KEPT, PUNCTUATION, NAVIGATION, BOILERPLATE, REPEATED = range(5)

SCHEMA = ("id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, n_lines long, n_bad_lines long, clean_words long, clean_text string")


def _sums(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[end] - total[start]


def _repeated_words(hashes: np.ndarray, words: Words, rows: int, window: int) -> np.ndarray:
    """Words of each row that lie in a window found twice or more in that row."""
    runs, at = shingles(hashes, words.row, window)
    row = words.row[at]
    order = np.lexsort((runs, row))
    a, b = runs[order], row[order]
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    again = np.zeros(len(order), dtype=bool)
    again[1:] |= same
    again[:-1] |= same
    edge = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(edge, at[order[again]], 1)
    np.add.at(edge, at[order[again]] + window, -1)
    return np.bincount(words.row[np.cumsum(edge[:-1]) > 0], minlength=rows)


def judge(texts: pa.Array, rules: LineRules) -> dict[str, np.ndarray | pa.Array]:
    """The result columns (without the id) for a run of texts."""
    data, offsets = utf8(texts)
    rows = len(texts)
    words = Words(data, offsets)
    n_words = np.diff(words.first)
    lead = (data & 0xC0) != 0x80  # first byte of a character
    chars = np.bincount(words.row, weights=_sums(lead, words.start, words.end), minlength=rows).astype(np.int64)
    is_symbol = np.isin(data, np.frombuffer(rules.symbols, np.uint8))
    symbols = _sums(is_symbol, offsets[:-1], offsets[1:])
    hashes = words.hashes()
    repeated = _repeated_words(hashes, words, rows, rules.window)

    breaks = np.zeros(256, dtype=bool)
    breaks[10] = True
    lines = Words(data, offsets, breaks)
    first = np.searchsorted(words.start, lines.start)
    count = np.searchsorted(words.start, lines.end) - first
    full = count > 0
    start, end, row, first, count = (x[full] for x in (lines.start, lines.end, lines.row, first, count))
    line_hash = span_hashes(data, start, end)
    order = np.lexsort((np.arange(len(row)), line_hash, row))
    equal = np.zeros(len(row), dtype=bool)
    equal[order[1:]] = (line_hash[order[1:]] == line_hash[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    n_dup = np.bincount(row[equal], minlength=rows)

    # line rules, cheapest evidence first; the last byte of the last word ends the line
    verdict = np.zeros(len(row), dtype=np.int8)
    last = data[words.end[first + count - 1] - 1] if len(row) else np.zeros(0, np.uint8)
    terminal = np.isin(last, np.frombuffer(rules.terminal, np.uint8))
    verdict[~terminal & (count <= rules.short_line_words)] = PUNCTUATION
    noisy = _sums(_sums(is_symbol, words.start, words.end) > 0, first, first + count)
    verdict[100 * noisy > rules.max_symbol_words_percent * count] = PUNCTUATION
    width = _sums(lead, start, end)
    upper = _sums((data >= 65) & (data <= 90), start, end)
    letters = upper + _sums((data >= 97) & (data <= 122), start, end)
    verdict[(100 * upper > rules.max_upper_percent * letters) & (letters > 20)] = PUNCTUATION
    digits = _sums((data >= 48) & (data <= 57), start, end)
    verdict[100 * digits > rules.max_digit_percent * width] = PUNCTUATION
    bars = _sums(np.isin(data, np.frombuffer(rules.navigation, np.uint8)), start, end)
    verdict[(bars >= 2) & (5 * bars >= count)] = NAVIGATION
    lower = ASCII_LOWER[data].tobytes()
    for phrase in rules.boilerplate:
        needle, at = phrase.encode(), 0
        while (at := lower.find(needle, at)) >= 0:
            i = int(np.searchsorted(start, at, side="right")) - 1
            if i >= 0 and at < end[i] and 2 * len(needle) >= width[i]:
                verdict[i] = BOILERPLATE
            at += len(needle)
    verdict[equal & (verdict == KEPT)] = REPEATED

    good = verdict == KEPT
    clean_words = np.bincount(row[good], weights=count[good], minlength=rows).astype(np.int64)
    base = (n_words < rules.min_words) | (100 * repeated > rules.max_repeat_percent * n_words)
    kept = ~base & (100 * (n_words - clean_words) <= rules.max_lost_percent * n_words)

    # the kept lines of each row, joined by newlines
    length = (end - start)[good]
    joined = np.full(int(length.sum()) + len(length), 10, dtype=np.uint8)
    out_start = np.cumsum(length + 1) - (length + 1)
    joined[gather(out_start, length)] = data[gather(start[good], length)]
    size = np.bincount(row[good], weights=length + 1, minlength=rows).astype(np.int64)
    raw = joined.tobytes()
    bounds = np.zeros(rows + 1, dtype=np.int64)
    np.cumsum(size, out=bounds[1:])
    clean = [raw[a:max(a, b - 1)].decode("utf-8") for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": n_dup,
            "n_repeat_words": repeated, "base_failed": base, "kept": kept,
            "n_lines": np.bincount(row, minlength=rows), "n_bad_lines": np.bincount(row[~good], minlength=rows),
            "clean_words": clean_words, "clean_text": pa.array(clean, pa.string())}


def line_quality(docs: DataFrame, rules: LineRules = LineRules(), *, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per document: counts, verdict and the cleaned text (see SCHEMA).

    A narrow map over Arrow batches: no shuffle, memory bounded by a run of
    about one megabyte of text or by the longest text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                cols = judge(part.column("text"), rules)
                arrays = [part.column("id")] + [
                    v if isinstance(v, pa.Array) else pa.array(v if v.dtype == bool else v.astype(np.int64))
                    for v in cols.values()]
                yield pa.RecordBatch.from_arrays(arrays, ["id", *cols])

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(narrow, run, SCHEMA).withColumnRenamed("id", id_col)
