import random
import re

import numpy as np
import pyarrow as pa

from paddock.llm.text import Words, gather, pieces, shingle_sets, span_hashes, utf8

WORD = re.compile("[^\x20\x09-\x0D]+")
TEXTS = [None, "", " ", "a", "a b\tc\n", "  é ß  x ", "日本 語\r\nz", "w " * 300, "x" * 5000, "a\x0bb"]


def test_words_are_the_contract_words():
    words = Words(*utf8(pa.array(TEXTS, pa.string())))
    raw = words.data.tobytes()
    for i, text in enumerate(TEXTS):
        own = [raw[words.start[j]:words.end[j]].decode() for j in range(words.first[i], words.first[i + 1])]
        assert own == WORD.findall(text or "")


def test_words_of_sliced_and_empty_columns():
    column = pa.array(["skip me", "one two", None, "three"])[1:]
    words = Words(*utf8(column))
    assert np.diff(words.first).tolist() == [2, 0, 1]
    assert len(Words(*utf8(pa.array([], pa.string()))).start) == 0


def test_equal_words_hash_alike_wherever_they_are():
    rng = random.Random(1)
    text = " ".join(rng.choice(["aa", "ab", "é", "long" * 40, "b"]) for _ in range(3000))
    words = Words(*utf8(pa.array([text, "x " + text])))
    hashes = words.hashes()
    raw = words.data.tobytes()
    by_word = {}
    for h, a, b in zip(hashes.tolist(), words.start, words.end, strict=True):
        assert by_word.setdefault(raw[a:b], h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_spans_longer_than_a_block(monkeypatch):
    import paddock.llm.text as text
    data = np.frombuffer(b"abcdefghij" * 40 + b" " + b"abcdefghij" * 40, np.uint8)
    spans = np.array([0, 401]), np.array([400, 801])
    whole = span_hashes(data, *spans)
    monkeypatch.setattr(text, "_BLOCK", 64)
    monkeypatch.setattr(text, "_powers", {})
    parts = span_hashes(data, *spans)
    assert parts[0] == parts[1] and whole[0] == whole[1] and (whole == parts).all()


def test_pieces_keep_all_rows_in_order():
    batch = pa.RecordBatch.from_arrays([pa.array(["ab" * n for n in range(50)] + [None, "z" * 900])], ["text"])
    parts = list(pieces(batch, "text", 200))
    assert len(parts) > 3
    assert [t for p in parts for t in p.column(0).to_pylist()] == batch.column(0).to_pylist()


def test_shingle_sets_against_python():
    texts = ["a b c d e f", "A B c d e f", "a b", None, "", "a b c d " * 5, "one"]
    values, rows, sizes = shingle_sets(pa.array(texts, pa.string()), 4)
    for i, t in enumerate(texts):
        w = (t or "").lower().split()
        want = {tuple(w[j:j + 4]) for j in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
        assert sizes[i] == len(want)
    assert set(values[rows == 0].tolist()) == set(values[rows == 1].tolist())


def test_gather():
    assert gather(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]
