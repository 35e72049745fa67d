import math
import zlib

import pyarrow as pa
import pytest

from paddock.llm.language import LanguageModel, SuffixAutomaton, identify, normalised, parser, predict


def naive(text, word):
    """Greedy longest-match parse of a word against a text, and its log frequencies."""
    phrases, likely, at = 0, 0.0, 0
    while at < len(word):
        stop = at
        while stop < len(word) and word[at:stop + 1] in text:
            stop += 1
        phrases += 1
        if stop == at:
            likely -= math.log(2 * len(text))
            stop += 1
        else:
            count = sum(text.startswith(word[at:stop], i) for i in range(len(text)))
            likely += math.log(count / len(text))
        at = stop
    return phrases, likely


@pytest.mark.parametrize("dense", [126, 3, 0])
def test_parse_against_naive_search(dense):
    samples = (("a", normalised("the cat sat on the mat with that hat")), ("b", normalised("öl über züge äther ß")))
    words = ["the", "Cat", "hats", "zug", "ÜBER", "xyz", "that's", "ätherthe", "thethe", "é1a", "matmat" * 20]
    count, phrases, likely = parser(samples, dense).parse([w.encode() for w in words], 64)
    for i, w in enumerate(words):
        parts = normalised(w).split()
        parts = [p[a:a + 64] for p in parts for a in range(0, len(p), 64)]
        assert count[i] == sum(map(len, parts))
        for j, (_, text) in enumerate(samples):
            want = [naive(text, " " + p) for p in parts]
            assert phrases[i, j] == sum(p for p, _ in want)
            assert likely[i, j] == pytest.approx(sum(q for _, q in want))


def test_automaton_counts_occurrences():
    text = "abracadabra"
    automaton = SuffixAutomaton(text)
    for a in range(len(text)):
        state = 0
        for b in range(a, len(text)):
            state = automaton.next[state][text[b]]
            part = text[a:b + 1]
            assert automaton.count[state] == sum(text.startswith(part, i) for i in range(len(text)))


def test_held_out_accuracy_and_contract(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    out = identify(docs).collect()
    assert len(out) == len(truth)
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert r.lang_pred in set(truth.values()) | {"und"}
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_odd_rows(docs_of):
    rows = [(1, "hello there my friend", "en", "s"), (2, "bonjour mon ami la", "fr", "s"), (3, "hello there again", "en", "s"),
            (4, "le bonjour et la nuit", "fr", "s"), (6, "hello hello hello", "en", "s"), (8, "la nuit et le jour", "fr", "s"),
            (10, None, "en", "s"), (11, "", None, "s"), (12, "123 !!", "en", "s"), (13, "日本", None, "s"),
            (None, "hello", "en", "s"), (3, "hello there again", "en", "s"), (14, "x" * 200000, None, "s")]
    out = identify(docs_of(rows)).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert [by[i].lang_pred for i in (10, 11, 12)] == ["und"] * 3 and by[None].held_out is False
    assert by[10].score == 0.0 and by[1].lang_pred == "en" and by[4].lang_pred == "fr"
    assert identify(docs_of([])).count() == 0
    nothing = identify(docs_of([(1, "words", None, None)])).collect()
    assert nothing[0].lang_pred == "und"


def test_learns_only_from_the_other_folds(docs_of):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 1]
    out = identify(docs_of([(i, "zzz words", "xx", "s") for i in held])).collect()
    assert {r.lang_pred for r in out} == {"und"}


def test_no_samples():
    assert predict(pa.array(["a"]), (), LanguageModel())[0] == ["und"]


def test_every_part_of_a_text_and_every_letter_is_learned(docs_of):
    """Openings alike, the rest told apart by rare letters only; and many letters in each language."""
    head = "same opening words " * 200
    a = [chr(0x4e00 + i) for i in range(400)]
    b = [chr(0x5e00 + i) for i in range(400)]
    rows = []
    for i in range(80):
        letters = a if i % 2 else b
        rows.append((i, head + " ".join("".join(letters[(i * 7 + k * 3 + m) % 400] for m in range(3)) for k in range(900)),
                     "aa" if i % 2 else "bb", "s"))
    rows += [(1000 + i, "".join((a if i % 2 else b)[(i * 11 + m) % 400] for m in range(40)), None, "s") for i in range(20)]
    out = {r.doc_id: r.lang_pred for r in identify(docs_of(rows)).collect()}
    assert all(out[1000 + i] == ("aa" if i % 2 else "bb") for i in range(20))


def test_a_rare_language_beside_a_frequent_one(docs_of):
    rows = [(i, f"the house and the garden number {i} are over there", "en", "s") for i in range(300)]
    rows += [(500, "kissa istuu puussa ja katsoo alas", "fi", "s"), (502, "kissat ja koirat istuvat puussa", "fi", "s"),
             (503, "kissa ja koira istuu", "fi", "s"), (900, "koirat istuvat puussa", None, "s")]
    out = {r.doc_id: r.lang_pred for r in identify(docs_of(rows)).collect()}
    assert out[900] == "fi" and out[7] == "en"


def test_too_many_languages_are_an_error(docs_of):
    rows = [(i, "some words", f"l{i}", "s") for i in range(30)]
    with pytest.raises(ValueError, match="languages"):
        identify(docs_of(rows), LanguageModel(docs_per_language=2, max_languages=5))
