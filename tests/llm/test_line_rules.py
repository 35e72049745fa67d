import re
from collections import Counter

from paddock.llm.line_rules import line_quality

WORD = re.compile("[^\x20\x09-\x0D]+")
GOOD = "The quick brown fox jumps over the lazy dog near the river bank today. "


def base(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    repeated = {i + j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeated), failed)


def test_base_counts_against_brute_force(docs_of, spark):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in given] + [
        (-1, None), (-2, ""), (-3, "\n\n \n"), (-4, "a b\na b\n\n a b"), (-5, "w " * 30000), (-6, "x" * 100000),
        (-7, GOOD * 3), (-7, GOOD * 3), (None, GOOD)]
    out = line_quality(docs_of(rows)).collect()
    assert len(out) == len(rows)
    text_of = dict(rows)
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(
            text_of[r.doc_id])
        assert not (r.kept and r.base_failed)


def test_lines_are_judged_first_then_documents(docs_of):
    fine = (GOOD.strip() + "\nLater that evening a small owl watched them both from its old tree.\n"
            "Nobody in the village knew why the animals met there every single night.")
    menu = "Home | News | Sport | Contact | About us"
    rows = [(1, fine), (2, menu + "\n" + fine + "\nAccept all cookies"), (3, "\n".join([f"{menu} | Page {c}" for c in "abcdefghi"] + [GOOD])),
            (4, " ".join(w.upper() + "!!" for w in fine.split()))]
    out = {r.doc_id: r for r in line_quality(docs_of(rows)).collect()}
    assert out[1].kept and out[1].n_bad_lines == 0 and out[1].clean_text == fine
    assert out[2].kept and out[2].n_bad_lines == 2 and out[2].clean_text == fine
    assert not out[3].kept and not out[4].kept


def test_empty_table(docs_of):
    assert line_quality(docs_of([])).count() == 0
