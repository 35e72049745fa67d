import random

import numpy as np

from paddock.llm.substring_dedup import PassageRules, compact_windows, drop_passages, passages, repeated_passages
from paddock.llm.text import U64


def test_compact_windows_against_definition():
    rng = np.random.RandomState(3)
    for n, width, top in ((1, 1, 9), (30, 4, 6), (60, 7, 1000), (60, 60, 5), (20, 30, 9)):
        values = rng.randint(1, top + 1, n).astype(U64)
        left, c, right = compact_windows(values, np.zeros(n, np.int64), np.array([0]), np.array([n - 1]), width)
        found = {(int(a), int(b)): int(m) for a, m, b in zip(left, c, right, strict=True)}
        for i in range(n):
            for j in range(i + width - 1, n):
                low = i + int(np.argmin(values[i:j + 1]))  # the leftmost minimum
                assert sum(a <= i and j <= b and m == low for (a, b), m in found.items()) == 1


def test_runs_join_while_shared():
    rules = PassageRules(min_words=12, size=3)
    shared = np.array([1] * 20 + [0] * 3 + [1] * 20 + [0] * 60 + [1] * 4, dtype=bool)
    assert passages(shared, rules) == [(0, 43)]


def texts_with_passages(rng):
    vocabulary = [f"v{i}" for i in range(3000)]

    def words(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    shared = [words(n) for n in (50, 51, 60, 90, 300)]
    line = words(30)  # shorter than a passage, very common
    texts = {}
    for i in range(120):
        parts = [words(rng.randint(0, 150))]
        if i % 3 == 0:
            parts += [rng.choice(shared), words(rng.randint(0, 80))]
        if i % 4 == 0:
            parts.append(line)
        if i % 17 == 0:
            parts += [line, shared[1][:20], words(5)]
        texts[i] = " ".join(w for p in parts for w in p)
    texts[200] = texts[201] = " ".join(words(70)).upper()
    texts[202] = texts[200].lower()
    return texts


def test_exact_repeats_are_covered_and_clean_text_is_not(docs_of):
    texts = texts_with_passages(random.Random(11))
    rows = list(texts.items()) + [(300, None), (301, ""), (302, " "), (303, "short text"), (303, "short text"),
                                  (None, texts[200])]
    found = repeated_passages(docs_of(rows))
    cover = {}
    for r in found.collect():
        assert r.ref_doc_ids and max(r.ref_doc_ids) < r.doc_id and r.n_words == r.end_word - r.start_word >= 50
        cover.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    first, need = {}, {}
    for i in sorted(texts):
        w = texts[i].lower().split()
        windows = [tuple(w[j:j + 50]) for j in range(len(w) - 49)]
        for j, key in enumerate(windows):
            if key in first:
                need.setdefault(i, set()).update(range(j, j + 50))
        for key in windows:
            first.setdefault(key, i)
    assert len(need) > 25
    for i, span in need.items():
        assert span <= cover[i]
    line = set(texts[4].split()[-30:])  # may continue a repeat, being shared as well
    for i, span in cover.items():  # nothing but the repeats and at most a shingle around them
        w = texts[i].split()
        assert i in need and len([j for j in span - need[i] if w[j] not in line]) <= 10

    cut = {r.doc_id: r.text for r in drop_passages(docs_of(rows), found).collect() if r.doc_id is not None}
    for i, span in cover.items():
        assert cut[i].split() == [w for j, w in enumerate(texts[i].split()) if j not in span]
    assert cut[300] is None and cut[301] == "" and cut[303] == "short text" and cut[200] == texts[200]


def test_edited_passages(docs_of):
    rng = random.Random(2)
    base = [f"p{rng.randrange(10**6)}" for _ in range(150)]
    edited = list(base)
    for at in (30, 75, 120):
        edited[at] = "changed"
    fresh = [f"q{i}" for i in range(200)]
    rows = [(1, " ".join(fresh[:60] + base)), (2, " ".join(edited + fresh[100:180]))]
    out = repeated_passages(docs_of(rows)).collect()
    assert {(r.doc_id, *r.ref_doc_ids) for r in out} == {(2, 1)}
    assert max(r.n_words for r in out) >= 140


def fresh_words(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def test_line_repeated_in_the_first_document(docs_of):
    rng, rows, want = random.Random(5), [], set()
    for k in range(0, 240, 10):
        line = fresh_words(rng, 42)
        passage = fresh_words(rng, 5) + line + fresh_words(rng, 5)
        # the line early, then the passage that contains it; or a first document with the line only
        own = passage if k % 20 else []
        first = line + fresh_words(rng, 20) if k % 40 < 20 else fresh_words(rng, 50) + line + fresh_words(rng, 50)
        rows.append((k, " ".join(first + own + fresh_words(rng, 30))))
        for j in (1, 2):
            rows.append((k + j, " ".join(fresh_words(rng, 9 * j) + passage + fresh_words(rng, 11))))
            if own or j == 2:
                want.add((k + j, 9 * j))
    found = {}
    for r in repeated_passages(docs_of(rows)).collect():
        found.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
    assert {(i, a) for i, a in want if any(b <= a and a + 52 <= e for b, e in found.get(i, ()))} == want


def test_edited_passages_around_a_line_of_an_unlike_first_document(docs_of):
    rng, rows = random.Random(6), []
    for k in range(0, 300, 10):
        a, line, b = fresh_words(rng, 14), fresh_words(rng, 49), fresh_words(rng, 14)
        rows.append((k, " ".join(fresh_words(rng, 60) + line + fresh_words(rng, 60))))
        rows.append((k + 1, " ".join(fresh_words(rng, 40) + a + line + b + fresh_words(rng, 40))))
        a[-1] = b[0] = "changed"  # 63 of 73 shingles stay, the longest exact run has 49 words
        rows.append((k + 2, " ".join(fresh_words(rng, 30) + a + line + b + fresh_words(rng, 30))))
    found = {(r.doc_id, p) for r in repeated_passages(docs_of(rows)).collect() for p in r.ref_doc_ids}
    assert found <= {(k + 2, k + 1) for k in range(0, 300, 10)} and len(found) >= 27


def test_best_segments_against_all_segments():
    rng, rules = np.random.RandomState(8), PassageRules(min_words=14, size=3)
    for _ in range(300):
        shared = np.repeat(rng.rand(12) < 0.7, rng.randint(1, 14, 12))
        found = passages(shared, rules)
        for a in range(len(shared)):
            for b in range(a + rules.width, len(shared) + 1):
                if shared[a] and shared[b - 1] and 100 * shared[a:b].sum() >= rules.percent * (b - a):
                    assert any(a < e and s < b for s, e in found)


def test_inserted_words(docs_of):
    for n, more in ((80, 7), (90, 10), (70, 6), (100, 12)):
        rng, rows, want = random.Random(n), [], {}
        for k in range(0, 80, 10):
            passage = fresh_words(rng, n)
            longer = passage[:n // 2] + fresh_words(rng, more) + passage[n // 2:]
            first, second = (longer, passage) if k % 20 else (passage, longer)
            rows.append((k, " ".join(fresh_words(rng, 20) + first + fresh_words(rng, 30))))
            rows.append((k + 1, " ".join(fresh_words(rng, 40) + second + fresh_words(rng, 20))))
            want[k + 1] = {j for j, w in enumerate(second, 40) if w in passage}, set(range(40, 40 + len(second)))
        found = {}
        for r in repeated_passages(docs_of(rows)).collect():
            assert r.ref_doc_ids == [r.doc_id - 1]
            found.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
        # two halves that are passages of their own leave the inserted words out
        assert all(found[i] <= want[i][1] for i in found), (n, more)
        assert sum(want[i][0] <= found.get(i, set()) for i in want) >= 7, (n, more)


def test_empty_table(docs_of):
    none = docs_of([])
    assert repeated_passages(none).count() == 0
    assert drop_passages(none, repeated_passages(none)).count() == 0
