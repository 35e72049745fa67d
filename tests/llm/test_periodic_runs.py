import hashlib
import random
import zlib

import numpy as np
import pytest

from paddock.llm.periodic_runs import find_runs, periodic_runs
from paddock.llm.queries import op12_periodic_runs
from paddock.llm.text import mix


def brute(words):
    """All runs by comparing every word with the word q places on, for every q."""
    n, out, seen = len(words), [], set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q) and (i, j + q) not in seen:
                seen.add((i, j + q))
                out.append((i, j + q - i, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_words(rng, n, letters):
    out = []
    while len(out) < n:
        if rng.random() < 0.4:
            q = rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 33, 40, 64])
            block = [rng.choice(letters) for _ in range(q)]
            if rng.random() < 0.3 and q > 4:  # a period with a periodic part inside
                block[:q - 2] = [block[0]] * (q - 2)
            length = int(q * rng.uniform(2.5, 6))
            out += [block[i % q] for i in range(length)]
        else:
            out += [rng.choice(letters) for _ in range(rng.randint(1, 12))]
    return out[:n]


def test_find_runs_equals_brute_force_on_many_rows_at_once():
    rng = random.Random(5)
    for _ in range(40):
        rows = [random_words(rng, rng.choice([0, 1, 5, 6, 40, 300, 700]), "ab" if rng.random() < .5 else "abcdefghij")
                for _ in range(6)]
        x = mix(np.array([ord(w) for r in rows for w in r], dtype=np.uint64))
        first = np.cumsum([0] + [len(r) for r in rows])
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        start, stop, q = find_runs(x, row, first)
        for k, words in enumerate(rows):
            mine = row[start] == k if len(row) else np.zeros(0, bool)
            got = list(zip((start - first[k])[mine].tolist(), (stop - start)[mine].tolist(), q[mine].tolist(), strict=True))
            assert got == brute(words), words


def test_fibonacci_word_has_no_run_of_exponent_four():
    a, b = "a", "ab"
    while len(b) < 3000:
        a, b = b, b + a
    x = mix(np.array([ord(c) for c in b], dtype=np.uint64))
    assert len(find_runs(x, np.zeros(len(x), np.int64), np.array([0, len(x)]))[0]) == 0 == len(brute(list(b[:800])))


@pytest.mark.parametrize("period", [1, 7, 8, 100, 2500])
def test_one_long_text(period):
    rng = random.Random(period)
    block = [rng.randrange(1 << 40) for _ in range(period)]
    words = [rng.randrange(1 << 40) for _ in range(77)] + block * 4 + block[:period // 2] + [5, 6]
    x = mix(np.array(words, dtype=np.uint64))
    got = [v.tolist() for v in find_runs(x, np.zeros(len(x), np.int64), np.array([0, len(x)]))]
    length = 4 * period + period // 2
    assert got == ([[77], [77 + length], [period]] if length >= 6 else [[], [], []])


def test_rows_with_nulls_blanks_repeats(docs_of):
    texts = [None, "", " \n ", "a", "x " * 6, "x\t\nx x x x", "a b " * 4 + "a", "é ü " * 4, "a b " * 4 + "a", "q " * 30000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "x " * 7), (3, "z z z z z z")]
    got = periodic_runs(docs_of(rows)).collect()
    assert len(got) == len(rows)
    want = []
    for i, t in rows:
        words = (t or "").split()
        runs = brute(words) if len(words) < 1000 else [(0, len(words), 1)]
        want.append((i, len(words), [r[0] for r in runs], [r[1] for r in runs], [r[2] for r in runs],
                     collapse(words, runs)))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_empty_table(docs_of, spark):
    assert periodic_runs(docs_of([(1, "a")]).limit(0)).count() == 0


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(random_words(rng, rng.choice([0, 3, 30, 200]), "abcdefgh"))) for i in range(400)] + [(7000, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: tuple(r)[1:] for r in op12_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        words = (text or "").split()
        n, h = len(words), zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs = brute(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
        lines = "".join(f"{s},{ln},{q}\n" for s, ln, q in runs)
        want = (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                hashlib.sha256(lines.encode()).hexdigest(),
                hashlib.sha256(collapse(words, runs).encode()).hexdigest())
        assert got[i] == want, i
