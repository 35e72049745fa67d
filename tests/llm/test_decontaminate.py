import random
import re
from dataclasses import replace

import numpy as np
import pyarrow as pa

from paddock.llm.decontaminate import Benchmark, LeakRules, WindowClass, benchmark_leaks
from paddock.llm.text import U64


def words(rng, n):
    return [f"t{rng.randrange(5000)}" for _ in range(n)]


def item_shingles(text):
    w = re.findall(r"[a-z0-9]+", text.lower())
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def test_multi_index_finds_all_within_radius():
    rng = np.random.RandomState(1)
    kind = WindowClass([(0, rng.randint(0, 2**63, 30).astype(U64))], 20, 0.75, 1)
    found = []
    for p in kind.prints:
        for flips in (0, 3, 8, 11, 12, 20):
            bits = rng.choice(64, flips, replace=False)
            found.append(int(p) ^ sum(1 << int(b) for b in bits))
    found = np.array(found, dtype=U64)
    w, e = kind.search(found, 11)
    want = {(i, j) for i, f in enumerate(found) for j, p in enumerate(kind.prints) if bin(int(f) ^ int(p)).count("1") <= 11}
    assert set(zip(w.tolist(), e.tolist(), strict=True)) == want


def test_planted_items_against_brute_force(docs_of, spark):
    rng = random.Random(4)
    items = {i: " ".join(words(rng, rng.choice((5, 6, 9, 15, 22, 40, 65)))) for i in range(60)}
    rows = []
    for d in range(300):
        text = words(rng, rng.randint(0, 200))
        if d % 3 == 0:
            item = items[rng.randrange(60)].split()
            if d % 6 == 0:
                item = [w.upper() + "," for w in item]
            at = rng.randint(0, len(text))
            text[at:at] = item
        rows.append((d, " ".join(text)))
    rows += [(400, None), (401, ""), (402, items[3]), (402, items[3]), (403, " ".join(words(rng, 20000)) + " " + items[5]),
             (None, items[6])]
    bench = spark.createDataFrame([(i, t, "k") for i, t in items.items()] + [(90, None, "k"), (91, " ", "k"), (92, items[3], "k")],
                                  "item_id long, text string, id string")
    out = benchmark_leaks(docs_of(rows), bench, replace(LeakRules(), block_items=20)).collect()
    got = {(r.doc_id, r.item_id) for r in out}
    assert len(got) == len(out)
    want = set()
    for d, text in rows:
        have = item_shingles(text or "")
        for i, item in [*items.items(), (92, items[3])]:
            own = item_shingles(item)
            if len(own & have) >= 0.8 * len(own):
                want.add((d, i))
    assert len(want) > 90 and got == want


def test_edited_items_are_found():
    rng = random.Random(9)
    items = [" ".join(words(rng, 60)) for _ in range(40)]
    known = Benchmark(list(range(40)), items, LeakRules())
    texts = []
    for item in items:
        w = item.split()
        w[rng.randrange(5, 55)] = "other"
        texts.append(" ".join(words(rng, rng.randint(10, 80)) + w + words(rng, 50)))
    found = {row for row, item, *_ in known.leaks(pa.array(texts)) if row == item}
    assert len(found) >= 0.9 * len(items)


def test_edited_items_just_above_the_share_against_brute_force():
    rng = random.Random(12)
    items = [" ".join(words(rng, n)) for n in (20, 30, 31, 34, 38, 40, 45, 50, 60, 80) for _ in range(10)]
    known = Benchmark(list(range(len(items))), items, LeakRules())
    texts, want = [], set()
    for i, item in enumerate(items):
        for _ in range(12):
            w = item.split()
            for _ in range(rng.randint(1, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = "other"
            have = item_shingles(" ".join(w))
            if 0.8 <= len(item_shingles(item) & have) / len(item_shingles(item)) < 0.95:
                want.add((len(texts), i))
                texts.append(" ".join(words(rng, rng.randint(0, 80)) + w + words(rng, 50)))
    found = {(row, item) for row, item, *_ in known.leaks(pa.array(texts))}
    assert len(want) > 600 and want <= found, (len(want & found), len(want))
    alone = Benchmark(list(range(len(items))), items, replace(LeakRules(), seeds=False))
    found = {(row, item) for row, item, *_ in alone.leaks(pa.array(texts))}
    assert len(want & found) >= 0.95 * len(want), (len(want & found), len(want))


def test_blocks_by_characters_find_the_same(docs_of, spark):
    rng = random.Random(3)
    items = [(i, " ".join(words(rng, 30))) for i in range(30)] + [(30, " ".join(words(rng, 5000)))]
    docs = docs_of([(i, " ".join(words(rng, 20)) + " " + t) for i, t in items])
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = {tuple(r) for r in benchmark_leaks(docs, bench).collect()}
    some = {tuple(r) for r in benchmark_leaks(docs, bench, replace(LeakRules(), block_chars=10_000)).collect()}
    assert one == some and len(one) == 31


def test_empty_tables(docs_of, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert benchmark_leaks(docs_of([(1, "a b c d e f g")]), none).count() == 0
    assert benchmark_leaks(docs_of([]), some).count() == 0
    assert benchmark_leaks(docs_of([(1, "x a b c d e f g")]), some).count() == 1
