import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paddock.llm.components import components
from paddock.llm.jaccard_join import JaccardJoin, jaccard_components, overlap, regions
from paddock.llm.text import shingle_sets


def brute(rows, size, percent):
    """Component of every id by all pairs."""
    sets = {}
    for i, text in rows:
        w = (text or "").lower().split()
        sets.setdefault(i, []).append({tuple(w[j:j + size]) for j in range(len(w) - size + 1)} if len(w) >= size
                                      else {tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {i: root(i) for i in ids}


def family(rng, n, words, edits):
    """Texts that drift away from a base by single words: chains, clusters and borderline pairs."""
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [[rng.choice(vocabulary) for _ in range(words)]]
    for _ in range(n - 1):
        text = list(rng.choice(texts))
        for _ in range(rng.randint(0, edits)):
            at = rng.randrange(len(text))
            text[at:at + rng.choice((0, 1, 1))] = [rng.choice(vocabulary)] * rng.choice((0, 1, 1))
        texts.append(text)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_components_against_all_pairs(docs_of, size, percent):
    rng = random.Random(size)
    texts = [t for words in (3, 5, 6, 7, 9, 12, 20, 31, 60, 150, 400) for t in family(rng, 14, words, 4)]
    texts += [None, "", " \n", "one", "one", "two words", "TWO words"] + ["same text for all of us here now"] * 9
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(3, texts[3])]
    out = jaccard_components(docs_of(rows), JaccardJoin(size=size, percent=percent)).collect()
    want = brute(rows, size, percent)
    assert len(out) == len(rows)
    assert len(set(want.values())) < 0.9 * len(want)
    for r in out:
        assert r.component_id == want[r.doc_id], (r.doc_id, texts[r.doc_id])


def test_near_sets_share_a_region():
    rng = random.Random(5)
    how = JaccardJoin(size=4, percent=85)
    for words in (6, 8, 10, 14, 25, 40, 90, 200, 1500):
        texts = family(rng, 25, words, 3)
        values, rows, sizes = shingle_sets(pa.array(texts), 4)
        keys, counts = regions(values, rows, sizes, how)
        own = np.split(keys, np.cumsum(counts)[:-1])
        for a in range(len(texts)):
            for b in range(a):
                inter, union = overlap(pa.array([texts[a]]), pa.array([texts[b]]), 4)
                if 100 * inter[0] >= 85 * union[0]:
                    assert set(own[a].tolist()) & set(own[b].tolist()), (texts[a], texts[b])


def test_null_ids_and_empty_table(docs_of):
    out = jaccard_components(docs_of([(None, "a b c d e f"), (1, "a b c d e f"), (None, ""), (2, "a b c d e f")])).collect()
    assert sorted(((r.doc_id, r.component_id) for r in out), key=str) == [(1, 1), (2, 1), (None, None), (None, None)]
    assert jaccard_components(docs_of([])).count() == 0
    assert jaccard_components(docs_of([(1, None), (2, "")])).filter("component_id = doc_id").count() == 2


def test_repeated_ids_link_by_every_text(docs_of):
    rng = random.Random(11)
    a, b, c = ([f"{k}{rng.randrange(10 ** 9)}" for _ in range(60)] for k in "abc")
    near = [["x"] + t[1:] for t in (a, b, c)]
    rows = [(1, a), (1, b), (2, near[0]), (3, near[1]), (4, b[:59]), (9, c), (7, near[2]), (9, a), (0, a), (8, None), (8, c),
            (6, ["alone"] * 9)]
    for order in (rows, rows[::-1]):
        docs = docs_of([(i, None if t is None else " ".join(t)) for i, t in order]).repartition(3)
        out = {(r.doc_id, r.component_id) for r in jaccard_components(docs).collect()}
        assert out == {(i, 0) for i in (0, 1, 2, 3, 4, 7, 8, 9)} | {(6, 6)}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    out = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert {out[i] for i in range(41)} == {0} and {out[i] for i in range(100, 130)} == {100} and out[201] == 200
    none = spark.createDataFrame([], "a long, b long")
    assert components(none, "a", "b").filter(F.col("node").isNotNull()).count() == 0
