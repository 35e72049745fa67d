import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paddock.llm.queries import op13_suffix_dedup
from paddock.llm.suffix_dedup import SuffixIndex, SuffixRules, drop_repeats, entries, picked, repeated_spans
from paddock.llm.text import utf8


def brute(texts, length):
    """Per text: removed runs and kept bytes, by counting every window."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(int)))
        out.append((len(b), edge[::2].tolist(), edge[1::2].tolist(), bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])))
    return out


def corpus(rng, n, alphabet="abcdefghijklmnop é日"):
    def prose(k):
        return "".join(rng.choice(alphabet) for _ in range(k))
    passages = [prose(rng.randint(20, 160)) for _ in range(4)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.15:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.35:  # a copy with edits
            t = list(rng.choice(texts) or "")
            for _ in range(rng.randint(1, 4)):
                if t:
                    t[rng.randrange(len(t))] = rng.choice("XYZ")
            texts.append("".join(t))
        elif kind < 0.8:
            parts = [prose(rng.randint(0, 90)) for _ in range(3)]
            texts.append(rng.choice(passages).join(parts[:rng.randint(1, 3)]) + rng.choice(passages)[:rng.randint(0, 90)])
        elif kind < 0.9:
            texts.append("ab" * rng.randint(0, 120) + prose(5))
        else:
            texts.append(rng.choice([None, "", prose(30), "z" * 200]))
    return texts


@pytest.mark.parametrize("seed,most", [(0, 1_000), (1, 2), (2, 4)])
def test_equals_brute_force(docs_of, seed, most):
    texts = corpus(random.Random(seed), 60)
    how = SuffixRules(length=50, gram=10, most=most)
    got = {r.doc_id: r for r in drop_repeats(docs_of(list(enumerate(texts))), how).collect()}
    for i, (n, starts, stops, kept) in enumerate(brute(texts, 50)):
        assert (got[i].n_bytes, got[i].starts, got[i].stops, bytes(got[i].kept)) == (n, starts, stops, kept), i


def test_blocks_do_not_change_entries():
    rng = random.Random(1)
    data, offsets = utf8(pa.array([t or "" for t in corpus(rng, 80)] + ["y" * 700]))
    how = SuffixRules(length=50, gram=10)

    def flat(how):
        parts = list(picked(data, offsets, how))
        return sorted(zip(*(np.concatenate(c).tolist() for c in zip(*parts)), strict=True))

    assert flat(how) == flat(SuffixRules(length=50, gram=10, block=137)) == flat(SuffixRules(length=50, gram=10, block=64))


def test_batches_do_not_change_the_result_and_levels_merge_geometrically(spark):
    texts = corpus(random.Random(9), 80)
    docs = spark.createDataFrame([(i, t or "") for i, t in enumerate(texts)], "rid long, text string")
    how, want = SuffixRules(length=50, gram=10), None
    for batches in (1, 5):
        spans = {(r.rid, r.at, tuple(sorted(r.windows or []))) for r in repeated_spans(docs, how, batches).collect()}
        assert want is None or spans == want
        want = spans
    index, every, sizes = SuffixIndex(), entries(docs, how), []
    for k in range(6):
        index.settle()
        index.add(every.filter(F.pmod("rid", F.lit(6)) == k))
        sizes.append([n for n, _ in index.levels])
    assert sizes == [[1], [1, 1], [2, 1], [2, 1, 1], [4, 1], [4, 1, 1]]
    counted = every.groupBy("key").count().filter("count > 1")
    assert {r.key for r in index.matches().collect()} == {r.key for r in counted.collect()}


def test_odd_rows(docs_of):
    same = "q" * 30 + "".join(map(str, range(80)))
    rows = [(1, None), (2, ""), (3, "short"), (None, same), (None, same), (4, "x" * 500), (5, same[:200]), (6, "p" * 199),
            (7, "p" * 199), (8, "é" * 100), (8, "é" * 100)]
    got = sorted(drop_repeats(docs_of(rows)).collect(), key=str)
    want = sorted(((i, *w) for (i, _), w in zip(rows, brute([t for _, t in rows], 200), strict=True)), key=str)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.starts, r.stops, bytes(r.kept)) for r in got) == \
        sorted((i is None, i or 0, n, a, b, k) for i, n, a, b, k in want)


def test_empty_table(docs_of):
    assert drop_repeats(docs_of([(1, "a")]).limit(0)).count() == 0


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(4)
    texts = [" ".join(t or "" for t in corpus(rng, 4)) for _ in range(60)]
    texts += [texts[3], texts[5][:400] + "!" + texts[5][400:], None, "head " + texts[7][:260] + " tail"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: tuple(r)[1:] for r in op13_suffix_dedup(spark, str(tmp_path)).collect()}
    for i, (n, starts, stops, kept) in enumerate(brute(texts, 200)):
        assert got[i] == (n, sum(stops) - sum(starts), len(starts), hashlib.sha256(kept).hexdigest()), i
