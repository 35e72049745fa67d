import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paddock.llm.quality import QualityModel, document_features, fit, judge_quality, predict

LABELS = "doc_id long, quality int, toxic int, text string"


def corpus(rng, n=400):
    rows, labels = [], []
    for i in range(n):
        kind = i % 8
        words = [f"w{rng.randrange(800)}" for _ in range(rng.randint(20, 120))]
        if kind == 0:
            words = [w.upper() + "!!" for w in words]
        if kind == 1:
            words[rng.randrange(len(words))] = "insult"
            words[rng.randrange(len(words))] = "slur"
        rows.append((i, " ".join(words), "en", f"host{i % 5}/sec"))
        labels.append((i, int(kind != 0), int(kind == 1), "t"))
    return rows, labels


def test_features_are_sets_and_sorted_by_text():
    ids, counts = document_features(pa.array(["b a b", None, "", "A, b"]), 1 << 12)
    parts = np.split(ids, np.cumsum(counts)[:-1])
    assert all(len(set(p.tolist())) == len(p) for p in parts)
    assert set(parts[0][parts[0] >= 256].tolist()) == set(parts[3][parts[3] >= 256].tolist())
    assert len(parts[1]) == len(parts[2]) and (parts[1] < 256).all()


def test_fit_tells_classes_apart_and_one_class_gives_the_default():
    model = QualityModel(features=64, penalty=0.01)
    rng = np.random.RandomState(0)
    labels = (rng.rand(300) < 0.3).astype(float)
    ids = np.stack([np.where(labels > 0, 1, 2), rng.randint(3, 64, 300)], axis=1).ravel()
    counts = np.full(300, 2)
    assert ((predict(ids, counts, *fit(ids, counts, labels, model)) > 0.5) == (labels > 0)).mean() > 0.98
    assert predict(ids, counts, *fit(ids, counts, np.zeros(300), model)) == pytest.approx(model.default_rate)


def test_held_out_accuracy(docs_of, spark):
    rows, labels = corpus(random.Random(1), 2400)
    out = {r.doc_id: r for r in judge_quality(docs_of(rows), spark.createDataFrame(labels[:1600], LABELS)).collect()}
    wrong = [i for i, q, t, _ in labels[1600:] if out[i].kept != (q == 1 and t == 0)]
    assert len(wrong) <= 8


def test_given_tables_keep_clean_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    train = labels.filter(F.col("doc_id") % 2 == 0)
    out = judge_quality(spark.read.parquet(f"{sf}/documents.parquet"), train)
    rates = out.join(labels.filter(F.col("doc_id") % 2 == 1), "doc_id").groupBy("quality", "toxic").agg(
        F.avg(F.col("kept").cast("double")).alias("kept")).collect()
    rate = {(r.quality, r.toxic): r.kept for r in rates}
    assert rate[1, 0] > 0.98 and rate[0, 0] < 0.1 and rate[1, 1] < 0.5


def test_site_rates_are_shrunk_sums(docs_of, spark):
    rows, labels = corpus(random.Random(3))
    out = judge_quality(docs_of(rows), spark.createDataFrame(labels, LABELS)).toPandas()
    assert out.site_rate.between(0, 1).all() and len(out) == len(rows)
    overall = (1 - (1 - out.p_low) * (1 - out.p_toxic)).mean()
    assert abs(out.site_rate.mean() - overall) < 0.1


def test_odd_rows(docs_of, spark):
    rows, labels = corpus(random.Random(2), 60)
    rows += [(100, None), (101, ""), (102, "x" * 300000), (None, "no id", None, None), (1, rows[1][1], "en", rows[1][3])]
    labels += [(1, 1, None, "t"), (None, 1, 0, "t"), (2, None, 1, "t"), (999, 0, 0, "t")]
    out = judge_quality(docs_of(rows), spark.createDataFrame(labels, LABELS)).collect()
    assert len(out) == len(rows) and all(r.kept is not None for r in out)
    none = spark.createDataFrame([], LABELS)
    assert judge_quality(docs_of(rows), none).filter("NOT kept").count() == 0
    assert judge_quality(docs_of([]), spark.createDataFrame(labels, LABELS)).count() == 0


def planted_sites(rng):
    """Hosts of bad or of clean documents, with documents that their text alone leaves open: rows, labels, open ids."""
    rows, labels, unsure = [], [], {}

    def add(kind, source, labelled=None):
        words = [f"w{rng.randrange(400)}" for _ in range(60)]
        if kind == "bad":
            words = ["junk", "spam", *words]
        if kind == "open":
            words = ["perhaps", *words]
        rows.append((len(rows), " ".join(words), "en", source))
        if labelled is not None:
            labels.append((len(rows) - 1, labelled, 0, "t"))
        return len(rows) - 1

    for h in range(12):
        bad = h % 2 == 0
        for k in range(120):
            add("bad" if bad else "clean", f"h{h}/p{k % 3}", int(not bad) if k < 60 else None)
        for k in range(40):
            add("open", f"h{h}/p{k % 3}", int(k % 2 == 0) if k < 24 else None)
        unsure[h] = [i for i in range(len(rows) - 10, len(rows))]
    large = [add("clean", "h0/large") for _ in range(300)]  # a large clean path of a bad host
    sparse = add("open", "h0/sparse")
    return rows, labels, unsure, large, sparse


def direct_posterior(out, path_of):
    """Rates and posteriors recomputed in numpy from the documents' own evidence."""
    out = out.set_index("doc_id")
    p = 1 - (1 - out.p_low) * (1 - out.p_toxic)
    path, host = out.index.map(path_of), out.index.map(lambda i: path_of(i).split("/")[0])
    overall = p.mean()

    def strength(n, bad, m):
        m = np.clip(m, 1e-6, 1 - 1e-6)
        many = n > 1
        n, bad, m = n[many], bad[many], m[many] if np.ndim(m) else m
        m = m * np.ones(len(n))
        excess = max(0.0, (n * (bad / n - m) ** 2).sum() - (m * (1 - m)).sum()) / (n * m * (1 - m)).sum()
        return min(1000.0, max(1.0, 1 / excess - 1 if excess > 0 else 1000.0))

    hosts = p.groupby(host).agg(["size", "sum"])
    a = strength(hosts["size"].to_numpy(), hosts["sum"].to_numpy(), overall)
    host_rate = (hosts["sum"] + a * overall) / (hosts["size"] + a)
    paths = p.groupby(path).agg(["size", "sum"])
    of_path = np.array([host_rate[x.split("/")[0]] for x in paths.index])
    b = strength(paths["size"].to_numpy(), paths["sum"].to_numpy(), of_path)
    n, bad = paths["size"].loc[path].to_numpy(), paths["sum"].loc[path].to_numpy()
    site = (bad - p.to_numpy() + b * host_rate.loc[host].to_numpy()) / (n - 1 + b)

    def logit(x):
        x = np.clip(x, 1e-6, 1 - 1e-6)
        return np.log(x / (1 - x))
    return host_rate, site, 1 / (1 + np.exp(-(logit(p.to_numpy()) + logit(site) - logit(overall))))


def test_sites_decide_where_texts_do_not(docs_of, spark):
    rows, labels, unsure, large, sparse = planted_sites(random.Random(8))
    out = judge_quality(docs_of(rows), spark.createDataFrame(labels, LABELS)).toPandas().sort_values("doc_id")
    host_rate, site, posterior = direct_posterior(out, lambda i: rows[i][3])
    np.testing.assert_allclose(out.site_rate, site, rtol=1e-9)
    np.testing.assert_allclose(out.posterior, posterior, rtol=1e-9)
    own = out.set_index("doc_id")
    p = 1 - (1 - own.p_low) * (1 - own.p_toxic)
    undecided = [(h, i) for h, some in unsure.items() for i in some if 0.3 <= p[i] <= 0.7]
    assert len(undecided) >= 30
    assert all(own.kept[i] == (h % 2 == 1) for h, i in undecided)  # the site decides where the text does not
    assert any(own.kept[i] != (p[i] < QualityModel().reject) for _, i in undecided)
    assert abs(own.site_rate[sparse] - host_rate["h0"]) < 0.02  # a sparse path moves to its host
    assert own.site_rate[large].max() < 0.15 < host_rate["h0"]  # a large one does not
    assert own.kept[large].mean() > 0.98


def test_repeated_labelled_ids_are_learned_alike(docs_of, spark):
    rows, labels = corpus(random.Random(5), 120)
    rows += [(i, "other text altogether", "en", "host0/sec") for i in range(0, 120, 3)]
    known = spark.createDataFrame(labels, LABELS)
    one = judge_quality(docs_of(rows), known).groupBy("doc_id").agg(F.sum("p_low").alias("p")).collect()
    two = judge_quality(docs_of(rows[::-1]).repartition(7), known).groupBy("doc_id").agg(F.sum("p_low").alias("p")).collect()
    assert {r.doc_id: pytest.approx(r.p) for r in one} == {r.doc_id: r.p for r in two}
