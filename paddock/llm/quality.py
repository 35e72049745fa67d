"""Quality classifier with hierarchical empirical Bayes site priors.

1. Document evidence: two logistic regressions (low quality, toxic) on the set
   of hashed words of the whole text plus coarse style features, fitted on a
   bounded, hash-ordered sample of the labelled documents.
2. Site evidence: the documents' probabilities are summed per host and per
   path (grouped aggregation over all documents). A host's rate is shrunk
   toward the global rate, a path's toward its host's; the strength of either
   prior is estimated from the spread between groups (method of moments).
3. Posterior: the document's log-odds, with the global prior replaced by its
   path's posterior (its own evidence left out). Documents with a posterior
   of ``reject`` or more are rejected.

For documents the host is ``source`` up to its first ``/`` and the path is the
rest of ``source`` with the language; both columns are parameters.

Defined results: a null or empty text has style features only; a null source
or language is a group of its own; repeated rows get equal results; labels
that are null are not used (a null ``toxic`` counts as 0), repeated labels
count once per distinct row, and of rows that repeat a labelled id the one whose
features come first is learned from; with labels of one class only a head gives
``default_rate``; very long texts are read whole; other input columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.llm.decontaminate import NOT_ALNUM
from paddock.llm.text import U64, Words, gather, list_array, map_batches, pieces, utf8
from paddock.session import materialize


@dataclass(frozen=True)
class QualityModel:
    features: int = 1 << 16
    max_labels: int = 20_000  # bound of the training sample
    epochs: int = 8
    batch: int = 32
    penalty: float = 0.11  # L1, times the square root of the sample size
    rate: float = 0.3
    max_balance: float = 3.0  # largest weight of the rarer class
    default_rate: float = 0.02
    max_strength: float = 1_000.0
    reject: float = 0.5


STYLE = 256  # the first feature ids are style features


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """A share on a logarithmic scale, 0 to 20."""
    return np.minimum(2 * np.log2(1 + 1000 * part / np.maximum(whole, 1)), 20).astype(np.int64)


def document_features(texts: pa.Array, features: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of every text, without repeats and sorted by text, and their number per text."""
    data, offsets = utf8(texts)
    rows = len(texts)
    words = Words(data, offsets, NOT_ALNUM)
    hashes = words.hashes(lower=True)
    ids = STYLE + (hashes >> U64(20)) % U64(features - STYLE)

    def total(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(mask, out=sums[1:])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    upper, lower = total((data >= 65) & (data <= 90)), total((data >= 97) & (data <= 122))
    marks, digits = total((data > 32) & (data < 128) & NOT_ALNUM[data]), total((data >= 48) & (data <= 57))
    n = np.diff(words.first)
    order = np.lexsort((hashes, words.row))
    h, r = hashes[order], words.row[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    distinct = np.bincount(r[fresh], minlength=rows)
    marked = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(np.isin(data, np.frombuffer(b"#*$%&", np.uint8)), out=marked[1:])
    shares = [(upper, upper + lower), (marks, upper + lower), (digits, upper + lower),
              (total(data == 33), n), (total(data == 124), n), (marked[offsets[1:]] - marked[offsets[:-1]], n),
              (n - distinct, n)]
    style = np.stack([21 * i + _share(*x) for i, x in enumerate(shares)]
                     + [21 * len(shares) + np.minimum(np.log2(n + 1).astype(np.int64), 20),
                        21 * (len(shares) + 1) + np.minimum(20 * distinct // np.maximum(n, 1), 20)], axis=1)
    all_rows = np.concatenate([np.repeat(np.arange(rows), style.shape[1]), r[fresh]])
    all_ids = np.concatenate([style.ravel(), ids[order][fresh].astype(np.int64)])
    key = np.unique(all_rows * features + all_ids)
    return key % features, np.bincount(key // features, minlength=rows)


def fit(ids: np.ndarray, counts: np.ndarray, labels: np.ndarray, model: QualityModel) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on a sparse 0/1 matrix.

    Follow-the-regularised-leader steps (McMahan et al. 2013) on small batches;
    the L1 penalty leaves only words that tell the classes apart."""
    weights, bias = np.zeros(model.features), float(np.log(model.default_rate / (1 - model.default_rate)))
    if not len(labels) or labels.min() == labels.max():
        return weights, bias
    first = np.cumsum(counts) - counts
    balance = np.where(labels > 0, min(model.max_balance, 0.5 / labels.mean()), 1.0)
    z, n = np.zeros(model.features + 1), np.zeros(model.features + 1)  # the last is the intercept
    order = np.random.RandomState(7)

    def solve(at):
        lean = np.where(at == model.features, 0.0, model.penalty * np.sqrt(len(labels)))
        return np.where(np.abs(z[at]) <= lean, 0.0,
                        -(z[at] - np.sign(z[at]) * lean) / ((1 + np.sqrt(n[at])) / model.rate + 1e-3))

    for _ in range(model.epochs):
        shuffled = order.permutation(len(labels))
        for begin in range(0, len(labels), model.batch):
            some = shuffled[begin:begin + model.batch]
            own = ids[gather(first[some], counts[some])]
            row = np.repeat(np.arange(len(some)), counts[some])
            used, place = np.unique(np.append(own, model.features), return_inverse=True)
            w = solve(used)
            score = w[-1] + np.bincount(row, weights=w[place[:-1]], minlength=len(some))
            wrong = balance[some] * (1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels[some])
            slope = np.bincount(place[:-1], weights=wrong[row], minlength=len(used))
            slope[-1] += wrong.sum()
            step = (np.sqrt(n[used] + slope ** 2) - np.sqrt(n[used])) / model.rate
            z[used] += slope - step * w
            n[used] += slope ** 2
    solved = solve(np.arange(model.features + 1))
    return solved[:-1], float(solved[-1])


def predict(ids: np.ndarray, counts: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    row = np.repeat(np.arange(len(counts)), counts)
    z = bias + np.bincount(row, weights=weights[ids], minlength=len(counts))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def training_sample(docs: DataFrame, labels: DataFrame, model: QualityModel) -> list:
    """Features and labels of at most ``max_labels`` labelled documents, the first in hash order."""
    chosen = labels.filter("quality IS NOT NULL").select(
        F.col("id").alias("label_id"), (F.col("quality") == 0).cast("double").alias("low"),
        (F.coalesce("toxic", F.lit(0)) == 1).cast("double").alias("toxic")).distinct()
    chosen = chosen.orderBy(F.xxhash64("label_id"), "label_id", "low", "toxic").limit(model.max_labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                ids, counts = document_features(part.column("text"), model.features)
                yield pa.RecordBatch.from_arrays(
                    [part.column("label_id"), list_array(pa.array(ids.astype(np.int32)), counts), part.column("low"),
                     part.column("toxic")], ["label_id", "ids", "low", "toxic"])

    # the broadcast side is bounded by max_labels rows of three numbers
    joined = docs.join(F.broadcast(chosen), F.col("id") == F.col("label_id")).select(
        "label_id", "text", "low", "toxic")
    made = map_batches(joined, run, "label_id long, ids array<int>, low double, toxic double")
    return made.groupBy("label_id", "low", "toxic").agg(F.min("ids").alias("ids"))


def document_evidence(docs: DataFrame, labels: DataFrame, model: QualityModel) -> DataFrame:
    """(id, host, path, p_low, p_toxic) of every document."""
    # in order of the id, so that the fit does not depend on how rows were partitioned
    sample = training_sample(docs, labels, model).toArrow().sort_by(
        [(c, "ascending") for c in ("label_id", "low", "toxic")])
    lists = sample.column("ids").combine_chunks()
    ids, counts = lists.flatten().to_numpy().astype(np.int64), np.diff(lists.offsets.to_numpy())
    heads = [fit(ids, counts, sample.column(k).to_numpy(), model) for k in ("low", "toxic")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                ids, counts = document_features(part.column("text"), model.features)
                scores = [pa.array(predict(ids, counts, w, b)) for w, b in heads]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("host"), part.column("path"), *scores],
                                                 ["id", "host", "path", "p_low", "p_toxic"])

    return map_batches(docs, run, "id long, host string, path string, p_low double, p_toxic double")


def _strength(groups: DataFrame, rate: Column, model: QualityModel) -> float:
    """Pseudo-count of a Beta prior from the spread of group rates around their parent's (method of moments)."""
    # var(group mean) = m(1 - m)/n + m(1 - m)/(strength + 1): excess over the sampling part
    m = F.greatest(F.least(rate, F.lit(1 - 1e-6)), F.lit(1e-6))
    spread = groups.filter("n > 1").agg(
        F.sum(F.col("n") * (F.col("bad") / F.col("n") - m) ** 2).alias("a"), F.sum(m * (1 - m)).alias("b"),
        F.sum(F.col("n") * m * (1 - m)).alias("c")).first()
    if not spread.c:
        return model.max_strength
    excess = max(0.0, spread.a - spread.b) / spread.c
    return float(min(model.max_strength, max(1.0, 1 / excess - 1 if excess > 0 else model.max_strength)))


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def judge_quality(docs: DataFrame, labels: DataFrame, model: QualityModel = QualityModel(), *,
                  id_col: str = "doc_id", text_col: str = "text", host: Column | None = None,
                  path: Column | None = None) -> DataFrame:
    """One row per document: id, p_low, p_toxic, site_rate (shrunk), posterior and ``kept``."""
    host = F.regexp_extract(F.col("source").cast("string"), "^[^/]*", 0) if host is None else host
    if path is None:
        path = F.concat_ws("|", F.col("source").cast("string"), F.coalesce(F.col("lang"), F.lit("")))
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
                       F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    labels = labels.select(F.col(id_col).cast("long").alias("id"), "quality", "toxic")
    scored = materialize(document_evidence(docs, labels, model).withColumn(
        "p_bad", 1 - (1 - F.col("p_low")) * (1 - F.col("p_toxic"))), "quality-evidence")

    paths = materialize(scored.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("n"), F.sum("p_bad").alias("bad")), "path-sums")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    top = paths.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = min(1 - 1e-6, max(1e-6, top.bad / top.n)) if top.n else model.default_rate
    a = _strength(hosts, F.lit(overall), model)
    hosts = hosts.select("host", ((F.col("bad") + a * overall) / (F.col("n") + a)).alias("host_rate"))
    paths = paths.join(hosts, "host")
    b = _strength(paths, F.col("host_rate"), model)
    joined = scored.join(paths, ["host", "path"])
    site = (F.col("bad") - F.col("p_bad") + b * F.col("host_rate")) / (F.col("n") - 1 + b)  # own evidence left out
    joined = joined.withColumn("site_rate", site)
    posterior = 1 / (1 + F.exp(-(_logit(F.col("p_bad")) + _logit(F.col("site_rate")) - _logit(F.lit(overall)))))
    return joined.withColumn("posterior", posterior).select(
        F.col("id").alias(id_col), "p_low", "p_toxic", "site_rate", "posterior",
        (F.col("posterior") < model.reject).alias("kept"))
