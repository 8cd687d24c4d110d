import math
import re
import zlib

import numpy as np
import pytest
from bibspark.llm import quality
from helpers import ODD, documents


def test_gradient_finds_the_order():
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 3, 900)
    rows, cols = [], []
    for i, g in enumerate(grades):
        for f in {0: (10, 11), 1: (11,), 2: (12,)}[g]:
            if rng.random() < 0.9:
                rows.append(i)
                cols.append(f)
        rows.append(i)
        cols.append(100 + int(rng.integers(0, 50)))
    model = quality.fit_arrays(np.array(rows), np.array(cols), grades, l1=5e-3)
    assert model.thresholds[0] <= model.thresholds[1]
    score = np.array([model.score({10, 11}), model.score({11}), model.score({12})])
    assert score[0] < score[1] < score[2]
    tails = model.tails(score)
    assert (tails[:, 0] >= tails[:, 1]).all()
    assert np.allclose(model.expected(score), tails.sum(axis=1))
    assert all(abs(model.weights.get(100 + k, 0)) < 0.5 for k in range(50))


def test_likelihood_gradient():
    """The fitted point is better than its neighbours."""
    rng = np.random.default_rng(1)
    rows, cols = np.repeat(np.arange(200), 3), rng.integers(0, 6, 600)
    grades = rng.integers(0, 3, 200)
    model = quality.fit_arrays(rows, cols, grades, l1=1e-3, steps=3000, least=1)

    def loss(w, theta):
        s = np.bincount(rows, w[cols], 200)
        cut = np.concatenate([np.full((200, 1), -np.inf), np.array(theta)[None, :] - s[:, None], np.full((200, 1), np.inf)], axis=1)
        c = 1 / (1 + np.exp(-cut))
        return -np.log(c[np.arange(200), grades + 1] - c[np.arange(200), grades]).mean() + 1e-3 * np.abs(w).sum()

    w = np.array([model.weights.get(i, 0.0) for i in range(6)])
    best = loss(w, model.thresholds)
    for _ in range(200):
        assert loss(w + rng.normal(0, 0.05, 6), np.array(model.thresholds) + rng.normal(0, 0.05, 2)) >= best - 1e-4


def sample(rng, counts, slots=400, size=12):
    """Rows of grades with so many documents each; a few slots speak for each grade, most for none."""
    grades = rng.permutation(np.repeat(np.arange(len(counts)), counts))
    rows = np.repeat(np.arange(len(grades)), size)
    cols = rng.integers(10, slots, len(rows))
    marked = rng.random(len(grades)) < 0.9
    cols[::size][marked] = grades[marked]
    cols[1::size][marked] = 3 + grades[marked] // 2
    return rows, cols, grades


@pytest.mark.parametrize("middle", [0, 1, 2, 3, 10, 100])
def test_rare_absent_and_single_middle_grades(middle):
    for seed in range(3):
        rows, cols, grades = sample(np.random.default_rng(seed), (3000, middle, 7000))
        model = quality.fit_arrays(rows, cols, grades)
        assert max(map(abs, model.thresholds)) < 30 and model.thresholds[0] <= model.thresholds[1]
        assert max(map(abs, model.weights.values())) < 30
        score = np.array([model.score(set(cols[rows == i].tolist())) for i in range(len(grades))])
        keep = model.tails(score)[:, 1] >= 0.5
        assert keep[grades == 2].mean() > 0.9 and keep[grades == 0].mean() < 0.2


@pytest.mark.parametrize("toxic", [0, 1, 2, 4, 8, 42])
def test_few_toxic_labels_keep_the_good(spark, toxic):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    few = labels[(labels.quality == 1) & (labels.toxic == 1)].sort_values("doc_id")
    some = spark.createDataFrame(labels.drop(few.index[toxic:]))
    rows = quality.rated(docs, quality.fit(docs, some)).join(some, "doc_id").collect()
    assert np.mean([r.keep for r in rows if r.quality == 1 and not r.toxic]) > 0.95
    assert np.mean([r.keep for r in rows if r.quality == 0]) < 0.3


def test_missing_ends():
    rng = np.random.default_rng(0)
    rows, cols, grades = sample(rng, (400, 400))
    low, high = quality.fit_arrays(rows, cols, grades), quality.fit_arrays(rows, cols, grades + 1)
    assert (low.tails(np.linspace(-9, 9, 5))[:, 1] < 1e-9).all() and (high.tails(np.linspace(-9, 9, 5))[:, 0] > 1 - 1e-9).all()
    assert low.thresholds[0] == pytest.approx(high.thresholds[1])


def plain_names(text):
    """The features of a text, worked out from their description and not word by word."""
    words, out = text.split(), set()
    if not words:
        return out
    distinct = sorted(set(words))
    for w in distinct:
        bare = w.lower().strip(".,;:!?\"'()[]{}*$%&#")
        end = re.search(r"[^\w\s]+$", w)
        out |= {bare} | ({"\0start=" + bare[:4]} if len(bare) > 4 else set()) | ({"\0tail=" + end.group()[:4]} if end else set())
    share = {
        "upper": [w.isupper() for w in distinct],
        "tailed": [not w[-1].isalnum() for w in distinct],
        "twice": [len(w) > 1 and not w[-1].isalnum() and not w[-2].isalnum() for w in distinct],
        "digits": [any(c.isdigit() for c in w) for w in distinct],
        "signs": [len(w) < 4 and not any(c.isalnum() for c in w) for w in distinct],
    }
    values = {k: sum(v) / len(distinct) for k, v in share.items()} | {"repeat": 1 - len(distinct) / len(words)}
    out |= {f"\0{k}>{i}" for k, v in values.items() for i in range(1, 11) if 10 * v >= i}
    out |= {f"\0density>{i}" for i in range(1, 9) if len(words) >= 20 and len(words) / len(distinct) >= 2**i / 2}
    out |= {f"\0words>{i}" for i in range(1, 20) if len(words) >= 2**i}
    out |= {f"\0length>{i}" for i in range(1, 16) if sum(map(len, distinct)) / len(distinct) >= i}
    return out | ({"\0bars"} if "|" in distinct else set())


def test_scores_worked_out_apart(spark, sf_dir):
    """Every row's columns from the weights, the thresholds and the features' description."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert model.weights
    for r in quality.rated(docs, model).collect():
        slots = {zlib.crc32(x.encode()) % 2**18 for x in plain_names(r.text or "")}
        score = sum(model.weights.get(s, 0) for s in slots)
        tails = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        assert r.score == pytest.approx(score, abs=1e-9) and r.expected_grade == pytest.approx(sum(tails), abs=1e-9)
        assert r.tail_probability == pytest.approx(tails[1], abs=1e-9) and r.keep == (r.tail_probability >= 0.5)


def test_the_model_does_not_depend_on_partitions_or_repeats(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels)
    assert quality.fit(docs.repartition(7).unionByName(docs), labels.repartition(3)) == model


def test_one_grade_or_none():
    model = quality.fit_arrays(np.array([0, 1]), np.array([3, 4]), np.array([2, 2]))
    assert (model.tails(np.zeros(1))[:, 1] > 0.99).all()
    assert (quality.fit_arrays(np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)).tails(np.zeros(1)) < 0.01).all()


def test_odd_rows(spark):
    docs = documents(spark, ODD, clash=True)
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (4, 0, 0), (4, 1, None), (None, 1, 1), (5, 1, 0), (6, 1, 0), (999, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    rows = quality.rated(docs, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in rows)
    assert quality.rated(docs.limit(0), model).count() == 0
    none = quality.fit(docs, labels.limit(0))
    assert quality.rated(docs, none).count() == len(ODD)


def test_held_out(spark):
    """Fitted on half of the labels, judged on the other half."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(docs, labels.filter("doc_id % 2 = 0"))
    rows = quality.rated(docs, model).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    clean = [r.keep for r in rows if r.quality == 1 and r.toxic == 0]
    bad = [not r.keep for r in rows if r.quality == 0 or r.toxic == 1]
    assert np.mean(clean) > 0.95
    assert np.mean(bad) > 0.6
    assert quality.rated(docs, model).count() == docs.count()
    assert sum(clean) == pytest.approx(len(clean), rel=0.05)
