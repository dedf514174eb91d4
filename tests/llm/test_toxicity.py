import numpy as np
import pytest
from marigrid.llm import toxicity


@pytest.fixture(scope="module")
def labelled(prose):
    rows = []
    for i in range(400):
        words = prose(80, i).split()
        toxic = i % 5 == 0
        for k in range(1 + i % 4 if toxic else 0):
            words.insert(7 * k + 3, ["Vile,", "scummy", "rotten."][(i + k) % 3])
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_accuracy(labelled):
    model = toxicity.fit_texts([t for _, t, _ in labelled[:300]], [y for *_, y in labelled[:300]])
    p = model.grades(np.array([model.score(toxicity.words(t)) for _, t, _ in labelled[300:]]))
    assert ((1 - p[:, 0] >= 0.5) == np.array([y == 1 for *_, y in labelled[300:]])).mean() >= 0.99
    assert list(model.cuts) == sorted(model.cuts)
    np.testing.assert_allclose(p.sum(1), 1)
    milder, worse = (model.score(toxicity.words(w)) for w in ("vile", "vile scummy rotten vile scummy rotten"))
    e = model.grades(np.array([milder, worse])) @ np.arange(4)
    assert e[0] < e[1]


def test_gradient_finds_the_cuts():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((4000, 2))
    y = (x @ [1.5, -1.0] + rng.logistic(size=4000) > np.array([[-1.0], [0.5], [2.0]])).sum(0)
    w, cuts = toxicity.fit_cuts(x, y, 4, steps=800)
    np.testing.assert_allclose(w, [1.5, -1.0], atol=0.15)
    np.testing.assert_allclose(cuts, [-1.0, 0.5, 2.0], atol=0.15)


def test_rows(spark, docs, odd, labelled):
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in labelled] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    table = docs([(i, t) for i, t, _ in labelled])
    model = toxicity.fit(table, labels)
    got = {r.doc_id: r for r in toxicity.severity(docs(odd), model).collect()}
    assert len(got) == len({i for i, _ in odd}) and not any(r.is_toxic for r in got.values())
    kept = toxicity.rejected(table, model)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _, y in labelled if not y}
    assert toxicity.rejected(docs(odd), model).count() == len(odd)


def test_repeated_ids_count_once(spark, docs, labelled):
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in labelled], "doc_id long, quality int, toxic int")
    once = toxicity.fit(docs([(i, t) for i, t, _ in labelled]), labels)
    often = [(i, t) for i, t, _ in labelled] + [(7, "zz " + labelled[7][1])] * 50
    assert toxicity.fit(docs(often), labels) == once


def test_without_labels(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs([(1, "a b c")]), labels)
    assert not toxicity.severity(docs([(1, "a b c")]), model).first().is_toxic
    assert toxicity.severity(docs([]), model).count() == 0
