"""Spark ML models against numpy on a small fixture."""

import numpy as np
import pytest

from revtext.operators.spark_ml import fit_logistic_regression, fit_perceptron

VOCAB = 8


def rows(spark, n=120):
    rng = np.random.default_rng(11)
    data = []
    for i in range(n):
        positive = int(rng.random() < 0.6)
        words = rng.integers(1, 7, 6) if positive else rng.integers(3, 9, 6)
        data.append((i, [*map(int, words), 0], [1 - positive, positive]))
    schema = "review_id long, features array<int>, label_ohe array<int>"
    return data, spark.createDataFrame(data, schema)


def counts(data):
    return np.array([[f.count(w) for w in range(1, VOCAB + 1)] for _, f, _ in data], dtype=float)


def predicted(model, df):
    scored = model.predict(df).orderBy("review_id").collect()
    return np.array([r.probability for r in scored]), [r.prediction for r in scored]


def test_logistic_regression_is_the_optimum(spark):
    data, df = rows(spark)
    model = fit_logistic_regression(df, 2, VOCAB, max_iter=500, tol=1e-12, reg=0.0)
    fitted = model.fitted.stages[-1]
    x, y = counts(data), np.array([label[1] for _, _, label in data])
    p = 1 / (1 + np.exp(-(x @ fitted.coefficients.toArray() + fitted.intercept)))
    assert np.abs(x.T @ (p - y) / len(y)).max() < 1e-3
    assert abs((p - y).mean()) < 1e-3
    probability, prediction = predicted(model, df)
    assert probability[:, 1] == pytest.approx(p, abs=1e-9)
    assert prediction == [int(v > 0.5) for v in p]


def test_perceptron_forward_pass(spark):
    data, df = rows(spark)
    model = fit_perceptron(df, 2, max_iter=10, embedding=6)
    _, embedding, network = model.fitted.stages
    vectors = {int(r.word): r.vector.toArray() for r in embedding.getVectors().collect()}
    x = np.array([np.mean([vectors[w] for w in f if w], axis=0) for _, f, _ in data])
    weights = network.weights.toArray()
    sizes = network.getLayers()
    assert sizes == [6, 128, 128, 2]
    at = 0
    for layer, (fan_in, fan_out) in enumerate(zip(sizes, sizes[1:])):
        matrix = weights[at : at + fan_in * fan_out].reshape(fan_in, fan_out)
        at += fan_in * fan_out
        x = x @ matrix + weights[at : at + fan_out]
        at += fan_out
        if layer < len(sizes) - 2:
            x = 1 / (1 + np.exp(-x))
    odds = np.exp(x - x.max(axis=1, keepdims=True))
    expected = odds / odds.sum(axis=1, keepdims=True)
    probability, prediction = predicted(model, df)
    assert probability == pytest.approx(expected, abs=1e-6)
    assert prediction == list(expected.argmax(axis=1))
