import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from velumra.operators import neural as N
from velumra.operators import tensor as T


def matrix(spark, x):
    x = np.atleast_2d(np.array(x, float))
    return T.Matrix(*x.shape, spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(x)], "i bigint, j bigint, v double"))


def dense(m):
    out = np.full((m.rows, m.cols), np.nan)
    for r in m.cells.collect():
        assert np.isnan(out[r.i, r.j])
        out[r.i, r.j] = r.v
    return out


def test_products_and_gradients(spark):
    a, b = matrix(spark, [[2, 3]]), matrix(spark, [[4], [5]])
    assert dense(a.matmul(b)).tolist() == [[23]]
    ga, gb = T.matmul_gradients(a, b, matrix(spark, [[1]]))
    assert dense(ga).tolist() == [[4, 5]] and dense(gb).tolist() == [[2], [3]]
    with pytest.raises(ValueError):
        a.matmul(a)


@pytest.mark.parametrize("one, two", [((2, 3), (2, 3)), ((2, 3), (1, 3)), ((2, 1), (2, 3)), ((2, 1), (1, 3)), ((1, 3), (2, 1)), ((1, 1), (2, 3)), ((1, 1), (1, 1))])
def test_sums(spark, one, two):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=one), rng.normal(size=two)
    a, b = matrix(spark, x), matrix(spark, y)
    total = a + b
    assert dense(total) == pytest.approx(x + y)
    g = rng.normal(size=(x + y).shape)
    u, v = N.Value(x), N.Value(y)
    (u + v).backward(g)
    assert dense(T.add_gradient(a, matrix(spark, g))) == pytest.approx(u.grad)
    assert dense(T.add_gradient(b, matrix(spark, g))) == pytest.approx(v.grad)


def test_shapes_that_do_not_fit(spark):
    for one, two in (((2, 3), (4, 3)), ((2, 3), (2, 2))):
        with pytest.raises(ValueError):
            matrix(spark, np.zeros(one)) + matrix(spark, np.zeros(two))
        with pytest.raises(ValueError):
            N.Value(np.zeros(one)) + N.Value(np.zeros(two))


def test_functions(spark):
    a = matrix(spark, [[-1.0, 0.0, 2.0, float("nan")]])
    assert dense(a.relu()).tolist() == [[0, 0, 2, 0]]
    b, g = matrix(spark, [[-1.0, 0.5]]), matrix(spark, [[3.0, 3.0]])
    assert dense(T.relu_gradient(b, g)).tolist() == [[0, 3]]
    assert dense(T.tanh_gradient(b, g)) == pytest.approx(3 * (1 - np.tanh([[-1.0, 0.5]]) ** 2))
    assert dense(b.transpose()).tolist() == [[-1], [0.5]]


def test_decay(spark):
    assert dense(matrix(spark, [[100, 50]]).decay(0.005, 138.629)) == pytest.approx(np.array([[50, 25]]), abs=1e-3)
    assert dense(matrix(spark, [[10]]).decay(0.5, -100)).tolist() == [[10]]
    assert dense(matrix(spark, [[1]]).decay(1, 100)).tolist() == [[0]]


def test_fills(spark):
    assert dense(T.zeros(spark, 2, 3)).tolist() == [[0] * 3] * 2
    x = dense(T.gaussian(spark, 100, 100, 7))
    assert abs(x.mean()) < 0.03 and abs(x.std() - 1) < 0.03
    assert (x == dense(T.gaussian(spark, 100, 100, 7))).all() and (x != dense(T.gaussian(spark, 100, 100, 8))).all()


def test_scalar_network():
    x, w, b = N.Value([[2]]), N.Value([[-3]]), N.Value([[10]])
    y = (x @ w + b).relu()
    y.backward()
    assert (y.data, x.grad, w.grad, b.grad) == (4, -3, 2, 1)
    y.grad[:] = 0
    y.backward()
    assert w.grad == 4  # leaves add up, what lies between doesn't


def test_transpose_is_on_the_tape():
    x = N.Value([[1.0, 2.0]])
    (x.T + x.T).backward()
    assert x.grad.tolist() == [[2, 2]]


@settings(max_examples=20, deadline=None)
@given(st.integers(1, 4), st.integers(1, 4), st.integers(0, 9))
def test_gradients_by_differences(inputs, hidden, seed):
    rng = np.random.default_rng(seed)
    model = N.Sequential(N.Linear(inputs, hidden, seed), N.Tanh()).add(N.Linear(hidden, 1, seed + 1, he=False))
    x, y = rng.normal(size=(3, inputs)), rng.normal(size=(3, 1))
    out = model.forward(N.Value(x))
    out.backward(N.squared_error(out.data, y)[1])
    for p in model.parameters():
        for at in np.ndindex(p.data.shape):
            kept, around = p.data[at], []
            for step in (1e-5, -1e-5):
                p.data[at] = kept + step
                around.append(N.squared_error(model.forward(N.Value(x)).data, y)[0])
            p.data[at] = kept
            assert (around[0] - around[1]) / 2e-5 == pytest.approx(p.grad[at], abs=1e-4)


def test_training_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 3))
    rows = spark.createDataFrame([(v.tolist(), [float(v[0] - v[1])]) for v in x], "x array<double>, y array<double>")
    fresh = lambda: N.Sequential(N.Linear(3, 5, 1), N.Relu(), N.Linear(5, 1, 2))
    m = fresh()
    one = N.train(rows.repartition(1), m, 0.05, 4)
    assert one == pytest.approx(N.train(rows.repartition(7), fresh(), 0.05, 4)) and one[-1] < one[0]
    assert N.predict(rows, m).first().prediction == pytest.approx(m.forward(N.Value(rows.first().x)).data[0].tolist())
    assert N.train(rows.limit(0), fresh(), 0.05, 4) == []
