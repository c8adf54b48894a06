"""Small feed-forward networks: a tape of NumPy matrices that runs inside a
task, modules, and training whose gradients add up over partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


class Value:
    """A matrix with the way back to what it was made of."""

    def __init__(self, data, made_of: tuple[Value, ...] = (), back: Callable[[np.ndarray], tuple] | None = None):
        self.data = np.atleast_2d(np.asarray(data, np.float64))
        self.grad = np.zeros_like(self.data)
        self._made_of, self._back = made_of, back

    def matmul(self, other: Value) -> Value:
        if self.data.shape[1] != other.data.shape[0]:
            raise ValueError(f"{self.data.shape} times {other.data.shape}")
        return Value(self.data @ other.data, (self, other), lambda g: (g @ other.data.T, self.data.T @ g))

    __matmul__ = matmul

    def __add__(self, other: Value) -> Value:
        if any(a != b and 1 not in (a, b) for a, b in zip(self.data.shape, other.data.shape)):
            raise ValueError(f"{self.data.shape} plus {other.data.shape}")
        return Value(self.data + other.data, (self, other), lambda g: (_folded(g, self.data.shape), _folded(g, other.data.shape)))

    def relu(self) -> Value:
        on = self.data > 0
        return Value(np.where(on, self.data, 0.0), (self,), lambda g: (g * on,))

    def tanh(self) -> Value:
        t = np.tanh(self.data)
        return Value(t, (self,), lambda g: (g * (1 - t * t),))

    @property
    def T(self) -> Value:
        return Value(self.data.T, (self,), lambda g: (g.T,))

    def backward(self, seed: np.ndarray | None = None) -> None:
        """Add the gradients of this value to those of all that it was made of.
        The seed is ``seed``, else this value's own gradient if that isn't zero,
        else ones. Values between here and the leaves are cleared first, so a
        second call adds once to the leaves."""
        order, seen, todo = [], set(), [(self, False)]
        while todo:
            v, done = todo.pop()
            if done:
                order.append(v)
            elif id(v) not in seen:
                seen.add(id(v))
                todo += [(v, True), *((m, False) for m in v._made_of)]
        if seed is None:
            seed = self.grad.copy() if self.grad.any() else np.ones_like(self.data)
        for v in order:
            if v._back:
                v.grad = np.zeros_like(v.data)
        self.grad = np.array(seed, np.float64).reshape(self.data.shape) + (0 if self._back else self.grad)
        for v in reversed(order):
            if v._back:
                for m, g in zip(v._made_of, v._back(v.grad)):
                    m.grad = m.grad + g


def _folded(g: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    for axis in (0, 1):
        if shape[axis] == 1 and g.shape[axis] != 1:
            g = g.sum(axis, keepdims=True)
    return g


class Linear:
    """x W + b, W normal with variance 2 / inputs (1 / inputs if not ``he``)."""

    def __init__(self, inputs: int, outputs: int, seed: int = 0, he: bool = True):
        spread = np.sqrt((2.0 if he else 1.0) / inputs)
        self.weight = Value(np.random.default_rng(seed).normal(0, 1, (inputs, outputs)) * spread)
        self.bias = Value(np.zeros((1, outputs)))

    def forward(self, x: Value) -> Value:
        return x @ self.weight + self.bias

    def parameters(self) -> list[Value]:
        return [self.weight, self.bias]


class Relu:
    def forward(self, x: Value) -> Value:
        return x.relu()

    def parameters(self) -> list[Value]:
        return []


class Tanh(Relu):
    def forward(self, x: Value) -> Value:
        return x.tanh()


class Sequential:
    def __init__(self, *layers):
        self.layers = list(layers)

    def add(self, layer) -> Sequential:
        self.layers.append(layer)
        return self

    def forward(self, x: Value) -> Value:
        for layer in self.layers:
            x = layer.forward(x)
        return x

    def parameters(self) -> list[Value]:
        return [p for layer in self.layers for p in layer.parameters()]


class Sgd:
    def __init__(self, parameters: list[Value], rate: float):
        self.parameters, self.rate = parameters, rate

    def step(self) -> None:
        for p in self.parameters:
            p.data = p.data - self.rate * p.grad

    def zero(self) -> None:
        for p in self.parameters:
            p.grad = np.zeros_like(p.data)


Loss = Callable[[np.ndarray, np.ndarray], tuple[float, np.ndarray]]


def squared_error(out: np.ndarray, wanted: np.ndarray) -> tuple[float, np.ndarray]:
    return float(((out - wanted) ** 2).sum()), 2 * (out - wanted)


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return np.array(batch.column(column).to_pylist(), np.float64).reshape(batch.num_rows, -1)


def gradients(rows: DataFrame, model: Sequential, loss: Loss = squared_error) -> tuple[float, list[np.ndarray], int]:
    """Loss and gradients over ``rows`` (x, y arrays), and their number. Each
    partition sends one row as large as the parameters; sums, not means, so
    they don't depend on how rows are spread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = 0.0, 0
        for p in model.parameters():
            p.grad = np.zeros_like(p.data)
        for batch in batches:
            if batch.num_rows:
                out = model.forward(Value(_matrix(batch, "x")))
                lost, seed = loss(out.data, _matrix(batch, "y"))
                out.backward(seed)
                total, n = total + lost, n + batch.num_rows
        flat = np.concatenate([p.grad.ravel() for p in model.parameters()] or [np.empty(0)])
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([n]), pa.array([flat.tobytes()], pa.binary())], names=["loss", "n", "grad"])

    def add(found: pa.Table) -> pa.Table:
        grads = sum(np.frombuffer(g) for g in found.column("grad").to_pylist())
        return pa.table({"loss": [float(np.sum(found.column("loss").to_numpy()))], "n": [int(np.sum(found.column("n").to_numpy()))], "grad": pa.array([np.asarray(grads).tobytes()], pa.binary())})

    parts = rows.select("x", "y").mapInArrow(run, "loss double, n bigint, grad binary")
    row = parts.groupBy().applyInArrow(add, "loss double, n bigint, grad binary").first()
    flat = np.frombuffer(bytes(row.grad)) if row else np.zeros(sum(p.data.size for p in model.parameters()))
    out, at = [], 0
    for p in model.parameters():
        out.append(flat[at : at + p.data.size].reshape(p.data.shape))
        at += p.data.size
    return (row.loss, out, row.n) if row else (0.0, out, 0)


def train(rows: DataFrame, model: Sequential, rate: float, epochs: int, loss: Loss = squared_error) -> list[float]:
    """Full-batch gradient descent on the mean loss; the mean loss before each step."""
    seen = []
    sgd = Sgd(model.parameters(), rate)
    for _ in range(epochs):
        lost, grads, n = gradients(rows, model, loss)
        if not n:
            break
        seen.append(lost / n)
        for p, g in zip(model.parameters(), grads):
            p.grad = g / n
        sgd.step()
        sgd.zero()
    return seen


def predict(rows: DataFrame, model: Sequential, out: str = "prediction") -> DataFrame:
    """``rows`` with the model's output for their ``x``."""
    kept = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = kept.value.forward(Value(_matrix(batch, "x"))).data.tolist() if batch.num_rows else []
            yield batch.append_column(out, pa.array(found, pa.list_(pa.float64())))

    from pyspark.sql import types as T

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))
