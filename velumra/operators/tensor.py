"""Two-dimensional matrices as DataFrames of cells (i, j, v), and the gradient
of each operation. Zeros are cells like any other, so a shape is never guessed."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import age_factor


@dataclass
class Matrix:
    rows: int
    cols: int
    cells: DataFrame

    def _map(self, f) -> Matrix:
        return Matrix(self.rows, self.cols, self.cells.select("i", "j", f(F.col("v")).alias("v")))

    def transpose(self) -> Matrix:
        return Matrix(self.cols, self.rows, self.cells.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))

    def matmul(self, other: Matrix) -> Matrix:
        """ValueError where the inner sizes differ."""
        if self.cols != other.rows:
            raise ValueError(f"{self.rows} x {self.cols} times {other.rows} x {other.cols}")
        a, b = self.cells.select("i", F.col("j").alias("k"), F.col("v").alias("a")), other.cells.select(F.col("i").alias("k"), "j", F.col("v").alias("b"))
        return Matrix(self.rows, other.cols, a.join(b, "k").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("v")))

    def __add__(self, other: Matrix) -> Matrix:
        """Sum; a side of one row or column is repeated along it. ValueError
        for other shapes."""
        for a, b in ((self.rows, other.rows), (self.cols, other.cols)):
            if a != b and 1 not in (a, b):
                raise ValueError(f"{self.rows} x {self.cols} plus {other.rows} x {other.cols}")
        small, large = (self, other) if self.rows * self.cols < other.rows * other.cols else (other, self)
        a, b = large.cells.select("i", "j", F.col("v").alias("a")), small.cells.select(F.col("i").alias("p"), F.col("j").alias("q"), F.col("v").alias("b"))
        rows, cols = max(self.rows, other.rows), max(self.cols, other.cols)
        if large.rows < rows or large.cols < cols:  # a column plus a row
            wide = a.crossJoin(b)
            i, j = (F.col("i") if large.rows == rows else F.col("p")), (F.col("j") if large.cols == cols else F.col("q"))
            return Matrix(rows, cols, wide.select(i.alias("i"), j.alias("j"), (F.col("a") + F.col("b")).alias("v")))
        same = [F.col("i") == F.col("p")] * (small.rows == rows) + [F.col("j") == F.col("q")] * (small.cols == cols)
        met = a.join(b, same) if same else a.crossJoin(b)
        return Matrix(rows, cols, met.select("i", "j", (F.col("a") + F.col("b")).alias("v")))

    def relu(self) -> Matrix:
        return self._map(lambda v: F.when((v > 0) & ~F.isnan(v), v).otherwise(F.lit(0.0)))

    def tanh(self) -> Matrix:
        return self._map(F.tanh)

    def decay(self, rate: float, time: float) -> Matrix:
        """Times exp(-rate x time), time not under 0 and tiny factors zero."""
        return self._map(lambda v: v * age_factor(rate, F.lit(float(time))))


def zeros(spark: SparkSession, rows: int, cols: int) -> Matrix:
    return _filled(spark, rows, cols, F.lit(0.0))


def gaussian(spark: SparkSession, rows: int, cols: int, seed: int = 0) -> Matrix:
    """Standard normal cells. They follow from seed, row and column alone, so a
    task that is run again, or a table cut otherwise, gives the same."""
    digest = lambda k: F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("i").cast("string"), F.col("j").cast("string"), F.lit(str(k))))
    unit = lambda k: (F.conv(F.substring(digest(k), 1, 13), 16, 10).cast("double") + 1.0) / float(2**52 + 1)
    return _filled(spark, rows, cols, F.sqrt(-2.0 * F.ln(unit(0))) * F.cos(2.0 * math.pi * unit(1)))


def _filled(spark: SparkSession, rows: int, cols: int, v: Column) -> Matrix:
    if rows < 0 or cols < 0:
        raise ValueError("a shape can't be negative")
    at = spark.range(rows * cols).select((F.col("id") / max(cols, 1)).cast("long").alias("i"), (F.col("id") % max(cols, 1)).alias("j"))
    return Matrix(rows, cols, at.select("i", "j", v.alias("v")))


def matmul_gradients(a: Matrix, b: Matrix, grad: Matrix) -> tuple[Matrix, Matrix]:
    return grad.matmul(b.transpose()), a.transpose().matmul(grad)


def add_gradient(operand: Matrix, grad: Matrix) -> Matrix:
    """Of one operand of a sum: the sum of ``grad`` over axes that it was repeated along."""
    i = F.col("i") if operand.rows == grad.rows else F.lit(0).cast("long")
    j = F.col("j") if operand.cols == grad.cols else F.lit(0).cast("long")
    return Matrix(operand.rows, operand.cols, grad.cells.select(i.alias("i"), j.alias("j"), "v").groupBy("i", "j").agg(F.sum("v").alias("v")))


def _by_cell(a: Matrix, grad: Matrix, f) -> Matrix:
    met = a.cells.select("i", "j", F.col("v").alias("a")).join(grad.cells.select("i", "j", F.col("v").alias("g")), ["i", "j"])
    return Matrix(a.rows, a.cols, met.select("i", "j", f(F.col("a"), F.col("g")).alias("v")))


def relu_gradient(a: Matrix, grad: Matrix) -> Matrix:
    """``a`` is what the function was applied to."""
    return _by_cell(a, grad, lambda v, g: F.when((v > 0) & ~F.isnan(v), g).otherwise(F.lit(0.0)))


def tanh_gradient(a: Matrix, grad: Matrix) -> Matrix:
    return _by_cell(a, grad, lambda v, g: g * (1.0 - F.tanh(v) * F.tanh(v)))


def linear(x: Matrix, weight: Matrix, bias: Matrix) -> Matrix:
    return x.matmul(weight) + bias


def sgd_step(parameter: Matrix, grad: Matrix, rate: float) -> Matrix:
    return _by_cell(parameter, grad, lambda p, g: p - rate * g)
