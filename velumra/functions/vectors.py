"""Vector expressions over ARRAY columns, and digests over BINARY columns.

All are built-in higher-order functions: they run inside the JVM and need no
Python worker. Lengths that differ raise when the row is evaluated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vectors shorter than this stay as they are when normalised.
SHORT = 1e-7
#: A product of norms under this makes a cosine of zero.
FLAT = 1e-10


def _wide(v: Column) -> Column:
    return v.cast("array<double>")


def _paired(a: Column, b: Column, term) -> Column:
    total = F.aggregate(F.zip_with(_wide(a), _wide(b), term), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).when(a.isNull() | b.isNull(), F.lit(None)).otherwise(F.raise_error("vectors differ in length").cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Sum of products; 0 for two empty vectors, null if either is null."""
    return _paired(a, b, lambda x, y: x * y)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_paired(a, b, lambda x, y: (x - y) * (x - y)))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_wide(v), F.lit(0.0), lambda s, x: s + x * x))


def normalize(v: Column) -> Column:
    """Unit length, but unchanged where the norm is under ``SHORT``."""
    return F.when(norm(v) < SHORT, _wide(v)).otherwise(F.transform(_wide(v), lambda x: x / norm(v)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where the norms' product is under ``FLAT``."""
    both = norm(a) * norm(b)
    return F.when(both < FLAT, F.when(F.size(a) == F.size(b), F.lit(0.0)).otherwise(F.raise_error("vectors differ in length").cast("double"))).otherwise(dot(a, b) / both)


def sha256_hex(*parts: Column) -> Column:
    """Upper-case hexadecimal SHA-256 of the parts one after another."""
    return F.upper(F.sha2(F.concat(*(p.cast("binary") for p in parts)), 256))
