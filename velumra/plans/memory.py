"""Python workers outlive their tasks; what they free must go back to the system."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def released(run: Kernel) -> Kernel:
    """``run``, which at its end gives the memory back that it no longer
    needs: else idle workers hold it while the JVM or other workers want it."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return whole
