"""What a Python process of an executor keeps between tasks: one model, and no free memory.

Spark uses such a process for later stages too, and there its memory counts
beside theirs; so a stage's model goes when another stage asks for its own.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa

Rows = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

_LAST: dict[Hashable, object] = {}


def last_used(name: Hashable, make: Callable[[], object]):
    """The model of that name, made anew unless it is the last one that this process asked for; any other is let go."""
    if name not in _LAST:
        _LAST.clear()
        _LAST[name] = make()
    return _LAST[name]


def forget() -> None:
    """Let go of the model that this process keeps."""
    _LAST.clear()


def releasing(rows: Rows) -> Rows:
    """``rows`` for ``mapInArrow``; after its last batch the memory that Arrow no longer needs goes back to the system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows(batches)
        pa.default_memory_pool().release_unused()

    return run
