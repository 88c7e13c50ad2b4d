"""Words and terms, and Arrow helpers shared by the operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa

#: A word: a maximal run of Unicode letters and digits. ``\w`` is those and the underscore.
WORD = re.compile(r"[^\W_]+")
#: A term: a maximal run of ASCII letters.
TERM = re.compile(r"[A-Za-z]{3,}")
#: Texts of one slice of a batch hold at most about this many characters, so that long texts do not pile up in memory.
SLICE_CHARS = 4_000_000


def words(text: str) -> list[str]:
    """Lower-cased words in order."""
    found = WORD.findall(text)
    return "\n".join(found).lower().split("\n") if found else []


def slices(batches: Iterator[pa.RecordBatch], text: int, most: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Cuts batches so that the string column at ``text`` has about ``most`` characters at once; one longer text comes alone."""
    for batch in batches:
        start, held = 0, 0
        texts: list[str | None] = []
        column = batch.column(text)
        for i in range(batch.num_rows):
            value = column[i].as_py()
            texts.append(value)
            held += len(value) if value else 0
            if held >= most:
                yield batch.slice(start, i + 1 - start), texts
                start, held, texts = i + 1, 0, []
        if texts:
            yield batch.slice(start), texts
