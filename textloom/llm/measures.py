"""Per-text counts that the quality rules and the quality classifier start from."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import bytes_of

#: Fixed values.
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\r\x0b\x0c"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = b"abcdefghijklmnopqrstuvwxyz"
DIGITS = b"0123456789"
STOPS = b".!?"

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
    "n_upper", "n_lower", "n_digits", "n_stops", "n_bangs", "n_distinct_words", "n_same_next",
)
COUNTS_DDL = ", ".join(f"{c} long" for c in COUNTS)


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found at least twice, all finds included."""
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    first: dict = {}
    again = set()
    if len(set(windows)) == len(windows):
        return 0
    for i, w in enumerate(windows):
        if first.setdefault(w, i) != i:
            again.add(w)
    covered = np.zeros(len(words), dtype=bool)
    at = np.fromiter((i for i, w in enumerate(windows) if w in again), dtype=np.int64)
    for i in range(width):
        covered[at + i] = True
    return int(covered.sum())


def count_text(data: bytes) -> tuple[int, ...]:
    words = data.split()
    n_bytes = len(data)
    removed = lambda chars: n_bytes - len(data.translate(None, chars))
    inside = data.translate(None, BLANKS)
    lines = data.split(b"\n")
    with_words = [x for x in lines if x.strip()]
    points = len(inside) if inside.isascii() else len(inside.decode("utf-8", "replace"))
    return (
        len(words),
        points,
        removed(SYMBOLS),
        len(with_words),
        len(with_words) - len(set(with_words)),
        repeated_words(words),
        removed(UPPER),
        removed(LOWER),
        removed(DIGITS),
        removed(STOPS),
        data.count(b"!"),
        len(set(words)),
        sum(map(bytes.__eq__, words, words[1:])),
    )


def count_batch(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """Counts of every text of a batch; a null text counts as an empty one."""
    rows = [count_text(x) for x in bytes_of(batch.column("text"))]
    made = np.array(rows, dtype=np.int64).reshape(len(rows), len(COUNTS))
    return {c: made[:, i] for i, c in enumerate(COUNTS)}
