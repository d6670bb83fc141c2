"""What several operators share: batches of bounded size and hashed words."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame

BATCH_ROWS, BATCH_BYTES = 500, 32 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches of few rows and bytes in this session, as texts may be very long.

    The bounds are read when the plan is made, after this returns, so they stay; a session that has smaller ones keeps them.
    """
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = conf.get(key)
        if not (now.isdigit() and 0 < int(now) <= most):
            conf.set(key, most)
    return df


def free_names(columns: list[str], *names: str) -> tuple[str, ...]:
    """The names, with underscores in front until no column has them."""
    low = {c.lower() for c in columns}
    out = []
    for n in names:
        while n.lower() in low:
            n = f"_{n}"
        out.append(n)
    return tuple(out)


class WordHashes(dict):
    """64-bit hash by word (bytes); forgets all when it holds ``limit`` words, so its memory is bounded."""

    def __init__(self, limit: int = 400_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def space_words(text: str | None) -> list[bytes]:
    """A-Z lower-cased; words are the runs without space and the characters 9 to 13."""
    return text.encode().lower().split() if text else []


def hashed(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _K1
    x = (x ^ (x >> np.uint64(29))) * _K2
    return x ^ (x >> np.uint64(32))


def shingles(h: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; of the whole sequence where it is shorter; none without words."""
    n = len(h)
    if not n:
        return h
    k = min(size, n)
    acc = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        acc = mix(acc) + h[i : n - k + 1 + i]
    return np.unique(mix(acc))
