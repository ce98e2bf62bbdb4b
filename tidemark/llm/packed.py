"""What operators that deal packed arrays to fragments share: the number of fragments, and compact forms of numbers."""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text whose numbers meet in one fragment.
FRAGMENT_BYTES = 256_000_000


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def fragments_for(docs: DataFrame, total: int | None = None) -> int:
    """So many fragments that none has the numbers of more than about FRAGMENT_BYTES of text, and twice the
    session's shuffle partitions at least."""
    total = text_bytes(docs) if total is None else total
    return max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // FRAGMENT_BYTES))


def range_cuts(hashes: np.ndarray, bits: int, fragments: int) -> list[int]:
    """Where in sorted hashes of so many bits each fragment begins, and the last ends: fragments are equal ranges of hashes."""
    of = ((hashes >> np.uint64(bits - 32)) * np.uint64(fragments)) >> np.uint64(32)
    return np.searchsorted(of, np.arange(fragments + 1, dtype=np.uint64)).tolist()


def press(*parts: np.ndarray | bytes, level: int = 1) -> bytes:
    """Arrays and bytes, compressed together, with their lengths in front."""
    body = b"".join(x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes() for x in parts)
    sizes = np.array([len(parts), *[len(x) if isinstance(x, bytes) else x.nbytes for x in parts]], np.uint32)
    return sizes.tobytes() + zstandard.compress(body, level)


def unpress(body: bytes) -> list[bytes]:
    n = int(np.frombuffer(body, np.uint32, 1)[0])
    cuts = np.concatenate([[0], np.cumsum(np.frombuffer(body, np.uint32, n, 4), dtype=np.int64)])
    whole = zstandard.decompress(body[4 + 4 * n :], max_output_size=int(cuts[-1]))
    return [whole[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def planes(numbers: np.ndarray) -> bytes:
    """Unsigned numbers by bytes of one weight, as many as the largest needs; high ones are mostly 0 and compress away."""
    width = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def numbers(body: bytes) -> np.ndarray:
    width = body[0]
    n = (len(body) - 1) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(body, np.uint8, n * width, 1).reshape(width, n).T
    return out.view("<u8").ravel()


def ascending(values: np.ndarray) -> bytes:
    """Sorted unsigned numbers as the steps between them."""
    return planes(np.diff(values, prepend=np.uint64(0)))


def from_steps(body: bytes) -> np.ndarray:
    return np.cumsum(numbers(body), dtype=np.uint64)
