"""Word shingles of whole texts and their hashes, by vectorised polynomial hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Words hashed at once; blocks overlap by the shingle width.
WORDS = 100_000
#: ASCII without letters and digits becomes white space, A-Z are lowered; other bytes stay.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


class Powers:
    """A random 64-bit number for each byte, and powers of an odd base and of its inverse modulo 2**64."""

    def __init__(self, seed: int = 20240229):
        rng = np.random.default_rng(seed)
        self.of_byte = rng.integers(1, 2**64, 256, np.uint64)
        base = int(rng.integers(2**62, 2**63)) | 1
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 2**64))
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(2 * n, self.base))))
                self.down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(2 * n, self.inverse))))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Sums so that hash(a, b) = (out[b] - out[a]) * down[a]."""
        self.grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.of_byte[data] * self.up[: len(data)], out=out[1:])
        return out


def plain_words(text: bytes) -> list[bytes]:
    return text.translate(PLAIN).split()


def hashed(words: list[bytes], width: int, powers: Powers) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks (joined words, starts, ends, hashes) that hold each shingle of `width` words once; the whole
    sequence where there are fewer words."""
    step = min(width, len(words))
    for k in range(0, len(words) - step + 1, WORDS):
        joined = b" ".join(words[k : k + WORDS + step - 1])
        data = np.frombuffer(joined, np.uint8)
        gaps = np.flatnonzero(data == 32)
        starts, ends = np.concatenate(([0], gaps + 1)), np.append(gaps, len(data))
        starts, ends = starts[: len(starts) - step + 1], ends[step - 1 :]
        total = powers.prefix(data)
        yield joined, starts, ends, (total[ends] - total[starts]) * powers.down[starts]
