"""The binary Golay code [23, 12, 7] as a fuzzy hash: every 23-bit word is near a few codewords.

The code is perfect: spheres of radius 3 around the 4096 codewords fill the space.  Two words at distance 1 thus
share a codeword when one takes its nearest and the other all within distance 4: one if it lies within 2 of its
nearest codeword or less, and six (the nearest and five at distance 4) if it lies at distance 3.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: Fixed value: generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parity bits of the 4096 messages; by syndrome the error patterns of weight up to 4, lightest first; their number."""
    parity = np.zeros(4096, np.int64)
    for message in range(4096):
        rest = message << 11
        for bit in range(22, 10, -1):
            if rest >> bit & 1:
                rest ^= GENERATOR << (bit - 11)
        parity[message] = rest
    patterns = np.zeros((2048, 6), np.int64)
    found = np.zeros(2048, np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            error = sum(1 << b for b in bits)
            s = int(parity[error >> 11] ^ (error & 2047))
            if weight < 4 or found[s] == 0 or bin(int(patterns[s, 0])).count("1") == 3:
                patterns[s, found[s]] = error
                found[s] += 1
    return parity, patterns, found


def nearby(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the codewords within distance 4 of 23-bit words, nearest first, shape (n, 6); and which count."""
    parity, patterns, found = tables()
    syndrome = parity[words >> 11] ^ (words & 2047)
    index = (words[:, None] ^ patterns[syndrome]) >> 11
    return index, np.arange(6) < found[syndrome][:, None]
