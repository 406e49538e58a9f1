"""Words of texts as arrays, and Rabin-Karp fingerprints of their n-grams by prefix polynomials."""

from __future__ import annotations

import numpy as np

#: Bytes of a polynomial's prefix sums at once; texts are gathered up to so many bytes, longer ones cut.
CHUNK = 1 << 21
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BLANK, _CUT = b" \t", b".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, np.uint8)
_KIND[list(_BLANK)] = 1
_KIND[list(_CUT)] = 2


def mixed(values: np.ndarray) -> np.ndarray:
    """Unsigned numbers with their bits spread, so that any few of them may pick a place."""
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(29))


class Polynomial:
    """Fingerprints modulo 2^64: sum of value(byte) * base^position, moved back to position zero.

    The values of all separators are one value: words are hashed as if parted by single blanks.
    """

    def __init__(self, seed: int):
        random = np.random.RandomState(seed)
        self.base = int(random.randint(1 << 29, 1 << 31)) * 8 + 5
        self.values = random.randint(0, 1 << 32, 256, np.uint64) << np.uint64(32)
        self.values |= random.randint(0, 1 << 32, 256, np.uint64) | np.uint64(1)
        self.values[list(_BLANK + _CUT)] = self.values[0x20]
        self.tables = (np.ones(1, np.uint64), np.ones(1, np.uint64))

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of the base and of its inverse; those of a text longer than a chunk are not kept."""
        if len(self.tables[0]) >= n:
            return self.tables
        made = []
        for factor in (self.base, pow(self.base, -1, 1 << 64)):
            row = np.full(max(n, CHUNK), factor, np.uint64)
            row[0] = 1
            made.append(np.multiply.accumulate(row))
        if n <= CHUNK:
            self.tables = tuple(made)
        return made[0], made[1]

    def hashes(self, words: Words, widths: list[int]) -> dict[int, np.ndarray]:
        """Per width the fingerprint of the n-gram at each word; zero where too few words follow."""
        n, most = len(words), max(widths)
        out = {k: np.zeros(n, np.uint64) for k in widths}
        a = 0
        while a < n:
            last = int(np.searchsorted(words.ends, words.starts[a] + CHUNK))  # words a..last-1 fit
            b = n if last >= n else max(a + 1, last - most + 1)
            low, high = int(words.starts[a]), int(words.ends[min(b + most - 1, n) - 1])
            power, inverse = self.powers(high - low + 1)
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(self.values[words.compact[low:high]] * power[: high - low], out=sums[1:])
            for k in widths:
                m = min(b, n - k + 1)
                if m > a:
                    first = words.starts[a:m] - low
                    found = (sums[words.ends[a + k - 1 : m + k - 1] - low] - sums[first]) * inverse[first]
                    out[k][a:m] = mixed(found)
            a = b
        return out


class Words:
    """The words of some texts: bytes with one separator behind each word, and where words start and end.

    Only A-Z are lower-cased. `text` is the position of a word's text, `piece` grows at every cut.
    """

    def __init__(self, texts: list[str]):
        parts = [t.encode().translate(_LOWER) for t in texts]
        raw = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
        kind = _KIND[raw]
        inside = kind == 0
        keep = inside.copy()
        keep[1:] |= inside[:-1]
        self.compact = raw[keep]
        self.ends = np.flatnonzero(kind[keep])
        self.starts = np.concatenate(([0], self.ends[:-1] + 1)) if len(self.ends) else self.ends
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        at = np.flatnonzero(begins)
        self.piece = np.searchsorted(np.flatnonzero(kind == 2), at)
        limits = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        self.counts = np.diff(np.searchsorted(at, limits), prepend=0)
        self.text = np.repeat(np.arange(len(parts)), self.counts)

    def __len__(self) -> int:
        return len(self.ends)

    def phrase(self, at: int, width: int) -> str:
        """The words from `at` on, parted by single blanks."""
        words = range(at, at + width)
        return b" ".join(self.compact[self.starts[i] : self.ends[i]].tobytes() for i in words).decode()


def chunks(lengths: list[int]) -> list[tuple[int, int]]:
    """Ranges of texts that together stay under a chunk's bytes; a longer text is a range of its own."""
    out, start, total = [], 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > CHUNK:
            out.append((start, i))
            start, total = i, 0
        total += n
    if len(lengths) > start:
        out.append((start, len(lengths)))
    return out
