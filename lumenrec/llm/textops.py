"""Hashes of words and shingles, for use inside Python tasks."""

from __future__ import annotations

import numpy as np
import xxhash

#: Translation of A-Z to a-z, other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SHINGLE = 5
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MEMO_ENTRIES = 1 << 19


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_memo = _WordHash()


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; bytes.split() splits at just these."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def windows(hashes: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """One hash for each run of ``width`` words; the whole sequence as one where it is shorter."""
    width = min(width, len(hashes))
    if not width:
        return hashes
    n = len(hashes) - width + 1
    acc = hashes[:n].copy()
    for j in range(1, width):
        acc *= _GOLDEN
        acc += hashes[j : j + n]
    return mix(acc + np.uint64(width))


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct 5-word shingles of a text as sorted 64-bit hashes; empty without words."""
    return np.unique(windows(hash_words(words_of(text))))


def portions(batches, size: int):
    """Ids and texts of Arrow batches ``(doc_id, text)``, about ``size`` bytes of text (one text at least) at a time; a null text is empty."""
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        texts, held, first = [], 0, 0
        for i, text in enumerate(batch.column("text")):
            texts.append(text.as_py() or "")
            held += len(texts[-1])
            if held >= size:
                yield ids[first : i + 1], texts
                texts, held, first = [], 0, i + 1
        if texts:
            yield ids[first:], texts


def places(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[0], starts[0] + 1 ..`` for ``counts[0]`` places, and so on for each run."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)
