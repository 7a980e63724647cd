"""Hashed character n-grams over whole batches of texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np

PAD = "\x02"
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def slices(texts: Iterable[str | None], signs: int = 1 << 18) -> Iterator[slice]:
    """Runs of texts with about ``signs`` signs in all, at least one text each: what is held at once doesn't depend on lengths."""
    start, held, i = 0, 0, 0
    for i, t in enumerate(texts, 1):
        held += len(t or "") + 16
        if held >= signs:
            yield slice(start, i)
            start, held = i, 0
    if start < i:
        yield slice(start, i)


def batch_codes(texts: Sequence[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each after ``pad`` pad signs and with runs of digits as one '0'; and each text's end.

    An end is the index behind a text's last code point; an empty text ends right behind its pad.
    """
    joined = (PAD * pad).join(["", *texts])
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    digit = (codes >= 48) & (codes <= 57)
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = ~(digit[1:] & digit[:-1])
    codes = np.where(digit, np.uint32(48), codes)[keep]
    return codes, np.r_[0, np.cumsum(keep)][np.cumsum(lengths + pad)]


def _joined(left: np.ndarray, right: np.ndarray, length: int) -> np.ndarray:
    """Hash of the gram that ends at each place, from that of its last ``length`` signs (right) and that of the rest (left)."""
    out = right * _MULTIPLY
    out[length:] += left[: len(left) - length]
    out ^= out >> np.uint64(29)
    out *= _MIX
    return out


def _of_order(n: int, known: dict[int, np.ndarray]) -> np.ndarray:
    if n not in known:
        last = 1 << ((n - 1).bit_length() - 1)
        known[n] = _joined(_of_order(n - last, known), _of_order(last, known), last)
    return known[n]


def rolling_hashes(codes: np.ndarray, orders: Sequence[int], bits: int) -> list[np.ndarray]:
    """For each order the bucket of the n-gram that ends at each code point, built up from grams of half the length."""
    # not a nested function that calls itself: the cycle would keep the arrays until Python collects its garbage
    known: dict[int, np.ndarray] = {1: (codes.astype(np.uint64) + np.uint64(1)) * _MIX}
    return [(_of_order(n, known) * _MULTIPLY >> np.uint64(64 - bits)).astype(np.int64) for n in orders]
