"""Hashed character and word n-grams of many texts at once, in NumPy. The arrays made from a run take some 100 bytes a
character, so that a long text is cut into runs."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np

_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BLANK_CHARS = re.compile("[\x00-\x20]")
#: Of bytes; the white space that the contracts name.
SPACE = re.compile(rb"[\x20\x09-\x0d]")


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MUL
    return (h ^ (h >> np.uint64(29))) * _BASE


_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base to the power of 0 to n - 1, modulo 2^64; the longest array of moderate length is kept."""
    out = _powers.get(int(base), np.zeros(0, np.uint64))
    if len(out) < n:
        out, done = np.ones(n, np.uint64), 1
        with np.errstate(over="ignore"):
            while done < n:
                take = min(done, n - done)
                out[done : done + take] = out[:take] * (out[done - 1] * base)
                done += take
        if n <= 1 << 21:
            _powers[int(base)] = out
    return out[:n]


def token_hashes(symbols: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hashes of symbols[first:last]: differences of prefix sums, scaled back to their start by powers of the
    base's inverse."""
    total = np.empty(len(symbols) + 1, np.uint64)
    total[0] = 0
    np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(symbols)), out=total[1:])
    return mix((total[last] - total[first]) * powers(_INVERSE, len(symbols) + 1)[first])


def buckets(h: np.ndarray, bits: int) -> np.ndarray:
    return (mix(h) >> np.uint64(64 - bits)).astype(np.int64)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points in a row, and where each text starts (one entry more than texts)."""
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum(lengths)])


def char_ngrams(texts: list[str], orders: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of the character n-grams of every order, a run and an order at a time. A-Z and a-z fall
    together, white space is one space. Where a long text is cut, an n-gram may come twice."""
    for numbers, run in overlapping([f" {t.lower()} " for t in texts], max(orders) - 1):
        c, starts = code_points(run)
        c = np.where(c <= 32, np.uint32(32), c).astype(np.uint64) + np.uint64(1)
        owner = np.repeat(numbers, np.diff(starts))
        inside = np.repeat(np.arange(len(run)), np.diff(starts))
        for n in orders:
            if len(c) < n:
                continue
            h = np.zeros(len(c) - n + 1, np.uint64)
            for k in range(n):
                h = h * _BASE + c[k : len(c) - n + 1 + k]
            whole = inside[: len(h)] == inside[n - 1 :]
            yield owner[: len(h)][whole], buckets(h[whole] + np.uint64(n), bits)


def word_ngrams(texts: list[str], bits: int, run_chars: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of every token and pair of neighbouring tokens, a run at a time. Tokens are runs of word
    characters or of other printing characters, told apart by case. A pair of equal tokens has one bucket whatever the token."""
    before, last_token = -1, np.zeros(0, np.uint64)
    for run in segments(texts, run_chars, _BLANK_CHARS):
        c, starts = code_points([t + "\n" for _, t in run])
        numbers = np.array([k for k, _ in run])
        kind = np.where(c <= 32, 0, np.where((c >= 128) | (c >= 48) & (c < 58) | (c >= 65) & (c < 91) | (c >= 97) & (c < 123), 1, 2)).astype(np.int8)
        edge = np.flatnonzero(np.diff(kind, prepend=np.int8(0), append=np.int8(0)))
        first, last = edge[:-1], edge[1:]
        printing = kind[first] > 0
        first, last = first[printing], last[printing]
        token = token_hashes(c, first, last)
        owner = numbers[np.searchsorted(starts, first, "right") - 1]
        # the last token of the run before is a neighbour where a text goes on
        lead = last_token if len(owner) and owner[0] == before else last_token[:0]
        chain, of = np.concatenate([lead, token]), np.concatenate([owner[: len(lead)], owner])
        pair = of[1:] == of[:-1]
        a, b = chain[:-1][pair], chain[1:][pair]
        pairs = np.where(a == b, np.uint64(7), mix(a) * _MUL + b)
        if len(owner):
            before, last_token = owner[-1], token[-1:]
        yield np.concatenate([owner, of[1:][pair]]), buckets(np.concatenate([token, pairs]), bits)


def segments(texts: Iterable, run: int, blank: re.Pattern) -> Iterator[list[tuple]]:
    """Runs of (text number, segment), about `run` characters or bytes together; a null text is empty. A longer text is
    cut behind a blank into segments."""
    out, size, empty = [], 0, blank.pattern[:0]
    for k, t in enumerate(texts):
        t, at = t or empty, 0
        while True:
            end = len(t)
            if end - at > run:
                end = m.end() if (m := blank.search(t, at + run)) else end
            out.append((k, t[at:end]))
            size += end - at
            if size >= run:
                yield out
                out, size = [], 0
            at = end
            if at >= len(t):
                break
    if out:
        yield out


def overlapping(texts: list[str], overlap: int, run_chars: int = 1 << 18) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(text numbers, segments): runs of about run_chars; the segments of a longer text share `overlap` characters."""
    numbers, out, size = [], [], 0
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - overlap), run_chars):
            numbers.append(k)
            out.append(t[at : at + run_chars + overlap])
            size += len(out[-1])
            if size >= run_chars:
                yield np.array(numbers), out
                numbers, out, size = [], [], 0
    if out:
        yield np.array(numbers), out


def runs_of(texts: Iterable[str | None], run_chars: int = 1 << 18) -> Iterator[tuple[int, list[str]]]:
    """(first number, texts): consecutive texts of about run_chars together; null is empty."""
    at, out, size = 0, [], 0
    for k, t in enumerate(texts):
        out.append(t or "")
        size += len(out[-1])
        if size >= run_chars:
            yield at, out
            at, out, size = k + 1, [], 0
    if out:
        yield at, out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))
