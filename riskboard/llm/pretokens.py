"""Pre-tokens of many texts at once, for the common byte-level pattern.

``PATTERN`` (contractions, words, numbers and signs with a blank before, white space) only
looks at classes of characters, so its matches follow from where classes change. Equal
pre-tokens are found by two polynomial hashes; where the two disagree, the caller leaves
the texts to the pattern itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import regex

# Fixed value: the pattern this module stands in for.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SIGN, _LETTER, _NUMBER, _SPACE = range(4)
_BLANK, _QUOTE = 32, 39
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _classes() -> np.ndarray:
    """Class of every character, as the pattern's library sees it."""
    points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    whole = "".join(map(chr, points))
    kind = np.zeros(len(points), np.uint8)
    for value, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, whole):
            kind[m.start():m.end()] = value
    out = np.zeros(0x110000, np.uint8)
    out[points] = kind
    return out


_TABLES: dict = {}


def _table(name, n: int = 0) -> np.ndarray:
    """Tables of this worker, made when first needed: classes, and powers of the bases."""
    if name == "class":
        if name not in _TABLES:
            _TABLES[name] = _classes()
    elif name not in _TABLES or len(_TABLES[name]) < n:
        powers = np.full(max(n, 1 << 16), name, np.uint64)
        powers[0] = 1
        _TABLES[name] = np.cumprod(powers, dtype=np.uint64)
    return _TABLES[name]


def starts(chars: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in texts put end to end (code points, bounds of texts)."""
    kind = _table("class")[chars]
    first = np.zeros(len(chars), bool)
    first[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    edge = first.copy()
    edge[1:] |= kind[1:] != kind[:-1]
    head = edge.copy()
    run = np.flatnonzero(edge & ~first & (kind != _SPACE))
    after = run[kind[run - 1] == _SPACE]
    head[after - 1] = True  # the last white space goes by itself, or
    head[after[chars[after - 1] == _BLANK]] = False  # with what follows, if it is a blank
    # a quote by itself with letters after it may be a contraction
    quote = np.flatnonzero(edge & head & (chars == _QUOTE))
    quote = quote[quote + 1 < len(chars)]
    quote = quote[(kind[quote + 1] == _LETTER) & ~first[quote + 1]]
    a, two = chars[quote + 1], np.minimum(quote + 2, len(chars) - 1)
    b = np.where(first[two] | (two != quote + 2), 0, chars[two])
    size = np.isin(a, [ord(x) for x in "stmd"]).astype(np.int64)
    for pair in ("re", "ve", "ll"):
        size[(a == ord(pair[0])) & (b == ord(pair[1]))] = 2
    quote, size = quote[size > 0], size[size > 0]
    head[quote + 1] = False
    rest = quote + 1 + size
    rest = rest[rest < len(chars)]
    head[rest] = True
    return np.flatnonzero(head)


def hashed(texts: list[str]) -> tuple[np.ndarray, ...]:
    """``code, place, first, second, counts`` of all pre-tokens of texts: which kind each
    one is, and for each kind its place (start, end) in the joined texts and two hashes;
    ``counts`` are the pre-tokens of each text. ``code`` is None if the hashes disagree."""
    whole = "".join(texts)
    bounds = np.append(0, np.cumsum([len(t) for t in texts]))
    chars = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    at = starts(chars, bounds) if len(chars) else np.empty(0, np.int64)
    ends = np.append(at[1:], len(chars))[:len(at)]
    mixed = (chars.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(31)
    hashes = []
    for base in _BASES:
        prefix = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum(mixed * _table(base, len(chars))[:len(chars)], out=prefix[1:])
        hashes.append((prefix[ends] - prefix[at]) * _table(pow(base, -1, 1 << 64), len(chars))[at])
    code, kinds = pd.factorize(hashes[0])
    one = np.empty(len(kinds), np.int64)
    one[code[::-1]] = np.arange(len(code))[::-1]
    size = ends - at
    if (hashes[1] != hashes[1][one][code]).any() or (size != size[one][code]).any():
        code = None
    counts = np.diff(np.searchsorted(at, bounds))
    return code, np.stack([at[one], ends[one]], axis=1), hashes[0][one], hashes[1][one], counts
