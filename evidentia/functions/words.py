"""Words and search terms of Arrow batches of lower-cased texts; the same as ``text.cleaned_words`` and ``text.tokens``."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from evidentia import params as P

#: Bytes and rows of text that a task works on at a time; a longer text is a part by itself.
PART_BYTES, PART_ROWS = 1 << 20, 1024

_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789-", dtype=np.uint8)] = True
_IDENT = re.compile(r"([a-z]{2,3})-([0-9]{2,3})")
_STOP = frozenset(P.STOP_WORDS)


def string_bytes(texts):
    """The bytes of a string array and its row edges in them."""
    flat = texts.cast(pa.large_string())
    edges = np.frombuffer(flat.buffers()[1], dtype=np.int64, count=len(flat) + flat.offset + 1)[flat.offset:] if len(flat) else np.zeros(1, np.int64)
    data = np.frombuffer(flat.buffers()[2], dtype=np.uint8) if len(flat) and flat.buffers()[2] else np.zeros(0, np.uint8)
    return data, edges


def parts(edges, size: int, rows: int):
    """Ranges of rows of at most ``size`` units and ``rows`` rows; a larger row is a range by itself."""
    low, n = 0, len(edges) - 1
    while low < n:
        high = max(low + 1, min(int(np.searchsorted(edges, edges[low] + size, side="right")) - 1, low + rows))
        yield low, high
        low = high


def spans(texts):
    """Per part of the batch: its rows ``low`` to ``high``, bytes, and the starts, sizes and rows (from ``low``) of its words.

    A word is a run of a-z, 0-9 and the hyphen. Bytes beyond ASCII end a word, as any other sign does.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    whole, edges = string_bytes(texts)
    for low, high in parts(edges, PART_BYTES, PART_ROWS):
        data, bounds = whole[edges[low]:edges[high]], edges[low:high + 1] - edges[low]
        # One sign before and after; a text's edge parts words, too.
        inside = np.zeros(len(data) + 2, dtype=bool)
        inside[1:-1] = _IN_WORD[data]
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[bounds] = True
        start = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
        end = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
        yield low, high, data, start, end - start, np.searchsorted(bounds, start, side="right") - 1


def _stems(word: str) -> list[str]:
    if len(word) > 4 and word.endswith("s") and not word.endswith("ss"):
        return [word, word[:-1]]
    if len(word) > 5 and word.endswith("ing"):
        return [word, word[:-3]]
    return [word]


def _hyphened(word: str) -> list[str]:
    ident = _IDENT.fullmatch(word)
    if ident:
        return [word, ident[1], ident[2], str(int(ident[2]))]
    return [t for part in word.split("-") if len(part) >= 2 and part not in _STOP for t in _stems(part)]


def _packed(data, starts, sizes):
    """Spans of bytes as a string array."""
    edges = np.r_[0, np.cumsum(sizes)]
    take = np.repeat(starts - edges[:-1], sizes) + np.arange(edges[-1])
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[take])))


def _terms(words):
    """Terms of distinct words: a dictionary of terms, the terms of all words one after another, and each word's edges in them."""
    data, edges = string_bytes(words)
    sizes, ends = np.diff(edges), edges[1:]
    hyphen = pc.match_substring(words, "-").to_numpy(zero_copy_only=False)
    plain = ~hyphen & (sizes >= 2) & ~pc.is_in(words, value_set=pa.array(sorted(_STOP), words.type)).to_numpy(zero_copy_only=False)
    back = lambda i: data[np.maximum(ends - i, 0)]
    s, n, g = ord("s"), ord("n"), ord("g")
    plural = plain & (sizes > 4) & (back(1) == s) & (back(2) != s)
    gerund = plain & ~plural & (sizes > 5) & (back(1) == g) & (back(2) == n) & (back(3) == ord("i"))
    stem = plural | gerund
    cut = _packed(data, edges[:-1][stem], (sizes - np.where(plural, 1, 3))[stem])
    split = [_hyphened(w) for w in words.filter(pa.array(hyphen)).to_pylist()]
    rest = pa.array([t for terms in split for t in terms], words.type)
    coded = pa.concat_arrays([words.filter(pa.array(plain)), cut, rest]).dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    many = plain.astype(np.int64) + stem
    many[hyphen] = [len(terms) for terms in split]
    bounds = np.r_[0, np.cumsum(many)]
    out, n_plain, n_stem = np.zeros(bounds[-1], np.int64), int(plain.sum()), int(stem.sum())
    out[bounds[:-1][plain]] = code[:n_plain]
    out[bounds[:-1][stem] + 1] = code[n_plain:n_plain + n_stem]
    out[np.repeat(hyphen, many)] = code[n_plain + n_stem:]
    return coded.dictionary, out, bounds


def count_terms(texts):
    """Per part of the batch: its rows ``low`` to ``high``, and lists of the terms of each row, their counts, and the row's length in terms.

    Each list ends with an empty term that stands for the row itself. A NULL text has no terms and no such end.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    given = texts.is_valid().to_numpy(zero_copy_only=False)
    for low, high, data, starts, sizes, owner in spans(texts):
        n = high - low
        words = _packed(data, starts, sizes).dictionary_encode()
        terms, of, bounds = _terms(words.dictionary)
        code = words.indices.to_numpy(zero_copy_only=False)
        many = np.diff(bounds)[code]
        # The places of a word's terms, for every word in turn.
        at = np.repeat(bounds[:-1][code] - np.r_[0, np.cumsum(many)[:-1]] if len(code) else np.zeros(0, np.int64), many) + np.arange(many.sum())
        row = np.repeat(owner, many)
        width = len(terms) + 1
        marks = np.flatnonzero(given[low:high])
        cells, counts = np.unique(np.r_[row * width + of[at], marks * width + width - 1], return_counts=True)
        offsets = np.searchsorted(cells, np.arange(n + 1) * width)
        named = pa.concat_arrays([terms, pa.array([""], terms.type)]).take(pa.array(cells % width)).cast(pa.string())
        edges = pa.array(offsets, pa.int32())
        yield (low, high, pa.ListArray.from_arrays(edges, named), pa.ListArray.from_arrays(edges, pa.array(counts, pa.int64())),
               pa.array(np.bincount(row, minlength=n), pa.int32()))
