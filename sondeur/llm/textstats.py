"""Rule statistics of texts, computed for whole Arrow batches by numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import Words, chunks, hash_word, mix64, text_buffers

NAMES = (
    "log_chars", "log_words", "word_chars", "letters", "upper", "digits", "stops", "commas", "bangs", "symbols",
    "spaces", "non_ascii", "log_lines", "line_words", "short_lines", "repeated_lines", "distinct_words", "top_word",
    "distinct_pairs", "function_words", "longest_word", "long_words",
)

_FUNCTION = """the and of to in a is that for it was on are as with by at be this from or an have not they his her which
le la les de des et en un une que qui dans pour sur pas du au par avec il elle est ne se ce
der die das und ist nicht ein eine zu den mit von auf für im dem sich des auch als es
el los las y que por con para no una su al del se como más pero sus o""".split()

# Classes of bytes: 0 rest, 1 lower, 2 upper, 3 digit, 4 .?, 5 ,;:'"()-, 6 !, 7 symbol, 8 blank, 9 newline, 10 first byte
# of a longer character, 11 its other bytes.
_CLASS = np.zeros(256, np.uint8)
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".?", ",;:'\"()-", "!", "#$%&*@|~^<>{}[]\\/=+_`", " \t\r\f\v", "\n"), 1):
    _CLASS[[ord(c) for c in _chars]] = _k
_CLASS[0xC0:] = 10
_CLASS[0x80:0xC0] = 11
_STOPS = np.sort(np.array([hash_word(w) for w in _FUNCTION], np.uint64))


def _runs(doc: np.ndarray, key: np.ndarray, weight: np.ndarray | None, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By text: distinct keys, the most frequent key's count, and the weight of all but the first of equal keys."""
    packed = (doc.astype(np.uint64) << np.uint64(40)) | (key >> np.uint64(24))
    if weight is None:
        packed.sort()
    else:
        order = np.argsort(packed, kind="stable")
        packed = packed[order]
    new = np.ones(len(packed), bool)
    new[1:] = packed[1:] != packed[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(packed)))
    owner = (packed[first] >> np.uint64(40)).astype(np.int64)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, owner, size)
    again = np.zeros(n)
    if weight is not None:
        rest = ~new
        again = np.bincount((packed[rest] >> np.uint64(40)).astype(np.int64), weight[order][rest], minlength=n)
    return np.bincount(owner, minlength=n), top, again


def _part(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    w = Words(data, offsets)
    n, buf, off = w.n, w.buf, w.offsets
    size = np.diff(off)
    owner = np.repeat(np.arange(n, dtype=np.int32) << 4, size)
    c = np.bincount(owner | _CLASS[buf], minlength=16 * n).reshape(n, 16).astype(np.float64)
    chars = np.maximum(size - c[:, 11], 1)
    words = np.maximum(w.count, 1)
    letters = c[:, 1] + c[:, 2] + c[:, 10]
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, w.doc, w.length)
    distinct, top, _ = _runs(w.doc, w.hash, None, n)
    same = w.doc[1:] == w.doc[:-1] if len(w.doc) else np.zeros(0, bool)
    pair = mix64(w.hash[:-1] * np.uint64(3) + w.hash[1:])[same] if len(w.doc) > 1 else np.zeros(0, np.uint64)
    pairs, _, _ = _runs(w.doc[1:][same] if len(w.doc) > 1 else w.doc[:0], pair, None, n)
    known = _STOPS[np.minimum(np.searchsorted(_STOPS, w.hash), len(_STOPS) - 1)] == w.hash
    # Lines: words between line ends; those without words are left out.
    ends = np.flatnonzero(buf == 10)
    row = np.searchsorted(ends, w.start) + w.doc  # rises by line and by text
    fresh = np.ones(len(row), bool)
    fresh[1:] = row[1:] != row[:-1]
    at = np.flatnonzero(fresh)
    if len(at):
        per = np.diff(np.append(at, len(row)))
        place = np.arange(len(row)) - np.repeat(at, per)
        line = np.add.reduceat(w.hash * (mix64(place.astype(np.uint64)) | np.uint64(1)), at)
        line_doc = w.doc[at]
        lines = np.bincount(line_doc, minlength=n)
        short = np.bincount(line_doc[per < 3], minlength=n)
        _, _, again = _runs(line_doc, mix64(line), per.astype(float), n)
    else:
        lines = short = again = np.zeros(n)
    full = np.maximum(lines, 1)
    cols = [
        np.log1p(size - c[:, 11]), np.log1p(w.count), (chars - c[:, 8] - c[:, 9]) / words, letters / chars, c[:, 2] / np.maximum(letters, 1), c[:, 3] / chars,
        c[:, 4] / words, c[:, 5] / words, c[:, 6] / words, c[:, 7] / words, (c[:, 8] + c[:, 9]) / chars, c[:, 10] / chars,
        np.log1p(lines), np.log1p(w.count / full), short / full, again / words, distinct / words, top / words,
        pairs / np.maximum(w.count - 1, 1), np.bincount(w.doc[known], minlength=n) / words, np.log1p(longest),
        np.bincount(w.doc[w.length > 20], minlength=n) / words,
    ]
    out = np.column_stack(cols)
    out[w.count == 0] = 0
    return out


def statistics(column: pa.Array) -> np.ndarray:
    """One row of NAMES for each text; a null, empty or blank text has all zeros."""
    data, offsets = text_buffers(column)
    parts = [_part(data, offsets[i : j + 1]) for i, j in chunks(offsets)]
    return np.vstack(parts) if parts else np.zeros((0, len(NAMES)))
