"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import drop as drop
from ..storage import exists as exists
from ..storage import shared_folder as shared_folder
from ..storage import stored as stored


#: Bytes of text that a vectorised step holds at a time (a single longer text is taken whole).
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def qualified(df: DataFrame, folder: str) -> str:
    """folder as a URI that any executor resolves alike."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString()
    return re.sub(r"^file:/+", "file:///", uri)


def small(df: DataFrame, rows: int, limit: int = 200_000) -> DataFrame:
    """df marked for broadcast only if its counted rows are few; otherwise Spark picks a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold about `limit` bytes; each range has at least one row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, len(column) + 1 + column.offset)[column.offset :] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix finaliser) over an array of uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POS = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Bytes that end words: ASCII white space, or everything in ASCII but letters and digits.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
MARKS = np.zeros(256, bool)
MARKS[:128] = True
MARKS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_UPPER = np.zeros(256, bool)
_UPPER[0x80:0x9F] = True
_UPPER[0x97] = False


class Words:
    """The words (runs of bytes that don't end words) of a run of texts, by numpy over their UTF-8 bytes.

    With `alone`, a character of a script without blanks between words (Han, Kana, Thai) is a word.  doc: each word's text number.  start, length: bytes.  hash: 64 bits of the word with A-Z and À-Þ in lower case.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, ends: np.ndarray = SPACE, alone: bool = False):
        base, n = int(offsets[0]), len(offsets) - 1
        buf = data[base : int(offsets[-1])]
        off = offsets - base
        self.n, self.buf, self.offsets = n, buf, off
        word = ~ends[buf]
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        inner = off[:-1][off[:-1] < len(buf)]
        begin[inner] = word[inner]  # a text's end ends a word
        if alone and len(buf) and int(buf.max()) >= 0xE0:
            lead = np.flatnonzero((buf >= 0xE3) & (buf <= 0xE9) | (buf == 0xE0) & np.isin(np.append(buf[1:], 0), (0xB8, 0xB9)))
            begin[lead] = True
            after = lead[lead + 3 < len(buf)] + 3
            begin[after] |= word[after]
        self.start = np.flatnonzero(begin)
        if len(self.start):
            # a word's bytes run to the next start but for white space, which the mask zeroes
            total = np.add.reduceat(word, self.start, dtype=np.int64)
            self.length = total
            lead = int(self.start[0])
            step = np.diff(np.append(self.start, len(buf)))
            place = (np.arange(lead, len(buf), dtype=np.int32 if len(buf) < 1 << 31 else np.int64) - np.repeat(self.start.astype(np.int32 if len(buf) < 1 << 31 else np.int64), step)).astype(np.uint8)
            fold = _FOLD[buf[lead:]]
            fold[1:] += (_UPPER[buf[lead + 1 :]] & (buf[lead:-1] == 0xC3)).astype(np.uint8) * np.uint8(32)
            value = fold.astype(np.uint64) + np.uint64(1)
            value *= _POS[place]
            del place
            value *= word[lead:]
            self.hash = mix64(np.add.reduceat(value, self.start - lead) ^ (total.astype(np.uint64) << np.uint64(48)))
            self.doc = np.searchsorted(off, self.start, side="right") - 1
        else:
            self.length = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            self.doc = np.zeros(0, np.int64)
        self.count = np.bincount(self.doc, minlength=n) if n else np.zeros(0, np.int64)


def hash_word(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(Words(data, np.array([0, len(data)])).hash[0])


def pow2_at_least(x: float) -> int:
    return 1 << max(0, math.ceil(math.log2(max(1.0, x))))
