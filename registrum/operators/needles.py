"""Needles found in texts as they stand, in one pass over the texts' bytes: no text is moved, and no piece of a text but what looks like a needle.

A window of 1, 2, 4, ... bytes has a number, made of the numbers of its halves. A needle begins with a window of the largest such width that it can hold, and
the window that it ends with covers the rest. A table of bits knows the windows that needles begin with and, by length, their two windows together. Every
task asks it at each place of a text. What passes is sent as it stands and joined with the needles, so the table, which other needles' bits may pass in
vain, decides nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

#: The widest window; of a needle beyond twice as many bytes the table knows both ends only.
WIDEST = 1 << 12
#: Places of a text that are asked at once; bytes and rows that are sent at once.
PLACES, SENT, ROWS = 1 << 17, 1 << 22, 20_000
#: Bits a needle, and the fewest and the most bits of the table (128 KB and 32 MB).
SPREAD, FEWEST, MOST = 192, 1 << 20, 1 << 28


def _width(length: int) -> int:
    return min(WIDEST, 1 << (length.bit_length() - 1))


@cache
def _odd(use: str, n: int) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(f"{use} {n}".encode(), digest_size=8).digest(), "big") | 1)


def _joined(left: np.ndarray, right: np.ndarray, width: int) -> np.ndarray:
    """The number of two windows of a width: all of their bytes while these fit, else a hash."""
    return (left << np.uint64(8 * width)) | right if width <= 4 else left * _odd("joined", width) + right


def _slots(numbers: np.ndarray, use: str, n: int, bits: int) -> np.ndarray:
    return ((numbers ^ _odd("from", n)) * _odd(use, n)) >> np.uint64(65 - bits.bit_length())


def _set(table: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (table[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column without nulls, and where each of its values begins and the last one ends."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8), offsets


def _table(needles: DataFrame, most: int) -> tuple[Broadcast, int]:
    """The table of bits of needles (needle, binary), and its bits: a power of two."""
    bits = 1 << (max(FEWEST, min(needles.count() * SPREAD, most)) - 1).bit_length()

    def number(block: np.ndarray) -> np.ndarray:
        block, width = block.astype(np.uint64), 1
        while block.shape[1] > 1:
            block, width = _joined(block[:, 0::2], block[:, 1::2], width), 2 * width
        return block[:, 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = _bytes(batch.column(0))
            sizes = np.diff(at)
            for n in np.unique(sizes).tolist():
                width, every = _width(n), at[:-1][sizes == n]
                for k in range(0, len(every), max(1, PLACES // width)):
                    begins = every[k : k + max(1, PLACES // width), None] + np.arange(width)
                    first = number(data[begins])
                    both = _joined(first, number(data[begins + (n - width)]), width)
                    slots = np.concatenate([_slots(first, "begins", width, bits), _slots(both, "whole", n, bits), _slots(both, "again", n, bits)])
                    word, place = np.unique(slots >> np.uint64(6), return_inverse=True)
                    bit = np.zeros(len(word), np.uint64)
                    np.bitwise_or.at(bit, place, np.uint64(1) << (slots & np.uint64(63)))
                    yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bit.view(np.int64))], ["word", "bit"])

    found = needles.select("needle").mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    table = np.zeros(bits >> 6, "<u8")
    table[found.column("word").to_numpy()] = found.column("bit").to_numpy().view(np.uint64)
    return needles.sparkSession.sparkContext.broadcast(table.view(np.uint8)), bits


def _places(data: np.ndarray, reach: int, table: np.ndarray, bits: int, lengths: dict[int, list[int]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, places below `reach` and numbers of what looks like a needle; data goes on behind them by the longest needle."""
    at, width = data.astype(np.uint64), 1
    while True:
        if width in lengths:
            some = np.flatnonzero(_set(table, _slots(at[:reach], "begins", width, bits)))
            for n in lengths[width]:
                both = _joined(at[some], at[some + (n - width)], width)
                kept = np.flatnonzero(_set(table, _slots(both, "whole", n, bits)))
                kept = kept[_set(table, _slots(both[kept], "again", n, bits))]
                if len(kept):
                    yield n, some[kept], both[kept]
        if width >= max(lengths):
            return
        at, width = _joined(at[:-width], at[width:], width), 2 * width


def found(texts: DataFrame, needles: DataFrame, most: int = MOST) -> DataFrame:
    """uid of texts (uid, text) and the needle (binary) for all that texts hold of needles (needle, binary, none empty), and little else; a text sends a needle
    once for each stretch of PLACES bytes that it reaches into. The table has `most` bits at most."""
    lengths: dict[int, list[int]] = {}
    for (n,) in needles.select(F.length("needle")).distinct().collect():
        lengths.setdefault(_width(n), []).append(n)
    longest = max(map(max, lengths.values()))
    table, bits = _table(needles, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _bytes(batch.column(1))
            ends, rows, values, size = offsets[1:], [], [], 0

            def sent() -> pa.RecordBatch:
                out = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(values, pa.binary())], ["uid", "needle"])  # noqa: B023
                rows.clear(), values.clear()  # noqa: B023
                return out

            step = max(PLACES, longest)
            for start in range(int(offsets[0]), int(offsets[-1]), step):
                reach = min(step, int(offsets[-1]) - start)
                part = np.zeros(reach + longest, np.uint8)
                own = data[start : min(int(offsets[-1]), start + reach + longest)]
                part[: len(own)] = own
                raw = part.tobytes()
                for n, at, numbers in _places(part, reach, table.value, bits, lengths):
                    row = np.searchsorted(ends, at + start, "right")
                    inside = at + start + n <= ends[row]
                    at, numbers, row = at[inside], numbers[inside], row[inside]
                    if n <= 8:  # the number is the needle
                        different, which = np.unique(numbers, return_inverse=True)
                        first = np.unique(row * len(different) + which, return_index=True)[1]
                    else:
                        seen: dict[tuple[int, bytes], int] = {}
                        for k, (r, a) in enumerate(zip(row.tolist(), at.tolist(), strict=True)):
                            seen.setdefault((r, raw[a : a + n]), k)
                        first = np.fromiter(seen.values(), np.int64, len(seen))
                    for k in range(0, len(first), max(1, SENT // n)):
                        some = first[k : k + max(1, SENT // n)]
                        rows.append(row[some])
                        values += [raw[a : a + n] for a in at[some].tolist()]
                        size += len(some) * n
                        if size >= SENT or len(values) >= ROWS:
                            yield sent()
                            size = 0
            if rows:
                yield sent()

    schema = StructType([texts.schema["uid"], StructField("needle", BinaryType())])
    return texts.where("text is not null").select("uid", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)
