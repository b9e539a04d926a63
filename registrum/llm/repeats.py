"""Removal of repeated passages: every byte covered by a string of LENGTH bytes that also starts earlier in the corpus.

Earlier is a smaller doc_id, or a smaller position in the same document; matches stay inside documents, and strings are judged on the
input. The corpus is never indexed as one text; equal strings are brought together first:

1. Each window of LENGTH bytes is given to an anchor, the leftmost of its SEED-byte strings with the smallest hash. Equal windows have equal
   anchors, and the windows of one anchor occurrence form one segment, so a document has about a segment for every 35 bytes.
2. Segments meet by anchor. One equal in whole (anchor, length and a further 56-bit hash) to an earlier segment is covered from end to end;
   a worker settles what repeats within its own batch at once, so that copies and common passages are thinned before the shuffle. Of
   anchors with several different segments, the first occurrence of each segment is asked for its text; all other anchors are done.
3. Buckets of those segments, in corpus order, get a run-length index each (`run_index`): its matching statistics are streamed from the samples
   at run ends, and windows whose LENGTH bytes also start at a smaller position are marked.
4. Anchors with more than HOT different segments would fill a task. Their segments are cut, at fixed distances from the anchor, into narrower
   ones of NARROW[0] windows, keyed by the bytes that all these windows share, and go through 2 and 3 again; what is still hot then, in NARROW[1].
5. Marks go back to their documents and overlapping ones are joined to spans.

Null texts are empty. Rows without an id are left whole. Rows that repeat a doc_id and its text are one document; an id with different texts
names no document, so its rows are left whole too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, freed, groups, mixed, prefix_hash, releasing, staged, utf8
from .run_index import RunIndex

#: Bytes of a repeated string and of an anchor; different segments of an anchor that go into one bucket; bytes of a bucket.
LENGTH, SEED, HOT, BUCKET = 100, 32, 1024, 1 << 18
#: Windows of the narrower segments of hot anchors.
NARROW = (8, 1)
#: Segments that a worker holds at once to settle what repeats among them.
SETTLED = 250_000

_DUP = np.uint64(128)


def segments(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each text data[at[i]:at[i + 1]] its segments: row, first byte in the text, windows, anchor hash, hash of the whole segment."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    base, data = int(at[0]), data[at[0] : at[-1]]
    across = LENGTH - SEED + 1
    if len(data) < LENGTH:
        return none
    sums, inverse = prefix_hash(data)
    size = len(data)
    seeds = mixed((sums[SEED:] - sums[:-SEED]) * inverse[: size - SEED + 1])
    low = (seeds >> np.uint64(31) << np.uint64(31)) | np.arange(len(seeds), dtype=np.uint64)
    width = 1
    while 2 * width <= across:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: size - LENGTH + 1], low[across - width :][: size - LENGTH + 1])
    anchor = (low & np.uint64((1 << 31) - 1)).astype(np.int64)
    lengths = np.diff(at)
    row = np.repeat(np.arange(len(lengths)), np.maximum(lengths - LENGTH + 1, 0))
    first = np.maximum(lengths - LENGTH + 1, 0).cumsum() - np.maximum(lengths - LENGTH + 1, 0)
    window = np.arange(len(row)) - first[row] + (at[:-1] - base)[row]  # starts of the windows that stay in their text
    if not len(window):
        return none
    anchor = anchor[window]
    edge = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]))
    many = np.diff(np.concatenate([edge, [len(window)]]))
    start, row = window[edge], row[edge]
    whole = mixed(((sums[start + many + LENGTH - 1] - sums[start]) * inverse[start]) ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return row, start - (at[:-1] - base)[row], many, seeds[anchor[edge]], whole


_ROWS = ["anchor", "segment", "doc", "start"]


def _thinned(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, segment, doc, start) in which copies of a segment among them are marked as settled."""
    anchor, segment, doc, start = (np.concatenate(x) for x in zip(*parts, strict=True))
    if not len(anchor):
        return
    order = np.lexsort((start, doc, segment, anchor))
    anchor, segment, doc, start = anchor[order], segment[order], doc[order], start[order]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (segment[1:] != segment[:-1])])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    copy = (doc != doc[first]) | (start != start[first])
    segment[copy] |= _DUP
    anchor[copy] = mixed(doc[copy].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + start[copy].astype(np.uint64))  # settled: spread at random
    for lo in range(0, len(anchor), 100_000):
        part = slice(lo, lo + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(anchor[part].view(np.int64)), pa.array(segment[part].view(np.int64)), pa.array(doc[part]), pa.array(start[part])], _ROWS)


def _anchored(docs: DataFrame) -> DataFrame:
    """anchor, segment, doc and start of every segment; the low byte of `segment` holds its windows less one, and a bit for settled copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts, held = batch.column(0).to_numpy(), [], 0
            data, at = utf8(batch.column(1))
            for lo, hi in groups(at):
                row, start, many, anchor, whole = segments(data, at[lo : hi + 1])
                parts.append((anchor, (whole & ~np.uint64(255)) | (many - 1).astype(np.uint64), ids[lo + row], start))
                held += len(row)
                if held > SETTLED:
                    yield from _thinned(parts)
                    parts, held = [], 0
            if parts:
                yield from _thinned(parts)

    return docs.mapInArrow(releasing(run), "anchor long, segment long, doc long, start long")


def narrower(data: np.ndarray, at: np.ndarray, anchor: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """The segments data[at[i]:at[i + 1]] cut into runs of up to `width` windows that stand at the same distances from the anchor (runs of one window need none): segment of each, first byte in it, windows, hash of the bytes that all such windows share, hash of the whole."""
    base, data = int(at[0]), data[at[0] : at[-1]]
    at = at - base
    sums, inverse = prefix_hash(data)
    windows = np.diff(at) - LENGTH + 1
    seeds = mixed((sums[SEED:] - sums[:-SEED]) * inverse[: len(data) - SEED + 1])
    lo, hi = at[:-1] + windows - 1, at[:-1] + LENGTH - SEED + 1  # where a seed lies in all of a segment's windows
    row = np.repeat(np.arange(len(windows)), hi - lo)
    place = np.arange(len(row)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[row]
    hit = np.flatnonzero(seeds[place] == anchor[row])
    where = np.full(len(windows), len(data))
    np.minimum.at(where, row[hit], place[hit])
    row = np.repeat(np.arange(len(windows)), windows)
    start = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows) + at[row]
    block = (where[row] - start) // width
    edge = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (block[1:] != block[:-1])])) if len(row) else np.zeros(0, np.int64)
    many = np.diff(np.concatenate([edge, [len(row)]]))
    row, start, block = row[edge], start[edge], block[edge]
    core = where[row] - block * width  # the last window start of a full block
    end = core - width + 1 + LENGTH
    key = mixed(((sums[end] - sums[core]) * inverse[core]) ^ np.uint64(width))
    whole = mixed(((sums[start + many + LENGTH - 1] - sums[start]) * inverse[start]) ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return row, start - at[row], many, key, whole


def _narrowed(pieces: DataFrame, width: int) -> DataFrame:
    """_anchored() for the narrower segments of rows of _pieces()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchor, doc, start = (batch.column(k).to_numpy() for k in range(3))
            data, at = utf8(batch.column(4))
            for lo, hi in groups(at):
                row, first, many, key, whole = narrower(data, at[lo : hi + 1], anchor[lo:hi].view(np.uint64), width)
                yield from _thinned([(key, (whole & ~np.uint64(255)) | (many - 1).astype(np.uint64), doc[lo:hi][row], start[lo:hi][row] + first)])

    return pieces.select("anchor", "doc", "start", "kinds", "bytes").mapInArrow(releasing(run), "anchor long, segment long, doc long, start long")


def _met(rows: DataFrame) -> DataFrame:
    """anchor, doc, start, size and kinds: segments that are covered whole (kinds 0), and the first ones of anchors with several kinds."""
    rows = rows.repartition("anchor")
    one = Window.partitionBy("anchor", "segment").orderBy("doc", "start")
    rows = rows.withColumn("first_doc", F.first("doc").over(one)).withColumn("first_start", F.first("start").over(one)).withColumn("turn", F.row_number().over(one))
    settled = F.col("segment").bitwiseAND(128) > 0
    rows = rows.withColumn("kinds", F.sum(F.when(settled | (F.col("turn") > 1), 0).otherwise(1)).over(Window.partitionBy("anchor")))
    copy = settled | (F.col("doc") != F.col("first_doc")) | (F.col("start") != F.col("first_start"))
    size = F.col("segment").bitwiseAND(127) + LENGTH
    return rows.where(copy | ((F.col("kinds") > 1) & (F.col("turn") == 1))).select("anchor", "doc", "start", size.alias("size"), F.when(copy, 0).otherwise(F.col("kinds")).alias("kinds"))


def _pieces(texts: DataFrame) -> DataFrame:
    """anchor, doc, start, kinds and bytes of the segments that a document's row lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, asked = batch.column(0).to_numpy(), batch.column(2)
            data, at = utf8(batch.column(1))
            first = np.concatenate([[0], np.cumsum(asked.value_lengths().to_numpy())])
            flat = asked.flatten()
            anchor, start, size, kinds = (flat.field(k).to_numpy() for k in range(4))
            row = np.repeat(np.arange(len(doc)), np.diff(first))
            lo = at[row] + start
            raw = [data[a:b].tobytes() for a, b in zip(lo, np.minimum(lo + size, at[row + 1]), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(doc[row]), pa.array(start), pa.array(kinds), pa.array(raw, pa.binary())], ["anchor", "doc", "start", "kinds", "bytes"])

    return texts.mapInArrow(releasing(run), "anchor long, doc long, start long, kinds long, bytes binary")


def _indexed(table: pa.Table) -> pa.Table:
    """doc, start and size of the passages of a bucket that match an earlier one."""
    doc, start = table.column("doc").to_numpy(), table.column("start").to_numpy()
    order = np.lexsort((start, doc))
    order = order[np.concatenate([[True], (np.diff(doc[order]) != 0) | (np.diff(start[order]) != 0)])]  # repeated rows are one document
    doc, start, raw = doc[order], start[order], table.column("bytes").to_pylist()
    index = RunIndex([np.frombuffer(raw[k], np.uint8) for k in order])
    late = index.late(LENGTH)
    of = np.searchsorted(index.starts, late, "right") - 1
    head = np.flatnonzero(np.concatenate([[True], (np.diff(late) > 1) | (np.diff(of) > 0)])) if len(late) else late
    many = np.diff(np.concatenate([head, [len(late)]]))
    of, late = of[head], late[head]
    out = pa.table({"doc": doc[of], "start": start[of] + late - index.starts[of], "size": many + LENGTH - 1})
    del index, raw
    freed()
    return out


def marked(docs: DataFrame, text: str = "text", hot: int = HOT, bucket: int = BUCKET) -> DataFrame:
    """doc_id, text and marks (start and size of covered passages in bytes, overlapping, unordered; null if none) of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    digest = F.xxhash64("text")
    torn = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(digest).alias("low"), F.max(digest).alias("high")).where("low <> high").select("doc_id")
    torn, torn_path = staged(torn, "torn")
    some = torn.limit(1).count() > 0
    whole = rows.where("doc_id is not null")
    whole = whole.join(torn, "doc_id", "left_anti") if some else whole

    level, marks, used = _anchored(whole), None, [torn_path]
    for width in (*NARROW, None):
        met, path = staged(_met(level), "segments")
        used.append(path)
        asked = met.where("kinds > 0")
        total, most = asked.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("kinds"), F.lit(0))).first()
        found = met.where("kinds = 0").select("doc", "start", "size")
        if total:
            lists = asked.groupBy("doc").agg(F.collect_list(F.struct("anchor", "start", "size", "kinds")).alias("asked"))
            pieces = _pieces(whole.join(lists, whole["doc_id"] == lists["doc"]).select("doc_id", "text", "asked"))
            buckets = F.pmod(F.xxhash64("anchor"), F.lit(-(-int(total) // bucket)))
            fit = pieces if width is None else pieces.where(F.col("kinds") <= hot)
            found = found.unionByName(fit.groupBy(buckets.alias("bucket")).applyInArrow(_indexed, "doc long, start long, size long"))
        marks = found if marks is None else marks.unionByName(found)
        if most <= hot or width is None:
            break
        level = _narrowed(pieces.where(F.col("kinds") > hot), width)
    marks, _ = staged(marks, "marks")
    for path in used:
        discard(spark, path)
    lists = marks.groupBy("doc").agg(F.collect_list(F.struct("start", "size")).alias("marks"))
    return rows.join(lists, rows["doc_id"] == lists["doc"], "left").select("doc_id", "text", "marks")


def cut(marked_rows: DataFrame, texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (start and end of removed runs), kept (the bytes left) and left_text (they as text without characters cut in two; null where nothing went, or without `texts`) of rows of marked()."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary, left_text string"
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept", "left_text"]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            sizes, flat = batch.column(2).value_lengths().fill_null(0).to_numpy(), batch.column(2).flatten()
            first = np.concatenate([[0], np.cumsum(sizes)])
            start, size = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            spans, kept, gone = [], [], []
            for k in range(batch.num_rows):
                own, n = data[at[k] : at[k + 1]], int(at[k + 1] - at[k])
                a = start[first[k] : first[k + 1]]
                if not len(a):
                    spans.append([])
                    kept.append(own.tobytes())
                    gone.append(0)
                    continue
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate((a + size[first[k] : first[k + 1]])[order])
                new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
                lo, hi = np.minimum(a[new], n), np.minimum(b[np.concatenate([new[1:], [len(a)]]) - 1], n)
                keep = np.zeros(n + 1, np.int64)
                np.add.at(keep, lo, 1)
                np.add.at(keep, hi, -1)
                left = own[np.cumsum(keep)[:n] == 0]
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(lo, hi, strict=True)])
                kept.append(left.tobytes())
                gone.append(n - len(left))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), pa.array(gone, pa.int64()), pa.array([len(x) for x in spans], pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary()), pa.array([x.decode(errors="ignore") if n and texts else None for x, n in zip(kept, gone, strict=True)], pa.string())], names)

    return marked_rows.mapInArrow(releasing(run), schema)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    return cut(marked(docs), False).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
