"""Phrase collocations, counted length by length.

A block of text becomes a stream of numbers, one for each word, with a mark between pieces. Words that are frequent in all blocks of a language
get a name (a number from 0) by a global count and are joined back to the blocks once, which keep named words only. From then on a phrase is
called by the names of its words, so a block needs no further join: it counts its distinct phrases of k named words, the counts are summed
globally, and frequent ones stay. For k > 2 a block leaves out phrases whose first or last k-1 words are not frequent; it asks a table of bits for
that, in which each frequent phrase has set one bit. A bit set by another phrase lets a phrase through in vain, never out: what is frequent is
decided by the count alone, also where the table, whose size has a bound, is full. A phrase's first and last k-1 words are its parents: cuts and the
phrases inside a phrase are looked up along them.

Counts are summed within a block before they are shuffled, names of words reach a block only for what it holds, and a block has a bounded size, so no
task holds a language or a phrase. Names are broadcast only while they are at most `BROADCAST` rows; beyond it the same join is shuffled.

Texts are lower-cased in A-Z, split at `.,;:!?` and line ends into pieces, and at spaces and tabs into words. Null and empty texts have no
words; null languages are `und`, together with the language of that name; long texts are read whole; repeated rows count each; other columns are
not read; an empty table gives none. Ties of a score go to the more frequent phrase, then to the smaller one by UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import discard, freed, mixed, releasing, staged, utf8

#: Words of the longest phrase, least occurrences, percentage of a phrase's occurrences inside a longer one that drops it, rows a language.
WORDS, LEAST, INSIDE, TOP = 4, 30, 80, 2000
#: Bytes of text in a block; rows of names that are few enough to broadcast; parts of a language that are ranked before the language is.
BLOCK, BROADCAST, PARTS = 4 << 20, 1_000_000, 64
#: Bits a phrase in the table of frequent phrases, its bits at most (32 MB), rows that a block sends at once.
SPREAD, BITS, ROWS = 16, 1 << 28, 1 << 18

_BREAK, _SPACE = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_SPACE[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _stream(text: bytes) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The numbers of the text's words with -1 between pieces, the distinct words, and their counts."""
    data = np.frombuffer(text, np.uint8)
    ends_piece = _BREAK[data]
    inside = ~(ends_piece | _SPACE[data])
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(_LOWER[data[inside]])).dictionary_encode()
    numbers = words.indices.to_numpy(zero_copy_only=False)
    piece = np.cumsum(ends_piece)[starts]
    new = np.diff(piece, prepend=piece[:1]) > 0
    stream = np.full(len(starts) + int(new.sum()), -1, np.int32)
    stream[np.arange(len(starts)) + np.cumsum(new)] = numbers
    return stream, words.dictionary, np.bincount(numbers, minlength=len(words.dictionary)).astype(np.int64)


def _packed(stream: np.ndarray) -> list[pa.Array]:
    """A stream compressed, and its size in bytes."""
    return [pa.array([pa.compress(stream, "zstd", asbytes=True)]), pa.array([stream.nbytes], pa.int32())]


def _blocks(docs: DataFrame, text: str, lang: str, size: int) -> DataFrame:
    """block, lang, stream, the block's words and their counts."""
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    schema = StructType.fromDDL("block long, lang string, stream binary, size int, words array<string>, counts array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        number = TaskContext.get().partitionId() << 33

        def full(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal number
            for of in [k for k, n in sizes.items() if n >= least]:
                stream, words, counts = _stream(b"\n".join(held.pop(of)))
                del sizes[of]
                columns = [pa.array([number], pa.int64()), pa.array([of]), *_packed(stream), pa.ListArray.from_arrays([0, len(words)], words.cast(pa.string())), pa.ListArray.from_arrays([0, len(counts)], pa.array(counts))]
                number += 1
                yield pa.RecordBatch.from_arrays(columns, schema.names)

        for batch in batches:
            data, at = utf8(batch.column(1))
            for k, of in enumerate(batch.column(0).to_pylist()):
                held.setdefault(of, []).append(data[at[k] : at[k + 1]].tobytes())
                sizes[of] = sizes.get(of, 0) + int(at[k + 1] - at[k]) + 1
                if sizes[of] >= size:
                    yield from full(size)
                elif sum(sizes.values()) >= 4 * size:
                    yield from full(0)
        yield from full(0)

    return rows.mapInArrow(releasing(run), schema)


def _named(blocks: DataFrame, known: DataFrame) -> DataFrame:
    """block, its stream of named words, and their names. known: block, number and id, which meet the block's stream as sorted rows, one block at a
    time, so a task's memory depends neither on how many blocks it has nor on the corpus."""
    schema = StructType.fromDDL("block long, stream binary, size int, ids array<long>")
    none = pa.Table.from_batches([], pa.schema([("block", pa.int64()), ("stream", pa.binary()), ("size", pa.int32()), ("ids", pa.list_(pa.int64()))]))

    def run(held: pa.Table, named: pa.Table) -> pa.Table:
        if not held.num_rows or not named.num_rows:
            return none
        numbers, ids = (named.column(c).to_numpy() for c in ("number", "id"))
        block, packed, size = (held.column(c)[0] for c in ("of", "packed", "size"))
        stream = np.frombuffer(pa.decompress(packed.as_buffer(), size.as_py(), "zstd"), np.int32)
        place = np.full(int(max(stream.max(), numbers.max())) + 2, -1, np.int32)  # its last place is that of -1
        place[numbers] = np.arange(len(numbers), dtype=np.int32)
        at = place[stream]
        at = at[(at >= 0) | np.concatenate([[True], at[:-1] >= 0])]  # one mark is enough between runs
        made = pa.Table.from_arrays([pa.array([block.as_py()]), *_packed(at), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids, pa.int64()))], schema.names)
        freed()
        return made

    streams = blocks.select(F.col("block").alias("of"), F.col("stream").alias("packed"), "size").groupBy("of")
    return streams.cogroup(known.groupBy("block")).applyInArrow(run, schema)  # names of their own: both sides come from the same table


def _slots(columns: list[np.ndarray], bits: int) -> np.ndarray:
    """The places of phrases, given by a column of names for each of their words, in a table of so many bits (a power of two)."""
    at = np.zeros(len(columns[0]), np.uint64)
    for names in columns:
        at = mixed(at + names.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return at & np.uint64(bits - 1)


def _table(phrases: DataFrame, width: str, most: int) -> Broadcast:
    """The table of bits of frequent phrases: at most `most` bits, and as many as its rows need; what is sent are its words that are not zero."""
    bits = 1 << (max(64, min(phrases.count() * SPREAD, most)) - 1).bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                data, at = utf8(batch.column(0))
                slot = _slots(list(data[at[0] : at[-1]].view(width).reshape(batch.num_rows, -1).T), bits)
                word, place = np.unique(slot >> np.uint64(6), return_inverse=True)
                bit = np.zeros(len(word), np.uint64)
                np.bitwise_or.at(bit, place, np.uint64(1) << (slot & np.uint64(63)))
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bit.view(np.int64))], ["word", "bit"])

    found = phrases.select("key").mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    table = np.zeros(bits >> 6, np.uint64)
    table[found.column("word").to_numpy()] = found.column("bit").to_numpy().view(np.uint64)
    return phrases.sparkSession.sparkContext.broadcast(table)


def _phrases(blocks: DataFrame, k: int, width: str, shorter: Broadcast | None) -> DataFrame:
    """The blocks' distinct phrases of k named words as key (the names of the words, one after the other) and their counts n; only those whose first
    and last k-1 words are in the table of frequent ones, if that is given."""
    schema = StructType.fromDDL("key binary, n int")

    def counted(at: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        whole = np.ones(max(0, len(at) - k + 1), bool)
        for j in range(k):
            whole &= at[j : len(whole) + j] >= 0
        if shorter is not None and len(whole):
            table, names = shorter.value, ids[at]  # a mark gets a name, but is in no whole phrase
            slot = _slots([names[j : len(whole) + 1 + j] for j in range(k - 1)], len(table) << 6)
            often = (table[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
            whole &= often[:-1] & often[1:]
        begins = np.flatnonzero(whole)
        if not len(begins):
            return
        code, below = at[begins].astype(np.int64), []  # below: for each length the distinct codes of its phrases
        for j in range(1, k):
            if j > 1:
                distinct, code = np.unique(code, return_inverse=True)
                below.append(distinct)
            code = code * len(ids) + at[begins + j]
        code, counts = np.unique(code, return_counts=True)
        columns = []
        for j in range(k - 1, 0, -1):
            code, last = np.divmod(code, len(ids))
            columns.append(last)
            code = below[j - 2][code] if j > 1 else code
        words = np.stack([ids[c] for c in [code, *reversed(columns)]], axis=1).astype(width)
        for lo in range(0, len(words), ROWS):
            some = words[lo : lo + ROWS]
            ends = np.arange(len(some) + 1, dtype=np.int32) * (k * some.itemsize)
            key = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(ends), pa.py_buffer(some.tobytes())])
            yield pa.RecordBatch.from_arrays([key, pa.array(counts[lo : lo + ROWS], pa.int32())], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed, size, ids in zip(*batch.columns, strict=True):
                stream = np.frombuffer(pa.decompress(packed.as_buffer(), size.as_py(), "zstd"), np.int32)
                yield from counted(stream, ids.values.to_numpy())

    return blocks.select("stream", "size", "ids").mapInArrow(releasing(run), schema)


def _counted(entries: DataFrame, keys: list[str], least: int, name: str) -> tuple[DataFrame, str]:
    """The keys that occur often enough, with their count f and a name: id."""
    return staged(entries.groupBy(*keys).agg(F.sum("n").alias("f")).where(F.col("f") >= least).withColumn("id", F.monotonically_increasing_id()), name)


def _numbered(names: DataFrame) -> tuple[DataFrame, str]:
    """names with ids from 0 without gaps, and the type that holds them: four bytes while there are few enough. Only counts by written part are ranked."""
    part = F.shiftright("id", 33)  # monotonic ids hold the part above 33 bits
    sizes = names.groupBy(part.alias("part")).agg(F.count("*").alias("rows")).collect()
    starts, total = [], 0
    for row in sorted(sizes):
        starts.append((row["part"], total))
        total += row["rows"]
    starts = names.sparkSession.createDataFrame(starts, "part int, start long")
    dense = names.withColumn("part", part.cast("int")).join(F.broadcast(starts), "part").withColumn("id", F.col("start") + F.col("id").bitwiseAND((1 << 33) - 1))
    return dense.drop("part", "start"), ">u4" if total <= 1 << 32 else ">u8"


def _known(entries: DataFrame, names: DataFrame, keys: list[str], broadcast: int) -> DataFrame:
    """block, number and id of its entries that have a name. Each entry finds one name or none."""
    names = names.select(*keys, "id")
    few = names.limit(broadcast + 1).count() <= broadcast
    return entries.join(F.broadcast(names) if few else names, keys).select("block", "number", "id")


def named_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", words: int = WORDS, least: int = LEAST, block: int = BLOCK, broadcast: int = BROADCAST, bits: int = BITS) -> tuple[list[DataFrame], DataFrame, list[str]]:
    """For each length the frequent phrases (lang, id, left, right, phrase, last word, f, and the counts of their beginnings and ends), the words
    of each language (lang, n), and the staged tables beneath."""
    paths: list[str] = []

    def kept(made: tuple[DataFrame, str]) -> DataFrame:
        paths.append(made[1])
        return made[0]

    blocks, path = staged(_blocks(docs, text, lang, block), "phrase-blocks", "zstd")
    entry = F.posexplode(F.arrays_zip("words", F.col("counts").alias("n"))).alias("number", "entry")
    entries = blocks.select("block", "lang", entry).select("block", "number", "lang", F.col("entry.words").alias("word"), "entry.n")
    totals = kept(staged(entries.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals"))
    names, width = _numbered(kept(_counted(entries, ["lang", "word"], least, "phrase-words")))
    none = F.array().cast("array<bigint>")
    size = np.dtype(width).itemsize
    blocks = kept(staged(_named(blocks, _known(entries, names, ["lang", "word"], broadcast)), "phrase-streams", "zstd"))
    discard(docs.sparkSession, path)
    levels = [names.select("lang", "id", F.unhex(F.lpad(F.hex("id"), 2 * size, "0")).alias("key"), F.col("word").alias("phrase"), F.col("word").alias("last"), "f", none.alias("heads"), none.alias("tails"))]
    table = None
    for k in range(2, words + 1):
        names = kept(_counted(_phrases(blocks, k, width, table), ["key"], least, f"phrase-pairs-{k}"))
        if table is not None:
            table.destroy()
        table = _table(names, width, bits) if k < words else None
        below = levels[-1]
        first = below.select(F.col("key").alias("_head"), F.col("id").alias("left"), "lang", F.col("phrase").alias("_phrase"), F.concat("heads", F.array("f")).alias("heads"))
        rest = below.select(F.col("key").alias("_tail"), F.col("id").alias("right"), "last", F.concat(F.array("f"), "tails").alias("tails"))
        both = names.withColumn("_head", F.substring("key", 1, (k - 1) * size)).withColumn("_tail", F.substring("key", size + 1, (k - 1) * size)).join(first, "_head").join(rest, "_tail")
        levels.append(kept(staged(both.select("lang", "id", "key", "left", "right", F.concat_ws(" ", "_phrase", "last").alias("phrase"), "last", "f", "heads", "tails"), f"phrases-{k}")))
    return levels, totals, paths


def mined(docs: DataFrame, text: str = "text", lang: str = "lang", words: int = WORDS, least: int = LEAST, inside: int = INSIDE, top: int = TOP, block: int = BLOCK, broadcast: int = BROADCAST, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first `top` phrases of 2 to `words` words."""
    levels, totals, paths = named_phrases(docs, text, lang, words, least, block, broadcast, bits)
    kept, longer = [], None  # longer: id of a phrase of the level at hand, and the counts of longer phrases around it
    for level in reversed(levels[1:]):
        if longer is None:
            kept.append(level)
        else:
            most = longer.groupBy("id").agg(F.max("around").alias("around"))
            kept.append(level.join(most, "id", "left").where(f"around is null or 100 * cast(around as decimal(20)) < {inside} * cast(f as decimal(20))"))
        # A phrase's parents lie inside it, and so does what lies inside its parents.
        around = level.select("id", F.col("f").alias("around")) if longer is None else level.select("id", F.col("f").alias("around")).unionByName(longer)
        parents = level.select("id", F.explode(F.array("left", "right")).alias("parent"))
        longer = around.join(parents, "id").select(F.col("parent").alias("id"), "around")
    number = lambda c: c.cast("decimal(20,0)")
    cut = lambda pair, k: F.struct(F.call_function("div", number(F.col("f")) * F.lit(2_000_000).cast("decimal(7,0)"), number(pair["l"]) + number(pair["r"])).alias("score"), k.alias("k"), pair["l"].alias("l"), pair["r"].alias("r"))
    columns = ["lang", "phrase", "f", "heads", "tails"]
    found = kept[0].select(columns)
    for level in kept[1:]:
        found = found.unionByName(level.select(columns))
    found = found.select("lang", "phrase", F.col("f").alias("a"), F.array_min(F.transform(F.arrays_zip(F.col("heads").alias("l"), F.col("tails").alias("r")), cut)).alias("cut"))
    found = found.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    found = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    out, _ = staged(found.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "phrases")
    for path in paths:
        discard(docs.sparkSession, path)
    return out


#: DuckDB twin: all phrases by value.
ORACLE = """
with t as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from (select lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) as piece from t)),
g as (select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from p, (select unnest([1, 2, 3, 4]) as k))),
f as (select lang, k, phrase, count(*) as f from g group by all having count(*) >= 30),
n as (select lang, cast(sum(len(w)) as bigint) as n from p group by 1),
c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from f where k > 1),
cuts as (select c.lang, c.phrase, c.a, j, x.f as l, y.f as r, cast((2000000 * cast(c.a as hugeint)) // (x.f + y.f) as bigint) as score
  from (select *, unnest(range(1, k)) as j from c) c join f x on x.lang = c.lang and x.k = j and x.phrase = array_to_string(c.w[1 : j], ' ') join f y on y.lang = c.lang and y.k = c.k - j and y.phrase = array_to_string(c.w[j + 1 :], ' ')),
best as (select lang, phrase, a, b.l as l, b.r as r, b.score as score from (select lang, phrase, a, arg_min(struct_pack(l := l, r := r, score := score), score * 10 + j) as b from cuts group by 1, 2, 3)),
out_ as (select distinct s.lang, s.phrase from c s join c g on s.lang = g.lang and s.k < g.k and contains(' ' || g.phrase || ' ', ' ' || s.phrase || ' ') and 100 * g.a >= 80 * s.a),
ranked as (select b.*, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from best b anti join out_ using (lang, phrase))
select lang, rank, phrase, a, l, r, n, score from ranked join n using (lang) where rank <= 2000
"""
