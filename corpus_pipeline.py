"""The corpus pipeline over `documents`: quality, near duplicates, repeated passages, benchmark decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet in the shared folder and rereads as the next
stage's docs. All but the last return the columns that they got. Rows without a doc_id are judged like others where a stage can judge a
single row (quality, decontamination, encoding) and kept whole where it compares documents by id; empty tables pass through; repeated rows
are copies. Of an id with different texts, near duplicates are judged text by text and never among themselves, repeated passages stay.
Columns besides doc_id and text are carried and never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registrum.llm import minhash, pieces, queries, repeats, rule_ensemble, spaced_seeds
from registrum.llm.common import discard, staged, table


def _all(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, learned from all labels, gives at least an even chance of quality 1."""
    model = rule_ensemble.learned(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    own = "__own_"
    renamed = docs.select(*[F.col(f"`{c}`").alias(own + c) for c in docs.columns])
    kept = rule_ensemble.scored(renamed, model, text=f"{own}text").where("predicted = 1")
    return kept.select(*[F.col(f"`{own}{c}`").alias(c) for c in docs.columns])


#: Near duplicates have at least this percentage of their shingles in common.
SIMILAR = 80


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id. Rows that repeat it, id included, come down to one."""
    dropped = minhash.linked(docs, percent=SIMILAR).where("not kept and n_shingles > 0").select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).distinct()
    same = (docs["doc_id"] == F.col("__id")) & (minhash.mark_of(docs["text"]) == F.col("__mark"))
    kept = docs.join(dropped, same, "left_anti").select(_all(docs))
    known = kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"])
    return known.unionByName(kept.where("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeat an earlier passage; a character cut in two goes. Documents that lose all their text go."""
    left = repeats.cut(repeats.marked(docs)).where("n_removed > 0").select(F.col("doc_id").alias("__id"), F.col("left_text").alias("__left")).dropDuplicates(["__id"])
    joined = docs.join(left, docs["doc_id"] == left["__id"], "left")
    text = F.coalesce("__left", "text")
    out = joined.where(~(F.col("__left").isNotNull() & (F.trim("__left") == "")))
    return out.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return spaced_seeds.clean(docs, table(spark, sf_dir, "benchmark")).select(_all(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the ids of every document left, in the public piece vocabulary."""
    model = queries.tokenizer()
    rows = pieces.encoded(docs, model, decode=False).select("doc_id", "ids")

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1)
            offsets = pa.Array.from_buffers(pa.int32(), len(ids) + 1, [None, ids.buffers()[1]], offset=ids.offset)
            starts = pa.array(offsets.to_numpy() // 4, pa.int32())
            flat = pa.Array.from_buffers(pa.int32(), (offsets[-1].as_py()) // 4, [None, ids.buffers()[2]]) if len(ids) else pa.array([], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(starts, flat)], ["doc_id", "ids"])

    return rows.mapInArrow(unpacked, "doc_id long, ids array<int>").select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("decontamination", decontaminated), ("encoding", encoded)]

#: SQL can't express the stages; tests hold run() against a brute-force version of them all.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, new = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if path:
            discard(spark, path)
        path = new
    return docs
