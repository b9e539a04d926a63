"""SentencePiece encoding and decoding through a distinct-chunk table.

No piece of the model holds a white-space marker after another character, so no merge can cross the place where a marker follows
something else. The text is cut there into marked words (one or more markers and what follows), each distinct marked word is segmented
once by the library, and ids are joined back by position. The table of distinct words lives in the Python worker that needs it and is
emptied when it reaches `TABLE` words, so memory is bounded whatever the vocabulary, and nothing is shuffled.

Null texts count as empty; empty texts give begin and end only. Long texts are segmented whole. Repeated rows are encoded alike, one row each;
columns beside the text and those kept are not read, whatever their names. An empty table gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing

MARK = "▁"
#: Distinct marked words that a worker keeps.
TABLE = 300_000

_WORD = re.compile(f"{MARK}+[^{MARK}]*")


class Chunks(dict):
    """Packed ids of marked words, segmented when first asked for."""

    def __init__(self, library):
        super().__init__()
        self.library = library
        self[MARK] = np.array([library.piece_to_id(MARK)], "<u4").tobytes()  # the library adds no marker to an empty text

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.library.encode(word[1:]), "<u4").tobytes()  # the library puts the first marker back
        if len(word) <= 64:
            self[word] = ids
        return ids


class Codec:
    """Exact encoding and decoding with begin and end ids."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        rule = proto.normalizer_spec
        if rule.precompiled_charsmap or rule.remove_extra_whitespaces or not rule.add_dummy_prefix or not rule.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the model normalizes texts; marked words can't be cut out of them")
        if any(re.search(f"[^{MARK}]{MARK}", p.piece) or p.type == p.USER_DEFINED for p in proto.pieces):
            raise ValueError("a piece crosses a white-space marker; marked words aren't independent")
        self.library = SentencePieceProcessor(model_proto=model)
        self.begin, self.end = (np.array([x], "<u4").tobytes() for x in (self.library.bos_id(), self.library.eos_id()))
        self.table = Chunks(self.library)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids, with begin and end."""
        if len(self.table) > TABLE:
            self.table = Chunks(self.library)
        words = _WORD.findall(MARK + text.replace(" ", MARK)) if text else ()
        return b"".join((self.begin, *map(self.table.__getitem__, words), self.end))

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, "<u4").tolist())


def encoded(docs: DataFrame, model: bytes, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decode: bool = True) -> DataFrame:
    """The `keep` columns, ids (binary, little-endian unsigned 32-bit) and, if asked for, decoded (string). `model` is the model file's bytes, of fixed size."""
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = rows.drop("__text").schema.add("ids", "binary")
    if decode:
        schema = schema.add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ids = [codec.encode(t) for t in part.column(part.num_columns - 1).to_pylist()]
                new = [pa.array(ids, pa.binary())] + [pa.array([codec.decode(x) for x in ids], pa.string())] * decode
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *new], schema.names)

    return rows.mapInArrow(releasing(run), schema)


def digests(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""
    return encoded(docs, model).select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
