"""Token counts by dynamic programming over a trie of distinct pre-tokens.

A pre-token is a run of white-space markers with the word behind it. Its token count is that of its best segmentation under a unigram
model (highest sum of log-probabilities, then fewest tokens). The forward score at a character depends only on the prefix up to there, so
distinct pre-tokens are inserted in a trie whose nodes hold the best score and its count; a shared prefix is computed once and a
pre-token's count is read off its terminal. Trie and terminals live in the worker and start anew at a size bound, which changes no count.

Null and empty texts have no pre-token and count 0. A character outside the vocabulary costs one byte token for each of its UTF-8 bytes.
Repeated rows are counted alike, one row each; columns beside the text and those kept are not read. An empty table gives none.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing

MARK = "▁"
#: Trie nodes, and pre-tokens with a stored count, that a worker keeps.
NODES, TERMINALS = 1_000_000, 400_000

_WORD = re.compile(f"{MARK}+[^{MARK}]*")


class Unigram:
    """Log-probabilities of pieces."""

    def __init__(self, scores: dict[str, float], byte: float):
        self.byte = byte
        self.ends: dict[str, float | None] = {p[k:]: None for p in scores for k in range(1, len(p))}  # what pieces end with
        self.ends |= scores

    @classmethod
    def ranked(cls, model: bytes) -> Unigram:
        """Zipf's law over the ranks of a public piece vocabulary: the piece of rank r has a probability in proportion to 1 / (r + 1)."""
        from sentencepiece import sentencepiece_model_pb2

        pieces = [p.piece for p in sentencepiece_model_pb2.ModelProto.FromString(model).pieces if p.type == p.NORMAL]
        total = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
        return cls({p: -math.log(r + 1) - total for r, p in enumerate(pieces)}, -math.log(len(pieces) + 1) - total)


class Trie(dict):
    """Terminal counts of pre-tokens; the nodes beneath them are filled as pre-tokens come."""

    def __init__(self, model: Unigram):
        super().__init__()
        self.model = model
        self.start()

    def start(self) -> None:
        self.clear()
        self.children: dict[tuple[int, str], int] = {}
        self.best, self.count = [0.0], [0]

    def insert(self, word: str) -> int:
        """The node of the whole pre-token, with what was missing on the way."""
        path, node = [0], 0
        ends, byte, children, best, count = self.model.ends, self.model.byte, self.children, self.best, self.count
        for d, ch in enumerate(word, 1):
            below = children.get((node, ch))
            if below is None:
                s = ends.get(ch)
                n = 1
                if s is None:
                    n = len(ch.encode())
                    s = byte * n
                top, n = best[node] + s, count[node] + n
                for lo in range(d - 2, -1, -1):
                    s = ends.get(word[lo:d], self)
                    if s is self:  # no piece ends so, and none that is longer
                        break
                    if s is not None:
                        at = path[lo]
                        s += best[at]
                        if s > top or s == top and count[at] + 1 < n:
                            top, n = s, count[at] + 1
                below = children[node, ch] = len(best)
                best.append(top)
                count.append(n)
            path.append(node := below)
        return node

    def __missing__(self, word: str) -> int:
        if len(word) > 256:  # long runs are counted without keeping their nodes
            alone = Trie(self.model)
            return alone.count[alone.insert(word)]
        n = self[word] = self.count[self.insert(word)]
        return n

    def tokens(self, text: str) -> tuple[int, int]:
        """Pre-tokens and tokens of a text."""
        words = _WORD.findall(MARK + text.replace(" ", MARK)) if text else ()
        if len(self.best) > NODES or len(self) > TERMINALS:
            self.start()
        return len(words), sum(map(self.__getitem__, words))


def counted(docs: DataFrame, model: Unigram, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns with n_pretokens and n_tokens."""
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = rows.drop("__text").schema.add("n_pretokens", "long").add("n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(model)
        for batch in batches:
            got = [trie.tokens(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array([x[k] for x in got], pa.int64()) for k in (0, 1))], schema.names)

    return rows.mapInArrow(releasing(run), schema)
