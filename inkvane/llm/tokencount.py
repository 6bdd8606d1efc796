"""Token counts by heap-and-linked-list byte-pair merging (operator 1)."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame

from .bpe import TokenCounter
from .common import Workspace, fresh, rows_of


@lru_cache(maxsize=2)
def _counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per document: (id, n_bytes, n_tokens, over_limit).

    A narrow map without a shuffle. Every distinct word is merged by popping the
    lowest-rank adjacent pair from a heap over a linked list of symbols; its
    count is its symbols less its merges, and no identifiers are made. Special
    strings inside a text count as one token, as the library's default has it.

    Null or empty texts have 0 bytes and 0 tokens; null ids stay null; repeated
    rows are counted row by row; an empty table gives an empty result; other
    columns, whatever their names, are not read. ``vocabulary`` is a path that
    every executor can open (an installed file).
    """
    import pyarrow as pa

    def run(batches):
        counter = _counter(vocabulary)
        for b in batches:
            rows = [(i, len(t.encode("utf-8", "surrogatepass")), counter.count(t)) for i, t in ((i, t or "") for i, t in rows_of(b))]
            ids, sizes, counts = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.record_batch([pa.array(ids, b.schema.field(0).type), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    Workspace(docs.sparkSession, "tokens")
    kind = docs.schema[id_col].dataType.simpleString()
    return fresh(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
