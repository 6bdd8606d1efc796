"""Token-ID output in a block format with static rANS coding (operator 5).

Layout of a token file, a folder with two Parquet datasets:

* ``blocks``, in ascending document order. Each row is one independent block: its
  shard and number, the directory of the documents in it (id, place, length) and
  the coded identifiers of all of them (see ``rans``).
* ``frequencies``, one row: format version, width of identifiers, and the counts
  of all identifiers (deflated 64-bit integers) with their CRC-32, which every
  block's head repeats.

Documents never cross blocks; blocks carry decoder checkpoints and checksums. So
any block, and any span between checkpoints, decodes with the table and without
the other blocks, in any process that can read the folder (``decode_folder``
does so without Spark).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import TokenEncoder
from .common import Workspace, fresh
from .rans import CHECKPOINT, LANES, VERSION, Frequencies, decode_block, encode_block

BLOCK_TOKENS = 1 << 19
BLOCK_SCHEMA = "shard int, block int, first_token long, n_tokens long, docs array<struct<doc_id:{kind},place:long,n:long>>, data binary"


@lru_cache(maxsize=2)
def _encoder(path: str) -> TokenEncoder:
    return TokenEncoder(path)


def tokenize(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): little-endian identifiers of each whole text, the end identifier appended."""
    import pyarrow as pa

    def run(batches):
        encoder = _encoder(vocabulary)
        end = np.array([end_id], encoder.kind).tobytes()
        for b in batches:
            ids = [x + end for x in encoder.encode_batch(b.column(1).to_pylist())]
            yield pa.record_batch([b.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return fresh(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, ids binary")


def frequencies(tokens: DataFrame, size: int, width: str) -> np.ndarray:
    """Counts of all identifiers of all documents; the result is as long as the vocabulary."""
    import pyarrow as pa

    def run(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), width), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["token", "n"])

    counts = np.zeros(size, np.int64)
    for r in tokens.select("ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.token] = r.n
    return counts


def write_blocks(tokens: DataFrame, counts: np.ndarray, width: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks in ascending document order; ties of an id are ordered by content."""
    import pyarrow as pa

    kind = tokens.schema["doc_id"].dataType
    schema = BLOCK_SCHEMA.format(kind=kind.simpleString())

    def run(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type

        shard, table = TaskContext.get().partitionId(), Frequencies(counts)
        arrow_docs = pa.list_(pa.struct([("doc_id", to_arrow_type(kind)), ("place", pa.int64()), ("n", pa.int64())]))
        first = block = held = 0
        docs: list[dict] = []
        parts: list[np.ndarray] = []

        def close():
            nonlocal first, block, held
            data = encode_block(np.concatenate(parts), table)
            out = pa.record_batch([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.array([held], pa.int64()), pa.array([docs], arrow_docs), pa.array([data], pa.binary())], names=["shard", "block", "first_token", "n_tokens", "docs", "data"])
            first, block, held = first + held, block + 1, 0
            docs.clear()
            parts.clear()
            return out

        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(raw, width)
                docs.append({"doc_id": i, "place": held, "n": len(ids)})
                parts.append(ids)
                held += len(ids)
                if held >= block_tokens:
                    yield close()
        if docs:
            yield close()

    ordered = tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    return ordered.mapInArrow(run, schema)


def write_table(spark: SparkSession, path: str, counts: np.ndarray, width: str) -> None:
    raw = np.asarray(counts, "<i8").tobytes()
    row = (VERSION, width, len(counts), bytearray(zlib.compress(raw)), zlib.crc32(raw))
    spark.createDataFrame([row], "version int, width string, size int, counts binary, crc32 long").coalesce(1).write.parquet(f"{path}/frequencies")


def _counts(version: int, size: int, counts: bytes, crc32: int) -> np.ndarray:
    if version != VERSION:
        raise ValueError("not a token file of this version")
    raw = zlib.decompress(counts)
    if zlib.crc32(raw) != crc32 or len(raw) != 8 * size:
        raise ValueError("checksum mismatch: the frequency table is damaged")
    return np.frombuffer(raw, "<i8")


def read_table(spark: SparkSession, path: str) -> np.ndarray:
    """The counts that a token file holds; as long as the vocabulary."""
    r = spark.read.parquet(f"{path}/frequencies").first()
    return _counts(r.version, r.size, bytes(r.counts), r.crc32)


def read_blocks(blocks: DataFrame, counts: np.ndarray) -> DataFrame:
    """Decode every block and give each document's identifiers' place, number and CRC-32."""
    import pyarrow as pa

    kind = blocks.schema["docs"].dataType.elementType["doc_id"].dataType

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        table = Frequencies(counts)
        for b in batches:
            for shard, first, docs, data in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                ids = decode_block(data, table).astype("<u4")
                crc = [zlib.crc32(ids[d["place"] : d["place"] + d["n"]]) for d in docs]
                yield pa.record_batch([pa.array([d["doc_id"] for d in docs], to_arrow_type(kind)), pa.array([shard] * len(docs), pa.int32()), pa.array([first + d["place"] for d in docs], pa.int64()), pa.array([d["n"] for d in docs], pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "shard", "place", "n_tokens", "ids_crc32"])

    return fresh(blocks, "shard", "first_token", "docs", "data").mapInArrow(run, f"doc_id {kind.simpleString()}, shard int, place long, n_tokens long, ids_crc32 long")


def decode_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids array<int>) from a token file, for readers that want the identifiers."""
    import pyarrow as pa

    blocks, counts = spark.read.parquet(f"{path}/blocks"), read_table(spark, path)
    kind = blocks.schema["docs"].dataType.elementType["doc_id"].dataType

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        table = Frequencies(counts)
        for b in batches:
            for docs, data in zip(*(b.column(k).to_pylist() for k in range(2)), strict=True):
                ids = decode_block(data, table)
                yield pa.record_batch([pa.array([d["doc_id"] for d in docs], to_arrow_type(kind)), pa.array([ids[d["place"] : d["place"] + d["n"]].astype(np.int32) for d in docs], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return fresh(blocks, "docs", "data").mapInArrow(run, f"doc_id {kind.simpleString()}, ids array<int>")


def decode_folder(path: str) -> Iterator[tuple[object, np.ndarray]]:
    """(doc_id, identifiers) of a token file that lies on a mounted disk, block by block, without Spark."""
    import pyarrow.dataset as ds

    (r,) = ds.dataset(f"{path}/frequencies", format="parquet").to_table().to_pylist()
    table = Frequencies(_counts(r["version"], r["size"], r["counts"], r["crc32"]))
    for b in ds.dataset(f"{path}/blocks", format="parquet").to_batches(columns=["docs", "data"], batch_size=1):
        for docs, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            ids = decode_block(data, table)
            for d in docs:
                yield d["doc_id"], ids[d["place"] : d["place"] + d["n"]]


def read_span(data: bytes, table: Frequencies, place: int, n: int) -> np.ndarray:
    """Identifiers ``place`` .. ``place + n`` of a block, decoded from the checkpoint before them on."""
    step = LANES * CHECKPOINT
    first = place // step
    ids = decode_block(data, table, first, -(-(place + n) // step) - first)
    return ids[place - first * step : place - first * step + n]


def write_token_file(docs: DataFrame, vocabulary: str, end_id: int, path: str) -> None:
    """Encode all documents and write the token file's folder."""
    spark = docs.sparkSession
    ws = Workspace(spark, "tokenfile")
    encoder = _encoder(vocabulary)
    width, size = encoder.kind.str, max(encoder.v.size, end_id + 1)
    tokens = ws.save(tokenize(docs, vocabulary, end_id), "ids")
    counts = frequencies(tokens, size, width)
    write_table(spark, path, counts, width)
    write_blocks(tokens, counts, width).write.option("compression", "none").parquet(f"{path}/blocks")
    ws.drop(tokens)


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the folder alone."""
    blocks, counts = spark.read.parquet(f"{path}/blocks"), read_table(spark, path)
    totals = sorted((r.shard, r.n) for r in blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
    bases = list(accumulate([n for _, n in totals], initial=0))
    # one row for each partition that wrote
    base = spark.createDataFrame([(shard, before) for (shard, _), before in zip(totals, bases, strict=False)], "shard int, base long")
    read = read_blocks(blocks, counts).join(F.broadcast(base), "shard")
    return read.select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def token_file(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Encode all documents, write the token file, read it back.

    Returns (doc_id, start, n_tokens, ids_crc32): ``start`` counts the
    identifiers of all documents before it in ascending doc_id order. Null or
    empty texts hold only the end identifier; a null doc_id sorts first;
    repeated ids are ordered by their identifiers; an empty table gives an empty
    result; extra columns are not read. Only the vocabulary-sized frequency table
    and one total for each shard reach the driver.
    """
    spark = docs.sparkSession
    path = Workspace(spark, "tokenfile").path
    write_token_file(docs, vocabulary, end_id, path)
    return read_token_file(spark, path)
