"""Shared plumbing: work tables, word hashing and connected components.

Every intermediate result that is read more than once is written as Parquet
below ``spark.checkpoint.dir`` (the folder that driver and executors share), so
that losing an executor costs a re-read and not the lineage.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch; texts can be long, so batches stay small.
BATCH_ROWS = 512
#: Bytes of an Arrow batch, about: a batch of very long texts ends sooner.
BATCH_BYTES = 8 << 20


def work_root(spark: SparkSession) -> str:
    """The shared folder that the session names; one of this machine only where all runs in one process of it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="inkvane-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Workspace:
    """A folder of Parquet tables that belongs to one run of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, f"{work_root(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write and reread: cuts the lineage and lets joins re-plan on real sizes."""
        self.n += 1
        path = f"{self.path}/{self.n:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._inkvane_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark._jvm
        for t in tables:
            p = jvm.org.apache.hadoop.fs.Path(t._inkvane_path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to a bound."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_WORDS = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_SPACES = bytes(b in (9, 10, 11, 12, 13, 32) for b in range(256))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base of the running sums, and of its inverse."""
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]), 4096)
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


_MARK_BYTES = b".,!?;:*|$%#&)\"]"
_MARKS = np.isin(np.arange(256), list(_MARK_BYTES))
_ALNUM = np.array([b < 128 and chr(b).isalnum() for b in range(256)])


def spans_of_words(data: np.ndarray, part_marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(starts, stops) of the words in a byte array that ends in white space.

    part_marks: a run of punctuation at a word's end is a word of its own where
    an ASCII letter or digit precedes it.
    """
    space = np.frombuffer(data.tobytes().translate(_SPACES), bool)
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(data) and not space[0]:
        edge = np.concatenate([[0], edge])
    starts, stops = edge[0::2], edge[1::2]
    if part_marks:
        tail = np.flatnonzero(_MARKS[data[stops - 1]])
        first, last = starts[tail], stops[tail] - 1
        for _ in range(8):  # back over a run of marks
            last -= _MARKS[data[last]] & (last > first)
        for k in np.flatnonzero(_MARKS[data[last]] & (last > first)).tolist():  # long runs
            last[k] = max(first[k], first[k] + len(data[first[k] : last[k]].tobytes().rstrip(_MARK_BYTES)) - 1)
        cut = _ALNUM[data[last]]
        inner, tail = last[cut] + 1, tail[cut]
        starts, stops = np.insert(starts, tail + 1, inner), np.insert(stops, tail, inner)
    return starts, stops


_TAILS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def eights(data: bytes) -> np.ndarray:
    """The eight bytes from each place on as one integer, zeros behind the end."""
    padded = np.frombuffer(data + bytes(16), np.uint8)
    return np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(data) + 1,), (1,), writeable=False)


def short_words(data: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(low, high): the bytes of each word of up to 15 bytes as two integers, its length in the upper byte of the second."""
    eight, size = eights(data), stops - starts
    low = eight[starts] & _TAILS[np.minimum(size, 8)]
    high = size.astype(np.uint64) << np.uint64(56)
    more = np.flatnonzero(size > 8)
    high[more] |= eight[starts[more] + 8] & _TAILS[np.minimum(size[more] - 8, 7)]
    return low, high


def distinct_words(data: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, which): an occurrence of each distinct word, and for every word the number of its distinct one.

    Words are told apart by their bytes: up to 16 bytes are two integers, longer
    words get a number by the words themselves.
    """
    eight = eights(data)
    size = stops - starts
    a = eight[starts] & _TAILS[np.minimum(size, 8)]
    b = np.zeros(len(starts), np.uint64)
    more = np.flatnonzero(size > 8)
    b[more] = eight[starts[more] + 8] & _TAILS[np.minimum(size[more] - 8, 8)]
    numbers: dict[bytes, int] = {}
    for k in np.flatnonzero(size > 16).tolist():
        b[k] = numbers.setdefault(data[starts[k] : stops[k]], len(numbers))
    kind = np.minimum(size, 17).astype(np.uint64)
    # long words: their first bytes do not matter beside their number
    a[size > 16] = 0
    key = mixed(a * np.uint64(0xBF58476D1CE4E5B9) + mixed(b + kind * np.uint64(0x9E3779B97F4A7C15)))
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    of = first[which]
    if not ((a == a[of]) & (b == b[of]) & (kind == kind[of])).all():  # two words with one key: by all three columns instead
        _, first, which = np.unique(np.stack([a, b, kind], axis=1), axis=0, return_index=True, return_inverse=True)
    return first, which.reshape(-1)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, in order; empty where there are fewer words."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k]
        out ^= out >> np.uint64(29)
    return mixed(out)


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's n-word shingles.

    A-Z are lower-cased; words are runs without ASCII white space. A text with
    fewer than n words has its whole sequence as the one shingle, a text without
    words has none.
    """
    if not text:
        return np.empty(0, np.uint64)
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    return np.unique(gram_hashes(h, min(n, len(words))))


def rows_of(batch) -> Iterator[tuple]:
    """The rows of an Arrow batch as tuples."""
    return zip(*(c.to_pylist() for c in batch.columns), strict=True)


def fresh(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that no extra column can clash with the operator's own."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def hash_sample(df: DataFrame, id_col: str, rows: int, total: int, seed: int = 0) -> DataFrame:
    """About the ``rows`` rows with the smallest id hashes, at most that many.

    Rows beyond a hash bound drop out before the sort, so the last task sees a
    little more than ``rows`` rows however many partitions there are.
    """
    h = F.xxhash64(id_col, F.lit(seed))
    if total > 2 * rows:
        share = (rows + 4 * rows**0.5) / total
        df = df.filter(F.pmod(h, F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))
    return df.orderBy(F.pmod(h, F.lit(1 << 40)), id_col).limit(rows)


def components(ws: Workspace, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge table: (id, component_id), for vertices with an edge.

    Alternates large-star and small-star steps until the edges are stars around
    each component's smallest vertex. The per-vertex minima are plain
    aggregations that combine before the shuffle, and are written before they
    are joined back, so that the join of a vertex with very many edges can be
    split.
    """
    import pyarrow as pa

    kind = edges.schema[a].dataType.simpleString()

    def forest(batches):
        """A spanning forest of the edges that a task holds, as stars: fewer edges, same components."""
        parent: dict[int, int] = {}

        def find(x):
            root = x
            while (up := parent.setdefault(root, root)) != root:
                root = up
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        def flush(schema):
            rows = [(v, find(v)) for v in list(parent)]
            rows = [(v, r) for v, r in rows if v != r]
            parent.clear()
            return pa.record_batch([pa.array([c[k] for c in rows], schema.field(0).type) for k in range(2)], names=["u", "v"])

        schema = None
        for batch in batches:
            schema = batch.schema
            for x, y in rows_of(batch):
                x, y = find(x), find(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            if len(parent) > 500_000:
                yield flush(schema)
        if schema is not None:
            yield flush(schema)

    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v")
    e = ws.save(e.mapInArrow(forest, f"u {kind}, v {kind}"), "edges")
    while True:
        ends = e.select(F.col("u").alias("id"), F.lit(1).alias("left")).unionAll(e.select(F.col("v").alias("id"), F.lit(0).alias("left")))
        wrong = ends.groupBy("id").agg(F.sum("left").alias("n"), F.min("left").alias("low")).filter("n > 1 or (n = 1 and low = 0)")
        if not wrong.agg(F.count("*").alias("n")).first().n:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = ws.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "large")
        big = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        big = ws.save(big, "large-star")
        low2 = ws.save(big.groupBy("u").agg(F.min("v").alias("m")), "small")
        small = big.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low2.select("u", F.col("m").alias("v"))).distinct()
        small = ws.save(small, "small-star")
        ws.drop(e, low, big, low2)
        e = small
    return e.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
