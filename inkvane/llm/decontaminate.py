"""Benchmark decontamination: rare seeds, then Smith-Waterman (operator 2).

Three-word grams of the test items seed the search. Their document frequencies
are counted over all documents; for each item every gram of at most RARE
documents, and of the others the rarer half of its grams (by rank, so a gram's
frequency alone never disqualifies it), join documents to the item, and a local
alignment of words around the seeds scores copies, edited and paraphrased ones
included.

Up to FILTER_GRAMS grams of test items the seeds travel to the texts: one pass
counts, a second one seeds and aligns, and no text is ever shuffled. Beyond,
hits are joined to the seeds, and texts to their cases.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WordHashes, Workspace, fresh, gram_hashes, rows_of

GRAM = 3
#: Documents up to which a gram always seeds.
RARE = 100
#: Grams of test items up to which they and the items are broadcast (some 24 bytes a gram); beyond, all is joined.
FILTER_GRAMS = 2_000_000
MATCH, MISMATCH, GAP = 2, -1, -1


class PlainHashes(WordHashes):
    """64-bit hashes of lower-case words without the punctuation at their ends; 0 where nothing is left."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        plain = word.strip(b"\"'.,;:!?()[]{}*|#$%&-_/\\")
        h = self[word] = (xxhash.xxh64_intdigest(plain) or 1) if plain else 0
        return h


_PLAIN = PlainHashes()


def plain_hashes(text: str | None) -> np.ndarray:
    """Hashes of a text's words, punctuation left out."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    h = np.fromiter(map(_PLAIN.__getitem__, words), np.uint64, len(words))
    return h[h != 0]


def gram_places(h: np.ndarray, sizes: list[int], wanted: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the text, numbers among the sorted ``wanted``) of the wanted grams; ``low`` marks their last bits."""
    places, found = [], []
    for n in sizes:
        g = gram_hashes(h, n).view(np.int64)
        at = np.flatnonzero(low[g & (len(low) - 1)])
        if len(at):
            k = np.minimum(np.searchsorted(wanted, g[at]), len(wanted) - 1)
            same = wanted[k] == g[at]
            places.append(at[same])
            found.append(k[same])
    empty = np.empty(0, np.int64)
    return (np.concatenate(places), np.concatenate(found)) if places else (empty, empty)


def marked(wanted: np.ndarray) -> np.ndarray:
    low = np.zeros(1 << 20, bool)
    low[wanted & (len(low) - 1)] = True
    return low


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two word sequences, and where it ends in the text (exclusive).

    One row of the table at a time; the gap along the row is a running maximum.
    """
    best, end = 0, 0
    ramp = np.arange(len(text) + 1) * -GAP
    above = np.zeros(len(text) + 1, np.int64)
    for w in item:
        row = np.maximum(above + GAP, 0)
        row[1:] = np.maximum(row[1:], above[:-1] + np.where(text == w, MATCH, MISMATCH))
        row = np.maximum.accumulate(row + ramp) - ramp
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
        above = row
    return best, end


def best_alignment(item: np.ndarray, text: np.ndarray, starts: list[int]) -> tuple[int, int, int]:
    """(score, start, end) of the best alignment within an item's length around seeds whose copy would start at ``starts``."""
    pad = len(item) // 2 + 2
    best = (0, 0, 0)
    lo = hi = None
    spans = []
    for s in sorted(set(starts)):
        a, b = max(0, s - pad), min(len(text), s + len(item) + pad)
        if hi is not None and a <= hi:
            hi = max(hi, b)
        else:
            if hi is not None:
                spans.append((lo, hi))
            lo, hi = a, b
    if hi is not None:
        spans.append((lo, hi))
    for a, b in spans:
        score, end = align(item, text[a:b])
        if score > best[0]:
            back, length = align(item[::-1], text[a : a + end][::-1])
            best = (score, a + end - length, a + end)
    return best


def _items(ws: Workspace, benchmark: DataFrame) -> DataFrame:
    """(item_id, item_key, words, gram, place, n): one row for each gram of each item's text; shorter items have one gram of all their words.

    Rows that repeat an item_id with other texts are items of their own, told apart by item_key.
    """
    import pyarrow as pa

    def run(batches):
        for b in batches:
            out = []
            for i, key, text in rows_of(b):
                h = plain_hashes(text)
                if len(h):
                    g = gram_hashes(h, min(GRAM, len(h))).view(np.int64)
                    out += [(i, key, h.view(np.int64), int(x), k, len(h)) for k, x in enumerate(g)]
            kinds = [b.schema.field(0).type, pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int32()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], names=["item_id", "item_key", "words", "gram", "place", "n"])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    rows = fresh(benchmark, "item_id", "text").filter("item_id is not null").select("item_id", F.xxhash64("text").alias("item_key"), "text").dropDuplicates(["item_id", "item_key"])
    return ws.save(rows.mapInArrow(run, f"item_id {kind}, item_key long, words array<long>, gram long, place int, n int"), "items")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, item_id, score, start_word, end_word) of each document that holds a test item.

    ``score`` is the alignment score divided by that of a whole copy; rows at or
    above ``threshold`` are returned, one for each document text and item: the
    best one where rows of the benchmark repeat an ``item_id`` with other texts,
    all of which are sought; the earlier place wins a tie.

    Null and empty texts or items match nothing; rows with a null id are left
    alone; rows that repeat an id are told apart by ``text_key``; empty tables
    give an empty result; extra columns are not read.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    ws = Workspace(spark, "decontaminate")
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    items = _items(ws, benchmark)
    sizes = [r.n for r in items.select(F.least("n", F.lit(GRAM)).alias("n")).distinct().collect()]
    few = items.count() <= FILTER_GRAMS
    texts = fresh(docs, id_col, text_col).filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))

    def seeded(found: DataFrame) -> DataFrame:
        """(gram, item_id, item_key, place) of the grams that seed, from (gram, df)."""
        rank = F.row_number().over(W.partitionBy("item_id", "item_key").orderBy("df", "gram", "place"))
        rare = items.join(found, "gram").withColumn("rank", rank).filter((F.col("df") <= RARE) | (F.col("rank") <= 4) | (2 * F.col("rank") <= F.col("n")))
        return ws.save(rare.select("gram", "item_id", "item_key", "place"), "rare")

    def scored(i, key, t: np.ndarray, cases, out: list) -> None:
        for item_id, item, starts in cases:
            score, start, end = best_alignment(item, t, starts)
            if score >= threshold * MATCH * len(item):
                out.append((i, key, item_id, score / (MATCH * len(item)), start, end))

    def packed(out: list, id_type, item_type):
        kinds = [id_type, pa.int64(), item_type, pa.float64(), pa.int32(), pa.int32()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], names=["id", "text_key", "item_id", "score", "start_word", "end_word"])

    schema = f"id {kind}, text_key long, item_id {item_kind}, score double, start_word int, end_word int"
    if few:
        from pyspark.sql.pandas.types import to_arrow_type

        item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
        grams = spark.sparkContext.broadcast(np.sort(items.select("gram").distinct().toArrow()["gram"].to_numpy()))

        def counts(batches):
            wanted = grams.value
            low, total = marked(wanted), np.zeros(len(wanted), np.int64)
            for b in batches:
                for text in b.column(0).to_pylist():
                    total[np.unique(gram_places(plain_hashes(text), sizes, wanted, low)[1])] += 1
            some = np.flatnonzero(total)
            yield pa.record_batch([pa.array(wanted[some], pa.int64()), pa.array(total[some])], names=["gram", "n"])

        found = texts.select("text").mapInArrow(counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("df"))
        rare = seeded(ws.save(found, "frequency")).orderBy("gram", "item_id", "item_key", "place").toArrow()
        words = items.select("item_id", "item_key", "words").dropDuplicates(["item_id", "item_key"]).toArrow().to_pylist()
        number = {(r["item_id"], r["item_key"]): k for k, r in enumerate(words)}
        owner = np.array([number[x] for x in zip(rare["item_id"].to_pylist(), rare["item_key"].to_pylist(), strict=True)], np.int64)
        known = spark.sparkContext.broadcast((rare["gram"].to_numpy(), owner, rare["place"].to_numpy().astype(np.int64), [r["item_id"] for r in words], [np.array(r["words"], np.int64) for r in words]))

        def leaks(batches):
            gram, owner, place, ids, bodies = known.value
            wanted, first = np.unique(gram, return_index=True)
            last = np.append(first[1:], len(gram))
            low = marked(wanted)
            for b in batches:
                out = []
                for i, key, text in rows_of(b):
                    h = plain_hashes(text)
                    at, k = gram_places(h, sizes, wanted, low)
                    if not len(at):
                        continue
                    n = last[k] - first[k]
                    seed = np.repeat(first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    mine, starts = owner[seed], np.repeat(at, n) - place[seed]
                    order = np.argsort(mine, kind="stable")
                    cut = np.flatnonzero(np.diff(mine[order])) + 1
                    groups = zip(np.split(mine[order], cut), np.split(starts[order], cut), strict=True)
                    scored(i, key, h.view(np.int64), [(ids[m[0]], bodies[m[0]], s.tolist()) for m, s in groups], out)
                yield packed(out, b.schema.field(0).type, item_type)

        rows = texts.mapInArrow(leaks, schema)
    else:
        grams = items.select("gram").distinct()

        def every_gram(batches):
            for b in batches:
                ids, keys, gs, places = [], [], [], []
                for i, key, text in rows_of(b):
                    h = plain_hashes(text)
                    for n in sizes:
                        g = gram_hashes(h, n).view(np.int64)
                        ids += [i] * len(g)
                        keys += [key] * len(g)
                        gs.append(g)
                        places.append(np.arange(len(g)))
                flat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
                yield pa.record_batch([pa.array(ids, b.schema.field(0).type), pa.array(keys, pa.int64()), pa.array(flat(gs), pa.int64()), pa.array(flat(places).astype(np.int32))], names=["id", "text_key", "gram", "at"])

        hits = texts.mapInArrow(every_gram, f"id {kind}, text_key long, gram long, at int")
        hits = ws.save(hits.join(grams, "gram", "left_semi").select("id", "text_key", "gram", "at"), "hits")
        rare = seeded(ws.save(hits.select("id", "gram").distinct().groupBy("gram").agg(F.count("*").alias("df")), "frequency"))
        pairs = hits.join(rare, "gram").groupBy("id", "text_key", "item_id", "item_key").agg(F.collect_set(F.col("at") - F.col("place")).alias("starts"))
        words = ws.save(items.select("item_id", "item_key", "words").dropDuplicates(["item_id", "item_key"]), "item-words")
        # a document's cases are dealt to so many rows that none holds very many
        deal = F.pmod(F.xxhash64("item_id", "item_key"), F.lit(64)).alias("deal")
        pairs = ws.save(pairs, "pairs").join(words, ["item_id", "item_key"]).groupBy("id", "text_key", deal).agg(F.collect_list(F.struct("item_id", "starts", "words")).alias("cases"))

        def alignments(batches):
            for b in batches:
                out = []
                for i, key, cases, text in rows_of(b):
                    scored(i, key, plain_hashes(text).view(np.int64), [(c["item_id"], np.array(c["words"], np.int64), c["starts"]) for c in cases], out)
                yield packed(out, b.schema.field(0).type, b.schema.field(2).type.value_type.field(0).type)

        rows = texts.join(ws.save(pairs, "cases"), ["id", "text_key"]).select("id", "text_key", "cases", "text").mapInArrow(alignments, schema)
    best = F.max_by(F.struct("score", "start_word", "end_word"), F.struct("score", -F.col("start_word"), -F.col("end_word")))
    rows = rows.groupBy("id", "text_key", "item_id").agg(best.alias("b")).select("id", "text_key", "item_id", "b.*")
    return ws.save(rows, "leaks").withColumnRenamed("id", id_col)


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that hold no test item, all columns unchanged.

    Null, empty and repeated rows are treated as in ``contaminated``: rows with a
    null id stay, and of rows that share an id only those whose text leaks go.
    """
    found = contaminated(docs, benchmark, threshold).select(F.col("doc_id").alias("_k"), F.col("text_key").alias("_h")).distinct()
    ws = Workspace(docs.sparkSession, "decontaminate")
    found = ws.save(found, "leaking")
    return docs.join(found, (docs["doc_id"] == found["_k"]) & (F.xxhash64(docs["text"]) == found["_h"]), "left_anti")


def benchmark_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``contaminated`` by document id alone."""
    return contaminated(docs, benchmark).drop("text_key")
