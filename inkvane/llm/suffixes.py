"""Repeated passages by sparse suffix arrays (operator 8).

A suffix is retained where the hash of its first ten words is the smallest
among the 41 ten-word starts of some 50-word window (its minimiser); so two equal
windows retain the same suffix, at the same place within them. The retained
suffixes of seeds that repeat, once for each distinct stretch around them, are
sorted by the words that follow (range partitions, so that a frequent seed is
many tasks' work). Of all suffixes, a suffix's neighbours in that order share the
most words with it: they tell how far any match can extend to the right. A second
sort, by the words before, tells the same for the left. Windows within both
extents are then compared exactly, and joined up to maximal passages.

At the border of a range partition a suffix lacks a neighbour; its extent there
is taken as unlimited, so that no match is lost. Words are sorted by 16 bits of
their hashes: a clash can only make an extent longer, never shorter.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, fresh, gram_hashes, mixed, powers, rows_of, word_hashes

SEED_WORDS = 10
UNLIMITED = 1 << 30
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class Stretches:
    """Hashes of any stretches of a text's words, from one running sum."""

    def __init__(self, words: np.ndarray):
        up, self.down = powers(len(words) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(words) * up[:-1], dtype=np.uint64)])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.down[start] + mixed((stop - start).astype(np.uint64)))


def minimisers(grams: np.ndarray, span: int) -> np.ndarray:
    """For each window of ``span`` grams the place of its smallest (the first of equals), by doubling."""
    at, reach = np.arange(len(grams)), 1
    while reach < span:
        step = min(reach, span - reach)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(grams[a] <= grams[b], a, b)
        reach += step
    return at


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def retained(text: str | None, length: int) -> tuple[np.ndarray, ...]:
    """(seed, lo, hi, at, stretch) of each retained suffix, at word ``at``: windows lo..hi have it as their minimiser."""
    words = word_hashes(words_of(text))
    if len(words) < length:
        return (np.empty(0, np.int64),) * 5
    grams = gram_hashes(words, SEED_WORDS)
    at = minimisers(grams, length - SEED_WORDS + 1)
    lo = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    hi = np.append(lo[1:], len(at)) - 1
    at = at[lo]
    stretch = Stretches(words)(lo, hi + length) ^ mixed((at - lo).astype(np.uint64) + np.uint64(1))
    return grams[at].view(np.int64), lo, hi, at, stretch.view(np.int64)


def shared(values: list[bytes], seeds: np.ndarray) -> np.ndarray:
    """For each row but the last how many 16-bit words its value shares from the start with the next row's of the same seed."""
    size = np.array([len(v) // 2 for v in values])
    flat = np.frombuffer(b"".join(values), "<u2")
    begin = np.cumsum(size) - size
    least = np.where(seeds[1:] == seeds[:-1], np.minimum(size[1:], size[:-1]), 0)
    out = np.zeros(len(least), np.int64)
    some = np.flatnonzero(least)
    if len(some):
        n = least[some]
        first = np.cumsum(n) - n
        step = np.arange(n.sum()) - np.repeat(first, n)
        differ = flat[np.repeat(begin[some], n) + step] != flat[np.repeat(begin[some + 1], n) + step]
        out[some] = np.minimum.reduceat(np.where(differ, step, np.repeat(n, n)), first)
    return out


def extents(batches, side: str):
    """Pairs of a batch of sorted rows and the extents of their ``side``: the most words that a row's shares with any other row's of its seed."""
    kept, before = None, UNLIMITED  # the last row waits for its successor
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([*([kept] if kept is not None else []), b]).combine_chunks()
        common = shared(t.column(side).to_pylist(), t.column("seed").to_numpy())
        extent = np.maximum(np.concatenate([[before], common]), np.append(common, 0))
        rows = t.to_batches()[0]
        kept, before = rows.slice(t.num_rows - 1), extent[-1]
        if t.num_rows > 1:
            yield rows.slice(0, t.num_rows - 1), extent[:-1]
    if kept is not None:
        yield kept, np.array([UNLIMITED])


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, within: bool = False) -> DataFrame:
    """Passages of at least ``length`` words that an earlier document holds too.

    (id, text_key, start_word, end_word, first_id): each maximal passage in a
    document, in words from 0, end exclusive, of which every ``length`` words
    occur in a document with a smaller id; ``first_id`` is such an earlier document.
    A-Z compare as lower case, words are runs without ASCII white space.

    within: a window counts as repeated from its second occurrence on in the order
    of (id, text_key, start), so repeats inside a document, and in rows that share
    an id with other texts, are found too; ``first_id`` may then be the id itself.

    Null or short texts hold no passage; rows with a null id are left alone; rows
    that repeat an id are one document for this purpose, and ``text_key`` tells
    their texts apart; an empty table gives an empty result; extra columns are
    not read.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "suffixes")
    kind = docs.schema[id_col].dataType.simpleString()
    texts = fresh(docs, id_col, text_col).filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))

    def suffixes(batches):
        for b in batches:
            ids, keys, cols = [], [], [[], [], [], [], []]
            for i, key, text in rows_of(b):
                got = retained(text, length)
                ids += [i] * len(got[0])
                keys += [key] * len(got[0])
                for c, x in zip(cols, got, strict=True):
                    c.append(x)
            seed, lo, hi, at, stretch = [np.concatenate(c) if c else np.empty(0, np.int64) for c in cols]
            yield pa.record_batch([pa.array(seed, pa.int64()), pa.array(ids, b.schema.field(0).type), pa.array(keys, pa.int64()), *(pa.array(c.astype(np.int32)) for c in (lo, hi, at)), pa.array(stretch, pa.int64())], names=["seed", "id", "text_key", "lo", "hi", "at", "stretch"])

    def contexts(batches):
        """What surrounds each suffix: the words from it on, those before it from the last on, and the hashes of its windows."""
        for b in batches:
            out = []
            for i, key, runs, text in rows_of(b):
                words = word_hashes(words_of(text))
                codes, stretches = (words >> np.uint64(48)).astype("<u2"), Stretches(words)
                for r in runs:
                    starts = np.arange(r["lo"], r["hi"] + 1)
                    out.append((r["seed"], i, key, r["lo"], codes[r["at"] : r["hi"] + length].tobytes(), codes[r["lo"] : r["at"]][::-1].tobytes(), stretches(starts, starts + length).tobytes()))
            kinds = [pa.int64(), b.schema.field(0).type, pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], names=["seed", "id", "text_key", "lo", "right", "left", "windows"])

    def to_right(batches):
        for b, extent in extents(batches, "right"):
            yield b.append_column("extent", pa.array(np.minimum(extent, UNLIMITED).astype(np.int32)))

    def to_left(batches):
        for b, extent in extents(batches, "left"):
            # window number k of a suffix begins at most ``extent`` words before it and ends within the right extent
            n = np.array([len(w) // 8 for w in b.column(6).to_pylist()], np.int64)
            before = np.array([len(x) // 2 for x in b.column(5).to_pylist()], np.int64)
            first = np.maximum(0, before - extent)
            last = np.minimum(n - 1, before + b.column(7).to_numpy() - length)
            keep = np.maximum(0, last - first + 1)
            row = np.repeat(np.arange(len(n)), keep)
            k = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(keep) - keep, keep)
            h = np.frombuffer(b"".join(b.column(6).to_pylist()), np.int64)[(np.cumsum(n) - n)[row] + k]
            lo = b.column(3).to_numpy()[row]
            yield pa.record_batch([pa.array(h, pa.int64()), b.column(1).take(pa.array(row)), b.column(2).take(pa.array(row)), pa.array((lo + k).astype(np.int32)), pa.array(lo, pa.int32())], names=["window", "id", "text_key", "lo", "run"])

    def in_order(rows: DataFrame, side: str) -> DataFrame:
        return rows.repartitionByRange("seed", side).sortWithinPartitions("seed", side)

    all_rows = ws.save(texts.mapInArrow(suffixes, f"seed long, id {kind}, text_key long, lo int, hi int, at int, stretch long"), "retained")
    ends = [g(c).alias(f"{c}_{n}") for c in ("id", "stretch", *(("text_key", "lo") if within else ())) for n, g in enumerate((F.min, F.max))]
    seeds = all_rows.groupBy("seed").agg(*ends).filter("id_0 < id_1" + (" or text_key_0 < text_key_1 or lo_0 < lo_1" if within else ""))
    seeds = ws.save(seeds.select("seed", (F.col("stretch_0") < F.col("stretch_1")).alias("several")), "seeds")
    rows = ws.save(all_rows.join(seeds, "seed"), "repeated")
    ws.drop(all_rows)
    place = F.struct("id", "text_key", "lo")
    firsts = rows.groupBy("seed", "stretch").agg(F.min(F.struct("id", "text_key", "lo", "hi", "at")).alias("f"), F.max(place).alias("last"), F.max("several").alias("several"))
    firsts = ws.save(firsts.select("seed", "stretch", "several", "last", "f.*"), "firsts")
    first_cols = [F.col("id").alias("first_id"), F.col("text_key").alias("first_key"), F.col("lo").alias("first_lo")]
    # an occurrence that overlaps the first one in its own text is no repeat: the first one stays whole
    repeat = "first_id < id" + (f" or first_key <> text_key or lo >= first_lo + {length}" if within else "")
    again = ws.save(firsts.filter(F.col("last") > place).select("seed", "stretch", *first_cols), "again")
    same = rows.join(again, ["seed", "stretch"])
    whole = same.filter(repeat).select("id", "text_key", "lo", (F.col("hi") + length).alias("end"), "first_id", "first_key", "first_lo")

    # where the stretches of a seed differ, the first holder of each, and those that do not repeat it, are sorted and compared
    cols = ["id", "text_key", "seed", "lo", "hi", "at"]
    apart = same.filter(f"several and not ({repeat})").select(*cols)
    edge = firsts.filter("several").select(*cols).unionByName(apart).groupBy("id", "text_key").agg(F.collect_list(F.struct("seed", "lo", "hi", "at")).alias("runs"))
    around = texts.join(ws.save(edge, "edges"), ["id", "text_key"]).select("id", "text_key", "runs", "text")
    schema = f"seed long, id {kind}, text_key long, lo int, right binary, left binary, windows binary"
    around = ws.save(around.mapInArrow(contexts, schema), "contexts")
    bounded = ws.save(in_order(around, "right").mapInArrow(to_right, f"{schema}, extent int"), "by-right")
    ws.drop(around)
    parts = ws.save(in_order(bounded, "left").mapInArrow(to_left, f"window long, id {kind}, text_key long, lo int, run int"), "windows")
    ws.drop(bounded)
    first = parts.groupBy("window").agg(F.min(place).alias("f"), F.max(place).alias("last")).filter("f < last").select("window", "f.*")
    first = ws.save(first.select("window", *first_cols), "first-windows")
    part_table = ws.save(parts.join(first, "window").filter(repeat).select("id", "text_key", "lo", (F.col("lo") + length).alias("end"), "first_id", "run"), "parts")
    # what an earlier stretch holds of a first holder's windows, it holds of its copies' windows too
    earlier = part_table.groupBy(F.col("id").alias("first_id"), F.col("text_key").alias("first_key"), F.col("run").alias("first_lo")).agg(F.min("first_id").alias("still"))
    whole = whole.join(ws.save(earlier, "earlier"), ["first_id", "first_key", "first_lo"], "left").select("id", "text_key", "lo", "end", F.least("first_id", "still").alias("first_id"))
    part = part_table.drop("run")

    def join_up(batches):
        for b in batches:
            out = []
            for i, key, spans in rows_of(b):
                last = None
                for x in sorted(spans, key=lambda x: (x["lo"], x["end"])):
                    if last and x["lo"] <= last[3]:
                        last[3], last[4] = max(last[3], x["end"]), min(last[4], x["first_id"])
                    else:
                        last = [i, key, x["lo"], x["end"], x["first_id"]]
                        out.append(last)
            kinds = [b.schema.field(0).type, pa.int64(), pa.int32(), pa.int32(), b.schema.field(0).type]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names=["id", "text_key", "start_word", "end_word", "first_id"])

    per_doc = whole.unionByName(part).groupBy("id", "text_key").agg(F.collect_set(F.struct("lo", "end", "first_id")).alias("spans"))
    found = ws.save(per_doc.mapInArrow(join_up, f"id {kind}, text_key long, start_word int, end_word int, first_id {kind}"), "passages")
    ws.drop(rows, parts, part_table, firsts)
    return found.withColumnRenamed("id", id_col)


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (each with the white space after it)."""
    raw = text.encode("utf-8", "surrogatepass")
    starts = [m.start() for m in WORD.finditer(raw)] + [len(raw)]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : starts[a]])
        at = starts[b]
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, each repeated passage cut from all but its first occurrence, repeats inside a document included.

    Columns and rows stay, but for documents of which nothing but white space is
    left; texts without a repeated passage are unchanged. Null, short and empty
    texts and rows with a null id stay as they are; rows equal in id and text are
    one document and stay or are cut alike; an empty table gives an empty result.
    """
    found = repeated_passages(docs, id_col, text_col, length, within=True)
    spans = found.groupBy(id_col, "text_key").agg(F.array_sort(F.collect_list(F.struct(F.col("start_word").alias("a"), F.col("end_word").alias("b")))).alias("spans"))
    spans = Workspace(docs.sparkSession, "suffixes").save(spans.select(F.col(id_col).alias("_k"), F.col("text_key").alias("_h"), F.col("spans").alias("_s")), "spans")
    key = F.xxhash64(text_col)

    def run(batches):
        for b in batches:
            where = b.schema.get_field_index(text_col)
            spans = b.column(b.num_columns - 1).to_pylist()
            texts = b.column(where).to_pylist()
            new = [cut_words(t, [(s["a"], s["b"]) for s in sp]) if sp else t for t, sp in zip(texts, spans, strict=True)]
            keep = pa.array([not sp or bool(n.strip()) for n, sp in zip(new, spans, strict=True)], pa.bool_())
            cols = list(b.columns[:-1])
            cols[where] = pa.array(new, b.schema.field(where).type)
            yield pa.record_batch(cols, names=b.schema.names[:-1]).filter(keep)

    joined = docs.join(spans, (docs[id_col] == spans["_k"]) & (key == spans["_h"]), "left").select(*(docs[c] for c in docs.columns), spans["_s"])
    return joined.mapInArrow(run, docs.schema)
