"""Near-duplicate groups by HyperMinHash (operator 6).

A document's sketch has 128 registers. A shingle's 64-bit hash names its
register by the top 7 bits; of the smallest remainder there, the register keeps
the number of leading zeros and the 10 bits after the first one. Bands of four
registers propose candidates, the collision-corrected Jaccard estimate of the
registers thins them, and the full shingle sets decide.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, components, fresh, mixed, rows_of, shingle_set

BUCKET_BITS, MANTISSA_BITS, BAND = 7, 10, 4
BUCKETS = 1 << BUCKET_BITS
#: Standard deviations below the threshold at which the estimate still passes a pair on to the exact check.
SLACK = 5.0
#: Rows and shingles that one task compares with each other; members of a larger group that lead it in turn.
UNIT_ROWS, UNIT_SHINGLES, LEADERS = 4096, 1 << 20, 4
# Fixed values of the published collision estimate for sketches of this kind.
COLLISIONS = 0.169919487159739093975315012348


def registers(shingles: np.ndarray) -> np.ndarray:
    """128 registers (0: empty) of a sorted set of 64-bit hashes."""
    rest_bits = 64 - BUCKET_BITS
    starts = np.searchsorted(shingles, np.arange(BUCKETS, dtype=np.uint64) << np.uint64(rest_bits))
    ends = np.append(starts[1:], len(shingles))
    out = np.zeros(BUCKETS, np.uint16)
    full = np.flatnonzero(ends > starts)
    rest = shingles[starts[full]] & np.uint64((1 << rest_bits) - 1)
    fraction, exponent = np.frexp(rest.astype(np.float64))
    zeros = np.minimum(rest_bits - exponent, 62)
    mantissa = np.floor((np.maximum(fraction, 0.5) - 0.5) * 2 * (1 << MANTISSA_BITS)).astype(np.int64)
    out[full] = (zeros << MANTISSA_BITS) + np.minimum(mantissa, (1 << MANTISSA_BITS) - 1) + 1
    return out


_PROBES = (mixed(np.arange(BUCKETS * 64, dtype=np.uint64).reshape(BUCKETS, 64)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
_MULTIPLIERS = mixed(np.arange(1, BAND + 1, dtype=np.uint64)) | np.uint64(1)


def bands(regs: np.ndarray) -> np.ndarray:
    """Hashes of the bands of four registers.

    An empty register borrows from the first full one on its own fixed random
    walk, so that sets smaller than the sketch still match in proportion to
    their similarity, and never because both lack something.
    """
    full = regs > 0
    source = np.arange(BUCKETS)
    empty = np.flatnonzero(~full)
    if len(empty):
        walk = _PROBES[empty]
        hit = full[walk]
        first = hit.argmax(1)
        source[empty] = np.where(hit[np.arange(len(empty)), first], walk[np.arange(len(empty)), first], np.flatnonzero(full)[0])
    v = (regs[source].astype(np.uint64) << np.uint64(BUCKET_BITS)) | source.astype(np.uint64)
    keys = (mixed(v).reshape(-1, BAND) * _MULTIPLIERS).sum(1)
    return mixed(keys + np.arange(BUCKETS // BAND, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def possible(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and the corrected estimate leave it possible that pairs reach the threshold.

    a, b: registers, a row for each pair (or one row for all); n, m: sizes of the sets.
    """
    either = np.count_nonzero((a > 0) | (b > 0), axis=1)
    ratio = n / m
    chance = COLLISIONS * 2.0 ** (BUCKET_BITS - MANTISSA_BITS) * 4 * ratio / (1 + ratio) ** 2
    equal = np.count_nonzero((a == b) & (a > 0), axis=1) - chance
    j = percent / 100
    return (equal >= j * either - SLACK * np.sqrt(either * j * (1 - j)) - 1) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 85) -> DataFrame:
    """(id, n_shingles, set_id, regs, bands); set_id names the exact set, null where it is empty.

    bands is empty where only an equal set can reach the threshold of ``percent``.
    """
    import pyarrow as pa

    def run(batches):
        for b in batches:
            out = []
            for i, text in rows_of(b):
                s = shingle_set(text, n)
                if not len(s):
                    out.append((i, 0, None, None, None))
                    continue
                r = registers(s)
                # the most similar other set has one shingle more
                keys = bands(r).view(np.int64) if 100 * len(s) >= percent * (len(s) + 1) else np.empty(0, np.int64)
                out.append((i, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), r.tobytes(), keys))
            kinds = [b.schema.field(0).type, pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names=["id", "n_shingles", "set_id", "regs", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    return fresh(docs, id_col, text_col).mapInArrow(run, f"id {kind}, n_shingles long, set_id binary, regs binary, bands array<long>")


def _confirm(ws: Workspace, pairs: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold: estimate first, then the full sets."""
    import pyarrow as pa

    def estimate(batches):
        for b in batches:
            regs = [np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint16).reshape(-1, BUCKETS) for k in (4, 5)]
            keep = possible(*regs, b.column(6).to_numpy(), b.column(7).to_numpy(), percent) if b.num_rows else []
            yield b.select(["a", "b", "set_a", "set_b"]).filter(pa.array(keep, pa.bool_()))

    def exact(batches):
        for b in batches:
            keep = []
            for _, _, sa, sb in rows_of(b):
                x, y = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda of: reps.select(F.col("id").alias(of), F.col("set_id").alias(f"set_{of}"), F.col("n_shingles").alias(f"n_{of}"), F.col("regs").alias(f"regs_{of}"))
    kind = pairs.schema["a"].dataType.simpleString()
    t = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b", "regs_a", "regs_b", "n_a", "n_b")
    likely = t.mapInArrow(estimate, f"a {kind}, b {kind}, set_a binary, set_b binary")
    full = lambda of: sets.select(F.col("set_id").alias(f"set_{of}"), F.col("hashes").alias(f"hashes_{of}"))
    t = likely.join(full("a"), "set_a").join(full("b"), "set_b")
    return ws.save(t.select("a", "b", "hashes_a", "hashes_b").mapInArrow(exact, f"a {kind}, b {kind}"), "links")


def spanning_links(labels: np.ndarray, sides: np.ndarray | None, sizes: np.ndarray, regs: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between rows of different components, as many as it takes to join them.

    labels: components known so far; sides: where given, only rows of different
    sides are compared. Every pair of rows that no chain of links joins yet is
    compared, by the estimate and then by the full sets.
    """
    count = len(labels)
    _, labels = np.unique(labels, return_inverse=True)
    if labels.max(initial=0) == 0:
        return []
    # words that one row alone holds are in no intersection
    distinct, token, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(count), [len(s) for s in sets])
    common = often[token] > 1
    token, owner = token[common], owner[common]
    stop = np.cumsum(np.bincount(owner, minlength=count))
    start = np.concatenate([[0], stop[:-1]])
    held = np.zeros(len(distinct), np.int64)
    out = []
    for x in range(count - 1):
        y = np.flatnonzero(labels[x + 1 :] != labels[x]) + x + 1
        if sides is not None:
            y = y[sides[y] != sides[x]]
        y = y[possible(regs[x : x + 1], regs[y], sizes[x], sizes[y], percent)]
        if not len(y):
            continue
        held[token[start[x] : stop[x]]] = 1
        length = stop[y] - start[y]
        ends = np.cumsum(length)
        places = np.repeat(start[y] - ends + length, length) + np.arange(ends[-1])
        sums = np.concatenate([[0], np.cumsum(held[token[places]])])
        both = sums[ends] - sums[ends - length]
        held[token[start[x] : stop[x]]] = 0
        for k in y[100 * both >= percent * (sizes[x] + sizes[y] - both)].tolist():
            if labels[k] != labels[x]:
                out.append((x, k))
                labels[labels == labels[k]] = labels[x]
    return out


def _link_units(units: DataFrame, percent: int) -> DataFrame:
    """(a, b) links that join the components of each unit's rows; units are (lo, i, j), each of bounded size, dealt and sorted by them."""
    import pyarrow as pa

    kind = units.schema["id"].dataType.simpleString()

    def run(batches):
        unit, held, schema = None, [], None

        def close():
            ids = [r[0] for r in held]
            place: dict = {}
            labels = np.array([place.setdefault(r[1], len(place)) for r in held])
            sides = np.array([r[2] for r in held])
            sizes = np.array([r[3] for r in held], np.int64)
            regs = np.frombuffer(b"".join(r[4] for r in held), np.uint16).reshape(len(held), BUCKETS)
            sets = [np.frombuffer(r[5], np.uint64) for r in held]
            links = spanning_links(labels, sides if unit[1] != unit[2] else None, sizes, regs, sets, percent)
            return [ids[x] for x, _ in links], [ids[y] for _, y in links]

        for b in batches:
            schema, a_out, b_out = b.schema, [], []
            for lo, i, j, *row in rows_of(b):
                if (lo, i, j) != unit:
                    if held:
                        a, c = close()
                        a_out += a
                        b_out += c
                    unit, held = (lo, i, j), []
                held.append(row)
            yield pa.record_batch([pa.array(a_out, schema.field("id").type), pa.array(b_out, schema.field("id").type)], names=["a", "b"])
        if held:
            yield pa.record_batch([pa.array(c, schema.field("id").type) for c in close()], names=["a", "b"])

    dealt = units.select("lo", "i", "j", "id", "c", "piece", "n_shingles", "regs", "hashes").repartition("lo", "i", "j").sortWithinPartitions("lo", "i", "j", "id")
    return dealt.mapInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, unit_rows: int = UNIT_ROWS, unit_shingles: int = UNIT_SHINGLES) -> DataFrame:
    """One row per document: (id, n_shingles, component_id, kept).

    Documents are linked where 100 * |A and B| >= percent * |A or B| over
    distinct 5-word shingles; component_id is the smallest id reachable.

    Equal sets are one class, represented by their smallest id. The classes that
    share a band's bucket form a group under the bucket's smallest id; buckets of
    copies mostly have the same one, so a class is in few groups. A group is
    resolved by one task that compares only classes that no chain of links joins
    yet, and that gives out only links that join something. A group beyond
    ``unit_rows`` or ``unit_shingles`` is first compared with LEADERS of its
    members in turn, each at the cost of the group's size; if several components
    are left then, its pieces meet two by two in tasks of bounded size. No row of
    the result depends on these bounds.

    Null or empty texts, and texts of white space, have no shingles and are
    linked with nothing; a row with a null id keeps a null component_id and is
    kept; rows that repeat an id form one vertex; an empty table gives an empty
    result; extra columns are not read.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "hyperminhash")
    docs = fresh(docs, id_col, text_col)
    all_rows = ws.save(sketch(docs, id_col, text_col, percent=percent), "sketches")
    usable = all_rows.filter("set_id is not null and id is not null")
    first = ws.save(usable.groupBy("set_id").agg(F.min("id").alias("rep")), "sets")
    member = ws.save(usable.select("id", "set_id").join(first, "set_id").select("id", "rep"), "classes")
    reps = ws.save(usable.join(first.select(F.col("rep").alias("id"), "set_id"), ["id", "set_id"]).select("id", "set_id", "n_shingles", "regs", "bands").dropDuplicates(["set_id"]), "reps")
    # an id that repeats with other texts ties their classes together
    same_id = member.groupBy("id").agg(F.min("rep").alias("b"), F.collect_set("rep").alias("reps")).filter("size(reps) > 1").select(F.explode("reps").alias("a"), "b").filter("a <> b")
    links = ws.save(same_id, "repeated-ids")

    keys = reps.select("id", "set_id", F.explode("bands").alias("key"))
    shared = ws.save(keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("key", "lo"), "shared")
    rows = ws.save(keys.join(shared, "key").select("lo", "id", "set_id").distinct(), "groups")
    wanted = ws.save(rows.select("id", "set_id").distinct(), "wanted")
    sets = ws.save(_sets(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), wanted), "shingles")
    sized = rows.join(reps.select("set_id", "n_shingles", "regs"), "set_id")
    load = sized.groupBy("lo").agg(F.greatest(F.ceil(F.count("*") / unit_rows), F.ceil(F.sum("n_shingles") / unit_shingles)).cast("int").alias("pieces"))
    load = ws.save(load, "load")
    sized = ws.save(sized.join(load, "lo"), "sized")
    units = sized.filter("pieces = 1").select("lo", F.lit(0).alias("i"), F.lit(0).alias("j"), "id", F.col("id").alias("c"), F.lit(0).alias("piece"), "n_shingles", "regs", "set_id")
    if not load.filter("pieces > 1").isEmpty():
        large, more = _after_leaders(ws, sized.filter("pieces > 1"), reps, sets, percent)
        links = links.unionByName(more)
        piece = F.pmod(F.xxhash64("id"), "pieces").cast("int")
        large = large.withColumn("piece", piece).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        units = units.unionByName(large.select("lo", F.least("piece", "other").alias("i"), F.greatest("piece", "other").alias("j"), "id", "c", "piece", "n_shingles", "regs", "set_id"))
    found = ws.save(_link_units(units.join(sets, "set_id"), percent), "links")
    stars = ws.save(components(ws, links.unionByName(found)), "components")
    # a class's representative is its smallest id, so a component's smallest representative is its smallest id
    whole = member.groupBy("id").agg(F.min("rep").alias("rep")).join(stars.select(F.col("id").alias("rep"), "component_id"), "rep", "left")
    whole = ws.save(whole.select("id", F.coalesce("component_id", "rep").alias("component_id")), "whole")
    return (
        all_rows.select("id", "n_shingles")
        .join(whole, "id", "left")
        .select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
    )


def _after_leaders(ws: Workspace, rows: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the groups that still hold several components, with those as ``c``; and the links found.

    In each turn every row of a group is compared with one leader: the smallest
    id that is not in the component of the leaders before.
    """
    links, open_rows = None, rows.withColumn("c", F.col("id")).withColumn("led", F.lit(False))
    for _ in range(LEADERS):
        lead = open_rows.filter("not led").groupBy("lo").agg(F.min_by(F.struct("id", "c"), "id").alias("l"))
        lead = ws.save(lead.select("lo", F.col("l.id").alias("leader"), F.col("l.c").alias("leader_c")), "leaders")
        pairs = open_rows.join(lead, "lo").filter("c <> leader_c").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
        new = _confirm(ws, pairs, reps, sets, percent)
        links = new if links is None else links.unionByName(new)
        stars = ws.save(components(ws, links), "leader-components")
        after = ws.save(lead.join(stars.withColumnRenamed("id", "leader"), "leader", "left").select("lo", F.coalesce("component_id", "leader").alias("led_c")), "led-components")
        now = open_rows.drop("c").join(stars, "id", "left").withColumn("c", F.coalesce("component_id", "id")).drop("component_id")
        now = ws.save(now.join(after, "lo", "left").withColumn("led", F.expr("led or coalesce(c = led_c, false)")).drop("led_c"), "led")
        several = ws.save(now.groupBy("lo").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count_if(~F.col("led")).alias("left")).filter("c0 < c1"), "several")
        open_rows = ws.save(now.join(several.select("lo"), "lo"), "open")
        if several.filter("left > 0").isEmpty():
            break
    return open_rows.drop("led"), links


def _sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set_id, hashes): the full sorted shingle set of each wanted representative, once."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            names, sets = [], []
            for asked, text in rows_of(b):
                raw = shingle_set(text).tobytes()
                if hashlib.blake2b(raw, digest_size=16).digest() in asked:  # rows that repeat an id may hold other texts
                    names.append(hashlib.blake2b(raw, digest_size=16).digest())
                    sets.append(raw)
            yield pa.record_batch([pa.array(names, pa.binary()), pa.array(sets, pa.binary())], names=["set_id", "hashes"])

    asked = wanted.groupBy("id").agg(F.collect_set("set_id").alias("asked"))
    rows = texts.join(asked, "id").withColumn("text_key", F.xxhash64("text")).dropDuplicates(["id", "text_key"])
    return rows.select("asked", "text").mapInArrow(run, "set_id binary, hashes binary")
