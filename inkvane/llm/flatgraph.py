"""Near-duplicate vectors by a robust-pruned flat graph (operator 9).

Vectors of a label are dealt to the shards of their nearest centroids, so that
shards overlap. Each shard builds a graph whose adjacency lists are pruned by the
robust rule (a neighbour is dropped when an already chosen one is much nearer to
it); a vector's lists from all its shards are united. Every vector is then sought
in the shard of its nearest centroid: greedily from the shard's medoid, then by
expanding everything found within the range. Links are confirmed by the cosine in
double precision. Recall is audited against brute force: every vector whose id is
divisible by 20 is compared with all vectors of its label, in blocks. The overlap
grows until recall is high enough; if it never is, whole labels are compared in
blocks instead.
"""

from __future__ import annotations

import logging

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, components, fresh, hash_sample, rows_of

#: Vectors a shard aims at; the most that one graph holds (larger shards are cut into pieces that are all searched).
TARGET, CAPACITY = 256, 4096
#: Vectors that the centroids may be fitted on.
SAMPLE = 20_000
DEGREE, POOL, ALPHA, BEAM = 24, 48, 1.2, 24
#: Queries that one task seeks; of these ids' vectors the links are audited; recall that is enough; shards a vector is dealt to at most.
CHUNK, EVERY, ENOUGH, MOST_SHARDS = 1024, 20, 0.98, 16
_LOG = logging.getLogger(__name__)


def robust_prune(sims: np.ndarray, pool: np.ndarray, between: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """Chosen members of ``pool`` (best first): those that no chosen one covers; distances are 1 - cosine."""
    far = 1 - sims
    open_ = np.ones(len(pool), bool)
    out = []
    for k in range(len(pool)):
        if not open_[k]:
            continue
        out.append(pool[k])
        if len(out) == degree:
            break
        open_ &= ALPHA * (1 - between[k]) > far
    return np.array(out, np.int64)


def build(x: np.ndarray, seed: int = 0) -> list[np.ndarray]:
    """Adjacency lists over unit vectors: each one's nearest in the shard and a few random ones, pruned, and made mutual."""
    n = len(x)
    rng = np.random.default_rng(seed)
    lists: list[list[int]] = [[] for _ in range(n)]
    for a in range(0, n, 256):
        sims = x[a : a + 256] @ x.T
        for i, row in enumerate(sims, a):
            row[i] = -2
            m = min(POOL, n - 1)
            if m <= 0:
                continue
            pool = np.argpartition(-row, m - 1)[:m]
            pool = np.unique(np.concatenate([pool, rng.integers(0, n, 4)]))
            pool = pool[pool != i]
            pool = pool[np.argsort(-row[pool], kind="stable")]
            lists[i] = robust_prune(row[pool], pool, x[pool] @ x[pool].T).tolist()
    back: list[set[int]] = [set(v) for v in lists]
    for i, v in enumerate(lists):
        for j in v[: DEGREE // 2]:
            back[j].add(i)
    return [np.array(sorted(v), np.int64) for v in back]


class Searcher:
    def __init__(self, x: np.ndarray, lists: list[np.ndarray]):
        self.x, self.n = x, len(x)
        width = max([1, *map(len, lists)])
        self.adj = np.full((self.n, width), self.n, np.int64)
        for i, v in enumerate(lists):
            self.adj[i, : len(v)] = v
        self.stamp = np.zeros(self.n + 1, np.int64)
        self.turn = 0
        self.medoid = int((x @ x.mean(0)).argmax()) if self.n else 0

    def fresh(self, frontier: np.ndarray) -> np.ndarray:
        c = self.adj[frontier].ravel()
        c = np.unique(c[self.stamp[c] != self.turn])
        c = c[c < self.n]
        self.stamp[c] = self.turn
        return c

    def within(self, q: np.ndarray, floor: float, start: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Nodes found with similarity of at least ``floor``, and their similarities."""
        self.turn += 1
        first = np.array([self.medoid] if start is None else [self.medoid, start])
        seen = np.unique(first)
        self.stamp[seen] = self.turn
        sims = self.x[seen] @ q
        expanded = np.zeros(len(seen), bool)
        while True:  # the greedy walk: the best four of the beam that are not yet expanded
            top = np.argsort(-sims, kind="stable")[:BEAM]
            go = top[~expanded[top]][:4]
            if not len(go):
                break
            expanded[go] = True
            new = self.fresh(seen[go])
            seen, sims, expanded = np.concatenate([seen, new]), np.concatenate([sims, self.x[new] @ q]), np.concatenate([expanded, np.zeros(len(new), bool)])
        while True:  # the range: all that lies within it is expanded, a whole front at a time
            go = np.flatnonzero((sims >= floor) & ~expanded)
            if not len(go):
                break
            expanded[go] = True
            new = self.fresh(seen[go])
            seen, sims, expanded = np.concatenate([seen, new]), np.concatenate([sims, self.x[new] @ q]), np.concatenate([expanded, np.zeros(len(new), bool)])
        hit = sims >= floor
        return seen[hit], sims[hit]


def centroids(vectors: dict, counts: dict) -> dict:
    """For each label a matrix of unit centroids: three rounds of spherical k-means over the sample."""
    out = {}
    for label, x in vectors.items():
        k = min(-(-counts[label] // TARGET), max(1, len(x) // 4))
        if k <= 1:
            continue
        c = x[:: max(1, len(x) // k)][:k].copy()
        for _ in range(3):
            near = np.concatenate([(x[a : a + 2048] @ c.T).argmax(1) for a in range(0, len(x), 2048)])
            for j in range(len(c)):
                mine = x[near == j]
                if len(mine) and (norm := np.linalg.norm(s := mine.sum(0))) > 0:
                    c[j] = s / norm
        out[label] = c
    return out


def unit(raw: bytes) -> np.ndarray:
    """The vector at length 1; its largest component first, so that no square over- or underflows."""
    v = np.frombuffer(raw, np.float64)
    v = v / np.abs(v).max()
    return v / np.linalg.norm(v)


def near_vectors(vectors: DataFrame, floor: float = 0.98) -> DataFrame:
    """See ``near_vectors_and_recall``, of which this is the first part."""
    return near_vectors_and_recall(vectors, floor)[0]


def near_vectors_and_recall(vectors: DataFrame, floor: float = 0.98, most_shards: int = MOST_SHARDS, enough: float = ENOUGH) -> tuple[DataFrame, float]:
    """One row per vector: (vec_id, n_links, component_id, kept); and the audited recall of the search that found them.

    Vectors are linked where their labels are equal and not null and their cosine
    is at least ``floor``. Equal vectors of a label are one node with a weight;
    n_links counts every other linked vector, copies included. Links are counted
    in the task that finds them and only one edge for each vector leaves it, so a
    dense group costs its size.

    Null labels, null or zero vectors and vectors with null or non-finite
    components link with nothing; a null vec_id keeps a null component_id and is
    kept; rows that repeat a vec_id are separate vectors; vectors of different
    lengths never link; an empty table gives an empty result; extra columns are
    not read.
    """
    import pandas as pd
    import pyarrow as pa

    spark = vectors.sparkSession
    ws = Workspace(spark, "flatgraph")
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("embedding", lambda v: v != 0)
    rows = fresh(vectors, "vec_id", "embedding", "label").withColumn("ok", F.coalesce(usable, F.lit(False)))

    def pack(batches):
        for b in batches:
            raw = [np.array(v, np.float64).tobytes() if ok else None for v, ok in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.record_batch([b.column(0), b.column(2), pa.array(raw, pa.binary())], names=["vec_id", "label", "v"])

    rows = ws.save(rows.mapInArrow(pack, f"vec_id {kinds['vec_id']}, label {kinds['label']}, v binary"), "vectors")
    nodes = ws.save(rows.filter("v is not null").groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")), "nodes")
    counts = {(r.label, r.n): r["count"] for r in nodes.groupBy("label", F.length("v").alias("n")).count().filter(F.col("count") > TARGET).collect()}
    sample: dict = {}
    for r in hash_sample(nodes, "id", SAMPLE, nodes.count()).collect():
        if (key := (r.label, len(r.v))) in counts:
            sample.setdefault(key, []).append(unit(r.v))
    centres = centroids({k: np.stack(v) for k, v in sample.items()}, counts)
    centres = spark.sparkContext.broadcast(centres)

    def assign(overlap):
        def run(batches):
            for b in batches:
                out = []
                for label, v, i, w in rows_of(b):
                    c = centres.value.get((label, len(v)))
                    order = np.argsort(-(c @ unit(v)), kind="stable")[:overlap].tolist() if c is not None else [0]
                    out += [(f"{label}/{len(v)}/{s}", i, w, v, k == 0) for k, s in enumerate(order)]
                types = [pa.string(), b.schema.field(2).type, pa.int64(), pa.binary(), pa.bool_()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, types, strict=True)], names=["shard", "id", "weight", "v", "home"])

        return run

    def graph(pdf):
        x = np.stack([unit(v) for v in pdf["v"]])
        ids = pdf["id"].to_numpy()
        return pd.DataFrame({"id": ids, "near": [ids[a].tolist() for a in build(x)]})

    def seek(key, pdf):
        pdf = pdf.sort_values(["id", "is_query"], kind="stable")
        node, query = pdf[~pdf["is_query"]], pdf[pdf["is_query"]]
        got = []
        if len(node) and len(query):
            ids, weight = node["id"].to_numpy(), node["weight"].to_numpy()
            place = {i: k for k, i in enumerate(ids.tolist())}
            x = np.stack([unit(v) for v in node["v"]])
            s = Searcher(x, [np.array([place[j] for j in near if j in place], np.int64) if near is not None else np.empty(0, np.int64) for near in node["near"]])
            for i, v in zip(query["id"].tolist(), query["v"], strict=True):
                found, _ = s.within(unit(v), floor, place.get(i))
                others = found[ids[found] != i]
                got.append((i, int(weight[others].sum()), min([i, *ids[others].tolist()])))
        return pd.DataFrame({c: pd.Series([r[k] for r in got], dtype="int64" if c == "links" else None) for k, c in enumerate(("id", "links", "root"))})

    id_kind = kinds["vec_id"]
    integral = id_kind in ("tinyint", "smallint", "int", "bigint")
    audited = nodes.filter(F.pmod(F.col("id") if integral else F.xxhash64("id"), F.lit(EVERY)) == 0)
    truth = ws.save(in_blocks(ws, nodes, audited, floor, id_kind), "audited")
    overlap = 2
    while True:
        dealt = ws.save(nodes.select("label", "v", "id", "weight").mapInArrow(assign(overlap), f"shard string, id {id_kind}, weight long, v binary, home boolean"), "dealt")
        sizes = ws.save(dealt.groupBy("shard").agg(F.ceil(F.count("*") / CAPACITY).cast("int").alias("pieces"), F.ceil(F.count_if("home") / CHUNK).cast("int").alias("chunks")), "sizes")
        placed = dealt.join(sizes, "shard").withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
        placed = ws.save(placed, "placed")
        lists = placed.groupBy("shard", "piece").applyInPandas(graph, f"id {id_kind}, near array<{id_kind}>")
        union = ws.save(lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")
        # queries meet every piece of their home shard, in chunks
        as_nodes = placed.filter("chunks > 0").join(union, "id").select("shard", "piece", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "id", "weight", "v", "near", F.lit(False).alias("is_query"))
        mine = F.pmod(F.xxhash64("id", F.lit(1)), "chunks").cast("int").alias("chunk")
        as_queries = placed.filter("home").select("shard", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), mine, "id", "weight", "v", F.lit(None).cast(f"array<{id_kind}>").alias("near"), F.lit(True).alias("is_query"))
        found = as_nodes.unionByName(as_queries).groupBy("shard", "piece", "chunk").applyInPandas(seek, f"id {id_kind}, links long, root {id_kind}")
        found = ws.save(found.groupBy("id").agg(F.sum("links").alias("links"), F.collect_set("root").alias("roots")), "found")
        recall = audit(truth, found)
        _LOG.info("recall %.4f with %d shards for each vector", recall, overlap)
        if recall >= enough:
            break
        if overlap >= most_shards:
            found = ws.save(in_blocks(ws, nodes, nodes, floor, id_kind), "all-pairs-of-labels")
            _LOG.warning("recall %.4f is too low with %d shards for each vector: whole labels were compared in blocks", recall, overlap)
            recall = 1.0
            break
        overlap *= 2
    edges = found.select(F.col("id").alias("a"), F.explode("roots").alias("b")).filter("a <> b")
    comp = ws.save(components(ws, edges), "components")
    per_node = nodes.join(found, "id").join(comp, "id", "left").select("label", "v", F.coalesce("component_id", "id").alias("component_id"), (F.col("links") + F.col("weight") - 1).alias("n_links"))
    per_node = ws.save(per_node, "result")
    linked = rows.filter("v is not null").join(per_node, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    component = F.col("component_id").cast("long") if integral else F.col("component_id")
    return out.select("vec_id", "n_links", component.alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept")), recall


def in_blocks(ws: Workspace, nodes: DataFrame, queries: DataFrame, floor: float, id_kind: str) -> DataFrame:
    """(id, links, roots) of each query by brute force: blocks of queries meet blocks of the nodes of their label.

    Blocks have CHUNK queries and CAPACITY nodes, about, whatever the label's size.
    """
    import pandas as pd

    label = [F.col("label"), F.length("v").alias("size")]
    cut = lambda t, n, name: t.groupBy(*label).agg(F.ceil(F.count("*") / n).alias(name))
    cuts = ws.save(cut(nodes, CAPACITY, "pieces").join(cut(queries, CHUNK, "chunks"), ["label", "size"]), "cuts")
    dealt = lambda t: t.withColumn("size", F.length("v")).join(cuts, ["label", "size"])
    hash_, every = F.xxhash64("id", F.lit(2)), lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    a = dealt(nodes).select("label", "size", F.pmod(hash_, "pieces").alias("piece"), F.explode(every("chunks")).alias("chunk"), "id", "weight", "v", F.lit(False).alias("is_query"))
    b = dealt(queries).select("label", "size", F.explode(every("pieces")).alias("piece"), F.pmod(hash_, "chunks").alias("chunk"), "id", "weight", "v", F.lit(True).alias("is_query"))

    def compare(pdf):
        node, query = pdf[~pdf["is_query"]], pdf[pdf["is_query"]]
        got = []
        if len(node) and len(query):
            ids, weight, x = node["id"].to_numpy(), node["weight"].to_numpy(), np.stack([unit(v) for v in node["v"]])
            for i, v in zip(query["id"].tolist(), query["v"], strict=True):
                hit = np.flatnonzero((x @ unit(v) >= floor) & (ids != i))
                got.append((i, int(weight[hit].sum()), min([i, *ids[hit].tolist()])))
        return pd.DataFrame({c: pd.Series([r[k] for r in got], dtype="int64" if c == "links" else None) for k, c in enumerate(("id", "links", "root"))})

    found = a.unionByName(b).groupBy("label", "size", "piece", "chunk").applyInPandas(compare, f"id {id_kind}, links long, root {id_kind}")
    return found.groupBy("id").agg(F.sum("links").alias("links"), F.collect_set("root").alias("roots"))


def audit(truth: DataFrame, found: DataFrame) -> float:
    """Recall of the found links against brute force: by link or by query (of those with links), whichever is lower."""
    t = truth.filter("links > 0").select("id", F.col("links").alias("all")).join(found.select("id", F.col("links").alias("got")), "id", "left")
    got = F.least("all", F.coalesce("got", F.lit(0)))
    r = t.agg(F.sum(got).alias("got"), F.sum("all").alias("all"), F.avg(got / F.col("all")).alias("mean")).first()
    return min(r["got"] / r["all"], r["mean"]) if r["all"] else 1.0
