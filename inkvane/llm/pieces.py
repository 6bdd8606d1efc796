"""SentencePiece encoding and decoding over a relational lattice (operator 10).

The piece table is a relation (piece, id, score). A word's lattice is relational
too: its substrings of bounded length, exploded and equi-joined to the pieces,
grouped by word; Viterbi is a fold over its positions with Spark's higher-order
``aggregate``. The model is of the BPE kind, so the fold is a constrained one: an
edge may only follow a piece beside which greedy merging would have left it. With
that constraint one path is left for every prefix, and it is the library's.

Corpora repeat their words, so the lattice is built for the most frequent words
of the corpus (a bounded dictionary that every task may hold), and the words
beyond are folded by the same recurrence in the workers that read them; both give
the same identifiers.

Words are split at spaces and carry the word-start marker; characters without a
piece are written as their bytes, and so is a marker that a text itself holds:
decoding is exact for every text.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, fresh, mixed, powers

SPACE_MARK = "▁"
#: Words of the corpus that the dictionary may hold, and characters that one of them may have.
DICTIONARY, LONGEST_WORD = 50_000, 200
#: Words that a worker remembers.
REMEMBERED = 500_000


class PieceModel:
    """Pieces, scores and byte pieces of a .model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.pieces: dict[str, tuple[int, float]] = {}
        self.text: list[bytes] = []
        self.bytes = [0] * 256
        for k, p in enumerate(proto.pieces):
            self.text.append(b"")
            if p.type == p.BYTE:
                self.bytes[int(p.piece[3:5], 16)] = k
                self.text[k] = bytes([int(p.piece[3:5], 16)])
            elif p.type in (p.NORMAL, p.USER_DEFINED):
                self.text[k] = p.piece.replace(SPACE_MARK, " ").encode()
                if SPACE_MARK not in p.piece[1:]:
                    self.pieces[p.piece] = (k, float(p.score))
        self.longest = max(map(len, self.pieces), default=1)
        #: Order of merging: single characters first, then by falling score; and each piece's last merge.
        ordered = sorted(self.pieces.items(), key=lambda x: (len(x[0]) > 1, -x[1][1]))
        self.order = {p: k for k, (p, _) in enumerate(ordered)}
        self.name = [p for p, _ in ordered]
        self.halves = [(k, k) for k in range(len(ordered))]
        for k, p in enumerate(self.name):
            if len(p) > 1:
                last = self.merge(list(p))[1]
                if last is None or "".join(last) != p:
                    del self.pieces[p]  # merging never arrives at it
                else:
                    self.halves[k] = (self.order[last[0]], self.order[last[1]])
        self.beside: dict[tuple[str, str], bool] = {}
        self.spaces = {p.piece: k for k, p in enumerate(proto.pieces) if p.type == p.NORMAL and set(p.piece) == {SPACE_MARK}}
        self.runs: dict[int, list[int]] = {}

    def merge(self, symbols: list[str], known=None) -> tuple[list[str], tuple[str, str] | None]:
        """Greedy merging of short lists: best piece first, leftmost of equals; and the last merge made."""
        known, last = known or self.order, None
        while True:
            best = min(((known[x], i) for i in range(len(symbols) - 1) if (x := symbols[i] + symbols[i + 1]) in known), default=None)
            if best is None:
                return symbols, last
            i = best[1]
            last = (symbols[i], symbols[i + 1])
            symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]

    def may_follow(self, left: str, right: str) -> bool:
        """Whether merging leaves the two pieces side by side: no earlier merge crosses the border between them."""
        got = self.beside.get((left, right))
        if got is None:
            if len(self.beside) >= 500_000:
                self.beside.clear()
            got = self.beside[left, right] = self._apart(left, right)
        return got

    def _apart(self, left: str, right: str) -> bool:
        if left not in self.order or right not in self.order:
            return True  # a character without a piece never merges
        a, b = self.order[left], self.order[right]
        limit = len(self.order) + 1
        while True:
            joined = self.order.get(self.name[a] + self.name[b])
            if joined is not None and joined < limit:
                return False
            if a > b:
                limit, a = a, self.halves[a][1]
                if a == limit:
                    limit, b = b + 1, self.halves[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self.halves[b][0]
                if b + 1 == limit:
                    limit, a = a, self.halves[a][1]
                    if a == limit:
                        return True

    def best_path(self, unit: str, marked: bool = True) -> list[int]:
        """Identifiers of a word; ``marked``: its first character is the word-start marker."""
        n = len(unit)
        start, ident = [0] * (n + 1), [0] * (n + 1)
        last: list[str] = [""] * (n + 1)
        get, may = self.pieces.get, self.may_follow
        for end in range(1, n + 1):
            for a in range(max(0, end - self.longest), end):
                sub = unit[a:end]
                hit = get(sub)
                if hit is None or sub[0] == SPACE_MARK and not (marked and a == 0):
                    if end - a > 1:
                        continue
                    start[end], ident[end], last[end] = a, -1, ""
                elif a == 0 or last[a] == "" or may(last[a], sub):
                    start[end], ident[end], last[end] = a, hit[0], sub
                    break
        out: list[int] = []
        at = n
        while at:
            a = start[at]
            out.extend([ident[at]] if ident[at] >= 0 else [self.bytes[x] for x in reversed(unit[a:at].encode("utf-8", "surrogatepass"))])
            at = a
        return out[::-1]

    def space_run(self, n: int) -> list[int]:
        """Identifiers of n markers in a row that no word took."""
        if n not in self.runs:
            self.runs[n] = [self.spaces[p] for p in self.merge([SPACE_MARK] * n, dict.fromkeys(self.spaces, 0))[0]] if n <= 64 else self.space_run(64) * (n // 64) + (self.space_run(n % 64) if n % 64 else [])
        return self.runs[n]

    def join_spaces(self, ids: np.ndarray) -> np.ndarray:
        """Markers left alone side by side become the longer pieces of the model, if it has any."""
        lone = ids == self.spaces.get(SPACE_MARK, -1)
        if not (lone[1:] & lone[:-1]).any():
            return ids
        edge = np.flatnonzero(np.diff(np.concatenate([[0], lone.astype(np.int8), [0]])))
        out, at = [], 0
        for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a > 1:
                out += [ids[at:a], np.array(self.space_run(b - a), "<i4")]
                at = b
        return np.concatenate([*out, ids[at:]])

    def decode(self, ids) -> str:
        raw = b"".join(map(self.text.__getitem__, ids))
        return raw[1:].decode("utf-8", "surrogatepass")


class BatchFolder:
    """The recurrence of ``best_path`` for many words at once, position by position.

    Words with a character of several bytes that has no piece, and words over
    LONGEST characters, go through ``best_path`` itself.
    """

    LONGEST, MET_BITS = 64, 21

    def __init__(self, model: PieceModel):
        self.model = model
        self.n = len(model.name)
        self.ids = np.array([model.pieces[p][0] if p in model.pieces else -1 for p in model.name] + model.bytes[:128], np.int32)
        usable = [k for k, p in enumerate(model.name) if p in model.pieces]
        data = np.frombuffer("".join(model.name[k] for k in usable).encode("utf-32-le"), "<u4")
        size = np.array([len(model.name[k]) for k in usable])
        stop = np.cumsum(size)
        h = self.hashes(data)(stop - size, stop)
        order = np.argsort(h)
        self.keys, self.values = h[order], np.array(usable, np.int32)[order]
        self.maybe = np.zeros(1 << 21, bool)
        self.maybe[(self.keys & np.uint64((1 << 21) - 1)).astype(np.int64)] = True
        self.met, self.fine = np.full(1 << self.MET_BITS, -1, np.int64), np.zeros(1 << self.MET_BITS, bool)

    @staticmethod
    def hashes(data: np.ndarray):
        up, down = powers(len(data) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)])
        return lambda a, b: mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``may_follow`` for arrays of pieces; pairs met lately are remembered, each at a place of its hash."""
        key = left.astype(np.int64) * self.n + right
        place = lambda k: (k.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.MET_BITS)).astype(np.int64)
        at = place(key)
        out, new = self.fine[at], np.flatnonzero(self.met[at] != key)
        if len(new):
            pairs, which = np.unique(key[new], return_inverse=True)
            fine = np.array([self.model._apart(self.model.name[k // self.n], self.model.name[k % self.n]) for k in pairs.tolist()], bool)
            at = place(pairs)
            self.met[at] = pairs
            self.fine[at] = fine
            out[new] = fine[which]
            # of pairs that share a place the last one stays, with its own answer
            last = self.met[at] == pairs
            self.fine[at[last]] = fine[last]
        return out

    def fold(self, words: list[str]) -> list[bytes]:
        """Identifiers of each word, little-endian."""
        units = [SPACE_MARK + w for w in words]
        out: list[bytes | None] = [None] * len(units)
        quick = [k for k, u in enumerate(units) if len(u) <= self.LONGEST]
        if quick:
            for k, ids in zip(quick, self._quick([units[k] for k in quick]), strict=True):
                out[k] = ids
        return [np.array(self.model.best_path(u), "<i4").tobytes() if o is None else o for u, o in zip(units, out, strict=True)]

    def _quick(self, units: list[str]) -> list[bytes | None]:
        data = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4")
        size = np.array([len(u) for u in units])
        off = np.cumsum(size) - size
        left = np.repeat(off + size, size) - np.arange(len(data))
        blocked = data == ord(SPACE_MARK)
        blocked[off] = False
        h = self.hashes(data)
        places = np.flatnonzero(~blocked)
        edges = {}
        for n in range(1, self.model.longest + 1):
            a = places[left[places] >= n]
            key = h(a, a + n)
            hit = self.maybe[(key & np.uint64((1 << 21) - 1)).astype(np.int64)]
            a, key = a[hit], key[hit]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            same = self.keys[at] == key
            edge = edges[n] = np.full(len(data), -1, np.int32)
            edge[a[same]] = self.values[at[same]]
        single = edges[1]  # characters without a piece: those of one byte are edges of their own that anything may border
        bare = (single < 0) & (data < 128)
        single[bare] = self.n + data[bare].astype(np.int32)
        last, back = np.full(len(data), -1, np.int32), np.zeros(len(data), np.int64)
        for end in range(1, int(size.max()) + 1):
            todo = off[size >= end]
            for n in range(min(end, self.model.longest), 0, -1):
                start = todo + end - n
                piece = edges[n][start]
                ok = piece >= 0
                if n < end:
                    before = last[start - 1]
                    check = np.flatnonzero(ok & (before >= 0) & (before < self.n) & (piece < self.n))
                    ok[check] = self.apart(before[check], piece[check])
                    ok &= before >= 0
                won = todo[ok] + end - 1
                last[won], back[won] = piece[ok], n
                todo = todo[~ok]
        whole = np.minimum.reduceat(last, off) >= 0  # else some character of several bytes has no piece
        at, steps = size.copy(), []
        at[~whole] = 0
        while (go := np.flatnonzero(at > 0)).size:
            here = off[go] + at[go] - 1
            steps.append((go, self.ids[last[here]]))
            at[go] -= back[here]
        count = np.zeros(len(units), np.int64)
        for go, _ in steps:
            count[go] += 1
        stop = np.cumsum(count)
        flat, place = np.empty(int(stop[-1]) if len(stop) else 0, "<i4"), stop.copy()
        for go, ids in steps:
            place[go] -= 1
            flat[place[go]] = ids
        raw = flat.tobytes()
        return [raw[4 * (b - c) : 4 * b] if w else None for b, c, w in zip(stop.tolist(), count.tolist(), whole.tolist(), strict=True)]


_MODELS: dict[str, PieceModel] = {}


def load(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): the words of all texts and how often they occur."""
    return docs.select(F.explode(F.split(F.col(text_col), " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def lattice(ws: Workspace, word_table: DataFrame, model: PieceModel) -> DataFrame:
    """(word, ids): the best path of each distinct word, by joins and folds alone; null words have none, the empty word is the marker."""
    spark = word_table.sparkSession
    pieces = spark.createDataFrame([(p, k, s) for p, (k, s) in model.pieces.items()], "piece string, id int, score double")
    w = word_table.select("word").distinct().withColumn("unit", F.concat(F.lit(SPACE_MARK), "word")).withColumn("n", F.length("unit"))
    at = w.select("word", "unit", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("start"))
    at = at.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(model.longest), F.col("n") - F.col("start")))).alias("len"))
    sub = F.substring("unit", F.col("start") + 1, F.col("len"))
    edges = at.select("word", "n", "start", (F.col("start") + F.col("len")).alias("end"), "len", sub.alias("sub"))
    allowed = (F.col("start") == 0) | ~F.col("sub").startswith(SPACE_MARK)
    # the piece table is as long as the vocabulary file
    edges = edges.withColumn("piece", F.when(allowed, F.col("sub"))).join(F.broadcast(pieces), "piece", "left").filter("id is not null or len = 1")
    edges = ws.save(edges.select("word", "n", "start", "end", F.when(F.col("id").isNotNull(), F.col("piece")).alias("piece"), F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("score", F.lit(0.0)).alias("score")), "edges")

    # which edges may follow which: the pairs that meet in some word, decided once each
    left = edges.select("word", F.col("end").alias("start"), F.col("piece").alias("before"))
    met = edges.join(left, ["word", "start"]).filter("piece is not null and before is not null")
    pairs = ws.save(met.select("before", "piece").distinct().mapInArrow(_decide(model), "before string, piece string, fine boolean").filter("fine").drop("fine"), "pairs")
    after = met.join(pairs, ["before", "piece"]).groupBy("word", "start", "end").agg(F.collect_set("before").alias("befores"))
    edges = edges.join(after, ["word", "start", "end"], "left")
    e = F.struct("end", "start", "id", "score", "piece", F.coalesce("befores", F.array().cast("array<string>")).alias("befores"))
    grouped = edges.groupBy("word").agg(F.first("n").alias("n"), F.collect_list(e).alias("edges"))
    # Viterbi with the constraint: of the edges that may end here, a piece before a bare character, then the best score
    best = F.expr(
        """aggregate(sequence(1, n), array(named_struct('known', true, 'score', 0.0D, 'start', 0, 'id', 0, 'piece', cast(null as string))), (acc, i) -> concat(acc, array(array_max(
        transform(filter(edges, e -> e.end = i and (e.piece is null or e.start = 0 or acc[e.start].piece is null or array_contains(e.befores, acc[e.start].piece))),
        e -> named_struct('known', e.piece is not null, 'score', acc[e.start].score + e.score, 'start', e.start, 'id', e.id, 'piece', e.piece))))))"""
    )
    path = F.expr(
        """aggregate(sequence(n, 1, -1), named_struct('at', n, 'path', cast(array() as array<struct<start:int,id:int>>)), (s, i) -> if(s.at = i,
        named_struct('at', best[i].start, 'path', concat(array(named_struct('start', best[i].start, 'id', best[i].id)), s.path)), s)).path"""
    )
    table = F.array(*(F.lit(k) for k in model.bytes))
    flat = F.flatten(
        F.transform(
            "path",
            lambda p: F.when(p["id"] >= 0, F.array(p["id"])).otherwise(
                F.transform(
                    F.sequence(F.lit(0), (F.length(F.hex(F.encode(F.substring(F.col("unit"), p["start"] + 1, F.lit(1)), "UTF-8"))) / 2).cast("int") - 1),
                    lambda k: F.element_at(table, F.conv(F.substring(F.hex(F.encode(F.substring(F.col("unit"), p["start"] + 1, F.lit(1)), "UTF-8")), k * 2 + 1, F.lit(2)), 16, 10).cast("int") + 1),
                )
            ),
        )
    )
    folded = grouped.withColumn("best", best).withColumn("path", path).withColumn("unit", F.concat(F.lit(SPACE_MARK), "word"))
    return folded.select("word", flat.alias("ids"))


def _decide(model: PieceModel):
    import pyarrow as pa

    def run(batches):
        for b in batches:
            fine = [model.may_follow(x, y) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(fine, pa.bool_())], names=["before", "piece", "fine"])

    return run


def dictionary(docs: DataFrame, model: PieceModel, size: int = DICTIONARY, text_col: str = "text") -> dict[str, bytes]:
    """Best paths of the corpus' most frequent words, from the relational lattice."""
    ws = Workspace(docs.sparkSession, "pieces")
    counted = words(fresh(docs, text_col).filter(F.col(text_col).isNotNull()), text_col).filter(F.length("word") < LONGEST_WORD)
    counted = ws.save(counted.filter("n > 1").withColumn("level", F.floor(F.log2("n") * 16)), "words")
    # the count from which on words fit into the dictionary, from a histogram of counts: no sort of all words
    room, lowest = size, None
    for r in sorted(counted.groupBy("level").agg(F.count("*").alias("k")).collect(), key=lambda r: -r.level):
        room -= r.k
        if room < 0:
            break
        lowest = r.level
    frequent = counted.filter(F.col("level") >= F.lit(lowest)) if lowest is not None else counted.limit(0)
    return {r.word: np.array(r.ids, "<i4").tobytes() for r in ws.save(lattice(ws, frequent, model), "paths").toLocalIterator()}


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_pieces, n_byte_pieces, ids, ids_crc32, round_trip) of each whole text.

    ``round_trip`` says that decoding the identifiers gave the text back. Null and
    empty texts have no pieces; null ids stay null; repeated rows are encoded row
    by row; an empty table gives an empty result; extra columns are not read.
    ``model_path`` is a file that every executor can open.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(dictionary(docs, load(model_path), text_col=text_col))

    def run(batches):
        model = load(model_path)
        folder, found = BatchFolder(model), dict(known.value)
        is_byte = np.zeros(len(model.text), bool)
        is_byte[model.bytes] = True
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            split = [t.split(" ") if t else [] for t in texts]
            if len(found) > REMEMBERED:
                found = dict(known.value)
            new: set[str] = set()
            for ws in split:
                new.update(set(ws).difference(found))
            fresh_words = list(new)
            for a in range(0, len(fresh_words), 20_000):
                part = fresh_words[a : a + 20_000]
                found.update(zip(part, folder.fold(part), strict=True))
            coded = [b"".join(map(found.__getitem__, ws)) for ws in split]
            arrays = [model.join_spaces(np.frombuffer(c, "<i4")) for c in coded]
            coded = [a.tobytes() for a in arrays]
            sizes = np.array([len(a) for a in arrays], np.int64)
            values = np.concatenate(arrays) if arrays else np.empty(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values, pa.int32()))
            back = [model.decode(a.tolist()) == t for a, t in zip(arrays, texts, strict=True)]
            fell = [int(is_byte[a].sum()) for a in arrays]
            yield pa.record_batch([b.column(0), pa.array(sizes), pa.array(fell, pa.int64()), lists, pa.array([zlib.crc32(c) for c in coded], pa.int64()), pa.array(back, pa.bool_())], names=[id_col, "n_pieces", "n_byte_pieces", "ids", "ids_crc32", "round_trip"])

    kind = docs.schema[id_col].dataType.simpleString()
    return fresh(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_pieces long, n_byte_pieces long, ids array<int>, ids_crc32 long, round_trip boolean")


def decode_pieces(coded: DataFrame, model_path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, text) from the identifiers; a null list gives an empty text, null ids stay null."""
    import pyarrow as pa

    def run(batches):
        model = load(model_path)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([model.decode(i or ()) for i in b.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    kind = coded.schema[id_col].dataType.simpleString()
    return fresh(coded, id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, text string")


def sentence_pieces(spark: SparkSession, docs: DataFrame, model_path: str) -> DataFrame:
    """``encode_pieces`` with the default columns; nulls, repeats and empty tables as there."""
    return encode_pieces(docs, model_path)
