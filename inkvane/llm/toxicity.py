"""Severity grades by cumulative-link ordinal regression (operator 4).

P(grade <= k) = logistic(threshold_k - w.x): one weight vector serves all ordered
thresholds, and the expected severity is the mean grade under the model. Features
are sparse: lower-cased words and their first 4, 5 and 6 characters, each as
log(1 + occurrences) in the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, fresh, hash_sample, rows_of

#: Labelled rows that the fit may use, for each class; the features it may keep.
SAMPLE_ROWS, MAX_FEATURES = 4000, 4096
#: The two-proportion score from which a feature has the plain ridge penalty (the best score, where none reaches it).
CLEAR = 6.0
GRADES = 4
#: P(grade > 0) from which a document is called toxic.
DECIDE = 0.15
_STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¡¿«»“”‘’„…–—"


def features_of(word: str) -> tuple[str, ...]:
    """A word's features; whole words and prefixes do not mix."""
    w = word.strip(_STRIP)
    return (w, *(f"{w[:n]}*" for n in (4, 5, 6) if len(w) >= n)) if w else ()


@dataclass
class OrdinalModel:
    """Weights by feature, ordered thresholds, and the log odds by which the sample over-represents class 1."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(GRADES - 1))
    shift: float = 0.0

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for k = 0 .. GRADES - 2."""
        z = np.asarray(score, float)[:, None] - self.thresholds[None, :] - self.shift
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Sparse:
    """A matrix by its cells other than zero, for products with vectors."""

    rows: np.ndarray
    cols: np.ndarray
    values: np.ndarray
    shape: tuple[int, int]

    @property
    def T(self) -> Sparse:  # noqa: N802
        return Sparse(self.cols, self.rows, self.values, self.shape[::-1])

    def __matmul__(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * v[self.cols], self.shape[0])


def _cuts(p: np.ndarray, d: int) -> np.ndarray:
    """Thresholds of the parameters behind the ``d`` weights: the first one, then logarithms of the gaps."""
    return p[d] + np.concatenate([[0.0], np.cumsum(np.exp(p[d + 1 :]))])


def loss_and_gradient(p: np.ndarray, x: np.ndarray | Sparse, y: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Mean negative log likelihood of the cumulative-link model with its ridge penalty, and the gradient."""
    n, d = x.shape
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    theta, s = _cuts(p, d), x @ p[:d]
    upper = np.append(theta, np.inf)[y]
    lower = np.concatenate([[-np.inf], theta])[y]
    fu, fl = np.where(np.isinf(upper), 1.0, sig(upper - s)), np.where(np.isinf(lower), 0.0, sig(lower - s))
    mass = np.maximum(fu - fl, 1e-9)
    du, dl = fu * (1 - fu) / mass, fl * (1 - fl) / mass
    g_theta = np.array([-(du[y == k].sum() - dl[y == k + 1].sum()) / n for k in range(len(theta))])
    g = np.empty_like(p)
    g[:d] = x.T @ (du - dl) / n + ridge * p[:d]
    g[d] = g_theta.sum()
    for k in range(1, len(theta)):
        g[d + k] = g_theta[k:].sum() * np.exp(p[d + k])
    return float(-np.log(mass).mean() + ridge * (p[:d] @ p[:d]) / 2), g


def fit_ordinal(x: np.ndarray | Sparse, y: np.ndarray, grades: int = GRADES, ridge: float = 5e-5, steps: int = 1000, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood by Adam over shared weights and thresholds kept in order by positive gaps."""
    d = x.shape[1]
    p = np.zeros(d + grades - 1)
    p[d] = np.log((np.mean(y == 0) + 1e-3) / (np.mean(y > 0) + 1e-3))
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        _, g = loss_and_gradient(p, x, y, ridge)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return p[:d], _cuts(p, d)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", grade_col: str | None = None, sample_rows: int = SAMPLE_ROWS) -> OrdinalModel:
    """Fit on at most ``sample_rows`` labelled documents of each class (those with the smallest id hashes).

    Where the labels carry no grades (``grade_col``), a toxic row's grade is the
    third of the toxic rows it falls in by its number of distinct significant
    features: 1, 2 or 3; other rows have grade 0.

    Every feature that is more frequent among toxic texts takes part, up to the
    MAX_FEATURES that tell the classes apart best; the ridge penalty weighs each,
    and the heavier the further its score falls below CLEAR. One that a single
    toxic text holds says nothing about other texts; it takes part only where no
    two toxic texts share any.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "toxicity")
    cols = ["doc_id", label_col, *([grade_col] if grade_col else [])]
    usable = fresh(labels, *cols).filter(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull())
    usable = usable.groupBy("doc_id").agg(F.max(F.col(label_col).cast("int")).alias("y"), *([F.max(grade_col).alias("grade")] if grade_col else []))
    shares = usable.agg(F.count("*").alias("n"), F.count_if(F.col("y") > 0).alias("k")).first()
    if not shares.n or not shares.k or shares.k == shares.n:
        return OrdinalModel()
    parts = [hash_sample(usable.filter(c), "doc_id", sample_rows, n) for c, n in (("y > 0", shares.k), ("y <= 0", shares.n - shares.k))]
    sample = ws.save(parts[0].unionByName(parts[1]), "sample")
    rows = fresh(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id").filter(F.col("text").isNotNull())
    import pyarrow as pa
    import pyarrow.compute as pc

    def featurise(batches):
        for b in batches:
            ids, names, counts, keys = [], [], [], []
            for i, text, key in rows_of(b):
                c: dict[str, int] = {}
                for w in text.lower().split():
                    for f in features_of(w):
                        c[f] = c.get(f, 0) + 1
                ids += [i] * len(c)
                names += c.keys()
                counts += c.values()
                keys += [key] * len(c)
            yield pa.record_batch([pa.array(ids, b.schema.field(0).type), pa.array(names, pa.string()), pa.array(counts, pa.int32()), pa.array(keys, pa.int64())], names=["doc_id", "feature", "n", "text_key"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    long = ws.save(rows.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(featurise, f"doc_id {kind}, feature string, n int, text_key long"), "features").join(F.broadcast(sample), "doc_id")
    # copies of one text count once: rows are told apart by a hash of the whole text
    per_class = [F.count_distinct(F.when(c, F.col("text_key"))).alias(k) for k, c in (("a", F.col("y") > 0), ("b", F.col("y") <= 0))]
    n1, n0 = long.agg(*per_class).first()
    if not n1 or not n0:
        return OrdinalModel()
    df = long.groupBy("feature").agg(*per_class)
    # one-sided two-proportion score: an order, not a bound
    pooled = (F.col("a") + F.col("b")) / (n1 + n0)
    z = (F.col("a") / n1 - F.col("b") / n0) / F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0) + 1e-12)
    more = df.withColumn("z", z).filter(F.col("a") / n1 > F.col("b") / n0).orderBy(F.desc("z"), "feature")
    scores = {r.feature: r.z for r in more.filter("a >= 2").limit(MAX_FEATURES).collect()} or {r.feature: r.z for r in more.limit(MAX_FEATURES).collect()}
    if not scores:  # nothing is more frequent among toxic texts
        return OrdinalModel()
    place = {f: k for k, f in enumerate(sorted(scores))}
    # a column scaled by s has a penalty of ridge / s**2 on its own weight
    scale = np.array([scores[f] for f in place])
    scale = np.minimum(1, scale / min(CLEAR, scale.max())) ** 6
    keep = spark.createDataFrame(list(place.items()), "feature string, col int")
    # as columns: rows of objects would take the driver's memory; rows that repeat an id count once
    cells = long.join(F.broadcast(keep), "feature").groupBy("doc_id", "col").agg(F.max("n").alias("n")).orderBy("doc_id", "col").toArrow()
    data = sample.orderBy("doc_id").toArrow()
    at_row = pc.index_in(cells["doc_id"], data["doc_id"]).to_numpy()
    at_col = cells["col"].to_numpy()
    x = Sparse(at_row, at_col, np.log1p(cells["n"].to_numpy()) * scale[at_col], (len(data), len(place)))
    y = (data["y"].to_numpy() > 0).astype(int)
    if grade_col:
        y = np.clip(np.where(y > 0, [int(g or 0) for g in data["grade"].to_pylist()], 0), y, GRADES - 1)
    else:
        found_n = np.bincount(x.rows, minlength=len(data))
        thirds = np.quantile(found_n[y > 0], [1 / 3, 2 / 3])
        y = np.where(y > 0, 1 + (found_n > thirds[0]) + (found_n > thirds[1]), 0)
    w, theta = fit_ordinal(x, y)
    w = w * scale
    shift = np.log((np.sum(y > 0) / np.sum(y == 0)) / (shares.k / (shares.n - shares.k)))
    return OrdinalModel({f: float(w[k]) for f, k in place.items()}, theta, float(max(0.0, shift)))


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, expected_severity, grade, p_toxic, toxic) of whole texts; a narrow map."""
    import pyarrow as pa

    def run(batches):
        known: dict[str, tuple | None] = {}
        weights = model.weights
        for b in batches:
            scores = np.array([text_score(t, weights, known) for t in b.column(1).to_pylist()])
            above = model.above(scores) if weights else np.zeros((b.num_rows, GRADES - 1))
            yield pa.record_batch([b.column(0), pa.array(above.sum(1)), pa.array((above >= 0.5).sum(1).astype(np.int32)), pa.array(above[:, 0]), pa.array(above[:, 0] >= DECIDE)], names=[id_col, "expected_severity", "grade", "p_toxic", "toxic"])

    Workspace(docs.sparkSession, "toxicity")
    kind = docs.schema[id_col].dataType.simpleString()
    return fresh(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, expected_severity double, grade int, p_toxic double, toxic boolean")


def keep_clean(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """The rows that the model does not call toxic, all columns unchanged; null and empty texts are not toxic."""
    if not model.weights:
        return docs
    import pyarrow as pa

    Workspace(docs.sparkSession, "toxicity")

    def run(batches):
        known: dict[str, tuple | None] = {}
        weights = model.weights
        for b in batches:
            scores = np.array([text_score(t, weights, known) for t in b.column(b.schema.get_field_index(text_col)).to_pylist()])
            yield b.filter(pa.array(model.above(scores)[:, 0] < DECIDE))

    return docs.mapInArrow(run, docs.schema)


def text_score(text: str | None, weights: dict[str, float], known: dict) -> float:
    """The linear score of one text; ``known`` remembers words' weighted features up to a bound."""
    counts: dict[str, int] = {}
    for w in (text or "").lower().split():
        try:
            hit = known[w]
        except KeyError:
            if len(known) >= 200_000:
                known.clear()
            hit = known[w] = tuple(f for f in features_of(w) if f in weights) or None
        if hit:
            for f in hit:
                counts[f] = counts.get(f, 0) + 1
    return float(sum(weights[f] * np.log1p(n) for f, n in sorted(counts.items())))


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labels, score every document.

    Null or empty texts score 0 and are not toxic; null ids are scored and stay
    null; repeated rows are scored row by row; labels that are null are not used,
    and an id labelled twice counts as toxic if either row says so; without both
    classes among the labels nothing is toxic; extra columns are not read.
    """
    return score(docs, fit(docs, labels))
