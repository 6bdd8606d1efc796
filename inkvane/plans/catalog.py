"""All queries of the library outside the llm subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import counted
from . import dialect, statistics, texts
from .dialect import Duck, Spark

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
RELATIONAL = texts.QUERIES | statistics.QUERIES


def views(spark: SparkSession, sf_dir: str, text: str) -> None:
    """Register the tables that a query names; a single-file table is spread over the cores by the plan itself."""
    for t in TABLES:
        if t in text:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def sized(spark: SparkSession, sf_dir: str, table: str) -> Spark:
    """The dialect with as many partitions as a table's files ask for, and no fewer than the session has, of a MB each at least."""
    size = int(str(spark.read.parquet(f"{sf_dir}/{table}.parquet")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return Spark(max(1, -(-size // dialect.PART_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), size >> 20)))


def relational(build: Callable, spark: SparkSession, sf_dir: str) -> DataFrame:
    text = build(Spark())
    if "REPARTITION" in text:
        text = build(sized(spark, sf_dir, "documents" if "documents" in text else "conversations"))
    views(spark, sf_dir, text)
    counted.register(spark, text)
    return spark.sql(text)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational(texts.lexical_diversity, spark, sf_dir)


def _named(name: str, build: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return relational(build, spark, sf_dir)

    query.__name__ = name
    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _named(k, f) for k, f in RELATIONAL.items()} | PROVIDED


def oracle_sql() -> dict[str, str]:
    return {k: f(Duck()) for k, f in RELATIONAL.items()} | PROVIDED_SQL


def _stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Spark()
    return relational(lambda _: f"WITH {texts.stories(d)} SELECT id, source, story FROM stories", spark, sf_dir)


def syntax_markers(spark, sf_dir):
    from ..functions.annotate import syntax_markers

    return syntax_markers(_stories(spark, sf_dir)).drop("pos")


def pos_ratios(spark, sf_dir):
    from ..functions.annotate import syntax_markers

    return syntax_markers(_stories(spark, sf_dir)).selectExpr("id", "explode(pos) as (marker, value)")


def semantic_markers(spark, sf_dir):
    from ..functions.annotate import semantic_markers

    return semantic_markers(_stories(spark, sf_dir))


def pca_projection(spark, sf_dir):
    from ..operators.projection import pca2

    return pca2(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding", "label")


def pca_of_sides(spark, sf_dir):
    """Originals and each model's rewrites in the plane of the core set's first two components."""
    from ..operators.matching import stored
    from ..operators.projection import pca2, spread_reduction

    def vectors(d):
        cells = ", ".join(f"coalesce(max(CASE WHEN marker = '{c}' THEN x END), 0)" for c in statistics.CORE_SET)
        both = "SELECT 'originals' AS label, id, marker, o AS x FROM long UNION ALL SELECT model AS label, id, marker, w AS x FROM long"
        return f"WITH {statistics.wide_long(d, statistics.CORE_SET)} SELECT label, id, array({cells}) AS v FROM ({both}) GROUP BY label, id"

    return spread_reduction(pca2(stored(relational(vectors, spark, sf_dir))), "originals")


def _standardised(spark: SparkSession, sf_dir: str, fit: str) -> DataFrame:
    """(model, id, o, w): the z scores of both sides of each pair as vectors; the markers are computed once."""
    from ..operators.matching import stored, view

    d = Spark()
    rows = view(stored(relational(lambda d: f"WITH {statistics.long(d)} SELECT * FROM long", spark, sf_dir)))
    text = statistics.side_by_side(d, fit, {"o": "zo", "w": "zw"}).replace(statistics.long(d), f"long AS (SELECT * FROM {rows})")
    cells = ", ".join(f"array({', '.join(f'{s}_{c}' for c in statistics.COMPARED)}) AS {s}" for s in "ow")
    return stored(spark.sql(f"WITH {text} SELECT model, id, {cells} FROM wide"))


def source_matching(spark, sf_dir):
    from ..operators.matching import matched

    return matched(_standardised(spark, sf_dir, "reference"))


def source_matching_stacked(spark, sf_dir):
    from ..operators.matching import matched

    return matched(_standardised(spark, sf_dir, "stacked"))


def burrows_delta_pairs(spark, sf_dir):
    from ..operators.matching import pairwise

    return pairwise(_standardised(spark, sf_dir, "rewrites"))


def wilcoxon_p(spark, sf_dir):
    from ..operators.paired import benjamini_hochberg, wilcoxon

    pairs = relational(lambda d: f"WITH {statistics.long(d)} SELECT * FROM long", spark, sf_dir)
    return benjamini_hochberg(wilcoxon(pairs, ["condition", "marker"]), "p", ["condition"])


def rewrite_offline(spark, sf_dir):
    from ..operators.rewriting import plan_jobs, rewrite_stories

    return rewrite_stories(plan_jobs(_stories(spark, sf_dir), ["gpt54"], ["generic"]))


def events_by_window(spark, sf_dir):
    from ..streaming.live import windowed_events

    return windowed_events(spark.read.parquet(f"{sf_dir}/events.parquet")).withColumn("total", F.round("total", 4))


#: SQL of the provided queries that SQL can express.
PROVIDED_SQL = {"events_by_window": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"}


def pair_distances(spark, sf_dir):
    from ..functions.annotate import pair_distances

    return pair_distances(relational(lambda d: f"WITH {statistics.pairs(d)} SELECT id, orig, rewrite FROM pairs", spark, sf_dir))


def compare_every_marker(spark, sf_dir):
    """The paired comparison of all shared numeric markers, those of the annotator and the embedder included."""
    from ..operators.markers import compare_sides

    return compare_sides(relational(lambda d: f"WITH {statistics.pairs(d)} SELECT id, orig, rewrite FROM pairs", spark, sf_dir))


def correlation_p(spark, sf_dir):
    from ..operators.paired import correlation

    return correlation(relational(lambda d: f"WITH {statistics.long(d)} SELECT * FROM long", spark, sf_dir), ["model", "marker"])


PROVIDED = {f.__name__: f for f in (syntax_markers, pos_ratios, semantic_markers, pca_projection, pca_of_sides, wilcoxon_p, rewrite_offline, events_by_window, pair_distances, correlation_p, compare_every_marker, source_matching, source_matching_stacked, burrows_delta_pairs)}


def _on_stored_markers(name: str, wanted: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    """A query that reads the markers of all pairs several times: they are computed once and stored."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..operators.matching import stored, view

        d = sized(spark, sf_dir, "conversations")
        source = statistics.wide_long(d, wanted)
        rows = view(stored(relational(lambda d: f"WITH {statistics.wide_long(d, wanted)} SELECT * FROM long", spark, sf_dir)))
        return spark.sql(RELATIONAL[name](d).replace(source, f"long AS (SELECT * FROM {rows})"))

    query.__name__ = name
    return query


PROVIDED |= {k: _on_stored_markers(k, w) for k, w in {"convergence": statistics.FULL_SET, "compare_all_markers": statistics.ALL_COMPARED, "marker_counts_by_dimension": statistics.ALL_COMPARED, "refined_effects": list(statistics.REFINED), "refined_categories": list(statistics.REFINED)}.items()}
