"""Command line: ``python -m inkvane QUERY... --data DIR --out DIR`` runs registered queries over a folder of tables.

``all`` stands for every query, ``markers``, ``comparison`` and ``report`` for the
ones of that stage; results are Parquet or CSV folders below ``--out``.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans import catalog, statistics
from .sources.tables import save_csv, save_parquet

STAGES = {
    "markers": [*statistics.TABLES, *statistics.STYLOMETRIC],
    "comparison": ["compare_markers", "compare_all_markers", "summary_by_dimension", "refined_effects", "stance_effects"],
    "report": [k for k in statistics.QUERIES if k.startswith("table_")] + ["marker_counts_by_dimension", "highlights", "reliability_summary", "temperature_summary", "convergence"],
    "sample": ["scan_filter_words", "stratified_sample"],
}


def wanted(names: list[str]) -> list[str]:
    """Queries by name, stages and ``all`` expanded, each once, in order."""
    known = catalog.queries()
    out = [q for n in names for q in (known if n == "all" else STAGES.get(n, [n]))]
    if unknown := sorted(set(out) - set(known)):
        raise SystemExit(f"unknown: {', '.join(unknown)}")
    return list(dict.fromkeys(out))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = argparse.ArgumentParser(prog="inkvane", description=__doc__)
    args.add_argument("names", nargs="+", metavar="QUERY", help=f"queries, or {', '.join(STAGES)}, all")
    args.add_argument("--data", required=True, help="folder of the Parquet tables")
    args.add_argument("--out", required=True, help="folder of the results")
    args.add_argument("--format", choices=["parquet", "csv"], default="parquet")
    a = args.parse_args(argv)
    names = wanted(a.names)
    spark = spark or SparkSession.builder.appName("inkvane").getOrCreate()
    save = save_csv if a.format == "csv" else save_parquet
    for n in names:
        save(catalog.queries()[n](spark, a.data), f"{a.out}/{n}")


if __name__ == "__main__":
    main()
