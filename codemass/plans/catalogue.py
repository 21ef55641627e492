"""Registered queries of the library's own operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codemass.operators import metrics, traverse
from codemass.plans import explore_queries, graph_queries, measure_queries, role_queries, series_queries, source_queries, text_queries
from codemass.plans.proxies import expand, frame


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composition metrics over components whose distances come from the dependency graph."""
    components = traverse.value_distances(frame(spark, sf_dir, "components"), frame(spark, sf_dir, "edges"))
    return metrics.composition(components)


_ALL = (graph_queries, measure_queries, series_queries, text_queries, role_queries, explore_queries, source_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to callable."""
    return {name: fn for module in _ALL for name, (fn, _) in module.QUERIES.items()} | {"scan_flagship": flagship}


def oracle_sql() -> dict[str, str]:
    """Query name to DuckDB SQL."""
    distances = graph_queries._HOPS + f", comp as (select snapshot_id, path, category, code_lines, greatest({graph_queries._BASE}, coalesce(h, 0))::int value_distance from {{components}} left join d on node = p_partkey) "
    flagship_sql = distances + measure_queries.QUERIES["composition_metrics"][1].replace("{components}", "comp")
    return {name: expand(sql) for module in _ALL for name, (_, sql) in module.QUERIES.items() if sql} | {"scan_flagship": expand(flagship_sql)}
