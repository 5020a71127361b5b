"""Queries of the nested-record operator (problem 1)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldproof.operators.flatten import EMITTED, emit_nodes, read_table, table_counts, table_schemas, write_tables
from fieldproof.session import shared_folder
from fieldproof.sources.tables import table


def nodes_of(spark: SparkSession, folder: str) -> DataFrame:
    """The tagged emission of tool_result and field_specs."""
    return emit_nodes(table(spark, folder, "tasks"), "line_no", ["tool_result"], ["field_specs"])


def written_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The emission as tables: written once partitioned by tag, in the shared folder, and read from there."""
    target = shared_folder(spark, "nodes")
    write_tables(nodes_of(spark, folder), target)
    return spark.read.schema(EMITTED).parquet(target)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """One row per object in tool_result and per element of field_specs, with its place and its parent's, from the full emission."""
    return nodes_of(spark, folder).select(F.col("record_key").alias("line_no"), "node_path", "parent_path")


def p1_field_table(spark: SparkSession, folder: str) -> DataFrame:
    """The flat table of the field specifications, read from the tagged emission."""
    flat = read_table(nodes_of(spark, folder), "field_specs", "path string, role string, value string, required boolean")
    return flat.select(F.col("record_key").alias("line_no"), "node_path", "path", "role", "value", "required")


def p1_table_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each flat table, and values of each of its members, every table written by tag and read back with its own schema."""
    nodes = written_nodes(spark, folder)
    return table_counts(nodes, table_schemas(nodes))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p1_field_table": p1_field_table, "p1_table_sizes": p1_table_sizes}

SQL: dict[str, str] = {
    "p1_field_table": """
        SELECT line_no, 'field_specs[' || (i - 1) || ']' AS node_path, field_specs[i].path AS path,
               field_specs[i].role AS role, field_specs[i].value AS value, field_specs[i].required AS required
        FROM (SELECT line_no, field_specs, unnest(range(1, len(field_specs) + 1)) AS i FROM tasks)
        WHERE field_specs[i] IS NOT NULL
    """,
}
