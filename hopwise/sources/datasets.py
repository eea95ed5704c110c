"""Datasets as files: written with their statistics in the same pass, read by selected paths."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: Values of a partition column that are sent to the driver to filter by.
MOST_PARTS = 10_000


def write_with_statistics(rows: DataFrame, path: str, fields: dict[str, list[str]]) -> dict[str, dict[str, int]]:
    """Write ``rows`` as JSON lines to ``path``, and how many rows each value of the ``fields`` has
    to ``path``_stats; returned as well.

    The counts are taken while the rows are written, so they are scanned once.  The values of a
    field are given; other values and nulls count as ``other``.  A field of several columns has
    their names joined by a slash, as have its values.
    """

    def value(field: str) -> Column:
        return F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in field.split("/")])

    metrics = {("total", "all"): F.count(F.lit(1))}
    for field, values in fields.items():
        metrics |= {(field, v): F.count_if(value(field) == v) for v in values}
        metrics[field, "other"] = F.count_if(~value(field).isin(values))
    seen = Observation()
    named = [c.alias(str(i)) for i, c in enumerate(metrics.values())]
    rows.observe(seen, *named).write.mode("overwrite").json(path)
    counts: dict[str, dict[str, int]] = {}
    for i, (field, v) in enumerate(metrics):
        counts.setdefault(field, {})[v] = seen.get[str(i)]
    rows.sparkSession.createDataFrame([(json.dumps(counts, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}_stats")
    return counts


def read_statistics(spark: SparkSession, path: str) -> DataFrame:
    """(field, value, n) of the statistics written beside ``path``."""
    rows = spark.read.text(f"{path}_stats").select(F.from_json("value", "map<string,map<string,long>>").alias("m"))
    return rows.select(F.explode("m").alias("field", "v")).select("field", F.explode("v").alias("value", "n"))


def read_selected(spark: SparkSession, folder: str, schema: str, selection: DataFrame, part: str) -> DataFrame:
    """Rows of the JSON files below ``folder`` that ``selection`` (place, path) names, with ``place``
    and ``path``, the file's folder below ``folder``.

    ``folder`` is laid out by the partition column ``part``, which starts every path.  Up to
    ``MOST_PARTS`` of its values are a filter, which prunes the files before they are listed and
    read; beyond, the join alone decides.
    """
    rows = spark.read.schema(f"{schema}, {part} string").json(folder)
    path = F.regexp_extract(F.col("_metadata.file_path"), rf"({part}=[^/]+(?:/[^/]+)*)/[^/]+$", 1)
    wanted = selection.select("place", "path", F.regexp_extract("path", f"{part}=([^/]+)", 1).alias(part))
    parts = [r[0] for r in wanted.select(part).distinct().limit(MOST_PARTS + 1).collect()]
    rows = rows.where(F.col(part).isin(parts)) if len(parts) <= MOST_PARTS else rows
    return rows.withColumn("path", path).join(wanted, [part, "path"]).drop(part)
