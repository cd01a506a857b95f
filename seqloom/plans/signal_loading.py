"""Problem 1: signal lines that fail to parse, and the reads of all others."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.session import table
from seqloom.sources import signal_lines as sl


def p1_found(spark, sf_dir):
    return sl.failed_lines(table(spark, sf_dir, "signal_lines")).select("line_id", "reason")


def p1_reads(spark, sf_dir):
    reads = sl.loaded_reads(table(spark, sf_dir, "signal_lines"))
    total = F.aggregate("signal", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return reads.select(
        "line_id", "read_id", F.size("signal").cast("long").alias("n_samples"), F.round(total, 2).alias("signal_sum")
    )


def p1_cell_errors(spark, sf_dir):
    parsed = sl.parse_lines(table(spark, sf_dir, "signal_lines"))
    return (
        sl.explode_cells(parsed)
        .groupBy("fmt", F.col("_sl_kind").alias("column_kind"))
        .agg(F.count(F.lit(1)).alias("n_cells"))
        .join(
            parsed.select("_sl_key", "fmt")
            .join(sl.cell_errors(parsed), "_sl_key")
            .withColumn(
                "column_kind",
                F.when(F.col("_sl_col") == 0, "id")
                .when((F.col("fmt") != "slow5") | (F.col("_sl_col") >= 7), "sample")
                .when(F.col("_sl_col") == 6, "length")
                .otherwise("calibration"),
            )
            .groupBy("fmt", "column_kind")
            .agg(F.count(F.lit(1)).alias("n_bad")),
            ["fmt", "column_kind"],
            "left",
        )
        .select("fmt", "column_kind", "n_cells", F.coalesce("n_bad", F.lit(0)).cast("long").alias("n_bad"))
    )


_SQL_PARSED = r"""
WITH l AS (
  SELECT line_id, fmt, n_declared,
         regexp_replace(regexp_replace(raw_line, '^\x{FEFF}', ''), '\r$', '') AS t
  FROM signal_lines
), r AS (
  SELECT * FROM l
  WHERE t IS NOT NULL AND NOT regexp_full_match(t, '[ \t]*')
    AND NOT starts_with(t, '#') AND NOT starts_with(t, '@')
    AND NOT (fmt = 'slow5' AND starts_with(t, 'read_id' || chr(9)))
), f AS (
  SELECT *, CASE WHEN fmt = 'csv' THEN
      CASE WHEN regexp_full_match(',' || t, '(?:,(?:"(?:[^"]|"")*"|[^",]*))+') THEN
        list_transform(regexp_extract_all(',' || t, ',("(?:[^"]|"")*"|[^",]*)', 1),
          lambda c: CASE WHEN starts_with(c, '"') THEN replace(c[2:length(c) - 1], '""', '"') ELSE c END) END
      ELSE string_split(t, chr(9)) END AS f
  FROM r
), j AS (
  SELECT *,
    CASE WHEN fmt = 'slow5' THEN CASE WHEN len(f) = 8 THEN string_split(f[8], ',') END ELSE f[2:] END AS s,
    CASE WHEN fmt = 'csv' AND f IS NULL THEN 'quoting'
      WHEN fmt = 'slow5' AND (len(f) <> 8 OR (regexp_full_match(f[7], ' *[+-]?[0-9]+ *')
           AND coalesce(try_cast(trim(f[7]) AS HUGEINT) <> len(string_split(f[8], ',')), true))) THEN 'columns'
      WHEN fmt <> 'slow5' AND len(f) <> n_declared + 1 THEN 'columns'
      WHEN NOT regexp_full_match(f[1], '[A-Za-z0-9_.:\-]{1,64}') THEN 'id' END AS fault
  FROM f
), v AS (
  SELECT *, CASE WHEN fmt = 'slow5' THEN
      len(list_filter(f[3:6], lambda x: NOT regexp_full_match(x, ' *[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)? *'))) > 0
      OR NOT regexp_full_match(f[7], ' *[+-]?[0-9]+ *')
      OR len(list_filter(s, lambda x: NOT regexp_full_match(x, ' *[+-]?[0-9]+ *')
             OR NOT coalesce(try_cast(trim(x) AS DOUBLE) BETWEEN -4096 AND 4095, false))) > 0
    ELSE
      len(list_filter(s, lambda x: NOT regexp_full_match(x, ' *[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)? *')
             OR NOT coalesce(try_cast(trim(x) AS DOUBLE) BETWEEN 0 AND 400, false))) > 0
    END AS bad
  FROM j
)
"""

QUERIES = {"p1_found": p1_found, "p1_reads": p1_reads, "p1_cell_errors": p1_cell_errors}
SQL = {
    "p1_found": _SQL_PARSED
    + "SELECT line_id, coalesce(fault, 'value') AS reason FROM v WHERE fault IS NOT NULL OR bad",
    "p1_reads": _SQL_PARSED
    + """SELECT line_id, f[1] AS read_id, CAST(len(s) AS BIGINT) AS n_samples,
       round(list_sum(list_transform(s, lambda x: CAST(CAST(CAST(trim(x) AS DOUBLE) AS FLOAT) AS DOUBLE))), 2) AS signal_sum
       FROM v WHERE fault IS NULL AND NOT bad""",
}
