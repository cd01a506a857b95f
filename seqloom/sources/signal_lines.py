"""Loading of raw signal lines, with the lines that fail set apart.

Every physical line of a signal file (``tsv``, ``csv`` or ``slow5``) is parsed
into cells; cells are exploded into (row, column, value); a rule table says for
each format and column kind what a value must be; violations are aggregated to
one reason per row; the loaded reads are the rows without a violation
(anti-join).

Only violating cells are shuffled: validation is a narrow map over exploded
cells with a broadcast rule table of a dozen fixed rows, so the shuffle grows
with the errors and not with the samples.

Defined results of edge cases
* null line, line of spaces and tabs, comment, slow5 header: neither read nor failure
* empty string: a line of no spaces or tabs counts as blank too
* unknown or null ``fmt``: failure ``columns`` (no layout gives its fields)
* null ``n_declared``: failure ``columns`` for tsv and csv, as no count can agree
* equal lines under two ids: each judged by itself; null or repeated ids are
  kept apart by content, rows that agree in id and content have one verdict
* other columns pass through; helper columns begin with ``_sl_``
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The line and value rules of the input format.
ID_PATTERN = r"^[A-Za-z0-9_.:\-]{1,64}\z"
NUMBER_PATTERN = r"^ *[+\-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+\-]?[0-9]+)? *\z"
WHOLE_PATTERN = r"^ *[+\-]?[0-9]+ *\z"
# One CSV line with every quote in its place; possessive, so that a line of any length needs no deep stack.
CSV_LINE = r'^(?:,(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+))++\z'
CSV_FIELD = r',("[^"]*+(?:""[^"]*+)*+"|[^",]*+)'

REASONS = ("quoting", "columns", "id", "value")

# format, column kind, check, lower and upper bound, reason
RULES = [
    ("tsv", "id", "identifier", None, None, "id"),
    ("tsv", "sample", "number", 0.0, 400.0, "value"),
    ("csv", "id", "identifier", None, None, "id"),
    ("csv", "sample", "number", 0.0, 400.0, "value"),
    ("slow5", "id", "identifier", None, None, "id"),
    ("slow5", "calibration", "number", None, None, "value"),
    ("slow5", "length", "whole", None, None, "value"),
    ("slow5", "sample", "whole", -4096.0, 4095.0, "value"),
]


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        RULES, "_sl_fmt string, _sl_kind string, _sl_check string, _sl_lo double, _sl_hi double, _sl_reason string"
    )


def _rank(reason: Column) -> Column:
    return F.array_position(F.array(*[F.lit(r) for r in REASONS]), reason).cast("int")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Reads among the lines, with their cells and the faults of whole rows.

    Adds ``_sl_key`` (row key), ``_sl_cells`` (array of fields, samples of slow5
    after its first seven fields) and ``_sl_fault`` (``quoting``, ``columns`` or null).
    """
    text = F.regexp_replace(F.regexp_replace("raw_line", r"^\x{FEFF}", ""), r"\r\z", "")
    df = lines.withColumn("_sl_text", text)
    t = F.col("_sl_text")
    header = (F.col("fmt") == "slow5") & t.startswith("read_id\t")
    df = df.where(
        t.isNotNull()
        & ~t.rlike(r"^[ \t]*\z")
        & ~t.startswith("#")
        & ~t.startswith("@")
        & ~F.coalesce(header, F.lit(False))
    )
    quoted_ok = F.concat(F.lit(","), t).rlike(CSV_LINE)
    has_quote = t.contains('"')
    csv_cells = F.when(~has_quote, F.split(t, ",", -1)).when(
        quoted_ok,
        F.transform(
            F.regexp_extract_all(F.concat(F.lit(","), t), F.lit(CSV_FIELD), F.lit(1)),
            lambda c: F.when(
                c.startswith('"'), F.regexp_replace(c.substr(F.lit(2), F.length(c) - 2), '""', '"')
            ).otherwise(c),
        ),
    )
    fields = F.when(F.col("fmt") == "csv", csv_cells).when(F.col("fmt").isin("tsv", "slow5"), F.split(t, "\t", -1))
    df = df.withColumn("_sl_fields", fields)
    f, n = F.col("_sl_fields"), F.size("_sl_fields")
    samples = F.split(F.try_element_at(f, F.lit(8)), ",", -1)
    df = df.withColumn("_sl_samples", F.when((F.col("fmt") == "slow5") & (n == 8), samples))
    declared = F.trim(F.try_element_at(f, F.lit(7)))
    # whole numbers of any length are compared as text, without sign and leading zeros
    digits = F.regexp_replace(F.regexp_replace(declared, r"^[+\-]", ""), r"^0+(?=[0-9])", "")
    differs = F.try_element_at(f, F.lit(7)).rlike(WHOLE_PATTERN) & (
        (digits != F.size("_sl_samples").cast("string")) | (declared.startswith("-") & (digits != "0"))
    )
    fault = (
        F.when((F.col("fmt") == "csv") & has_quote & ~quoted_ok, "quoting")
        .when(f.isNull(), "columns")
        .when(F.col("fmt") == "slow5", F.when((n != 8) | differs, "columns"))
        .when(F.col("n_declared").isNull() | (n.cast("long") != F.col("n_declared").cast("long") + 1), "columns")
    )
    cells = F.when(
        F.col("fmt") == "slow5", F.when(n == 8, F.concat(F.slice(f, 1, 7), F.col("_sl_samples"))).otherwise(f)
    ).otherwise(f)
    key = F.concat_ws(
        ":",
        F.coalesce(F.col("line_id").cast("string"), F.lit("-")),
        F.coalesce("fmt", F.lit("-")),
        F.coalesce(F.col("n_declared").cast("string"), F.lit("-")),
        F.md5(F.col("raw_line")),
    )
    return (
        df.withColumn("_sl_fault", fault)
        .withColumn("_sl_cells", cells)
        .withColumn("_sl_key", key)
        .drop("_sl_fields", "_sl_samples", "_sl_text")
    )


def explode_cells(parsed: DataFrame) -> DataFrame:
    """(row, column, value) of every cell of rows whose layout is right."""
    kind = (
        F.when(F.col("_sl_col") == 0, "id")
        .when((F.col("fmt") != "slow5") | (F.col("_sl_col") >= 7), "sample")
        .when(F.col("_sl_col") == 6, "length")
        .when(F.col("_sl_col") >= 2, "calibration")
        .otherwise("free")
    )
    return (
        parsed.where(F.col("_sl_fault").isNull())
        .select("_sl_key", "fmt", F.posexplode("_sl_cells").alias("_sl_col", "_sl_value"))
        .withColumn("_sl_kind", kind)
    )


def cell_errors(parsed: DataFrame) -> DataFrame:
    """Violations, one row per broken cell: key, column, value, reason."""
    cells = explode_cells(parsed)
    rules = F.broadcast(rule_table(parsed.sparkSession))  # a dozen fixed rows
    joined = cells.join(rules, (F.col("fmt") == F.col("_sl_fmt")) & (cells["_sl_kind"] == rules["_sl_kind"]))
    v = F.col("_sl_value")
    number = F.expr("try_cast(trim(_sl_value) AS double)")
    shape = (
        F.when(F.col("_sl_check") == "identifier", v.rlike(ID_PATTERN))
        .when(F.col("_sl_check") == "number", v.rlike(NUMBER_PATTERN))
        .otherwise(v.rlike(WHOLE_PATTERN))
    )
    inside = F.coalesce(number >= F.col("_sl_lo"), F.lit(True)) & F.coalesce(number <= F.col("_sl_hi"), F.lit(True))
    bounded = F.col("_sl_lo").isNotNull()
    ok = shape & (~bounded | (number.isNotNull() & inside))
    return joined.where(~F.coalesce(ok, F.lit(False))).select("_sl_key", "_sl_col", "_sl_value", "_sl_reason")


def row_errors(parsed: DataFrame) -> DataFrame:
    """One row per failing key: the first reason that applies and the number of broken cells."""
    rows = parsed.where(F.col("_sl_fault").isNotNull()).select(
        "_sl_key", _rank(F.col("_sl_fault")).alias("_sl_rank"), F.lit(0).alias("_sl_cell")
    )
    cells = cell_errors(parsed).select("_sl_key", _rank(F.col("_sl_reason")).alias("_sl_rank"), F.lit(1).alias("_sl_cell"))
    worst = (
        rows.unionByName(cells)
        .groupBy("_sl_key")
        .agg(F.min("_sl_rank").alias("_sl_rank"), F.sum("_sl_cell").cast("long").alias("n_bad_cells"))
    )
    names = F.array(*[F.lit(r) for r in REASONS])
    return worst.select("_sl_key", F.element_at(names, F.col("_sl_rank")).alias("reason"), "n_bad_cells")


def _own(lines: DataFrame) -> DataFrame:
    """Without columns of the caller that would clash with what is added."""
    return lines.drop("reason", "n_bad_cells", "read_id", "signal")


def failed_lines(lines: DataFrame) -> DataFrame:
    """Lines that are reads but can't be loaded, with ``reason`` and ``n_bad_cells``."""
    parsed = parse_lines(_own(lines))
    return (
        parsed.join(row_errors(parsed), "_sl_key")
        .drop("_sl_key", "_sl_cells", "_sl_fault")
    )


def loaded_reads(lines: DataFrame) -> DataFrame:
    """Reads of the lines without a fault: ``read_id`` and ``signal``, other columns kept."""
    parsed = parse_lines(_own(lines))
    clean = parsed.join(row_errors(parsed).select("_sl_key"), "_sl_key", "left_anti")
    first = F.when(F.col("fmt") == "slow5", 8).otherwise(2)
    samples = F.slice("_sl_cells", first, F.greatest(F.size("_sl_cells") - first + 1, F.lit(0)))
    return clean.withColumn("read_id", F.element_at("_sl_cells", 1)).withColumn(
        "signal", F.transform(samples, lambda x: F.trim(x).cast("double").cast("float"))
    ).drop("_sl_key", "_sl_cells", "_sl_fault", "raw_line")
