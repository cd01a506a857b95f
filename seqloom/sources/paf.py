"""PAF text: reading into typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBERS = {
    "query_len": "int", "query_start": "int", "query_end": "int", "target_len": "bigint", "target_start": "bigint",
    "target_end": "bigint", "num_matches": "int", "alignment_len": "int", "mapq": "int",
}
COLUMNS = [
    "query_name", "query_len", "query_start", "query_end", "strand", "target_name", "target_len", "target_start",
    "target_end", "num_matches", "alignment_len", "mapq",
]


def parse_paf(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """Twelve typed columns and ``tags``.  Comments and rows of fewer fields are left out; a number
    that can't be read is 0."""
    p = F.split(F.regexp_replace(F.col(line_col), r"\r\z", ""), "\t", -1)
    rows = lines.where(~F.col(line_col).startswith("#")).select(p.alias("_p")).where(F.size("_p") >= 12)

    def field(i: int, name: str) -> Column:
        raw = F.element_at("_p", i + 1)
        if name in NUMBERS:
            return F.coalesce(F.expr(f"try_cast(element_at(_p, {i + 1}) AS {NUMBERS[name]})"), F.lit(0)).cast(NUMBERS[name]).alias(name)
        return F.left(raw, F.lit(1)).alias(name) if name == "strand" else raw.alias(name)

    tags = F.slice("_p", 13, F.greatest(F.size("_p") - 12, F.lit(0)))
    return rows.select(*[field(i, c) for i, c in enumerate(COLUMNS)], tags.alias("tags"))


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    return parse_paf(spark.read.text(path))
