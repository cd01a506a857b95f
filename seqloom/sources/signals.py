"""Whole signal files of known format, strict: a bad number fails the read.  For lenient loading with
reasons see ``signal_lines``."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def format_of(path: str) -> str:
    end = path.rpartition(".")[2].lower()
    return {"csv": "csv", "slow5": "slow5", "blow5": "slow5"}.get(end, "tsv")


def _floats(parts) -> F.Column:
    return F.transform(parts, lambda x: F.trim(x).cast("float"))


def read_signal(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """(read_id, signal)."""
    fmt = fmt or format_of(path)
    lines = spark.read.text(path).select(F.regexp_replace("value", r"\r\z", "").alias("v"))
    lines = lines.where((F.trim("v") != "") & ~F.col("v").startswith("#"))
    if fmt == "slow5":
        header = [r[0] for r in spark.read.text(path).where(F.col("value").rlike("^#?read_id\t")).limit(1).collect()]
        names = header[0].lstrip("#").split("\t") if header else []
        at = next((i for i, n in enumerate(names) if n in ("raw_signal", "signal")), -1)
        parts = F.split("v", "\t", -1)
        cell = F.element_at(parts, at + 1 if at >= 0 else -1)
        rows = lines.where(~F.col("v").startswith("@") & ~F.col("v").startswith("read_id\t"))
        return rows.select(F.element_at(parts, 1).alias("read_id"), _floats(F.filter(F.split(cell, ","), lambda x: x != "")).alias("signal"))
    parts = F.split("v", "," if fmt == "csv" else "\t", -1)
    values = F.filter(F.slice(parts, 2, F.size(parts)), lambda x: F.trim(x) != "")
    return lines.select(F.trim(F.element_at(parts, 1)).alias("read_id"), _floats(values).alias("signal"))


def read_pore_model(path: str) -> tuple[int, list[float], str]:
    """(k, levels, name) of a JSON object, or of a flat list of 4^k levels."""
    with open(path) as f:
        data = json.load(f)
    if isinstance(data, list):
        levels, name = data, "custom"
        k = (len(levels).bit_length() - 1) // 2
    else:
        levels, name, k = data["levels"], data.get("name", "custom"), int(data["kmer_size"])
    if len(levels) != 4**k:
        raise ValueError(f"{len(levels)} levels are not 4^{k}")
    return k, [float(x) for x in levels], name
