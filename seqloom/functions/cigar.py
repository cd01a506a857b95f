"""CIGAR strings, as column expressions and as plain helpers for kernels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def operations(cigar: Column | str) -> Column:
    """array<struct<n, op>>"""
    return F.transform(
        F.regexp_extract_all(_c(cigar), F.lit(r"([0-9]+[=XMIDNSHP])"), F.lit(1)),
        lambda t: F.struct(F.regexp_extract(t, r"^([0-9]+)", 1).cast("int").alias("n"), F.right(t, F.lit(1)).alias("op")),
    )


def trimmed_statistics(cigar: Column | str) -> Column:
    """struct<aln_len, mismatches, gap_opens> without leading and trailing indels; null for a null or
    empty string or one of indels alone."""
    core = F.regexp_replace(F.regexp_replace(_c(cigar), r"^(?:[0-9]+[ID])+", ""), r"(?:[0-9]+[ID])+\z", "")
    ops = operations(core)
    total = lambda kinds: F.aggregate(
        F.filter(ops, lambda o: o["op"].isin(*kinds)), F.lit(0), lambda a, o: a + o["n"]
    )
    return F.when(
        F.size(ops) > 0,
        F.struct(
            total(["=", "M", "X", "I", "D"]).alias("aln_len"),
            total(["X"]).alias("mismatches"),
            F.size(F.filter(ops, lambda o: o["op"].isin("I", "D"))).alias("gap_opens"),
        ),
    )


def length(cigar: Column | str, kinds: str = "=XMID") -> Column:
    return F.aggregate(F.filter(operations(cigar), lambda o: o["op"].isin(*kinds)), F.lit(0), lambda a, o: a + o["n"])


def encode(ops: np.ndarray) -> str:
    """Run-length text of an array of one-letter operations."""
    if len(ops) == 0:
        return ""
    edge = np.flatnonzero(np.concatenate([[True], ops[1:] != ops[:-1]]))
    runs = np.diff(np.concatenate([edge, [len(ops)]]))
    return "".join(f"{n}{chr(o)}" for n, o in zip(runs.tolist(), ops[edge].tolist()))


def tag(tags: Column | str, name: str) -> Column:
    """Value of the first tag ``name:type:value`` of an array of tags."""
    hit = F.filter(_c(tags), lambda t: t.startswith(name + ":"))
    return F.regexp_extract(F.try_element_at(hit, F.lit(1)), r"^[^:]*:[^:]*:(.*)\z", 1)
