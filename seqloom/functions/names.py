"""Name functions of genomes and alignment targets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def species_of(name: Column | str, repeated_suffix: bool = False) -> Column:
    """Species of a genome name: without a trailing ``.fa``, ``.fasta`` or ``.fna``, the first
    two ``_``-separated pieces, else the first two ``.``-separated ones, else the whole name.
    ``repeated_suffix`` drops repeated endings too.  Null stays null."""
    name = F.col(name) if isinstance(name, str) else name
    tail = r"(?:(?:\.fa)*(?:\.fasta)*(?:\.fna)*)\z" if repeated_suffix else r"\.(?:fa|fasta|fna)\z"
    stem = F.regexp_replace(name, tail, "")
    parts, dots = F.split(stem, "_", -1), F.split(stem, r"\.", -1)
    pair = lambda p: F.concat_ws("_", F.element_at(p, 1), F.try_element_at(p, F.lit(2)))
    return F.when(F.size(parts) >= 2, pair(parts)).when(F.size(dots) >= 2, pair(dots)).otherwise(stem)
