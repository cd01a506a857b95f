"""FASTA and FASTQ as a Spark data source (format ``seqfile``), one file a partition.

Gzip is known by its first bytes, whatever the name.  FASTQ records have exactly
four lines; a quality line is never taken for letters.
"""

from __future__ import annotations

import gzip
import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# File endings of sequence files.
EXTENSIONS = ("fa", "fasta", "fna", "fsa")
SCHEMA = "file string, record_no int, name string, seq string"


def open_text(path: str):
    with open(path, "rb") as f:
        magic = f.read(2)
    return gzip.open(path, "rt", encoding="latin-1") if magic == b"\x1f\x8b" else open(path, encoding="latin-1")


def keep_dna(text: str) -> str:
    return "".join(c for c in text.upper() if c in "ACGTN")


def read_records(path: str, dna_only: bool = True):
    """(name, seq) of a file; the name is the first word.  With ``dna_only`` other letters than ACGTN go
    and empty records are left out."""
    name, parts = None, []

    def done():
        seq = "".join(parts)
        seq = keep_dna(seq) if dna_only else seq.upper()
        return (name, seq) if name is not None and (seq or not dna_only) else None

    with open_text(path) as f:
        for line in f:
            line = line.rstrip("\r\n")
            if line.startswith(">"):
                if r := done():
                    yield r
                name, parts = (line[1:].split() or [""])[0], []
            elif line.startswith("@") and name is None and not parts:
                while line:  # four-line records
                    seq = f.readline().strip()
                    f.readline()
                    f.readline()
                    name, parts = (line[1:].split() or [""])[0], [seq]
                    if r := done():
                        yield r
                    line = f.readline().rstrip("\r\n")
                name, parts = None, []
            elif name is not None:
                parts.append(line.strip())
    if r := done():
        yield r


def list_files(folder: str) -> list[str]:
    """Sequence files below a folder (or the file itself), sorted by path."""
    if os.path.isfile(folder):
        return [folder]
    found = []
    for root, _, names in os.walk(folder):
        for n in names:
            stem = n[:-3] if n.lower().endswith(".gz") else n
            if stem.rpartition(".")[2].lower() in EXTENSIONS:
                found.append(os.path.join(root, n))
    return sorted(found)


def stem_of(path: str) -> str:
    base = os.path.basename(path)
    base = base[:-3] if base.lower().endswith(".gz") else base
    return base.rpartition(".")[0] or base


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str, dna_only: bool):
        self.path, self.dna_only = path, dna_only

    def partitions(self):
        return [_Part(p) for p in list_files(self.path)] or [_Part("")]

    def read(self, partition):
        if not partition.path:
            return
        rows: list = []
        size = 0
        for i, (name, seq) in enumerate(read_records(partition.path, self.dna_only)):
            rows.append((partition.path, i, name, seq))
            size += len(seq)
            if size > 4 << 20:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows):
        file, no, name, seq = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(file), pa.array(no, pa.int32()), pa.array(name), pa.array(seq)], names=["file", "record_no", "name", "seq"]
        )


class SequenceFiles(DataSource):
    @classmethod
    def name(cls):
        return "seqfile"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"], self.options.get("dna_only", "true").lower() == "true")


def read_fasta(spark: SparkSession, path: str, dna_only: bool = True) -> DataFrame:
    spark.dataSource.register(SequenceFiles)
    return spark.read.format("seqfile").option("path", path).option("dna_only", str(dna_only).lower()).load()


def read_genomes(spark: SparkSession, folder: str) -> DataFrame:
    """(genome_id, genome_name, contig_no, contig_name, seq, base_offset): one file is one genome, its id the
    rank of its path; contigs lie one after the other."""
    rows = read_fasta(spark, folder)
    # file names are few: a table of ids is built from the listing, not by a global sort of the contigs
    files = list_files(folder)
    ids = spark.createDataFrame([(p, i, stem_of(p)) for i, p in enumerate(files)], "file string, genome_id int, genome_name string")
    w = Window.partitionBy("genome_id").orderBy("record_no")
    return rows.join(ids, "file").select(
        "genome_id",
        "genome_name",
        F.col("record_no").alias("contig_no"),
        F.col("name").alias("contig_name"),
        "seq",
        (F.sum(F.length("seq")).over(w) - F.length("seq")).cast("long").alias("base_offset"),
    )
