"""The index as Parquet tables in a folder: build, open, grow by shards, compact, describe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import search
from seqloom.session import merge_join


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def build(contigs: DataFrame, folder: str, k: int = 31, shard_id: int = 0, kmers_per_file: int = 50_000_000) -> None:
    """Writes contigs, k-mers (sorted by word in range partitions, so that row groups prune) and the
    description of one shard.  A finished stage is not repeated."""
    spark = contigs.sparkSession
    base = f"{folder}/shard_id={shard_id}"
    if not _exists(spark, f"{base}/contigs"):
        contigs.write.mode("overwrite").option("compression", "zstd").parquet(f"{base}/contigs")
    stored = spark.read.parquet(f"{base}/contigs")
    facts = stored.agg(F.count_distinct("genome_id").alias("g"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("n")).first()
    if not _exists(spark, f"{base}/kmers"):
        files = max(1, -(-int(facts["n"]) // kmers_per_file))
        pairs = search.kmer_genomes(search.kmer_index(stored, k))
        pairs.repartitionByRange(files, "kmer").sortWithinPartitions("kmer", "genome_id").write.mode("overwrite").option(
            "compression", "zstd"
        ).parquet(f"{base}/kmers")
    row = [("seqloom-1", k, shard_id, int(facts["g"]), int(facts["n"]))]
    spark.createDataFrame(row, "version string, kmer_size int, shard int, num_genomes long, total_bases long").coalesce(1).write.mode(
        "overwrite"
    ).json(f"{base}/metadata")


def shards(spark: SparkSession, folder: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith("shard_id="))


def open_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of all shards with ``shard_id``."""
    parts = [spark.read.parquet(f"{folder}/shard_id={s}/{name}").withColumn("shard_id", F.lit(s)) for s in shards(spark, folder)]
    if not parts:
        raise FileNotFoundError(folder)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def add_genomes(contigs: DataFrame, folder: str, k: int = 31) -> int:
    """New genomes as a shard of their own; their ids go on after those present."""
    spark = contigs.sparkSession
    have = shards(spark, folder)
    offset = 0
    if have:
        offset = int(open_table(spark, folder, "contigs").agg(F.max("genome_id")).first()[0]) + 1
    shard = (have[-1] + 1) if have else 0
    build(contigs.withColumn("genome_id", (F.col("genome_id") + offset).cast("int")), folder, k, shard)
    return shard


def needs_compaction(spark: SparkSession, folder: str, share: float = 0.1) -> bool:
    """Whether shards after the first hold more than ``share`` of the first's genomes."""
    rows = describe(spark, folder).groupBy().agg(
        F.sum(F.when(F.col("shard") > 0, F.col("num_genomes")).otherwise(0)).alias("more"), F.sum(F.when(F.col("shard") == 0, F.col("num_genomes")).otherwise(0)).alias("base")
    ).first()
    return rows["base"] > 0 and rows["more"] / rows["base"] > share


def compact(spark: SparkSession, folder: str, target: str, k: int = 31, shard_id: int = 0) -> None:
    """All shards as one, ``shard_id`` of another folder."""
    build(open_table(spark, folder, "contigs").drop("shard_id"), target, k, shard_id)


def describe(spark: SparkSession, folder: str) -> DataFrame:
    parts = [spark.read.json(f"{folder}/shard_id={s}/metadata") for s in shards(spark, folder)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def search_index(queries: DataFrame, folder: str, k: int = 31, target: int = 384, max_freq: int = 10_000) -> DataFrame:
    """Containment over the stored k-mers: each shard scored by its own number of genomes, ranked together."""
    from seqloom.functions import stats
    from seqloom.functions.dna import sampled_kmers

    spark = queries.sparkSession
    samples = sampled_kmers(queries, ["query_name"], "seq", k, target)
    wanted = samples.select("kmer").distinct()
    pairs = merge_join(open_table(spark, folder, "kmers"), wanted, "kmer", "left_semi")
    freq = pairs.groupBy("shard_id", "kmer").agg(F.sum("n").alias("_f"), F.count(F.lit(1)).alias("card")).where(F.col("_f") <= max_freq)
    sizes = F.broadcast(describe(spark, folder).select(F.col("shard").cast("int").alias("shard_id"), "num_genomes"))  # a row a shard
    hits = merge_join(samples, merge_join(pairs, freq, ["shard_id", "kmer"]), "kmer").join(sizes, "shard_id")
    scored = hits.groupBy("query_name", "n_sampled", "shard_id", "genome_id").agg(
        F.count(F.lit(1)).alias("shared"), F.sum(stats.information_content(F.col("num_genomes"), "card")).alias("info_score")
    )
    return search.rank_candidates(search.add_posteriors(scored, k))
