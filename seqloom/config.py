"""Search settings, presets and hardware profiles."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class SearchConfig:
    kmer_size: int = 31
    sample_target: int = 384
    max_seed_freq: int = 10_000
    max_target_seqs: int = 100
    min_identity: float = 0.7
    min_query_coverage: float = 0.3
    min_score_ratio: float = 0.1
    max_candidates: int = 8_000
    adaptive: bool = True
    cross_species: bool = False
    pigeonhole: bool = False
    ic_mode: str = "sum_log2"  # or "position_max_ln" of the chunked store

    def __post_init__(self):
        if not 1 <= self.kmer_size <= 31:
            raise ValueError("kmer_size must be 1..31")
        if self.ic_mode not in ("sum_log2", "position_max_ln"):
            raise ValueError("unknown ic_mode")


# Fixed values of the presets.
PRESETS = {
    "default": {},
    "amr": {"max_target_seqs": 1000, "min_identity": 0.9, "min_query_coverage": 0.8},
    "cross-species": {"min_identity": 0.5, "cross_species": True},
    "fast": {"min_identity": 0.5},
}


def resolve(preset: str = "default", **given) -> SearchConfig:
    """A preset fills what still has its default; a setting equal to its default counts as not given."""
    if preset not in PRESETS:
        raise ValueError(f"unknown preset {preset}")
    base = SearchConfig()
    own = {k: v for k, v in given.items() if v != getattr(base, k)}
    unknown = set(given) - {f.name for f in fields(SearchConfig)}
    if unknown:
        raise TypeError(f"unknown settings {sorted(unknown)}")
    return replace(base, **(PRESETS[preset] | own))


# Memory in GB, threads, candidates, targets, seed frequency.
PROFILES = {
    "laptop": {"memory_gb": 8, "threads": 4, "max_candidates": 50, "max_target_seqs": 10, "max_seed_freq": 5_000},
    "workstation": {"memory_gb": 64, "threads": None, "max_candidates": 500, "max_target_seqs": 50, "max_seed_freq": 10_000},
}


def spark_conf(profile: str) -> dict[str, str]:
    """Spark settings of a hardware profile."""
    p = PROFILES[profile]
    return {
        "spark.driver.memory": f"{p['memory_gb'] * 3 // 4}g",
        "spark.master": f"local[{p['threads'] or '*'}]",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }


def estimate_batches(n_genomes: int, memory_gb: float, mb_per_genome: float = 30.0, usable: float = 0.8) -> int:
    """Index shards so that one fits the memory."""
    fit = max(1, int(memory_gb * 1024 * usable / mb_per_genome))
    return max(1, -(-n_genomes // fit))
