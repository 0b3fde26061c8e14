"""Settings of the engine and the retrieval profile of each kind of question."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class EngineConfig:
    """Fixed values that results depend on; every one can be overridden."""

    rrf_k: int = 60
    routing_sample: int = 60
    routing_top_chunks: int = 3
    gate_ratio: float = 0.45
    reserve_slots: int = 3
    sweep_cap: int = 60
    neighbour_discount: float = 0.75
    child_tokens: int = 350
    child_overlap: int = 60
    parent_tokens: int = 1600
    section_tokens: int = 800
    running_line_ratio: float = 0.6
    rows_per_chunk: int = 10
    table_parts: int = 6
    table_tokens: int = 3000
    row_labels: int = 12
    manifest_least: int = 2
    manifest_most: int = 25
    heading_share: float = 0.5
    fact_fire: float = 78.0
    fact_trust: float = 85.0
    filter_cap: int = 20
    cell_cap: int = 20000
    context_tokens: int = 6000
    containment: float = 0.8
    shingle_words: int = 8
    router_weight: float = 0.35
    router_protect: float = 0.85
    prune_overlap: float = 0.6

    @classmethod
    def from_conf(cls, spark: SparkSession, prefix: str = "lodestrata.") -> EngineConfig:
        """Values from session settings named ``prefix`` + field, else the defaults."""
        found = {f.name: type(f.default)(v) for f in fields(cls) if (v := spark.conf.get(prefix + f.name, None)) is not None}
        return cls(**found)


# What each kind of question retrieves.
PROFILE_COLUMNS = "intent string, mode string, candidate_k int, final_k int, max_per_source int, decompose boolean, neighbours boolean, context_tokens int, min_rerank int, gated boolean, max_documents int, gate_ratio double, subtopics boolean, document_order boolean"
PROFILES = [
    ("fact_lookup", "focused", 20, 4, 3, False, False, 4000, 2, True, 2, 0.45, False, False),
    ("comparison", "per_entity", 40, 10, 4, True, False, 7000, 2, True, 4, 0.45, False, False),
    ("multi_hop", "multi_hop", 40, 8, 3, True, False, 7000, 1, False, 4, None, False, False),
    ("procedural", "focused", 30, 8, 6, False, True, 7000, 1, True, 2, 0.45, False, True),
    ("synthesis", "outline", 60, 16, 10, True, False, 9000, 2, True, 2, 0.60, True, True),
    ("exhaustive", "sweep", 80, 24, 24, True, True, 10000, 1, True, 2, 0.65, False, True),
    ("cross_document", "broad", 60, 14, 4, True, False, 9000, 1, False, 6, None, True, False),
]


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROFILES, PROFILE_COLUMNS)
