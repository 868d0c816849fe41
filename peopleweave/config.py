"""Tunable weights and limits. Every value can be overridden per call.

Fixed values: the defaults below have to equal the published behaviour for results to agree.
"""
from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class RetrievalConfig:
    keyword_weight: float = 0.4
    vector_weight: float = 0.6
    keyword_threshold: float = 0.08
    boost_role: float = 0.08
    boost_skill: float = 0.12
    boost_skill_text: float = 0.10
    boost_leadership: float = 0.08
    boost_open_source: float = 0.18
    boost_code_source: float = 0.06
    boost_specialized: float = 0.12
    boost_exact_name: float = 0.45
    boost_prefix_name: float = 0.18
    specialized_keyword: float = 0.85
    specialized_vector: float = 0.15
    biased_keyword: float = 0.58
    biased_vector: float = 0.42
    limit: int = 50
    max_text_terms: int = 12
    max_must_haves: int = 20


@dataclass(frozen=True)
class RankConfig:
    project_match: float = 0.08
    repo_match: float = 0.04
    follower_scale: float = 0.02
    freshness_decay_days: float = 365.0
    pair_weight: float = 0.3
    specialized: float = 0.12
    specialized_repo: float = 0.08
    open_source_source: float = 0.12
    open_source_text: float = 0.08
    tech_lead: float = 0.08
    university: float = 0.18
    university_seed: float = 0.24
    strong_vector: float = 0.75
    strong_keyword: float = 0.5
    pair_limit: int = 15
    count_stars: bool = False


@dataclass(frozen=True)
class DimensionWeights:
    tech: float = 0.30
    project: float = 0.25
    academic: float = 0.15
    stability: float = 0.10
    community: float = 0.10
    location: float = 0.10
    experience_cap: float = 30.0

    def __post_init__(self):
        values = (self.tech, self.project, self.academic, self.stability, self.community, self.location)
        if any(v < 0 or v > 1 for v in values):
            raise ValueError("weights must lie in [0, 1]")
        if round(sum(values) * 1000) != 1000:
            raise ValueError("weights must sum to exactly 1.0")


@dataclass(frozen=True)
class OpportunityConfig:
    direction: float = 0.72
    freshness: float = 0.1
    reachability: float = 0.08
    engagement: float = 0.05
    revisit: float = 0.05
    low_direction_cap: float = 0.18
    size: int = 7
    top_count: int = 3
    suppression_days: int = 1
    pool_scan: int = 120
    pool_keep: int = 60


@dataclass(frozen=True)
class IdentityConfig:
    merge_threshold: float = 0.9
    review_threshold: float = 0.7
    singleton_confidence: float = 0.5


@dataclass(frozen=True)
class MemoryConfig:
    min_count: int = 3
    window_days: int = 30
    inferred_confidence: float = 0.65
    inferred_expiry_days: int = 30
    cache_ttl_days: int = 7


@dataclass(frozen=True)
class QueryCacheConfig:
    max_entries: int = 100
    threshold: float = 0.95
    ttl_seconds: int = 3600


@dataclass(frozen=True)
class Config:
    retrieval: RetrievalConfig = field(default_factory=RetrievalConfig)
    rank: RankConfig = field(default_factory=RankConfig)
    dimensions: DimensionWeights = field(default_factory=DimensionWeights)
    opportunity: OpportunityConfig = field(default_factory=OpportunityConfig)
    identity: IdentityConfig = field(default_factory=IdentityConfig)
    memory: MemoryConfig = field(default_factory=MemoryConfig)
    cache: QueryCacheConfig = field(default_factory=QueryCacheConfig)

    def override(self, **sections) -> "Config":
        """``cfg.override(rank={"pair_weight": 0.5})`` returns a changed copy; unknown names raise."""
        return replace(self, **{name: replace(getattr(self, name), **values) for name, values in sections.items()})


DEFAULT = Config()
