"""The thresholds of matching, in one place; every operator takes them as parameters with these defaults."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Policy:
    similarity: float = 0.30
    word_similarity: float = 0.60
    strict_word_similarity: float = 0.50
    auto_accept: float = 0.90
    limit: int = 10
    near_boost: float = 0.2
    far_km: float = 10.0
    place_threshold: float = 0.3
    place_factor: float = 0.1
    reference_threshold: float = 0.45
    reference_floor: float = 0.8
    fallback_threshold: float = 0.30
    fallback_cap: float = 0.7
    biblio_accept: float = 0.99
    trigram_weight: float = 0.35
    id_base: str = "https://w3id.org/matchloom/id/"


POLICY = Policy()
