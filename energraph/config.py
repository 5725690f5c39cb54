"""Every knob of the engine with its default and its bounds; a bad value raises ValueError.

The numbers here are fixed values: results depend on them.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

#: Order of the layers, which breaks ties between equal contributions.
LAYERS = ("semantic", "entity", "structural", "derivation", "learned")


def need(holds: bool, message: str) -> None:
    if not holds:
        raise ValueError(message)


def _positive(o: object, *names: str) -> None:
    for n in names:
        need(getattr(o, n) > 0, f"{n} must be positive")


def _not_negative(o: object, *names: str) -> None:
    for n in names:
        need(getattr(o, n) >= 0, f"{n} must not be negative")


def _share(o: object, *names: str) -> None:
    for n in names:
        need(0 < getattr(o, n) <= 1, f"{n} must be in (0, 1]")


@dataclass(frozen=True)
class LayerWeights:
    semantic: float = 0.5
    entity: float = 1.0
    structural: float = 0.3
    derivation: float = 1.0
    learned: float = 0.0

    def __post_init__(self) -> None:
        _not_negative(self, *LAYERS)

    def of(self, layer: str) -> float:
        need(layer in LAYERS, f"unknown layer {layer}")
        return getattr(self, layer)

    def enabled(self) -> dict[str, float]:
        return {f.name: getattr(self, f.name) for f in fields(self) if getattr(self, f.name) > 0}


@dataclass(frozen=True)
class StructuralEdgeConfig:
    adjacent: float = 1.0
    same_section: float = 0.6
    same_document: float = 0.0

    def __post_init__(self) -> None:
        _not_negative(self, "adjacent", "same_section", "same_document")


@dataclass(frozen=True)
class SemanticEdgeConfig:
    k: int = 5
    min_similarity: float = 0.0

    def __post_init__(self) -> None:
        _positive(self, "k")
        need(0 <= self.min_similarity < 1, "min_similarity must be in [0, 1)")


@dataclass(frozen=True)
class EntityEdgeConfig:
    max_df_ratio: float = 0.02

    def __post_init__(self) -> None:
        _share(self, "max_df_ratio")


@dataclass(frozen=True)
class EntityExtractionConfig:
    model: str = "xx_ent_wiki_sm"
    labels: tuple[str, ...] = ("PER", "PERSON", "ORG", "LOC", "GPE", "NORP", "FAC", "EVENT", "WORK_OF_ART", "PRODUCT", "LAW", "MISC")
    min_entities: int = 1

    def __post_init__(self) -> None:
        _not_negative(self, "min_entities")


@dataclass(frozen=True)
class PropositionConfig:
    max_per_chunk: int = 12
    min_chars: int = 15
    tag_polarity: bool = False

    def __post_init__(self) -> None:
        _positive(self, "max_per_chunk", "min_chars")


@dataclass(frozen=True)
class MassConfig:
    enabled: bool = False
    exponent: float = 1.0
    floor: float = 0.5
    cap: float = 2.0

    def __post_init__(self) -> None:
        _not_negative(self, "exponent")
        _share(self, "floor")
        need(self.cap >= 1, "cap must be at least 1")


@dataclass(frozen=True)
class PropagationConfig:
    seed_energy: float = 10.0
    damping: float = 0.60
    threshold_ratio: float = 0.15
    max_hop: int = 8
    max_nodes: int = 512
    split_alpha: float = 1.0
    mass: MassConfig = field(default_factory=MassConfig)

    def __post_init__(self) -> None:
        _positive(self, "seed_energy", "split_alpha")
        need(0 < self.damping < 1, "damping must be in (0, 1)")
        need(0 <= self.threshold_ratio < 1, "threshold_ratio must be in [0, 1)")
        _not_negative(self, "max_hop")
        need(self.max_nodes >= 1, "max_nodes must be at least 1")


@dataclass(frozen=True)
class DedupConfig:
    enabled: bool = True
    sigma: float = 2.0
    floor: float = 0.95
    min_pairs: int = 8
    include_seeds: bool = True
    distinct_sources: bool = True

    def __post_init__(self) -> None:
        _not_negative(self, "sigma", "min_pairs")
        _share(self, "floor")


@dataclass(frozen=True)
class ConflictConfig:
    enabled: bool = True
    coefficient: float = 1.0

    def __post_init__(self) -> None:
        _share(self, "coefficient")


@dataclass(frozen=True)
class PolarityConfig(ConflictConfig):
    pass


@dataclass(frozen=True)
class NegativeSeedConfig:
    enabled: bool = True
    seed_width: int = 5
    energy_ratio: float = 1.0
    coefficient: float = 1.0

    def __post_init__(self) -> None:
        _positive(self, "seed_width", "energy_ratio")
        _share(self, "coefficient")


@dataclass(frozen=True)
class OutputConfig:
    min_cluster_nodes: int = 3
    min_cluster_energy_share: float = 0.15

    def __post_init__(self) -> None:
        _positive(self, "min_cluster_nodes")
        need(0 <= self.min_cluster_energy_share <= 1, "min_cluster_energy_share must be in [0, 1]")


@dataclass(frozen=True)
class NLICandidateConfig:
    top_k: int = 5
    min_similarity: float = 0.80
    max_pairs: int = 20_000
    require_shared_subject: bool = True
    subject_prefix_chars: int = 40
    max_subject_df_ratio: float = 0.005
    threshold: float = 0.90

    def __post_init__(self) -> None:
        _positive(self, "top_k", "max_pairs", "subject_prefix_chars")
        _share(self, "max_subject_df_ratio", "threshold")


@dataclass(frozen=True)
class LearnedLayerConfig:
    enabled: bool = True
    learning_rate: float = 0.1
    forgetting: float = 0.99
    max_strength: float = 1.0

    def __post_init__(self) -> None:
        _positive(self, "learning_rate", "max_strength")
        _share(self, "forgetting")


@dataclass(frozen=True)
class ThermalConfig:
    enabled: bool = True
    residue_ratio: float = 0.25
    auto_reset: bool = False
    min_overlap: float = 0.05

    def __post_init__(self) -> None:
        need(0 < self.residue_ratio < 1, "residue_ratio must be in (0, 1)")
        need(0 <= self.min_overlap <= 1, "min_overlap must be in [0, 1]")


@dataclass(frozen=True)
class ConsolidationConfig:
    min_runs: int = 100

    def __post_init__(self) -> None:
        _positive(self, "min_runs")


@dataclass(frozen=True)
class RetrievalConfig:
    propagation: PropagationConfig = field(default_factory=PropagationConfig)
    seed_width: int = 5
    contact_overfetch: int = 3

    def __post_init__(self) -> None:
        _positive(self, "seed_width", "contact_overfetch")


@dataclass(frozen=True)
class ColoredRetrievalConfig:
    propagation: PropagationConfig = field(default_factory=lambda: PropagationConfig(threshold_ratio=0.01, split_alpha=3.0))
    seed_width: int = 2
    contact_overfetch: int = 3
    max_colors: int = 4
    chain_mode: str = "sequential"
    max_answer_words: int = 10

    def __post_init__(self) -> None:
        _positive(self, "seed_width", "contact_overfetch", "max_colors", "max_answer_words")
        need(self.chain_mode in ("none", "single", "sequential"), "chain_mode must be none, single or sequential")


@dataclass(frozen=True)
class IterativeBaselineConfig:
    per_step_k: int = 5
    max_steps: int = 4
    stop_phrase: str = "answer is"
    max_collected: int = 20

    def __post_init__(self) -> None:
        _positive(self, "per_step_k", "max_steps", "max_collected")
        need(bool(self.stop_phrase), "stop_phrase must not be empty")


@dataclass(frozen=True)
class EvaluationConfig:
    sample_size: int = 1000
    sample_seed: int = 42
    k_values: tuple[int, ...] = (2, 5, 10)
    recall_weight: float = 0.65
    novelty_weight: float = 0.35

    def __post_init__(self) -> None:
        _not_negative(self, "sample_size", "recall_weight", "novelty_weight")
        need(bool(self.k_values) and min(self.k_values) >= 1, "k_values must be at least 1")
        need(abs(self.recall_weight + self.novelty_weight - 1) < 1e-9, "weights must sum to 1")

    @property
    def primary_k(self) -> int:
        return 5 if 5 in self.k_values else self.k_values[-1]


@dataclass(frozen=True)
class Profile:
    damping: float
    threshold_ratio: float
    seed_width: int

    def retrieval(self, base: RetrievalConfig | None = None) -> RetrievalConfig:
        base = base or RetrievalConfig()
        return replace(base, seed_width=self.seed_width, propagation=replace(base.propagation, damping=self.damping, threshold_ratio=self.threshold_ratio))

    def colored(self, base: ColoredRetrievalConfig | None = None) -> ColoredRetrievalConfig:
        base = base or ColoredRetrievalConfig()
        return replace(base, seed_width=self.seed_width, propagation=replace(base.propagation, damping=self.damping, threshold_ratio=self.threshold_ratio))


PROFILES = {"precise": Profile(0.45, 0.01, 3), "explore": Profile(0.75, 0.01, 8), "compare": Profile(0.60, 0.01, 6)}
