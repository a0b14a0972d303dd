"""Default parameters, as one frozen value that is handed on and never changed."""

from __future__ import annotations

from dataclasses import dataclass

# Words and patterns that routing and lexical search are defined by.
STOPWORDS = (
    "a", "al", "algo", "ante", "como", "con", "cual", "cuando", "de", "del", "desde", "donde", "el", "ella", "en", "entre", "es", "esta",
    "este", "esto", "hay", "la", "las", "lo", "los", "mas", "me", "para", "pero", "por", "porque", "que", "se", "segun", "ser", "si", "sin",
    "sobre", "son", "su", "sus", "un", "una", "y", "ya",
)
RELATIONAL_PATTERNS = (
    "se relaciona", "relacion entre", "relacion con", "como afecta", "como impacta", "impacto en", "impacto de", "depende de", "dependen de",
    "consecuencia de", "vinculad", "conecta con", "conexion entre", "flujo entre", "cadena de", "quien depende", "que relacion hay",
)
STRUCTURAL_NOUNS = ("nodo", "proceso", "riesgo", "rol", "indicador", "kpi", "hallazgo", "documento", "nota", "circuito", "fase", "etapa")
VALID_FROM_KEYS = ("fecha_vigencia", "vigente_desde", "fecha_inicio", "valid_from", "effective_date")
VALID_UNTIL_KEYS = ("fecha_derogacion", "fecha_derogación", "derogado_el", "fecha_fin", "valid_until", "expiry_date")
REVIEW_KEYS = ("fecha_revision", "fecha_revisión", "revisar_el", "review_date")
DEPRECATION_CALLOUTS = ("caution", "danger", "failure", "bug", "deprecated")


# Defaults that results depend on.
@dataclass(frozen=True)
class Params:
    top_k: int = 6
    min_similarity: float = 0.30
    min_relative_score: float = 0.62
    chunk_size: int = 1800
    chunk_overlap: int = 250
    parent_size: int = 6000
    child_size: int = 700
    child_overlap: int = 100
    rrf_k: int = 60
    semantic_weight: float = 1.0
    lexical_weight: float = 0.8
    candidate_multiplier: int = 4
    graph_weight: float = 0.5
    graph_hops: int = 2
    graph_decay: float = 0.5
    graph_backlink: float = 0.7
    graph_seeds: int = 4
    graph_max_candidates: int = 20
    mmr_lambda: float = 0.72
    max_chunks_per_document: int = 3
    rerank_candidates: int = 12
    rerank_weight: float = 0.7
    rerank_passage_chars: int = 900
    router_min_mentions: int = 2
    router_relational_weight: float = 0.5
    router_hybrid_weight: float = 0.25
    router_weak_margin: float = 0.05
    posterior_threshold: float = 0.35
    memory_interval: int = 10
    recent_turns: int = 4
    memory_context_chars: int = 12000
    branch_margin: float = 0.08
    weak_branch_weight: float = 0.5
    max_linked: int = 3
    linked_factor: float = 0.85
    bm25_k1: float = 1.2
    bm25_b: float = 0.75

    @property
    def candidate_limit(self) -> int:
        return max(20, self.top_k * self.candidate_multiplier)


DEFAULTS = Params()
