"""Parameters of the retrieval operators as frozen dataclasses; unknown keys of a config file are ignored."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field

RELATIONS = ("HAS_SUBSECTION", "HAS_CHUNK", "HAS_ITEM", "CAPTIONS", "LINKS_TO")


@dataclass(frozen=True)
class Drill:
    tau_local: float = 0.35
    tau_child: float = 0.45
    margin: float = 0.05
    top_k: int = 2
    top_r: int = 3
    threshold_mode: str = "absolute"  # absolute, percentile or rank
    rank_top_p: float = 0.5


@dataclass(frozen=True)
class Expand:
    max_depth: int = 3
    max_nodes: int = 200
    allowed_relations: tuple[str, ...] = ()


@dataclass(frozen=True)
class Score:
    mode: str = "full"  # or text_only
    w_text: float = 1.0
    w_type: float = 0.3
    w_level: float = 0.15
    w_dist: float = 0.2
    type_bonus: dict = field(default_factory=lambda: {"list_item": 1.0, "chunk": 0.6, "section_title": 0.8, "caption": 0.2})
    level_bonus: dict = field(default_factory=lambda: {1: 0.1, 2: 0.2, 3: 0.3})


@dataclass(frozen=True)
class Output:
    top_k_text: int = 20


@dataclass(frozen=True)
class Subgraph:
    tail_after: int = 2
    max_window_chunks: int = 8
    fallback_before: int = 2
    fallback_after: int = 2


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.5
    b: float = 0.75


@dataclass(frozen=True)
class Heuristic:
    """Defaults are those of the lexical variant; ``DENSE_HEURISTIC`` has the dense one's."""

    top_k: int = 10
    candidate_multiplier: int = 12
    min_chars: int = 80
    fallback_min_chars: int = 40
    relax_threshold: int = 4
    rare_terms_top_n: int = 2
    drop_bullets: bool = False
    drop_incomplete: bool = False


DENSE_HEURISTIC = Heuristic(candidate_multiplier=6, drop_bullets=True, drop_incomplete=True, relax_threshold=0)


@dataclass(frozen=True)
class CleanCap:
    top_k_chunks: int | None = 7
    token_budget: int = 350
    min_chunk_chars: int = 5
    min_chars: int = 20
    joiner: str = "\n\n---\n\n"
    allow_first_chunk_trim: bool = True


def of(kind: type, values: dict | None):
    """``kind`` from a dict, without the keys it does not have."""
    names = {f.name for f in dataclasses.fields(kind)}
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in (values or {}).items() if k in names})


def load(path: str) -> dict:
    """A config file, which must hold an object."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    if not isinstance(found, dict):
        raise ValueError(f"{path} must hold a JSON object")
    return found
