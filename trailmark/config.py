"""Options passed to the retrieval and turn-budget operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class RetrievalConfig:
    """Thresholds of one retrieval run."""

    min_score: float = 0.1
    min_q_value: int = 7
    experience_top_n: int = 1
    max_epoch: int = 1


@dataclass(frozen=True)
class TurnConfig:
    """Limits of one agent task."""

    max_iterations: int = 10
    max_epoch: int = 1

    @property
    def max_total_turns(self) -> int:
        return self.max_iterations * (1 + max(1, self.max_epoch))
