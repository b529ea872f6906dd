"""Settings, as one frozen value that plans take as a parameter."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Budgets in tokens. Packing: size, semantic or none; overlap scope: window or document."""

    window: int = 500
    overlap: int = 50
    slack: int = 4
    packing: str = "size"
    percentile: float = 0.5
    scope: str = "window"
    source: str = ""
    top_k: int = 8
    metadata_slots: int = 2
    min_similarity: float = 0.45
    fusion: int = 60
    evidence: int = 10
    view: int = 20
    rounds: int = 2
    follow: int = 4

    def __post_init__(self):
        assert 0 <= self.overlap < self.window and 0 < self.percentile < 1
        assert self.packing in ("size", "semantic", "none") and self.scope in ("window", "document")
        assert 0 <= self.metadata_slots < self.top_k and self.rounds >= 0

    @property
    def budget(self) -> int:
        """Tokens of a body, before its context lines are taken off."""
        return self.window - self.overlap - self.slack
