"""Settings of a translation run."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class JobConfig:
    source_language: str = "English"
    target_language: str = "Polish"
    domain: str = "Food-contact packaging, printing materials, chemical migration tests"
    mode: str = "standard"
    translator_provider: str = "mock"
    translator_model: str = "mock"
    glossary_sha256: str = "missing"
    prompt_sha256: str = "missing"
    require_human_review: bool = True
    max_revision_attempts: int = 1
    translation_concurrency: int = 4
    review_concurrency: int = 4
    use_user_phrase_memory: bool = False

    def __post_init__(self) -> None:
        for name in ("translation_concurrency", "review_concurrency"):
            if not 1 <= getattr(self, name) <= 16:
                raise ValueError(f"{name} must be between 1 and 16")
        if self.mode not in ("standard", "high_assurance", "strict_regulatory"):
            raise ValueError(f"unknown mode {self.mode!r}")
