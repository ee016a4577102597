"""Run settings, passed explicitly (never read as a global inside executors)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

# Defaults that results depend on.
DEFAULT_CHUNK_SIZE_TOKENS = 512
DEFAULT_CHUNK_OVERLAP_PCT = 0.15
DEFAULT_MIN_CONTENT_CHARS = 100
DEFAULT_TARGET_LANGUAGE = "en"
DEFAULT_LANGUAGE_CONFIDENCE = 0.9
DEFAULT_LANGUAGE_SAMPLE_CHARS = 2000
DEFAULT_EMBED_BATCH_SIZE = 256


@dataclass(frozen=True)
class IngestConfig:
    chunker_strategy: str = "fixed"          # "fixed"; anything else means sentence packing
    chunk_size_tokens: int = DEFAULT_CHUNK_SIZE_TOKENS
    chunk_overlap_pct: float = DEFAULT_CHUNK_OVERLAP_PCT
    tokenizer: str = "regex"                 # "regex" (native) or "bpe" (fixed windows only)
    chunker: Callable | None = None          # DataFrame -> DataFrame with the chunk columns; replaces the strategy
    cleaning_steps: tuple[Callable, ...] | None = None    # Column -> Column, in order; None = defaults
    min_content_chars: int = DEFAULT_MIN_CONTENT_CHARS
    target_language: str | None = DEFAULT_TARGET_LANGUAGE
    language_confidence_threshold: float = DEFAULT_LANGUAGE_CONFIDENCE
    language_sample_chars: int | None = DEFAULT_LANGUAGE_SAMPLE_CHARS   # None = the whole text
    boilerplate_patterns: tuple[str, ...] | None = None   # None = defaults, () = strip nothing
    embed_batch_size: int = DEFAULT_EMBED_BATCH_SIZE
    embed_max_concurrency: int | None = None # tasks that call the model at once; None = every task slot
    embed_retry: object | None = "default"   # a RetryPolicy, None = no retry
    vector_size: int = 64
    upsert_key: tuple[str, ...] = ("tenant_id", "point_id")
    extra: dict[str, str] = field(default_factory=dict)   # metadata merged into every document (these win)

    @property
    def chunk_overlap_tokens(self) -> int:
        # Same truncation as the reference: int(size * pct).
        return int(self.chunk_size_tokens * self.chunk_overlap_pct)
