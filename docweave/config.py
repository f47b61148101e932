"""Options of a documentation job."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from .functions.render import DocstringStyle, GoogleStyle
from .functions.text import token_count
from .operators.throttle import RateLimit
from .schema import LANGUAGES, QUOTE_STYLES


class DocumentationError(Exception):
    """The job as a whole cannot run."""


@dataclass(frozen=True)
class DocumentationConfig:
    generate_docstring_func: Any  # called with language, definition, definition_type, temperature
    include_rules: list[str] = field(default_factory=list)
    exclude_rules: list[str] = field(default_factory=list)
    inplace: bool = False
    max_workers: int = 16  # concurrent generator calls
    quote_style: str = '"""'
    temperature: float = 0.25
    skip_init_methods: bool = True
    docstring_builder: DocstringStyle = field(default_factory=GoogleStyle)
    language: str = "python"
    recursive: bool = False  # let ** match any number of folders
    cache_path: str | None = None  # kept between runs when given
    cache_buckets: int = 64  # of a new cache: a few hundred MB of answers for each
    cache_segments: int = 8  # beyond this many, the smallest are merged
    calls_per_task: int = 10_000  # answers lost, at most, with one executor
    models: list[tuple[str, int]] | None = None  # names and token limits, to route requests by
    token_count: Any = token_count  # from a text column to its tokens, for models and rate limits
    rate_limit: RateLimit | None = None  # calls and tokens a minute of the whole job

    def __post_init__(self) -> None:
        for name in ("include_rules", "exclude_rules"):
            rules = getattr(self, name)
            if not isinstance(rules, list):
                raise TypeError(f"{name} must be a list")
            for rule in rules:
                if not isinstance(rule, str):
                    raise TypeError(f"every rule in {name} must be a string, not {rule!r}")
        if self.quote_style not in QUOTE_STYLES:
            raise ValueError(
                f"quote style {self.quote_style!r} is not one of {', '.join(QUOTE_STYLES)}"
            )
        if not isinstance(self.docstring_builder, DocstringStyle):
            raise ValueError(f"{self.docstring_builder!r} is not a DocstringStyle")
        if not callable(self.generate_docstring_func):
            raise TypeError("generate_docstring_func must be callable")
        if self.rate_limit is not None and not isinstance(self.rate_limit, RateLimit):
            raise TypeError("rate_limit must be a RateLimit")
        if self.max_workers < 1 or self.calls_per_task < 1:
            raise ValueError("max_workers and calls_per_task must be positive")
        if self.cache_buckets < 1 or self.cache_segments < 1:
            raise ValueError("cache_buckets and cache_segments must be positive")
        if self.language not in {name for name, _, _ in LANGUAGES}:
            raise ValueError(f"unknown language {self.language!r}")
