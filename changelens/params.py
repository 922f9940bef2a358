"""Parameters of the analysis, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, field

from changelens.functions import fixed


@dataclass(frozen=True)
class RiskParams:
    """Weights of the four risk factors and the score bands."""

    weights: dict[str, float] = field(default_factory=lambda: dict(fixed.RISK_WEIGHTS))
    high: float = fixed.RISK_THRESHOLDS["high"]
    medium: float = fixed.RISK_THRESHOLDS["medium"]

    def __post_init__(self) -> None:
        if set(self.weights) != set(fixed.RISK_WEIGHTS):
            raise ValueError(f"weights must name exactly {sorted(fixed.RISK_WEIGHTS)}")
        total = sum(self.weights.values())
        if abs(total - 1.0) > 0.001:
            raise ValueError(f"weights must sum to 1 (they sum to {total})")
        if self.medium >= self.high:
            raise ValueError("the medium threshold must be below the high threshold")


@dataclass(frozen=True)
class SecretPattern:
    """One secret pattern; users may add their own as data.

    ``any_literal`` lists lower-case literals of which every match contains at
    least one (ignoring case); it only speeds the scan up and may stay empty.
    """

    type: str
    regex: str
    severity: str
    confidence: float
    description: str = ""
    recommendation: str = ""
    exclude_files: tuple[str, ...] = ()
    include_files: tuple[str, ...] = ()
    any_literal: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.severity not in fixed.SEVERITY_PRIORITY:
            raise ValueError(f"unknown severity {self.severity}")


@dataclass(frozen=True)
class ScanOptions:
    """What to look for and how much of it to return."""

    min_severity: str | None = None
    max_findings: int = 0
    include_context: bool = False
    context_lines: int = 2
    custom_patterns: tuple[SecretPattern, ...] = ()
    exclude_types: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.min_severity is not None and self.min_severity not in fixed.SEVERITY_PRIORITY:
            raise ValueError(f"unknown severity {self.min_severity}")

    @property
    def context_size(self) -> int:
        return self.context_lines or 2


@dataclass(frozen=True)
class FileChoice:
    """Which files of a diff are looked at: staged changes only, include globs,
    exclude globs, and the first lines of files with more changed lines (0: all)."""

    staged_only: bool = False
    include_patterns: tuple[str, ...] = ()
    exclude_patterns: tuple[str, ...] = ()
    max_lines_per_file: int = 0
