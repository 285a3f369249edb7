"""Requests: validation, aliases and clamps in one place."""

from __future__ import annotations

from dataclasses import dataclass, field

from quarry.functions.globs import normalise

MODES = ("semantic", "bm25", "hybrid", "keyword")
#: Extensions in order of preference, and names that older callers use for targets.
EXTENSIONS = (".py", ".java", ".ts", ".tsx", ".js", ".jsx")
TARGETS = {"functions": "functions", "function": "functions", "symbols": "functions", "diff_hunks": "diff_hunks", "diff": "diff_hunks", "commits": "diff_hunks", "changed_functions": "changed_functions"}


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(high, int(value)))


def extension(wanted: str | None, counts: dict[str, int]) -> str:
    """The wanted extension if supported, else the most common one, ties by preference."""
    if wanted and wanted != "auto":
        ext = wanted if wanted.startswith(".") else f".{wanted}"
        if ext not in EXTENSIONS:
            raise ValueError(f"unsupported extension {wanted!r}")
        return ext
    return max(EXTENSIONS, key=lambda e: (counts.get(e, 0), -EXTENSIONS.index(e)))


@dataclass(frozen=True)
class Search:
    query: str
    mode: str = "hybrid"
    target: str = "functions"
    top_k: int = 5
    semantic_weight: float = 0.75
    include_files: tuple[str, ...] | None = None
    include_globs: list[str] = field(default_factory=list)
    exclude_globs: list[str] = field(default_factory=list)

    def __post_init__(self):
        fix = lambda k, v: object.__setattr__(self, k, v)
        fix("mode", self.mode if self.mode in MODES else "hybrid")
        fix("target", TARGETS.get(self.target, "functions"))
        fix("top_k", clamp(self.top_k, 1, 50))
        fix("semantic_weight", max(0.0, min(1.0, float(self.semantic_weight))))
        fix("include_globs", normalise(self.include_globs))
        fix("exclude_globs", normalise(self.exclude_globs))

    @property
    def needs_vectors(self) -> bool:
        return self.mode in ("semantic", "hybrid")

    @property
    def commit_weight(self) -> float:
        """Commits blend at 0.6 unless the caller chose a weight of their own."""
        return 0.6 if self.semantic_weight == 0.75 else self.semantic_weight
