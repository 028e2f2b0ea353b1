"""Values of settings: memory sizes, version compatibility, and options of the stages with their defaults."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from ..operators import correct
from ..operators.reads import ORIENTATIONS

_UNITS = {"": 1, "B": 1, "KB": 10**3, "MB": 10**6, "GB": 10**9, "TB": 10**12, "KIB": 2**10, "MIB": 2**20, "GIB": 2**30, "TIB": 2**40}


def memory_size(text: str) -> int:
    """Bytes of '2048', '256MiB', '1.5 GiB' or '4GB'; sizes are positive."""
    m = re.fullmatch(r"\s*([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]*)\s*", text)
    if not m or m[2].upper() not in _UNITS:
        raise ValueError(f"not a size: {text!r}")
    size = float(m[1]) * _UNITS[m[2].upper()]
    if not math.isfinite(size) or size < 1:
        raise ValueError(f"not a positive size: {text!r}")
    return int(size)


def compatible(one: str, two: str) -> bool:
    """Whether artefacts of two versions fit: equal major and minor numbers."""
    parts = [re.fullmatch(r"(\d+)\.(\d+)(?:\.\d+.*)?", v.strip()) for v in (one, two)]
    if not all(parts):
        raise ValueError(f"not a version: {one!r} or {two!r}")
    return parts[0].groups() == parts[1].groups()


@dataclass(frozen=True)
class PermitOptions:
    """Options of choosing and correcting barcodes; exactly one way of choosing is given."""

    orientation: str = "fw"
    knee: bool = False
    expect_cells: int | None = None
    force_cells: int | None = None
    valid_barcodes: str | None = None
    unfiltered_list: str | None = None
    min_reads: int = 10
    policy: str = "unique"
    neighbourhood: str | None = None
    confidence: str = "0.975"
    sample_mode: str = "exact"

    def __post_init__(self) -> None:
        ways = [self.knee, self.expect_cells is not None, self.force_cells is not None, self.valid_barcodes is not None, self.unfiltered_list is not None]
        if sum(ways) != 1:
            raise ValueError("exactly one way of choosing barcodes")
        if self.orientation not in ORIENTATIONS or self.min_reads < 1 or self.sample_mode not in correct.SAMPLE_MODES:
            raise ValueError("an option has no such value")

    def spec(self, length: int, multi: bool = False) -> correct.Spec:
        """The correction that these options ask for; the neighbourhood follows the way of choosing unless it is given."""
        usual = correct.DEFAULTS["multi" if multi else "unfiltered" if self.unfiltered_list else "filtered"]
        return correct.Spec(length, self.neighbourhood or usual, self.policy, correct.confidence(self.confidence))
