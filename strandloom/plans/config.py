"""Settings of a mapping run."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class AlignConfig:
    """Names and defaults of the mapping options; errors 0 means: from the read lengths.

    min_clipped_factor: share of a read that a single read's clipped shape must keep (1: none is clipped). clip_quality:
    ends of a lower quality are clipped (0: none are). short_reads: whether reads of less than nine tenths of the longest
    take part in pairs, with errors in proportion to their length.
    """

    errors: int = 0
    mode: str = "first"  # first, second or all strata
    orientation: str = "fr"
    errors_paired: float = 0.09
    max_mate_distance: int = 1000
    sensitive: bool = True
    sensitivity_factor: float = 2.5
    mask_low_quality: int = 0
    min_clipped_factor: float = 1.0
    clipping_sigmas: float = 14
    saturation_sigmas: float = 7
    confidence_sigmas: float = 4
    merge_distance: int = 12
    merge_from_first: bool = True
    score_match: float = 1.0
    score_mismatch: float = -5.0
    score_clipping: float = -6.0
    score_tie: float = 0.5
    max_indel: int = 50
    gap_open: float = -5.0
    gap_extend: float = -0.4
    mapq_mult: float = 90.0
    mapq_div: float = 0.5
    max_mappings: int = 1024
    max_pairs: int = 128
    contig_filter: str = ""
    read_group: str = ""
    seed: int = 18
    short_reads: bool = False
    boundary_clipping: bool = True
    paired_clipping: bool = True
    clip_quality: int = 0
    short_indel_refinement: bool = True

    def __post_init__(self):
        if self.orientation not in ("fr", "ff", "rf"):
            raise ValueError(f"orientation is fr, ff or rf, not {self.orientation!r}")
        if self.mode not in ("first", "second", "all"):
            raise ValueError(f"mode is first, second or all, not {self.mode!r}")


def auto_errors(max_length: int, min_length: int) -> int:
    """The error limit that read lengths suggest, at most a twentieth of the shortest."""
    by_length = next((e for bound, e in ((100, 3), (127, 4), (153, 5), (203, 6), (253, 7)) if max_length < bound), 8)
    return min(by_length, min_length // 20)


def segments(length: int, stage: int) -> list[tuple[int, int]]:
    """The pieces of a stage: with no more than `stage` errors one of them has none."""
    cut = lambda j: (length * j + stage) // (stage + 1)
    return [(cut(j), cut(j + 1)) for j in range(stage + 1)]


def stages(errors: int) -> list[int]:
    """The stages that a run of so many errors passes: all up to 3 or so, then the last one at once."""
    if errors <= 3:
        return list(range(errors + 1))
    return [*range(max(2, errors - 3) + 1), errors]


def read_group(line: str) -> tuple[str, str]:
    r"""The line with \t made tabs, and its ID."""
    line = line.replace("\\t", "\t")
    ids = [x.split("ID:", 1)[1] for x in line.split("\t") if "ID:" in x]
    return line, ids[-1] if ids else ""
