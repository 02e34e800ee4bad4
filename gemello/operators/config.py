"""Thresholds of the two rule profiles, validated when they are made."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    """Profile G accepts a video by mean or by count; profile R by mean only."""

    hamming: int = 31
    aspect: float = 0.10
    quality: int = 50
    window_ms: int = 2000
    part_bits: int = 10
    parts: int = 8
    sobel: float = 0.85
    video_mean: float = 0.80
    video_frames: int = 4
    count_rule: bool = True

    def __post_init__(self) -> None:
        if not 0 <= self.hamming <= 256 or not 0 <= self.quality <= 100:
            raise ValueError("hamming is within 0..256 and quality within 0..100")
        if not 0 <= self.aspect <= 1 or not 0 <= self.sobel <= 1 or not 0 <= self.video_mean <= 1:
            raise ValueError("aspect, sobel and video_mean are within 0..1")
        if self.window_ms < 0 or not 0 <= self.part_bits <= 64 or not 1 <= self.parts <= 9 or not 1 <= self.video_frames <= 6:
            raise ValueError("window_ms, part_bits, parts or video_frames is out of range")


G = Thresholds()
R = Thresholds(count_rule=False)
