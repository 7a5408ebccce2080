"""Parameters of the operators, with their defaults and accepted bounds.

Every operator takes one of these frozen records (or keyword arguments with the same
defaults); a value out of bounds is refused when the record is built, before any job runs.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Changing the planning logic in a way that must invalidate derived outputs bumps this.
LOGIC_VERSION = 1

# --- fixed values -----------------------------------------------------------------------
MAX_CLIPS_PER_SCENE = 4
MAX_GROUP = 4
END_TOUCH_S = 0.15
END_TOUCH_PENALTY = 0.15
MIN_SPEECH_S = 0.25
RUN_TOLERANCE = 0.08
EDGE_GAP_S = 0.5
UTTERANCE_GAP_S = 0.8
TEMPO_RANGE = (0.7, 1.45)
SPEECH_RANGE = (0.6, 1.6)
PAUSE_RANGE = (0.3, 3.0)
SEARCH_BONUS = (0.3, 0.8, 1.5)
SEARCH_RATIO = ((0.55, 1.8), (0.45, 2.2))
SHORT_PENALTY = 3.0
RATE_RANGE = (0.7, 1.5)
TRIM_RANGE = (0.92, 1.2)
LIP_LEAD_S = 0.05
MOUTH_WINDOW_S = 0.6
MOUTH_MAX_SHIFT_S = 0.1
HEARD_WEIGHT = 0.12
MAX_PAUSE_S = 0.7
KEEP_PAUSE_S = 0.45
PACE_SPREAD = 0.12
MAX_CUE_CHARS = 84
MAX_REQUEST_CHARS = 2000
STATUSES = ("pending", "audio_generating", "audio_complete", "video_generating",
            "video_complete", "syncing", "complete", "failed")
VIDEO_EXTENSIONS = (".mp4", ".mov", ".webm", ".mkv")


class ParameterError(ValueError):
    """A parameter is outside its accepted bounds."""


def _check(name: str, value: float, low: float | None = None, high: float | None = None,
           above: float | None = None, below: float | None = None) -> None:
    if low is not None and value < low:
        raise ParameterError(f"{name}={value} must be >= {low}")
    if high is not None and value > high:
        raise ParameterError(f"{name}={value} must be <= {high}")
    if above is not None and value <= above:
        raise ParameterError(f"{name}={value} must be > {above}")
    if below is not None and value >= below:
        raise ParameterError(f"{name}={value} must be < {below}")


@dataclass(frozen=True)
class Planning:
    words_per_second: float = 2.5
    target_s: float = 7.0
    max_s: float = 8.5
    min_s: float = 2.5
    scene_cost: float = 2.0
    paragraph_penalty: float = 120.0

    def __post_init__(self):
        _check("words_per_second", self.words_per_second, above=0.5, below=6)
        _check("scene_cost", self.scene_cost, low=0)
        _check("paragraph_penalty", self.paragraph_penalty, low=0)
        _check("min_s", self.min_s, low=0)
        if not self.min_s <= self.target_s <= self.max_s:
            raise ParameterError("scene lengths must satisfy min <= target <= max")


@dataclass(frozen=True)
class Sync:
    max_speedup: float = 1.15
    max_slowdown: float = 0.9
    mode: str = "video_master"
    fit_lead: float = 0.25
    fit_tail: float = 0.3
    lip_align: bool = True

    def __post_init__(self):
        _check("max_speedup", self.max_speedup, low=1.0, high=1.5)
        _check("max_slowdown", self.max_slowdown, above=0.5, high=1.0)
        _check("fit_lead", self.fit_lead, low=0, high=2)
        _check("fit_tail", self.fit_tail, low=0, high=2)
        if self.mode not in ("video_master", "audio_master", "lip_voice"):
            raise ParameterError(f"unknown sync mode {self.mode!r}")


@dataclass(frozen=True)
class Audio:
    sample_rate: int = 48000
    tail_padding: float = 0.2
    trim_silence: bool = True
    silence_threshold_db: float = -45
    keep_leading: float = 0.03
    keep_trailing: float = 0.12
    sentence_gap: float = 0.2

    def __post_init__(self):
        _check("sample_rate", self.sample_rate, low=8000, high=96000)
        _check("tail_padding", self.tail_padding, low=0, high=2)
        _check("silence_threshold_db", self.silence_threshold_db, low=-80, high=-20)
        _check("keep_leading", self.keep_leading, low=0, high=1)
        _check("keep_trailing", self.keep_trailing, low=0, high=1)
        _check("sentence_gap", self.sentence_gap, low=0, high=2)


@dataclass(frozen=True)
class Video:
    width: int = 1280
    height: int = 720
    fps: int = 24

    def __post_init__(self):
        _check("width", self.width, low=64)
        _check("height", self.height, low=64)
        _check("fps", self.fps, low=1, high=120)


@dataclass(frozen=True)
class Clips:
    """Clip lengths a footage source can deliver."""

    allowed: tuple[float, ...] = (4.0, 6.0, 8.0)
    max_clip_s: float = 8.0
    preferred_s: float = 8.0

    def __post_init__(self):
        object.__setattr__(self, "allowed", tuple(sorted({float(a) for a in self.allowed})))
        _check("max_clip_s", self.max_clip_s, above=0)
        _check("preferred_s", self.preferred_s, above=0, high=self.max_clip_s)
        if not self.allowed:
            raise ParameterError("allowed must not be empty")
        _check("allowed", self.allowed[-1], high=self.max_clip_s)


@dataclass(frozen=True)
class LongClips:
    """Two-length rule: one short clip, or as many long clips as the narration needs."""

    clip_s: int = 8
    long_clip_s: int = 10
    long_after_s: float = 7.0

    def __post_init__(self):
        _check("clip_s", self.clip_s, low=4, high=10)
        _check("long_clip_s", self.long_clip_s, low=4, high=10)
        _check("long_after_s", self.long_after_s, above=0)


@dataclass(frozen=True)
class Retry:
    max_attempts: int = 3
    backoff_s: tuple[float, ...] = (5.0, 15.0, 45.0)
    rate_limit_floor_s: float = 60.0

    def __post_init__(self):
        _check("max_attempts", self.max_attempts, low=1, high=10)


@dataclass(frozen=True)
class Quality:
    duration_tolerance: float = 0.1
    max_frozen_padding: float = 0.3

    def __post_init__(self):
        _check("duration_tolerance", self.duration_tolerance, low=0)
        _check("max_frozen_padding", self.max_frozen_padding, low=0)
