"""Options of the entry points, checked where they are made."""

from __future__ import annotations

from dataclasses import dataclass, field

from quillspark.operators.candidates import PROVIDERS, TEMPERATURES

STAGES = ("all", "generate", "score", "build")


def _check(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class PairOptions:
    """Building preference data; defaults are fixed values."""

    input: str = ""
    output_dir: str = "out"
    candidates_path: str | None = None
    scored_path: str | None = None
    stage: str = "all"
    limit: int = 200
    seed: int = 20260807
    temperatures: tuple[float, ...] = field(default=TEMPERATURES)
    top_p: float = 0.9
    repetition_penalty: float = 1.08
    min_answer_chars: int = 80
    max_answer_chars: int = 700
    min_margin: float = 0.5
    max_margin: float = 8.0
    sample_chosen_fallback: bool = True
    overwrite_selection: bool = False
    judge_model: str = "stand-in"
    sft_model: str = "stand-in"
    max_new_tokens: int = 384
    generate_batch_size: int = 4
    judge_batch_size: int = 8
    judge_max_length: int = 2048

    def __post_init__(self) -> None:
        _check(self.stage in STAGES, f"stage must be one of {', '.join(STAGES)}")
        _check(self.limit >= 0, "limit must not be negative")
        _check(0 < self.top_p <= 1, "top_p must be in (0, 1]")
        _check(0 < self.min_answer_chars <= self.max_answer_chars, "answer lengths must be a rising range above 0")
        _check(0 <= self.min_margin <= self.max_margin, "margins must be a rising range from 0")
        _check(bool(self.temperatures) and min(self.temperatures) > 0, "temperatures must be positive and at least one")
        _check(min(self.generate_batch_size, self.judge_batch_size) > 0, "batch sizes must be positive")
        _check(min(self.max_new_tokens, self.judge_max_length) > 0, "token limits must be positive")
        _check(bool(self.output_dir), "output_dir must not be empty")


@dataclass(frozen=True)
class FillOptions:
    """Filling missing answers."""

    input: str = ""
    out: str = "answers.csv"
    provider: str = "deepseek"
    limit: int = 0

    def __post_init__(self) -> None:
        _check(self.provider in PROVIDERS, f"provider must be one of {', '.join(PROVIDERS)}")
        _check(self.limit >= 0, "limit must not be negative")
        _check(bool(self.out), "out must not be empty")


@dataclass(frozen=True)
class CompareOptions:
    """Comparing two models' answers."""

    eval_file: str = ""
    output_dir: str = "out"
    limit: int = 0
    seed: int = 20260803
    rm_model: str | None = None
    rm_input_format: str | None = None
    max_new_tokens: int = 384
    overwrite: bool = False

    def __post_init__(self) -> None:
        _check(self.limit >= 0, "limit must not be negative")
        _check(self.max_new_tokens > 0, "max_new_tokens must be positive")
        _check(self.rm_input_format in (None, "question_answer", "chat", "paragraphs"), "unknown rm_input_format")
        _check(self.rm_model is None or self.rm_input_format is not None, "rm_model needs the rm_input_format it was trained with")
        _check(bool(self.output_dir), "output_dir must not be empty")
