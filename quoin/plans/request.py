"""A labelling run's request and its rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from quoin.operators.pixels import MIN_CONTRAST, effects_errors

# Names of engines.
ENGINES = ["paddle", "surya", "tesseract"]
VLM_ENGINES = ["paddleocr_vl", "hunyuan_ocr", "glm_ocr", "dots_ocr", "unlimited_ocr"]


class RequestError(ValueError):
    """All that is wrong with a request."""


@dataclass(frozen=True)
class RunRequest:
    input_dir: str = ""
    output_dir: str = ""
    score_threshold: float = 0.95
    preferred_model: str | None = None
    lang: str = "ru"
    latin_model_size: str = "medium"
    extract_pdf_text_layer: bool = True
    pdf_ocr_fallback: bool = True
    append_crop_size: bool = False
    normalize_labels: bool = False
    alphabet_file: str | None = None
    detector_engine: str = "paddle"
    engines: list[str] = field(default_factory=lambda: list(ENGINES))
    min_agree: int = 2
    mode: str = "consensus"
    vlm_engines: list[str] = field(default_factory=list)
    vlm_min_agree: int = 1
    iou_threshold: float = 0.5
    degrade_page_share: float = 0.0
    degrade_seed: int = 0
    degrade_min_contrast: float = MIN_CONTRAST
    degrade_effects: dict | None = None

    def __post_init__(self):
        wrong = self.problems()
        if wrong:
            raise RequestError("; ".join(wrong))

    def problems(self) -> list[str]:
        rules = [
            (0 <= self.score_threshold <= 1, "score_threshold must be from 0 to 1"),
            (self.lang in ("ru", "latin"), "lang must be ru or latin"),
            (self.latin_model_size in ("tiny", "small", "medium"), "latin_model_size must be tiny, small or medium"),
            (self.detector_engine in ENGINES, f"detector_engine must be one of {ENGINES}"),
            (self.mode in ("consensus", "vlm"), "mode must be consensus or vlm"),
            (self.min_agree >= 1 and self.vlm_min_agree >= 1, "an agreement takes one engine at least"),
            (0 < self.iou_threshold <= 1, "iou_threshold must be over 0, up to 1"),
            (0 <= self.degrade_page_share <= 1, "degrade_page_share must be from 0 to 1"),
            (self.degrade_min_contrast >= 0, "degrade_min_contrast must not be negative"),
            (self.pdf_ocr_fallback or self.extract_pdf_text_layer, "without text layer and without OCR every page would be skipped"),
        ]
        wrong = [said for ok, said in rules if not ok]
        if self.degrade_page_share > 0:
            if self.mode == "vlm" or not self.extract_pdf_text_layer:
                wrong.append("degradation needs mode consensus and the text layer")
            if self.degrade_effects is not None:
                wrong += effects_errors(self.degrade_effects)
        if self.mode == "vlm":
            return wrong + _subset("vlm_engines", self.vlm_engines, VLM_ENGINES, self.vlm_min_agree)
        wrong += _subset("engines", self.engines, ENGINES, self.min_agree)
        if self.preferred_model is not None and self.preferred_model not in self.engines:
            wrong.append("preferred_model must be one of the engines")
        return wrong


def _subset(name: str, chosen: list[str], known: list[str], agree: int) -> list[str]:
    if not chosen or set(chosen) - set(known):
        return [f"{name} must be a subset of {known}, not empty"]
    return [] if 1 <= agree <= len(chosen) else [f"agreement of {agree} among {len(chosen)} {name}"]
