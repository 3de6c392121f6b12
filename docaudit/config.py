"""Thresholds and weights of an audit; a job passes its own Settings to change them."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date


@dataclass(frozen=True)
class Settings:
    # Gates.
    ocr_confidence: int = 40
    ocr_min_alnum: int = 25
    ocr_blur: float = 40.0
    type_fit: int = 35
    mismatch_margin: int = 15
    min_signals: int = 2
    decisive_score: int = 50
    extraction: int = 45
    risk: int = 70
    good_read: int = 140
    excellent_read: int = 200
    fast_read: int = 80
    # What the context of a document adds to a type's score.
    high_ocr: int = 70
    low_ocr: int = 45
    context: dict = field(default_factory=lambda: {"highOcrConfidence": 5, "lowOcrConfidence": -8, "photoLayout": 3, "qrLayout": 2, "logoDetected": 8, "cardAspect": 2})
    # Share of each category in the risk score.
    categories: dict = field(default_factory=lambda: {"ocrQuality": 0.08, "layoutMatch": 0.25, "logoDetection": 0.20, "validation": 0.18, "tampering": 0.19, "resolution": 0.10})
    max_upload_bytes: int = 10 * 1024 * 1024
    #: Years and ages are judged as of this day, so that results do not depend on the clock.
    as_of: date = date(2025, 1, 1)


DEFAULT = Settings()
