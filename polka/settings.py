"""Settings of an application: named values from the environment, else from a mapping of secrets, else defaults."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any


def _blank(value: Any) -> bool:
    return value is None or not str(value).strip()


@dataclass(frozen=True)
class Number:
    """A number within bounds; a blank value means the default, anything else that does not fit is an error."""

    default: float
    low: float
    high: float
    kind: type = float

    def read(self, name: str, value: Any) -> float:
        if _blank(value):
            return self.default
        try:
            x = self.kind(value)
        except (TypeError, ValueError):
            raise ValueError(f"{name}: {value!r} is no number") from None
        if not self.low <= x <= self.high:  # NaN lies in no interval
            raise ValueError(f"{name}: {x} is not within {self.low} and {self.high}")
        return x


# Names, defaults and bounds of the settings, and the shape of a model's name.
NUMBERS = {
    "MATCH_THRESHOLD": Number(72.0, 50.0, 100.0), "VISION_WORKERS": Number(2, 1, 4, int), "MIN_RECOGNITION_CONFIDENCE": Number(0.55, 0.0, 1.0),
}
MODEL_NAME = r"gemini-[a-z0-9.-]{1,80}"


@dataclass(frozen=True)
class Settings:
    model: str
    match_threshold: float
    vision_workers: int
    min_recognition_confidence: float
    key: str = field(default="", repr=False)  # never shown


def load_settings(default_model: str, secrets: Mapping[str, Any] | None = None, environ: Mapping[str, str] | None = None) -> Settings:
    """The environment goes before the secrets, even where its value is blank; raises ``ValueError`` for what does not fit."""
    env = os.environ if environ is None else environ
    given = lambda name: env[name] if name in env else (secrets or {}).get(name)
    model = default_model if given("GEMINI_MODEL") is None else str(given("GEMINI_MODEL")).strip()
    if not re.fullmatch(MODEL_NAME, model):
        raise ValueError(f"GEMINI_MODEL: {model!r} is no model name")
    numbers = {name.lower(): shape.read(name, given(name)) for name, shape in NUMBERS.items()}
    return Settings(model=model, key=str(given("GEMINI_API_KEY") or "").strip(), **numbers)
