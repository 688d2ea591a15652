"""Configuration of the gate, from code or from a TOML file."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from ..functions.payloads import PAYLOADS


@dataclass(frozen=True)
class CustomIntent:
    id: str
    intent: str
    regex: str


@dataclass(frozen=True)
class GateConfig:
    """payload_a and payload_b are the payload vocabularies of the channels; a deployment may bring its own.

    ascii_words: words of the allowlist end where ASCII letters do, as in RE2; else at any letter's end, as in the reference."""

    intents: list[CustomIntent] = field(default_factory=list)
    forbidden_keywords: list[str] = field(default_factory=list)
    context_window: int = 3
    audit_detail_level: str = "Basic"
    profile: str | None = None
    payload_a: list[str] = field(default_factory=lambda: PAYLOADS)
    payload_b: list[str] = field(default_factory=lambda: PAYLOADS)
    ascii_words: bool = False


def load(path: str, lenient: bool = False) -> GateConfig:
    """A missing file gives the defaults; a malformed one raises, or gives the defaults where `lenient`."""
    if not Path(path).exists():
        return GateConfig()
    try:
        raw = tomllib.loads(Path(path).read_text(encoding="utf-8"))
        intents = [CustomIntent(x["id"], x["intent"], x["regex"]) for x in raw.get("intents", [])]
        return GateConfig(intents, list(raw.get("forbidden_keywords", [])), int(raw.get("context_window", 3)), raw.get("audit_detail_level", "Basic"))
    except (tomllib.TOMLDecodeError, KeyError, TypeError, ValueError):
        if lenient:
            return GateConfig()
        raise
