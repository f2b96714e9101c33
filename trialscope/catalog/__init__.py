"""Named queries. ``load()`` imports every family once and so fills the registry."""

from __future__ import annotations

import importlib

FAMILIES = ["logs", "interactions", "code", "findings", "sessions", "projects", "experiments", "storage", "streams"]


def load() -> None:
    for family in FAMILIES:
        importlib.import_module(f"{__name__}.{family}")
