"""Settings with placeholders: ``${NAME}`` and ``${NAME:default}`` in texts, at any depth, are taken from the environment."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from typing import Any

_PLACEHOLDER = re.compile(r"\$\{([^:{}]+)(?::([^{}]+))?\}")


def filled(settings: Any, environment: Mapping[str, str] | None = None) -> Any:
    """The settings with their placeholders filled in; without value and default a placeholder is empty. Other types stay as they are."""
    known = os.environ if environment is None else environment
    match settings:
        case str():
            return _PLACEHOLDER.sub(lambda m: known.get(m[1], m[2] or ""), settings)
        case dict():
            return {name: filled(value, known) for name, value in settings.items()}
        case list():
            return [filled(value, known) for value in settings]
        case _:
            return settings


def read_settings(path: str, environment: Mapping[str, str] | None = None) -> Any:
    """A JSON file of settings, filled in."""
    with open(path, encoding="utf-8") as file:
        return filled(json.load(file), environment)
