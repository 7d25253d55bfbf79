"""Settings from a mapping, a JSON or YAML file and the environment. Unknown keys are refused; secrets never show."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import get_type_hints

from lumenlit.errors import ConfigError


class Secret(str):
    """A text that does not print."""

    def __repr__(self) -> str:
        return "Secret(***)"

    def __str__(self) -> str:
        return "***"

    def reveal(self) -> str:
        return "".join(self)


@dataclass(frozen=True)
class Listing:
    page_size: int = 100
    newest_first: bool = False
    total_limit: int | None = None
    max_attempts: int | None = 3


@dataclass(frozen=True)
class Chunking:
    words: int = 350
    overlap: int = 50

    def __post_init__(self):
        if self.words < 1 or not 0 <= self.overlap < self.words:
            raise ConfigError("chunking: the overlap must be smaller than the window")


@dataclass(frozen=True)
class Search:
    facet_keys: tuple[str, ...] = ()
    title_weight: float = 10.0
    abstract_weight: float = 4.0
    body_weight: float = 1.0


@dataclass(frozen=True)
class Model:
    name: str = ""
    base_url: str = ""
    api_key: Secret = field(default=Secret(""))
    temperature: float = 0.0


@dataclass(frozen=True)
class Settings:
    """Everything a run can be told."""

    path: str = ""
    listing: Listing = Listing()
    chunking: Chunking = Chunking()
    search: Search = Search()
    model: Model = Model()


def _build(kind: type, values: object, where: str) -> object:
    if not isinstance(values, dict):
        raise ConfigError(f"{where or 'the settings'} must be a mapping")
    known, hints = {f.name for f in fields(kind)}, get_type_hints(kind)
    unknown = sorted(set(values) - known)
    if unknown:
        raise ConfigError(f"unknown settings in {where or 'the file'}: {', '.join(map(str, unknown))}")
    out = {}
    for name, value in values.items():
        hint, at = hints[name], f"{where}.{name}".strip(".")
        if is_dataclass(hint):
            out[name] = _build(hint, value, at)
        elif hint is Secret:
            out[name] = Secret(value)
        elif hint is float and isinstance(value, int) and not isinstance(value, bool):
            out[name] = float(value)
        elif str(hint).startswith("tuple"):
            if not isinstance(value, (list, tuple)) or not all(isinstance(x, str) for x in value):
                raise ConfigError(f"{at} must be a list of texts")
            out[name] = tuple(value)
        else:
            # The value is left out of the message, as it may be a misplaced secret.
            allowed = getattr(hint, "__args__", (hint,))
            if not isinstance(value, allowed) or (isinstance(value, bool) and bool not in allowed):
                raise ConfigError(f"{at} must be {' or '.join(a.__name__ for a in allowed)}")
            out[name] = value
    return kind(**out)


def load_settings(source: dict | str | Path, environ: dict | None = None, prefix: str = "LUMENLIT_") -> Settings:
    """Settings of a mapping or file; ``LUMENLIT_MODEL__API_KEY`` and the like override it, with a double underscore between levels."""
    if isinstance(source, dict):
        values = json.loads(json.dumps(source))
    else:
        text = Path(source).read_text(encoding="utf-8")
        if str(source).endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError as e:
                raise ConfigError("YAML needs the optional package PyYAML") from e
            values = yaml.safe_load(text) or {}
        else:
            values = json.loads(text)
    for name, value in (os.environ if environ is None else environ).items():
        if not name.startswith(prefix) or "__" not in name:
            continue
        *above, last = name[len(prefix) :].lower().split("__")
        at = values
        for part in above:
            at = at.setdefault(part, {})
        try:
            at[last] = json.loads(value) if last != "api_key" else value
        except ValueError:
            at[last] = value
    return _build(Settings, values, "")
