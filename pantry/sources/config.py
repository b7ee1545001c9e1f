"""Settings, from the environment or from values given."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pantry.plans.errors import CatalogError

_NAMES = {"product": "PANTRY_RATE_LIMIT_PRODUCT", "search": "PANTRY_RATE_LIMIT_SEARCH", "vocabulary": "PANTRY_RATE_LIMIT_VOCABULARY"}


@dataclass(frozen=True)
class Settings:
    """Requests a minute of each class, where the catalog and the full vocabularies lie, and how long a request may take."""

    product: int = 15
    search: int = 10
    vocabulary: int = 10
    catalog: str | None = None
    vocabularies: str | None = None
    deadline_s: float = 15.0

    def __post_init__(self) -> None:
        for name in _NAMES:
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int) or value < 1:
                raise CatalogError("invalid_input", f"the {name} rate must be a whole number of at least 1", field=name, value=value)

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> "Settings":
        env = dict(os.environ) if env is None else env
        out: dict[str, object] = {"catalog": env.get("PANTRY_CATALOG") or None, "vocabularies": env.get("PANTRY_VOCABULARIES") or None}
        for field, name in _NAMES.items():
            if env.get(name, "").strip():
                try:
                    out[field] = int(env[name])
                except ValueError:
                    raise CatalogError("invalid_input", f"{name} must be a whole number", field=name, value=env[name]) from None
        return cls(**out)  # type: ignore[arg-type]


_settings: Settings | None = None


def settings() -> Settings:
    """Read once, on first use."""
    global _settings
    _settings = _settings or Settings.from_env()
    return _settings
