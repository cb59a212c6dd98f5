"""Settings: environment before given values before defaults."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """Defaults of the operators' parameters."""

    chunk_tokens: int = 1500
    batch_size: int = 3
    coref_distance: int = 3
    coref_window: int = 2
    seed_count: int = 5
    expansion_cap: int = 20
    degree_cap: int = 50
    context_items: int = 15
    use_triplets: bool = False

    @classmethod
    def load(cls, given: Mapping[str, object] | None = None, env: Mapping[str, str] = os.environ, prefix: str = "LECTERN_") -> Settings:
        values = {}
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper(), (given or {}).get(f.name))
            if raw is not None:
                values[f.name] = str(raw).lower() in ("1", "true", "yes") if isinstance(f.default, bool) else type(f.default)(raw)
        return cls(**values)
