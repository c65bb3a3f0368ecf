"""Settings from the environment; secrets stay out of Spark's configuration."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


@dataclass
class Settings:
    """``root``: the warehouse directory; ``style``: name of the figure style; ``keys``: secrets by name."""

    root: str | None = None
    style: str = "default"
    keys: dict[str, str] = field(default_factory=dict, repr=False)

    @classmethod
    def from_environment(cls, prefix: str = "PELORUS_") -> Settings:
        env = {k[len(prefix) :].lower(): v for k, v in os.environ.items() if k.startswith(prefix)}
        keys = {k.removesuffix("_key"): v for k, v in env.items() if k.endswith("_key")}
        return cls(env.get("root"), env.get("style", "default"), keys)

    def require_root(self) -> str:
        if not self.root:
            raise RuntimeError("the warehouse root is not set")
        return self.root.rstrip("/")


current = Settings.from_environment()
