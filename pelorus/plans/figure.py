"""Figures, where matplotlib can be imported."""

from __future__ import annotations

import pickle
from pathlib import Path
from typing import Any, ClassVar

from pelorus.plans import settings
from pelorus.plans.objects import DataObject, Format

#: Settings of figures by style name.
STYLES: dict[str, dict[str, Any]] = {
    "default": {},
    "paper": {"font.size": 9, "figure.figsize": (3.4, 2.4), "axes.spines.top": False, "axes.spines.right": False},
    "slides": {"font.size": 16, "figure.figsize": (10, 5.6), "lines.linewidth": 2.5},
}


def use_style(name: str | None = None) -> None:
    """Apply a style, by default that of the settings; an unknown name raises ``KeyError``."""
    chosen = STYLES[name or settings.current.style]
    import matplotlib

    matplotlib.rcParams.update(matplotlib.rcParamsDefault)
    matplotlib.rcParams.update(chosen)


class Figure(DataObject):
    """A pickled figure on a local path, drawn from small results; PNG, PDF and SVG come from :meth:`export`."""

    make_format = Format.MODEL
    formats = (Format.MODEL,)
    kinds: ClassVar[tuple[str, ...]] = ("png", "pdf", "svg")

    def draw(self) -> Any:
        raise NotImplementedError

    def _make(self) -> dict[str, object]:
        use_style()
        Path(self.path()).parent.mkdir(parents=True, exist_ok=True)
        Path(self.path()).write_bytes(pickle.dumps(self.draw()))
        return {}

    def export(self, kind: str, replace: bool = False) -> str:
        if kind not in self.kinds:
            raise TypeError(f"{kind!r} is none of {', '.join(self.kinds)}")
        target = Path(f"{self.directory}/{self.stem}.{kind}")
        if target.exists() and not replace:
            raise FileExistsError(target)
        pickle.loads(Path(self.path()).read_bytes()).savefig(target, dpi=300, bbox_inches="tight")
        return str(target)
