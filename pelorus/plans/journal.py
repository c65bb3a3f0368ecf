"""One log file per object: begin and end markers and summaries, kept apart under concurrency."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

logger = logging.getLogger("pelorus")
_current: ContextVar[str | None] = ContextVar("pelorus_object", default=None)


def format_summary(phase: str, fields: dict[str, object]) -> str:
    """``<phase>_summary | k=v ...`` with ``path`` last."""
    ordered = [(k, v) for k, v in fields.items() if k != "path"] + [(k, v) for k, v in fields.items() if k == "path"]
    return f"{phase}_summary | " + " ".join(f"{k}={v}" for k, v in ordered)


@contextmanager
def object_log(stem: str, path: str | None, phase: str) -> Iterator[None]:
    """Append this context's messages to ``path``; messages of other contexts go elsewhere."""
    token, handler = _current.set(stem), None
    if path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        handler = logging.FileHandler(path, encoding="utf-8")
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        handler.addFilter(lambda _: _current.get() == stem)
        logger.addHandler(handler)
        logger.setLevel(min(logger.level or logging.INFO, logging.INFO))
    try:
        logger.info("begin %s %s", phase, stem)
        yield
        logger.info("end %s %s", phase, stem)
    finally:
        if handler:
            logger.removeHandler(handler)
            handler.close()
        _current.reset(token)
