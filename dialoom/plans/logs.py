"""Driver logs. What failed and succeeded by block is data, and written as tables by the run."""

from __future__ import annotations

import logging
import os

NAME = "dialoom"
# Fixed value: the layout of a line.
FORMAT = "%(asctime)s - %(name)s - %(levelname)s - %(message)s"


def logger(name: str = NAME, *, level: str = "INFO", path: str | None = None) -> logging.Logger:
    """A logger that doesn't propagate, on the console and, if `path` is given, in a file begun anew.

    Called again, it replaces its handlers.
    """
    out = logging.getLogger(name)
    out.setLevel(level)
    out.propagate = False
    for old in list(out.handlers):
        out.removeHandler(old)
        old.close()
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if path:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        handlers.append(logging.FileHandler(path, mode="w", encoding="utf-8"))
    for handler in handlers:
        handler.setFormatter(logging.Formatter(FORMAT))
        out.addHandler(handler)
    return out
