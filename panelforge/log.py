"""The library's logger: to the console and, where a file is named, to that."""

from __future__ import annotations

import logging
import os

FORM = logging.Formatter("%(asctime)s | %(levelname)s | %(name)s | %(message)s", "%Y-%m-%d %H:%M:%S")


def logger(name: str = "panelforge", level: str = "INFO", path: str | None = None) -> logging.Logger:
    """The logger ``name``; set up on the first call only. Folders of ``path`` are made."""
    log = logging.getLogger(name)
    if log.handlers:
        return log
    log.setLevel(level.upper())
    log.propagate = False
    if path:
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    for handler in [logging.StreamHandler(), *([logging.FileHandler(path, encoding="utf-8")] if path else [])]:
        handler.setFormatter(FORM)
        log.addHandler(handler)
    return log
