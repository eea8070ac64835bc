"""Logs of a run on the driver: one file a day, cut at a size, kept for a number of files."""

from __future__ import annotations

import logging
from datetime import date
from logging.handlers import RotatingFileHandler
from pathlib import Path

SIZE, KEPT = 20 << 20, 30


class _Task(logging.Filter):
    def __init__(self, task: str):
        super().__init__()
        self.task = task

    def filter(self, record: logging.LogRecord) -> bool:
        record.task = getattr(record, "task", self.task)
        return True


def start(folder: str, task: str = "-", level: int = logging.INFO) -> logging.Logger:
    """The library's logger with a rolling file below ``folder``; lines name the task they belong to."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    handler = RotatingFileHandler(Path(folder) / f"{date.today().isoformat()}.log", maxBytes=SIZE, backupCount=KEPT, encoding="utf-8")
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s [%(task)s] %(message)s"))
    handler.addFilter(_Task(task))
    logger = logging.getLogger("tessella")
    for old in [h for h in logger.handlers if isinstance(h, RotatingFileHandler)]:
        logger.removeHandler(old)
        old.close()
    logger.addHandler(handler)
    logger.setLevel(level)
    return logger
