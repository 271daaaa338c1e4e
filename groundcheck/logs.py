"""Logging: text or JSON lines, with banners for stages."""

from __future__ import annotations

import json
import logging
import sys

NOISY = ("py4j", "urllib3", "httpx", "matplotlib")


class JsonLines(logging.Formatter):
    def format(self, record):
        row = {"message": record.getMessage(), "logger": record.name, "level": record.levelname, "time": self.formatTime(record)}
        if record.exc_info:
            row |= {"exception": self.formatException(record.exc_info)}
        return json.dumps(row, ensure_ascii=False)


def setup(level: str = "INFO", form: str = "text") -> logging.Logger:
    handler = logging.StreamHandler(sys.stderr)
    handler.setFormatter(JsonLines() if form == "json" else logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
    root = logging.getLogger("groundcheck")
    root.handlers[:] = [handler]
    root.setLevel(level.upper())
    root.propagate = False
    for name in NOISY:
        logging.getLogger(name).setLevel(logging.WARNING)
    return root


def banner(stage: str, number: int, total: int) -> str:
    return f"[{number}/{total}] {stage}"
