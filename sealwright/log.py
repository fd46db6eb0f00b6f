"""Logging of the driver side: plain lines or JSON, configured once."""

from __future__ import annotations

import json
import logging
import sys
import time

ROOT = "sealwright"
_FIELDS = frozenset(vars(logging.makeLogRecord({})))


class _Lines(logging.Formatter):
    """One line a record, with what the caller gave as `extra`; no times in replay mode, so that runs compare."""

    def __init__(self, as_json: bool, replay: bool):
        super().__init__()
        self.as_json, self.replay = as_json, replay

    def format(self, record: logging.LogRecord) -> str:
        facts = {"level": record.levelname.lower(), "logger": record.name, "event": record.getMessage()}
        if not self.replay:
            facts = {"time": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(record.created))} | facts
        facts |= {k: v for k, v in vars(record).items() if k not in _FIELDS and k not in ("message", "asctime")}
        if record.exc_info:
            facts["error"] = self.formatException(record.exc_info)
        return json.dumps(facts, sort_keys=True, default=str) if self.as_json else " ".join(f"{k}={v}" for k, v in facts.items())


def logger(name: str | None = None) -> logging.Logger:
    return logging.getLogger(f"{ROOT}.{name}" if name else ROOT)


def configure(level: str = "INFO", json_output: bool = False, replay_mode: bool = False, stream=None) -> None:
    """The first call takes effect, later ones change nothing."""
    root = logger()
    if root.handlers:
        return
    number = logging.getLevelNamesMapping().get(level.upper())
    if number is None:
        raise ValueError(f"unknown level {level!r}")
    handler = logging.StreamHandler(stream or sys.stderr)
    handler.setFormatter(_Lines(json_output, replay_mode))
    root.addHandler(handler)
    root.setLevel(number)
    root.propagate = False
