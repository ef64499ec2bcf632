"""Named loggers, as text or JSON lines, optionally into a rotating file. The first settings of a name stay.

A logger is described as a table for ``logging.config``, which builds its handlers; a JSON line is described as a list
of fields, each with the place where a record holds it.
"""

from __future__ import annotations

import json
import logging
import logging.config
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

# The fields of a JSON line in their order, and the two lines of text.
JSON_FIELDS = {"timestamp": "created", "level": "levelname", "logger": "name", "message": "message", "module": "module", "function": "funcName", "line": "lineno"}
CONSOLE_LINE = "%(asctime)s | %(levelname)-8s | %(name)s | %(message)s"
FILE_LINE = "%(asctime)s | %(levelname)-8s | %(name)s | %(funcName)s:%(lineno)d | %(message)s"
TIME = "%Y-%m-%d %H:%M:%S"


class JSONFormatter(logging.Formatter):
    """One JSON object a record; ``exception`` and ``data`` only where a record has them."""

    def usesTime(self) -> bool:
        return False

    def formatMessage(self, record: logging.LogRecord) -> str:
        held = vars(record) | {"created": datetime.fromtimestamp(record.created, UTC).isoformat()}
        line = {field: held[place] for field, place in JSON_FIELDS.items()}
        optional = {"exception": record.exc_text, "data": held.get("extra_data")}
        return json.dumps(line | {k: v for k, v in optional.items() if v is not None}, default=str)

    def format(self, record: logging.LogRecord) -> str:
        if record.exc_info and record.exc_info[0] and not record.exc_text:
            record.exc_text = self.formatException(record.exc_info)
        record.message = record.getMessage()
        return self.formatMessage(record)


def settings_of(level: str, json_format: bool, log_file: str | None, max_bytes: int, backup_count: int) -> dict[str, Any]:
    """Handlers and formatters as ``logging.config.dictConfig`` takes them; an unknown level counts as INFO."""
    known = level.upper() if level.upper() in logging.getLevelNamesMapping() else "INFO"
    text = lambda line: {"()": JSONFormatter} if json_format else {"format": line, "datefmt": TIME}
    table: dict[str, Any] = {
        "formatters": {"console": text(CONSOLE_LINE)},
        "handlers": {"console": {"class": "logging.StreamHandler", "stream": "ext://sys.stdout", "formatter": "console", "level": known}},
    }
    if log_file:
        table["formatters"]["file"] = text(FILE_LINE)
        table["handlers"]["file"] = {"class": "logging.handlers.RotatingFileHandler", "filename": log_file, "maxBytes": max_bytes, "backupCount": backup_count, "encoding": "utf-8", "formatter": "file", "level": known}
    return table | {"level": known}


class GovernanceLogger:
    """Loggers by name; who asks for a known one gets it as it is."""

    _known: dict[str, logging.Logger] = {}

    @classmethod
    def get_logger(cls, name: str, level: str = "INFO", json_format: bool = False, log_file: str | None = None, max_bytes: int = 10 * 2**20, backup_count: int = 5) -> logging.Logger:
        if name not in cls._known:
            table = settings_of(level, json_format, log_file, max_bytes, backup_count)
            known = table.pop("level")
            own = [] if logging.getLogger(name).handlers else [*table["handlers"]]  # a name that others set up keeps its handlers
            if own and log_file:
                Path(log_file).absolute().parent.mkdir(parents=True, exist_ok=True)
            logger = {"level": known, "propagate": False} | ({"handlers": own} if own else {})
            logging.config.dictConfig({"version": 1, "incremental": False, "disable_existing_loggers": False, "loggers": {name: logger}} | (table if own else {}))
            cls._known[name] = logging.getLogger(name)
        return cls._known[name]

    @classmethod
    def reset(cls) -> None:
        """Forget all names and close what they write to."""
        names, cls._known = list(cls._known), {}
        for logger in map(logging.getLogger, names):
            closing, logger.handlers = logger.handlers, []
            for handler in closing:
                handler.close()


def get_logger(name: str, **settings) -> logging.Logger:
    return GovernanceLogger.get_logger(name, **settings)
