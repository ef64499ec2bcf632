"""Named loggers: lines as text and JSON, files, and their end."""

import json
import logging

import pytest

from plumbline.logs import GovernanceLogger, get_logger


@pytest.fixture(autouse=True)
def clean():
    yield
    GovernanceLogger.reset()


def test_json_lines(tmp_path):
    file = tmp_path / "below" / "log.json"
    log = get_logger("plumbline.test.json", json_format=True, log_file=str(file))
    log.debug("not shown")
    log.info("rows: %d", 3, extra={"extra_data": {"table": "orders"}})
    try:
        raise KeyError("absent")
    except KeyError:
        log.exception("failed")
    first, second = map(json.loads, file.read_text().splitlines())
    assert list(first) == ["timestamp", "level", "logger", "message", "module", "function", "line", "data"]
    assert (first["level"], first["logger"], first["message"], first["function"], first["data"]) == ("INFO", "plumbline.test.json", "rows: 3", "test_json_lines", {"table": "orders"})
    assert first["timestamp"].endswith("+00:00") and second["level"] == "ERROR" and "KeyError" in second["exception"] and "data" not in second


def test_text_lines(tmp_path, capsys):
    file = tmp_path / "log.txt"
    log = get_logger("plumbline.test.text", level="warning", log_file=str(file))
    log.info("not shown")
    log.warning("odd")
    assert capsys.readouterr().out.rstrip().endswith("| WARNING  | plumbline.test.text | odd")
    assert "| plumbline.test.text | test_text_lines:" in file.read_text() and file.read_text().count("\n") == 1


def test_names_are_kept_and_reset():
    log = get_logger("plumbline.test.kept", level="nonsense")
    assert log is get_logger("plumbline.test.kept", level="DEBUG") and log.level == logging.INFO and not log.propagate and len(log.handlers) == 1
    GovernanceLogger.reset()
    assert not log.handlers and get_logger("plumbline.test.kept", level="DEBUG").level == logging.DEBUG
