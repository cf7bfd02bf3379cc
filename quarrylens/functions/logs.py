"""Log levels and a handler for programs that use the library; the library itself adds none."""

from __future__ import annotations

import logging

PACKAGE_LOGGER = "quarrylens"


def level_for(verbose: int = 0, quiet: int = 0) -> int:
    """Of counts of options: quiet wins over verbose."""
    if quiet:
        return logging.WARNING if quiet == 1 else logging.ERROR
    return logging.DEBUG if verbose else logging.INFO


def configure_logging(verbose: int = 0, quiet: int = 0) -> logging.Logger:
    """Let the library's messages go to standard error. Called again it sets the level and adds nothing."""
    log = logging.getLogger(PACKAGE_LOGGER)
    log.setLevel(level_for(verbose, quiet))
    if not any(getattr(h, "of_command_line", False) for h in log.handlers):
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(levelname)s %(name)s: %(message)s"))
        handler.of_command_line = True
        log.addHandler(handler)
    return log
