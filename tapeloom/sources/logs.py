"""Logs of the driver to the console and a file, each from a level on; the report of a run."""

from __future__ import annotations

import logging
import os

from pyspark.sql import DataFrame


def logger(name: str, path: str, console: int = logging.INFO, file: int = logging.DEBUG) -> logging.Logger:
    """A logger that writes to the console and to the file ``path``, whose folder is made; called again it takes the handlers anew."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    made = logging.getLogger(name)
    for old in list(made.handlers):
        made.removeHandler(old)
        old.close()
    made.setLevel(min(console, file))
    made.propagate = False
    for handler, level in ((logging.StreamHandler(), console), (logging.FileHandler(path, encoding="utf-8"), file)):
        handler.setLevel(level)
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        made.addHandler(handler)
    return made


def report(log: DataFrame, run_id: int) -> list[str]:
    """What is said of one run, a line an epoch: losses with two and five decimals, or none where they are missing."""
    said = lambda x, n: "none" if x is None else f"{x:.{n}f}"
    rows = log.where(log["run_id"] == run_id).select("epoch", "train_loss", "valid_loss").orderBy("epoch").toLocalIterator()
    return [f"epoch {r.epoch}: average training loss {said(r.train_loss, 2)}, validation loss {said(r.valid_loss, 5)}" for r in rows]
