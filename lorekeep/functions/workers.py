"""What Python workers need to run this package's functions."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def reachable() -> None:
    """Let the active session's Python workers import this package from where it is, whatever folder the session was
    started in, as they do from an installed one. To be called before a Python function is put into a plan."""
    env = SparkSession.active().sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])
