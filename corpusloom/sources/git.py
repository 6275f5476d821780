"""Paths that git reports as changed against a revision."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession

BASE = "HEAD~1"


def changed_paths(root: str, base: str = BASE) -> list[str]:
    """Paths below ``root`` that differ between the working tree and ``base``; deleted ones too, untracked ones not."""
    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    done = subprocess.run(["git", "-C", root, "diff", "--name-only", base, "--"], capture_output=True, text=True)
    if done.returncode:
        raise RuntimeError(f"git diff failed: {done.stderr.strip()}")
    return [p for p in done.stdout.splitlines() if p]


def changed_table(spark: SparkSession, root: str, base: str = BASE) -> DataFrame:
    return spark.createDataFrame([(p,) for p in changed_paths(root, base)], "path string")
