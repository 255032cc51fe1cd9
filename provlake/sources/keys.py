"""Chain keys, read where they are used.

Only a file path or variable name travels with a plan; the key material is read inside the task,
so it shows neither in plans, configs nor event logs.
"""

from __future__ import annotations

import os
from dataclasses import dataclass


@dataclass(frozen=True)
class KeySource:
    """Where executors find a key, and the id recorded beside what it authenticates."""

    keyid: str
    path: str | None = None
    env: str | None = None
    shipped: str | None = None  # name of a file distributed with ``SparkContext.addFile``

    def read(self) -> bytes:
        if self.shipped:
            from pyspark import SparkFiles
            with open(SparkFiles.get(self.shipped), "rb") as fh:
                return fh.read().strip()
        if self.path:
            with open(self.path, "rb") as fh:
                return fh.read().strip()
        value = os.environ.get(self.env or "")
        if not value:
            raise ValueError(f"no key material for keyid {self.keyid}")
        return value.encode()
