"""Settings of the engine, from the environment or the session."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

PREFIX, CONF = "LORIKEET_", "spark.lorikeet."


@dataclass(frozen=True)
class Settings:
    """Limits of the operators; every one may be set as ``LORIKEET_<NAME>`` or ``spark.lorikeet.<name>``."""

    top: int = 15
    final: int = 5
    weak_distance: float = 1.2
    chunk_size: int = 512
    chunk_overlap: float = 0.15
    lock_failures: int = 5
    lock_minutes: int = 15
    history_rows: int = 50
    activity_rows: int = 100
    web_route: bool = False
    legacy_dispatch: bool = False

    @classmethod
    def read(cls, env: Mapping[str, str] | None = None, spark: SparkSession | None = None) -> Settings:
        """The defaults, overlaid by the environment, overlaid by the session; broken numbers raise."""
        env = os.environ if env is None else env
        found = {}
        for f in fields(cls):
            given = env.get(PREFIX + f.name.upper())
            if spark is not None:
                given = spark.conf.get(CONF + f.name, given)
            if given is not None:
                kind = type(f.default)
                found[f.name] = given.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(given)
        return cls(**found)
