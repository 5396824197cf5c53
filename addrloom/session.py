"""The one session that the library runs in."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(name: str = "addrloom", **settings: str) -> SparkSession:
    """The active session, or a new one with the library's defaults; settings name Spark's with _ for a dot."""
    builder = SparkSession.builder.appName(name)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config("spark." + key.replace("_", "."), value)
    return builder.getOrCreate()


def data_path(part: str, variable: str = "ADDRLOOM_DATA") -> str:
    """A path below the folder that an environment variable names, the current folder if it is unset."""
    return os.path.join(os.environ.get(variable, "."), part)
