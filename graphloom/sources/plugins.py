"""Framework plugins: what a project uses and which routes its files declare."""

from __future__ import annotations

import logging
from abc import ABC, abstractmethod
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.sources import index, scan

log = logging.getLogger(__name__)


class FrameworkPlugin(ABC):
    """One framework. Both methods are declarative: they take and return DataFrames."""

    name: str
    languages: tuple[str, ...]

    @abstractmethod
    def detect(self, files: DataFrame) -> DataFrame:
        """One row (framework, confidence, version, language, entry_files) for scanned files (path, language, text)."""

    @abstractmethod
    def endpoints(self, parsed: DataFrame) -> DataFrame:
        """Endpoints of parsed files."""


class Express(FrameworkPlugin):
    name, languages = "express", ("typescript", "tsx", "javascript")

    def detect(self, files: DataFrame) -> DataFrame:
        return scan.detect(files)

    def endpoints(self, parsed: DataFrame) -> DataFrame:
        return index.endpoints(parsed.where(F.col("language").isin(*self.languages)))


class Plugins:
    """Registered plugins. The surest detection above 0.5 wins, the first registered among equals; a plugin that fails
    is logged and passed over."""

    def __init__(self, *plugins: FrameworkPlugin):
        self.plugins = list(plugins) or [Express()]

    def register(self, plugin: FrameworkPlugin) -> None:
        self.plugins.append(plugin)

    def detect(self, files: DataFrame) -> tuple[FrameworkPlugin, dict] | None:
        found = []
        for order, plugin in enumerate(self.plugins):
            try:
                row = plugin.detect(files).first()
                found.append((row.framework, float(row.confidence), order))
            except Exception:
                log.exception("plugin %s failed", plugin.name)
        if not found:
            return None
        spark = files.sparkSession
        best = scan.arbitrate(spark.createDataFrame(found, "framework string, confidence double, `order` int")).first()
        return (self.plugins[best.order], best.asDict()) if best else None

    def endpoints(self, parsed: DataFrame) -> DataFrame:
        return reduce(DataFrame.unionByName, (p.endpoints(parsed) for p in self.plugins))
