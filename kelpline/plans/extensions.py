"""A registry of functions DataFrame -> DataFrame, with order, enablement and a key-value store for each."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Transform = Callable[[DataFrame], DataFrame]
#: Version of stored settings; before it, extensions that are not supported any more could be enabled.
VERSION = 2


@dataclass
class Extension:
    id: str
    name: str
    version: str
    run: Transform
    enabled: bool = True
    order: int = 0
    needs: tuple[str, ...] = ()
    store: dict[str, str] = field(default_factory=dict)


class Registry:
    def __init__(self) -> None:
        self._all: dict[str, Extension] = {}

    def add(self, extension: Extension) -> bool:
        """The first of an id stays; an extension without id, name or version, or with unknown needs, is refused."""
        if not (extension.id and extension.name and extension.version) or extension.id in self._all or not set(extension.needs) <= set(self._all):
            return False
        self._all[extension.id] = extension
        return True

    def remove(self, extension_id: str) -> None:
        self._all.pop(extension_id, None)

    def reorder(self, ids: list[str]) -> bool:
        """The named ids come first, in the order given, the others after them as they were; an unknown id changes nothing."""
        if not set(ids) <= set(self._all):
            return False
        before = sorted(self._all.values(), key=lambda e: (e.order, e.id))
        for place, extension_id in enumerate(dict.fromkeys([*ids, *(e.id for e in before)])):
            self._all[extension_id].order = place
        return True

    def enabled(self) -> list[Extension]:
        return sorted((e for e in self._all.values() if e.enabled), key=lambda e: (e.order, e.id))

    def apply(self, df: DataFrame) -> DataFrame:
        for e in self.enabled():
            df = df.transform(e.run)
        return df

    def table(self, spark: SparkSession) -> DataFrame:
        """The registry as rows; it is as long as the list of extensions."""
        rows = [(e.id, e.name, e.version, e.enabled, e.order, e.store) for e in self._all.values()]
        return spark.createDataFrame(rows, "id string, name string, version string, enabled boolean, order int, store map<string, string>")


def migrated(settings: DataFrame, supported: list[str]) -> DataFrame:
    """Stored settings (id, enabled, version) as of ``VERSION``: rows of an older or unknown version whose extension is not
    supported are disabled; newer rows stay as they are."""
    old = F.coalesce(F.col("version") < VERSION, F.lit(True))
    enabled = F.col("enabled") & (~old | F.col("id").isin(supported))
    return settings.withColumns({"enabled": enabled, "version": F.when(old, VERSION).otherwise(F.col("version"))})
