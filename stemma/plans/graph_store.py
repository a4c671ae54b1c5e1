"""The whole store under versions: graph, schemas and artifacts change together or not at all.

Tables of one ``SnapshotLog``. Readers keep the version they opened; a writer whose base was
overtaken makes its change again on the newer one. Columns added later have defaults for older
parts, so stores of earlier layouts stay readable.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ledger import activate_schema, active_schema, check_relation_types
from .session import TABLES, Graph
from .snapshots import Change, SnapshotLog

SCHEMAS = TABLES | {
    "schemas": "id long, name string, body string, is_active boolean, created_ts double",
    "artifacts": "name string, kind string, path string, sha256 string, created_ts double, version long",
}
DEFAULTS = {"nodes.status": "'proposed'", "edges.status": "'proposed'", "nodes.aliases": "array()", "nodes.properties": "map()"}


class GraphStore:
    def __init__(self, spark: SparkSession, path: str, clock: Callable[[], float] = time.time):
        self.log, self.clock = SnapshotLog(spark, path, SCHEMAS, DEFAULTS), clock

    def open(self, version: int | None = None) -> Graph:
        """The graph of one version, the latest if none is named; later commits don't change it."""
        version = self.log.version() if version is None else version
        return Graph(**{name: self.log.read(name, version) for name in TABLES})

    def change(self, make: Callable[[Graph], dict[str, DataFrame]], note: str = "") -> int:
        """Replace the tables that ``make`` returns for the graph it is given; made anew after a conflict."""
        return self.log.update(lambda base: Change(replace=make(self.open(base)), note=note))

    def append(self, note: str = "", **rows: DataFrame) -> int:
        return self.log.update(lambda base: Change(append=rows, note=note))

    # Schemas ---------------------------------------------------------------------------------

    def install_schema(self, name: str, body: str, entities: DataFrame, relations: DataFrame, activate: bool = True) -> int:
        """Add a schema version and return its id; relation ends must be declared types or ``*``."""
        open_ = check_relation_types(relations, entities).collect()
        if open_:
            raise ValueError(f"undeclared types: {sorted((r['name'], r['end']) for r in open_)}")
        number = 0

        def change(base: int) -> Change:
            nonlocal number
            known = self.log.read("schemas", base)
            number = (known.agg(F.max("id")).first()[0] or 0) + 1
            new = self.log.spark.createDataFrame([(number, name, body, activate, self.clock())], SCHEMAS["schemas"])
            return Change(replace={"schemas": (known.withColumn("is_active", F.lit(False)) if activate else known).unionByName(new)}, note=f"schema {number}")

        self.log.update(change)
        return number

    def activate(self, schema_id: int) -> None:
        def change(base: int) -> Change:
            known = self.log.read("schemas", base)
            if known.where(F.col("id") == schema_id).isEmpty():
                raise ValueError(f"no schema {schema_id}")
            return Change(replace={"schemas": activate_schema(known, schema_id)}, note=f"activate {schema_id}")

        self.log.update(change)

    def schema(self, version: int | None = None) -> DataFrame:
        """The active schema, else the newest: one row, none in an empty store."""
        return active_schema(self.log.read("schemas", version))

    # Artifacts -------------------------------------------------------------------------------

    def register_artifact(self, name: str, kind: str, path: str, sha256: str) -> int:
        """A new version of a named artifact; returns its number, 1 for the first."""
        number = 0

        def change(base: int) -> Change:
            nonlocal number
            last = self.log.read("artifacts", base).where(F.col("name") == name).agg(F.max("version")).first()[0]
            number = (last or 0) + 1
            return Change({"artifacts": self.log.spark.createDataFrame([(name, kind, path, sha256, self.clock(), number)], SCHEMAS["artifacts"])}, note=f"artifact {name}")

        self.log.update(change)
        return number

    def artifact(self, name: str, version: int | None = None) -> DataFrame:
        """One version of an artifact, the latest if none is named."""
        rows = self.log.read("artifacts").where(F.col("name") == name)
        return rows.where(F.col("version") == version) if version else rows.orderBy(F.desc("version")).limit(1)
