"""One object over sources, sequences, similarity and triggers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators import sequences as S
from eventloom.operators import similarity as M
from eventloom.sources.warehouse import Source, Warehouse, write_results
from eventloom.streaming.incremental import Incremental
from eventloom.streaming.triggers import Rule, TriggerEngine


class Pipeline:
    """Attach sources, build the warehouse, process sequences, relate entities, follow changes. Steps are lazy until written or collected."""

    def __init__(self, spark: SparkSession, d: int, config: S.Config | None = None):
        self.d, self.config, self.warehouse = d, config, Warehouse(spark)

    def ingest(self, sources: dict[str, Source | str], tables: list[str], only: list[str] | None = None) -> dict[str, int]:
        for name, source in sources.items():
            self.warehouse.attach(name, source)
        return self.warehouse.build(tables, only)

    def process(self, steps: int = 3, **load) -> DataFrame:
        """(id, representation, patterns, predictions) of the loaded sequences."""
        return S.process(self.warehouse.load_sequences(**load), self.d, self.config, steps)

    def relate(self, least: float = 0.5, ids: list[str] | None = None, **load) -> DataFrame:
        entities = self.warehouse.load_entities(**load).select(F.col("id").alias("entity_id"), "category", F.explode("embeddings").alias("modality", "embedding"))
        wanted = self.warehouse.spark.createDataFrame([(i,) for i in ids], "id string") if ids is not None else None
        return M.relationships(entities, least, wanted)

    def run(self, sources: dict[str, Source | str], root: str | None = None, steps: int = 3) -> dict:
        """Ingest, process and relate; with ``root`` the results are appended there."""
        counts = self.ingest(sources, ["event_sequences", "entities"])
        results = self.process(steps) if counts["event_sequences"] else None
        if root and results is not None:
            write_results(results, root)
        return {"counts": counts, "results": results, "relationships": self.relate() if counts["entities"] else None}

    def stream(self, alpha: float = 1.0) -> Incremental:
        return Incremental(alpha)

    def watch(self, table: str = "event_sequences", rules: list[Rule] | None = None, **more) -> TriggerEngine:
        return TriggerEngine(self.warehouse.spark, lambda: self.warehouse.load_sequences(table), self.d, rules=rules, config=self.config, **more)
