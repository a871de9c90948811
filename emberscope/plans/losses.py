"""What a build leaves behind, counted in the passes that make the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession

SCHEMA = "step string, what string, rows long"


class Losses:
    """Counts by step, taken while the rows go by: no table is read for them.

    ``watch`` a table on its way into a write; when the write is done, ``lines`` and ``table`` know the counts. A task that
    Spark runs twice because its executor was lost may count its rows twice, so these are figures to look at, not to add up with money.
    """

    def __init__(self) -> None:
        self._steps: list[tuple[str, Observation, list[str]]] = []

    def watch(self, df: DataFrame, step: str, **counts: Column) -> DataFrame:
        seen = Observation()
        self._steps.append((step, seen, list(counts)))
        return df.observe(seen, *[c.alias(name) for name, c in counts.items()])

    def lines(self) -> list[tuple[str, str, int]]:
        """(step, what, rows) of all that was watched. Waits for writes that have not ended."""
        out = [(step, name, int(seen.get[name] or 0)) for step, seen, names in self._steps for name in names]
        held = {(step, what): n for step, what, n in out}
        for step, what, whole, rest in DIFFERENCES:
            if whole in held and rest in held:
                out.append((step, what, held[whole] - held[rest]))
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.lines(), SCHEMA)


#: Losses that are what is missing from one count to another.
DIFFERENCES = [
    ("silver_fires", "repeated", ("silver_fires", "read"), ("silver_fires", "kept")),
    ("gold_full", "orphans", ("gold_full", "detections"), ("gold_full", "labelled")),
    ("gold_features", "incomplete", ("gold_features", "read"), ("gold_features", "kept")),
]
