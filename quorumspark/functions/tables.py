"""Table functions, for DataFrames and SQL: one pass over the sorted rows of a partition, in the state of a few values."""

from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

_PICKED = T.StructType([T.StructField("indicator", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("entity", T.StringType()), T.StructField("year", T.IntegerType())])


@F.udtf
class PickExamples:
    """(indicator, level, entity, year) of candidates (indicator, level, dist, entity, year, region): for each level in turn the closest of a new entity in a new region, else of a new entity, else the closest.

    Spark partitions by indicator and sorts by level, distance, entity and year, so rows stream by; a level keeps its three best so far and an indicator the entities and regions it has used.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("candidates are a table")
        return AnalyzeResult(_PICKED, partitionBy=[PartitioningColumn("indicator")], orderBy=[OrderingColumn(c) for c in ("level", "dist", "entity", "year")])

    def __init__(self):
        self.indicator = self.level = None
        self.entities, self.regions, self.best = set(), set(), {}

    def _chosen(self):
        row = self.best.get(0) or self.best.get(1) or self.best.get(2)
        self.best = {}
        if row is None:
            return None
        self.entities.add(row["entity"])
        self.regions.add(row["region"])
        return self.indicator, int(row["level"]), row["entity"], int(row["year"])

    def eval(self, row: T.Row):
        if self.level is not None and row["level"] != self.level:
            yield self._chosen()
        self.indicator, self.level = row["indicator"], row["level"]
        new = row["entity"] not in self.entities
        kind = 2 if not new else 1 if row["region"] in self.regions else 0
        for k in range(kind, 3):
            self.best.setdefault(k, row)

    def terminate(self):
        last = self._chosen()
        if last:
            yield last


def register(spark) -> None:
    """The table functions by name, for SQL: SELECT * FROM pick_examples(TABLE(candidates))."""
    spark.udtf.register("pick_examples", PickExamples)
