"""Mini-batch k-means on a stream: a model table with a version for each micro-batch.

Each micro-batch is assigned to the centres of the version before it, its sums
are merged in one aggregate, and then the centres move. A batch that runs
again starts from the same earlier version and writes the same version over
it, so each batch counts exactly once however often it runs. Versions hold k
rows each and outlive the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.clustering import MiniBatch


class VersionedMiniBatch:
    """A sink of points (features) that keeps a model under ``folder``, one version per micro-batch.

    ``centres`` are those to begin with; without them, the first batch of k
    points or more gives them and isn't counted, as in ``MiniBatch``.
    """

    def __init__(self, spark: SparkSession, folder: str, k: int, centres: list[list[float]] | None = None, seed: int = 42):
        self.spark, self.folder, self.k, self.centres, self.seed = spark, folder.rstrip("/"), k, centres, seed

    def _exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/model")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def versions(self) -> DataFrame:
        """batch, cluster, centre, n of all versions."""
        return self.spark.read.schema("cluster int, centre array<double>, n bigint, batch int").parquet(f"{self.folder}/model")

    def model(self, before: int | None = None) -> MiniBatch:
        """The model of the last version, or of the last one before a batch."""
        found = MiniBatch(self.k, self.seed)
        if self.centres is not None:
            found.centres = [list(map(float, c)) for c in self.centres]
        if self._exists():
            rows = self.versions() if before is None else self.versions().where(F.col("batch") < before)
            last = rows.agg(F.max("batch").alias("b")).first().b
            if last is not None:
                for r in rows.where(F.col("batch") == last).orderBy("cluster").collect():  # k rows
                    if r.cluster >= len(found.centres):
                        found.centres.append([])
                    found.centres[r.cluster], found.counts[r.cluster] = list(r.centre), r.n
        return found

    def __call__(self, points: DataFrame, number: int) -> None:
        model = self.model(number).partial_fit(points)
        rows = [(i, c, n) for i, (c, n) in enumerate(zip(model.centres, model.counts, strict=False))]
        self.spark.createDataFrame(rows, "cluster int, centre array<double>, n bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/model/batch={number}")
