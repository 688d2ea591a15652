"""Channel D: embeddings, the nearest centroid, and centroids trained with k-means."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 384
THRESHOLD = 0.7


#: The categories that clusters are named after, in order.
NAMES = ["MalwareCreation", "SystemIntrusion", "SocialEngineering", "HarmfulContent", "JailbreakAttempt", "UnauthorizedAccess", "IdentityTheft", "PhysicalHarm"]
#: Texts embedded and compared at once, and the most marked texts that a query trains on.
BLOCK, FIT_ROWS = 1024, 20_000


def embedded(texts: list[str | None]) -> np.ndarray:
    """Counts of hashed byte trigrams of the lower-cased texts, each row of unit length; texts under three bytes are zero."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for row, text in zip(out, texts, strict=True):
        b = np.frombuffer((text or "").lower().encode(), dtype=np.uint8).astype(np.int64)
        if len(b) > 2:
            row += np.bincount(((b[:-2] * 31 + b[1:-1]) * 31 + b[2:]) % DIMENSIONS, minlength=DIMENSIONS)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0)


@F.arrow_udf(T.ArrayType(T.FloatType()))
def trigram_embedding(text: pa.Array) -> pa.Array:
    """`embedded` as a column."""
    flat = embedded(text.to_pylist())
    return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, DIMENSIONS), pa.int32()), pa.array(flat.ravel(), pa.float32()))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def nearest_centroid(rows: DataFrame, vector: str, centroids: list[tuple[str, list[float]]]) -> DataFrame:
    """rows with category and similarity of the nearest centroid; 'None' and 0 if none is above 0. The list is short and goes into the plan."""
    scored = F.array(*[F.struct(cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in c])).alias("s"), F.lit(-i).alias("order"), F.lit(n).alias("c")) for i, (n, c) in enumerate(centroids)])
    best = F.array_max(scored)
    up = best["s"] > 0
    return rows.withColumns({"category": F.when(up, best["c"]).otherwise("None"), "similarity": F.when(up, best["s"]).otherwise(0.0)})


def decision(similarity: Column) -> Column:
    return F.when(similarity > THRESHOLD, "SemanticViolation").otherwise("QuestionFactual")


def train_centroids(rows: DataFrame, vector: str, k: int = 8, seed: int = 42, starts: int = 10, rounds: int = 300) -> list[tuple[str, list[float]]]:
    """k-means from several starts; the one of least cost, with its clusters named in order."""
    return CentroidModel(_fitted(rows.select(F.col(vector).alias("v")), k, seed, starts, rounds)).centroids()


def _fitted(rows: DataFrame, k: int, seed: int, starts: int, rounds: int) -> KMeansModel:
    data = rows.select(array_to_vector(F.col("v").cast("array<double>")).alias("features")).persist()
    models = [KMeans(k=k, seed=seed + i, maxIter=rounds).fit(data) for i in range(starts)]
    data.unpersist()
    return min(models, key=lambda m: m.summary.trainingCost)


class CentroidModel:
    """Named centroids of texts that should be noticed. It is saved as Spark's own k-means model beside the digest of its names and values."""

    def __init__(self, model: KMeansModel):
        self.model = model
        self.centers = np.array([np.asarray(c, dtype=np.float64) for c in model.clusterCenters()]).astype(np.float32)

    @classmethod
    def fit(cls, rows: DataFrame, text: str, k: int = 8, seed: int = 42, starts: int = 10, rounds: int = 300) -> CentroidModel:
        return cls(_fitted(rows.filter(F.octet_length(text) > 2).select(trigram_embedding(text).alias("v")), k, seed, starts, rounds))

    def centroids(self) -> list[tuple[str, list[float]]]:
        return [(NAMES[i] if i < len(NAMES) else f"Category{i}", c.tolist()) for i, c in enumerate(self.centers)]

    def digest(self) -> str:
        return centroids_digest(self.centroids())

    def save(self, spark: SparkSession, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        spark.createDataFrame([(self.digest(),)], "digest string").coalesce(1).write.mode("overwrite").parquet(f"{path}/digest")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CentroidModel:
        """A saved model; one whose values do not match its digest is refused."""
        out = cls(KMeansModel.load(f"{path}/model"))
        if spark.read.parquet(f"{path}/digest").first()["digest"] != out.digest():
            raise ValueError(f"the centroids in {path} are not those that were saved")
        return out

    def score(self, text: Column) -> Column:
        """STRUCT<category, similarity> of the nearest centroid of each text: the first of the greatest that is above 0, else 'None' and 0. Blocks of texts are multiplied with all centroids at once."""
        names = [n for n, _ in self.centroids()]
        length = np.sqrt((self.centers * self.centers).sum(1))
        unit = np.divide(self.centers, length[:, None], out=np.zeros_like(self.centers), where=length[:, None] > 0)

        @F.arrow_udf(T.StructType([T.StructField("category", T.StringType()), T.StructField("similarity", T.FloatType())]))
        def run(column: pa.Array) -> pa.Array:
            texts, category, similarity = column.to_pylist(), [], []
            for at in range(0, len(texts), BLOCK):
                near = embedded(texts[at : at + BLOCK]) @ unit.T
                best = near.argmax(1)
                most = near[np.arange(len(best)), best]
                category += [names[i] if x > 0 else "None" for i, x in zip(best.tolist(), most.tolist(), strict=True)]
                similarity.append(np.maximum(most, 0))
            return pa.StructArray.from_arrays([pa.array(category, pa.string()), pa.array(np.concatenate(similarity) if similarity else [], pa.float32())], ["category", "similarity"])

        return run(text)


def centroids_digest(centroids: list[tuple[str, list[float]]]) -> str:
    """A digest of names and values that shows any change of the table."""
    h = hashlib.sha256()
    for name, c in centroids:
        h.update(name.encode() + np.asarray(c, dtype="<f4").tobytes())
    return h.hexdigest()


def label_centroids(rows: DataFrame, vector: str, label: str) -> DataFrame:
    """The mean vector of each label, coordinate by coordinate."""
    parts = rows.select(label, F.posexplode(vector).alias("at", "x")).groupBy(label, "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("centroid"))


def nearest_label(rows: DataFrame, key: str, vector: str, centroids: DataFrame, label: str) -> DataFrame:
    """The nearest labelled mean of each row; the means are one per label and travel as one array."""
    table = centroids.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("category"), "centroid"))).alias("table"))
    both = rows.select(key, vector).crossJoin(F.broadcast(table))  # a single row
    scored = F.transform("table", lambda c, i: F.struct(cosine(F.col(vector), c["centroid"]).alias("similarity"), (-i).alias("order"), c["category"].alias("category")))
    best = F.array_max(scored)
    return both.select(key, best.alias("best")).select(key, F.col("best.category").alias("category"), F.col("best.similarity").alias("similarity"))
