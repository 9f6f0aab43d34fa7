"""Vectors of texts, computed once per distinct text and encoder."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replyloom.constants import EMBEDDING_DIM
from replyloom.functions.tables import union_all
from replyloom.functions.text import content_key

#: A batch of texts to a batch of vectors.
Encoder = Callable[[Sequence[str]], Sequence[Sequence[float]]]

KEY_CHARS = 32


def keyed(texts: DataFrame, model: str, text: str = "text") -> DataFrame:
    return texts.withColumn("key", content_key(F.col(text), model, KEY_CHARS))


def usable(store: DataFrame, dim: int = EMBEDDING_DIM) -> DataFrame:
    """Stored vectors of the right length; others are ignored and computed anew."""
    return store.filter(F.size("vector") == dim).select("key", "vector")


def missing(keyed_texts: DataFrame, store: DataFrame, dim: int = EMBEDDING_DIM, text: str = "text") -> DataFrame:
    """One row per distinct text that the store cannot serve."""
    wanted = keyed_texts.groupBy("key").agg(F.any_value(text).alias("text"))
    return wanted.join(usable(store, dim).select("key"), "key", "left_anti")


def encode(rows: DataFrame, encoder: Encoder, batch: int = 256) -> DataFrame:
    """Run the encoder over ``(key, text)`` rows in Arrow batches on the executors."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (frame.slice(start, batch) for frame in frames for start in range(0, frame.num_rows, batch)):
            vectors = [[float(x) for x in v] for v in encoder(part.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(vectors, pa.list_(pa.float32()))], names=["key", "vector"])

    return rows.select("key", "text").mapInArrow(run, "key string, vector array<float>")


class VectorStore:
    """Vectors by key in committed versions below ``path``.

    A refresh writes its vectors to a folder of its own and then, when all is written, one marker that names it; readers
    take the folders that have a marker. What a failed refresh left behind is never read. Two refreshes at once may both
    compute a text; readers take the vector of the marker that sorts first, so a key has one row. Files
    directly in ``path``, from before there were versions, count as a version that sorts before all others.
    """

    _SCHEMA = "key string, vector array<float>"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def versions(self) -> list[str]:
        """The committed folders, in the order of their markers; one small row per refresh."""
        markers = f"{self.path}/_versions/markers"
        if not self._exists(markers):
            return []
        return sorted(r["version"] for r in self.spark.read.schema("version string").option("recursiveFileLookup", True).json(markers).collect())

    def read(self, dim: int | None = None) -> DataFrame:
        """``(key, vector)``, one row per key; with ``dim`` of vectors of this length alone, so that a wrong one hides no right one."""
        found = [self.spark.createDataFrame([], self._SCHEMA).withColumn("_version", F.lit(""))]
        if self._exists(self.path):
            found.append(self.spark.read.schema(self._SCHEMA).parquet(self.path).withColumn("_version", F.lit("")))
        for version in self.versions():
            folder = self.spark.read.schema(self._SCHEMA).parquet(f"{self.path}/_versions/data/{version}")
            found.append(folder.withColumn("_version", F.lit(version)))
        rows = union_all(*found)
        rows = rows if dim is None else rows.filter(F.size("vector") == dim)
        return rows.groupBy("key").agg(F.min_by("vector", "_version").alias("vector"))

    def write(self, vectors: DataFrame) -> str:
        """Write ``(key, vector)`` rows, not yet visible; the name to commit."""
        version = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        vectors.select("key", "vector").write.parquet(f"{self.path}/_versions/data/{version}")
        return version

    def commit(self, version: str) -> None:
        """Make a written version visible: one file that appears whole or not at all."""
        marker = self.spark.createDataFrame([(version,)], "version string").coalesce(1)
        marker.write.json(f"{self.path}/_versions/markers/{version}")

    def refresh(self, texts: DataFrame, encoder: Encoder, model: str, dim: int = EMBEDDING_DIM, text: str = "text") -> DataFrame:
        """Add vectors for texts that the store lacks, then return the texts with their vectors."""
        wanted = keyed(texts, model, text)
        self.commit(self.write(encode(missing(wanted, self.read(dim), dim, text), encoder)))
        return wanted.join(self.read(dim), "key", "left")


def embedding_refresh(
    texts: DataFrame, store_path: str, encoder: Encoder, model: str, dim: int = EMBEDDING_DIM, text: str = "text"
) -> DataFrame:
    """:meth:`VectorStore.refresh` of the store at ``store_path``."""
    return VectorStore(texts.sparkSession, store_path).refresh(texts, encoder, model, dim, text)


def refresh_counts(keyed_texts: DataFrame, store: DataFrame, dim: int = EMBEDDING_DIM) -> DataFrame:
    """Distinct texts served by the store and to be computed, as ``(name, value)``."""
    wanted = keyed_texts.select("key").distinct()
    ready = usable(store, dim).select("key").distinct().withColumn("_ready", F.lit(True))
    state = F.when(F.col("_ready"), "hit").otherwise("miss")
    return wanted.join(ready, "key", "left").groupBy(state.alias("name")).agg(F.count(F.lit(1)).alias("value"))
