"""The stored vector index of the rule corpus: built beside the one in use, then put in force at once.

Each build has a folder of its own that is never changed afterwards. A build is in force once its marker exists; markers
are numbered, and each is made in one step by the one builder that gets its number. So readers see the whole old index or
the whole new one, and a frame that was read before a swap stays readable.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RULES
from .rules import index_meta, latest_rules, parsed_rules, stale_index
from .similarity import with_embeddings

INDEX = f"{RULES}, text_hash STRING, embedding ARRAY<FLOAT>, embedding_error STRING"
META = "key STRING, value STRING"
KEPT = 2  # builds that stay: the one in force and the one before, which readers may still be at


class IndexFolder:
    """Builds of an index below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._files = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}")

    def _builds(self) -> dict[int, str]:
        """Numbers of the builds that are or were in force, with their folders."""
        at = self._path("in_force")
        if not self._files.exists(at):
            return {}
        names = [f.getPath().getName() for f in self._files.listStatus(at)]
        return {int(n.split("-")[0]): f"build-{n}" for n in names if n[0].isdigit()}

    def current(self) -> int:
        """Number of the build in force; 0 if there is none."""
        return max(self._builds(), default=0)

    def _read(self, table: str, schema: str, build: int | None) -> DataFrame:
        builds = self._builds()
        build = max(builds, default=0) if build is None else build
        if build not in builds:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{builds[build]}/{table}")

    def rules(self, build: int | None = None) -> DataFrame:
        """Rows of a build, of the one in force by default; those without a vector too."""
        return self._read("rules", INDEX, build)

    def meta(self, build: int | None = None) -> DataFrame:
        return self._read("meta", META, build)

    def searchable(self, build: int | None = None) -> DataFrame:
        """Rows that a search can find, in the form that `similarity.search_rules` takes."""
        return self.rules(build).filter("embedding IS NOT NULL").drop("text_hash", "embedding_error")

    def put_in_force(self, folder: str, build: int) -> None:
        """Make the marker of a finished build. Fails if another builder has put a build of this number in force."""
        if build in self._builds():
            raise FileExistsError(f"build {build} is in force already")
        name = folder.removeprefix("build-")
        self._files.create(self._path(f"in_force/{name}"), False).close()
        taken = sorted(f.getPath().getName() for f in self._files.listStatus(self._path("in_force")) if f.getPath().getName().startswith(f"{build}-"))
        if taken[0] != name:  # two builders at the same moment: the first name stays
            self._files.delete(self._path(f"in_force/{name}"), False)
            raise FileExistsError(f"build {build} is in force already")

    def drop_older(self, kept: int = KEPT) -> None:
        """Delete all but the newest builds, and unfinished ones of numbers that are past."""
        builds = self._builds()
        newest = sorted(builds)[-kept:]
        for build in set(builds) - set(newest):
            self._files.delete(self._path(f"in_force/{builds[build].removeprefix('build-')}"), False)
        names = {builds[b] for b in newest}
        for status in self._files.listStatus(self._path("")):
            name = status.getPath().getName()
            if name.startswith("build-") and name not in names and int(name.split("-")[1]) <= max(newest, default=0):
                self._files.delete(status.getPath(), True)


def rebuild(index: IndexFolder, lines: DataFrame, embed: Callable[[list[str]], np.ndarray], model: str = "default",
            batch: int = 50) -> int:
    """Bring the index up to date with the rule lines (`value`, `position`, `modified_at`); the number in force after.

    Nothing happens while the lines' modification time, the model and the absence of failed texts are as of the last
    build, and none at all if no rule can be read. Else the rules are parsed again, but a text whose hash was indexed by
    the same model keeps its vector: only distinct texts that are new, and those that failed before, are embedded.
    """
    build = index.current()
    meta = index.meta()
    known = {r["key"]: r["value"] for r in meta.collect()}  # four rows
    same_model = known.get("model") == model
    if same_model and known.get("failed") == "0" and not stale_index(lines, meta).first()["stale"]:
        return build
    rules = latest_rules(parsed_rules(lines)).withColumn("text_hash", F.sha2("chunk_text", 256))
    if rules.isEmpty():
        return build
    folder = f"build-{build + 1}-{uuid.uuid4().hex}"
    path = f"{index.root}/{folder}"
    before = index.rules(build).filter("embedding IS NOT NULL").select("text_hash", "embedding").dropDuplicates(["text_hash"])
    kept = before if same_model else before.limit(0)
    texts = rules.select("text_hash", "chunk_text").dropDuplicates(["text_hash"])
    fresh = with_embeddings(texts.join(kept, "text_hash", "left_anti"), embed, batch).drop("chunk_text")
    fresh.write.mode("overwrite").parquet(f"{path}/fresh")  # the model is asked once, whatever is tried again below
    fresh = index.spark.read.schema(fresh.schema).parquet(f"{path}/fresh")
    vectors = kept.withColumn("embedding_error", F.lit(None).cast("string")).unionByName(fresh)
    rows = rules.join(vectors, "text_hash", "left")
    rows.select("sid", "msg", "classtype", "chunk_text", "text_hash", "embedding", "embedding_error").write.mode("overwrite").parquet(f"{path}/rules")
    stored = index.spark.read.schema(INDEX).parquet(f"{path}/rules")
    mtime = lines.agg(F.max("modified_at").cast("string")).first()[0]
    failed = stored.filter("embedding IS NULL").agg(F.count("*").cast("string").alias("value")).select(F.lit("failed").alias("key"), "value")
    name = index.spark.range(1).select(F.lit("model").alias("key"), F.lit(model).alias("value"))
    done = index_meta(stored.filter("embedding IS NOT NULL"), mtime)
    done.unionByName(failed).unionByName(name).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    index.put_in_force(folder, build + 1)
    index.drop_older()
    return build + 1
