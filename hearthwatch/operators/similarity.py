"""Vector search over the rule corpus."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

# Query vectors and corpus rows that meet in one task.
QUERY_BLOCK = 2048
CORPUS_PART = 1 << 15
QUERIES_AT_ONCE = 64  # of a block, whose scores are held at a time: 16 MB for a full part
# Equal vectors must tie whichever batch they sit in, so scores are compared to this many decimals.
SCORE_DIGITS = 12


def with_embeddings(rules: DataFrame, embed: Callable[[list[str]], np.ndarray], batch: int = 50) -> DataFrame:
    """Add `embedding` from a caller-supplied function over batches of search texts.

    A batch the function fails on keeps NULL vectors, which every search skips; `embedding_error` says why, so that
    those rows can be found and done again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records in batches:
            texts = records.column("chunk_text").to_pylist()
            vectors: list[list[float] | None] = []
            errors: list[str | None] = []
            for start in range(0, len(texts), batch):
                part = texts[start:start + batch]
                try:
                    vectors.extend(np.asarray(embed(part), dtype=np.float32).tolist())
                    errors.extend([None] * len(part))
                except Exception as e:  # the embedding service is outside our control
                    vectors.extend([None] * len(part))
                    errors.extend([f"{type(e).__name__}: {e}"] * len(part))
            yield pa.RecordBatch.from_arrays(
                [*records.columns, pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())],
                [*records.schema.names, "embedding", "embedding_error"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rules.schema.fields)
    return rules.mapInArrow(run, f"{schema}, embedding ARRAY<FLOAT>, embedding_error STRING")


def with_term_vectors(rules: DataFrame, dims: int = 256, text: str = "chunk_text") -> DataFrame:
    """Add a hashed, length-normalised term vector as `embedding`, using Spark ML."""
    from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    words = RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{N}]+").transform(rules)
    counts = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dims).transform(words)
    unit = Normalizer(inputCol="_tf", outputCol="_unit").transform(counts)
    return unit.withColumn("embedding", vector_to_array("_unit", "float32")).drop("_words", "_tf", "_unit")


def _best_of_part(key: str, k: int, schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k best corpus rows of one part for each query of one block: one matrix product, one selection a query."""

    def unit(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        values = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
        matrix = values.astype(np.float64).reshape(len(column), -1)
        length = np.linalg.norm(matrix, axis=1)
        usable = np.flatnonzero(length > 0)
        return usable, matrix[usable] / length[usable, None]

    def run(queries: pa.Table, corpus: pa.Table) -> pa.Table:
        if not queries.num_rows or not corpus.num_rows:
            return schema.empty_table()
        rows, vectors = unit(corpus.column("embedding"))
        asked, wanted = unit(queries.column("vector"))
        keys = corpus.column(key).to_numpy()[rows]
        found_q, found_r, found_s = [], [], []
        for column, q in enumerate(asked):
            if column % QUERIES_AT_ONCE == 0:
                scores = np.round(vectors @ wanted[column : column + QUERIES_AT_ONCE].T, SCORE_DIGITS)
            score = scores[:, column % QUERIES_AT_ONCE]
            some = np.arange(len(score))
            if len(some) > k:  # the k-th best and whatever equals it; ties go by key below
                some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
            best = some[np.lexsort((keys[some], -score[some]))[:k]]
            found_q.append(np.full(len(best), q))
            found_r.append(rows[best])
            found_s.append(score[best])
        if not found_q:
            return schema.empty_table()
        return pa.Table.from_arrays(
            [queries.column("query_id").take(pa.array(np.concatenate(found_q))), corpus.column(key).take(pa.array(np.concatenate(found_r))),
             pa.chunked_array([pa.array(np.concatenate(found_s))])], schema=schema)

    return run


def nearest(corpus: DataFrame, queries: DataFrame, k: int, key: str = "sid") -> DataFrame:
    """The k most similar corpus rows per query, exactly.

    `corpus` has `key` and `embedding`, `queries` has `query_id` and `vector`; only vectors of equal width are
    compared, and vectors that are NULL or have no length never match. Queries go into blocks and the corpus into
    parts of bounded size, each block meets each part in a task of its own, and only its best k per query leave
    the task (equal scores by smaller key). Nothing is collected, and nothing runs before the result is asked for.
    """
    asked = queries.filter("vector IS NOT NULL").select("query_id", "vector", F.size("vector").alias("_width"))
    stored = corpus.filter("embedding IS NOT NULL").select(key, "embedding", F.size("embedding").alias("_width"))

    def pieces(rows: DataFrame, size: int) -> Column:
        return F.greatest(F.lit(1).cast("long"), F.ceil(rows.agg(F.count("*") / size).scalar()))

    blocks, parts = pieces(asked, QUERY_BLOCK), pieces(stored, CORPUS_PART)
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    asked = asked.withColumn("_block", F.pmod(F.xxhash64("query_id"), blocks)).withColumn("_part", spread(parts))
    stored = stored.withColumn("_part", F.pmod(F.xxhash64(key), parts)).withColumn("_block", spread(blocks))
    types = {f.name: f.dataType for f in [*queries.schema.fields, *corpus.schema.fields]}
    schema = f"query_id {types['query_id'].simpleString()}, `{key}` {types[key].simpleString()}, score DOUBLE"
    arrow = pa.schema([("query_id", to_arrow_type(types["query_id"])), (key, to_arrow_type(types[key])), ("score", pa.float64())])
    meet = ["_block", "_part", "_width"]
    found = asked.groupBy(*meet).cogroup(stored.groupBy(*meet)).applyInArrow(_best_of_part(key, k, arrow), schema)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def search_rules(rules: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """`nearest` with the rule's columns and the score rounded for display."""
    hits = nearest(rules, queries, k)
    return hits.join(rules.drop("embedding"), "sid").select(
        "query_id", "rank", "sid", "msg",
        F.coalesce(F.nullif("classtype", F.lit("")), F.lit("unknown")).alias("classtype"),
        F.col("chunk_text").alias("context"),
        F.bround("score", 4).alias("similarity"),
    )


def alert_context(anomalies: DataFrame, signature_vectors: DataFrame, rules: DataFrame, k: int = 3) -> DataFrame:
    """Signature alerts with their k most similar rules; each distinct signature is searched once.

    `anomalies` are in stored form; other anomaly types come back without context.
    """
    is_alert = F.col("anomaly_type") == "suricata_alert"
    signature = F.coalesce(F.get_json_object("details", "$.signature"), F.col("summary"))
    keyed = anomalies.withColumn("signature", F.when(is_alert, signature))
    wanted = keyed.select("signature").filter("signature IS NOT NULL").distinct()
    queries = signature_vectors.join(wanted, "signature").select(F.col("signature").alias("query_id"), "vector")
    context = search_rules(rules, queries, k).withColumnRenamed("query_id", "signature")
    return keyed.join(context, "signature", "left")
