"""Encodings and distances of hierarchical symbols."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rutine.functions.scalars import row_key
from rutine.operators.sequence import cooccurrence


def vector_size(log: DataFrame, columns: list[str]) -> int:
    """The rounded root of the total number of distinct values; columns without any value count as none."""
    row = log.agg(*[F.countDistinct(c).alias(f"_{i}") for i, c in enumerate(columns)]).first()
    return max(1, round(sum(row) ** 0.5))


def embed_rows(log: DataFrame, columns: list[str], size: int | None = None, seed: int = 42) -> DataFrame:
    """log with `vector`, the mean of the word vectors of a row's values, each row being a sentence. A row without a value has zeros."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    size = size or vector_size(log, columns)
    words = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in columns]))
    rows = log.withColumn("_words", words)
    model = Word2Vec(vectorSize=size, minCount=1, windowSize=max(1, len(columns)), seed=seed, numPartitions=1, inputCol="_words", outputCol="_vector").fit(rows)
    return model.transform(rows).withColumn("vector", vector_to_array("_vector")).drop("_words", "_vector")


def embed_sequence(log: DataFrame, columns: list[str], size: int = 32, window: int = 5, seed: int = 42) -> DataFrame:
    """log with `vector`, that of the whole row as a word, each log being a sentence."""
    from pyspark.ml.feature import Word2Vec

    rows = log.withColumn("_word", row_key(*columns))
    order = F.array_sort(F.collect_list(F.struct("event_index", "_word")))
    sentences = rows.groupBy("log_id").agg(F.transform(order, lambda x: x["_word"]).alias("_words"))
    longest = sentences.agg(F.max(F.size("_words"))).first()[0] or 1  # no log is cut into several sentences
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=1, seed=seed, numPartitions=1, maxSentenceLength=max(1000, longest), inputCol="_words", outputCol="_vector").fit(sentences)
    from pyspark.ml.functions import vector_to_array

    words = model.getVectors().select(F.col("word").alias("_word"), vector_to_array("vector").alias("_vector"))
    none = F.array_repeat(F.lit(0.0), size)
    return rows.join(words, "_word", "left").withColumn("vector", F.coalesce("_vector", none)).drop("_word", "_vector")


def fiedler_order(counts: DataFrame) -> DataFrame:
    """(value, place) of the values of cooccurrence() counts of one log, in the order of the Laplacian's second eigenvector.

    The matrix is as large as the number of distinct values; it is solved on the driver."""
    rows = counts.groupBy("a", "b").agg(F.sum("count").alias("n")).collect()
    names = sorted({r.a for r in rows} | {r.b for r in rows})
    at = {x: i for i, x in enumerate(names)}
    c = np.zeros((len(names), len(names)))
    for r in rows:
        c[at[r.a], at[r.b]] += r.n
    c = (c + c.T) / 2
    v = np.linalg.eigh(np.diag(c.sum(axis=0)) - c)[1][:, min(1, len(names) - 1)] if names else np.zeros(0)
    if len(v) and v[np.argmax(np.abs(v))] < 0:  # an eigenvector's sign is free
        v = -v
    order = sorted(range(len(names)), key=lambda i: (round(float(v[i]), 9), names[i]))
    kind = dict(counts.dtypes)["a"]
    return counts.sparkSession.createDataFrame([(names[i], p) for p, i in enumerate(order)], f"value {kind}, place int")


def encode_cooccurrence(log: DataFrame, column: str, n: int = 1) -> DataFrame:
    """log with `code`, the place of its value in fiedler_order(); -1 for a value that never occurs with another."""
    places = fiedler_order(cooccurrence(log, column, n)).withColumnsRenamed({"value": column, "place": "code"})
    return log.join(F.broadcast(places), column, "left").fillna(-1, ["code"])  # distinct values, held by the driver before


def encode_cooccurrence_columns(log: DataFrame, columns: list[str], n: int = 1) -> DataFrame:
    """log with one `code` for all columns: their places as digits of mixed radix, the first column the highest."""
    code, parts = F.lit(0).cast("long"), []
    for i, c in enumerate(columns):
        log = encode_cooccurrence(log, c, n).withColumnRenamed("code", f"_code{i}")
        radix = log.agg(F.max(f"_code{i}")).first()[0] or 0
        code = code * (radix + 2) + F.col(f"_code{i}") + 1
        parts.append(f"_code{i}")
    return log.withColumn("code", code).drop(*parts)


def level_codes(log: DataFrame, path: str = "path") -> DataFrame:
    """log with `levels`: for each level of its path array the code of its value, by first appearance in the log at that level."""
    each = log.select("log_id", "event_index", F.posexplode(path).alias("_level", "_value"))
    first = each.groupBy("log_id", "_level", "_value").agg(F.min("event_index").alias("_first"))
    codes = first.withColumn("_code", F.row_number().over(Window.partitionBy("log_id", "_level").orderBy("_first")) - 1).drop("_first")
    rows = each.join(codes, ["log_id", "_level", "_value"]).groupBy("log_id", "event_index").agg(F.array_sort(F.collect_list(F.struct("_level", "_code"))).alias("_all"))
    rows = rows.select("log_id", "event_index", F.transform("_all", lambda x: x["_code"]).alias("levels"))
    return log.join(rows, ["log_id", "event_index"])


def hierarchy_weights(n: int) -> list[float]:
    """2^(n-1), ..., 2, 1 from the top level down."""
    return [float(2 ** (n - 1 - level)) for level in range(n)]


def hierarchy_distance(a: Column, b: Column, weights: list[float]) -> Column:
    """Sum over levels that differ of the level's weight, less what equal levels below it soften: w * (1 - equal below / (levels from here down + 1))."""
    n = len(weights)
    out = F.lit(0.0)
    for i, w in enumerate(weights):
        below = F.lit(0)
        for j in range(i + 1, n):
            below = below + F.coalesce((F.get(a, F.lit(j)) == F.get(b, F.lit(j))).cast("int"), F.lit(0))
        out = out + F.when(F.get(a, F.lit(i)) != F.get(b, F.lit(i)), F.lit(w) * (1 - below / (n - i + 1))).otherwise(F.lit(0.0))
    return out


def cost_matrix(symbols: DataFrame, weights: list[float]) -> DataFrame:
    """(log_id, a, b, cost) for all pairs of a log's distinct symbols (log_id, symbol_id, levels): the vocabulary squared, not the log."""
    x = symbols.select("log_id", F.col("symbol_id").alias("a"), F.col("levels").alias("_a"))
    y = symbols.select("log_id", F.col("symbol_id").alias("b"), F.col("levels").alias("_b"))
    return x.join(y, "log_id").select("log_id", "a", "b", hierarchy_distance(F.col("_a"), F.col("_b"), weights).alias("cost"))


def group_distances(groups: DataFrame, weights: list[float]) -> DataFrame:
    """(log_id, g1, g2, distance) for pairs of groups (log_id, group_id, ordinal, levels), g1 <= g2: the mean distance of their rows, place by
    place, over the shorter one."""
    x = groups.select("log_id", F.col("group_id").alias("g1"), "ordinal", F.col("levels").alias("_a"))
    y = groups.select("log_id", F.col("group_id").alias("g2"), "ordinal", F.col("levels").alias("_b"))
    pairs = x.join(y, ["log_id", "ordinal"]).where("g1 <= g2")
    return pairs.groupBy("log_id", "g1", "g2").agg(F.avg(hierarchy_distance(F.col("_a"), F.col("_b"), weights)).alias("distance"))


def standardized(df: DataFrame, vector: str = "vector", keys: list[str] | None = None) -> DataFrame:
    """df with `scaled`: each dimension less its mean, over its population deviation, among the rows of the same keys (all rows without keys); a
    constant dimension is 0. Rows with a null key are left out."""
    by = keys or []
    each = df.select(*by, F.posexplode(vector).alias("_at", "_x")).groupBy(*by, "_at").agg(F.avg("_x").alias("m"), F.stddev_pop("_x").alias("s"))
    facts = each.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_at", "m", "s"))).alias("_facts"))
    scaled = F.zip_with(vector, "_facts", lambda x, f: F.when(f["s"] > 0, (x - f["m"]) / f["s"]).otherwise(F.lit(0.0)))
    both = df.join(facts, by) if by else df.crossJoin(F.broadcast(facts))  # one row
    return both.withColumn("scaled", scaled).drop("_facts")
