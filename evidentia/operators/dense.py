"""Dense vectors: embedding a table and exact or approximate nearest chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia import params as P
from evidentia.functions.bounds import top_n
from evidentia.functions.ship import ship
from evidentia.functions.vectors import hashed_vector

QUERY_BLOCK = 4096
#: Scores that a task holds at a time (8 bytes each).
SCORES = 1 << 22


def embed(df: DataFrame, text: str = "text", vector: str = "vector", dim: int = P.HASH_DIM, single: bool = False) -> DataFrame:
    """Add the hashed unit vector of a text column, as floats if ``single``. A narrow stage, no shuffle."""
    ship(df.sparkSession)
    return df.withColumn(vector, hashed_vector(F.col(text), dim, single))


def check_dimension(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """Fail the job on a vector of another length."""
    ok = F.size(vector) == dim
    wrong = F.concat(F.lit(f"vector length is not {dim}: "), F.size(vector).cast("string"))
    return df.withColumn(vector, F.when(F.assert_true(ok, wrong).isNull(), F.col(vector)))


def _query_blocks(queries: DataFrame, block: int):
    """Split the queries into parts of about ``block`` rows; each part alone is small enough to ship."""
    total = queries.count()
    parts = max(1, -(-total // block))
    if parts == 1:
        return [queries]
    share = F.pmod(F.xxhash64("query_id"), F.lit(parts))
    return [queries.where(share == i) for i in range(parts)]


def _scorer(query_ids, matrix, allowed, k: int, out_id, id_type):
    import numpy as np
    import pyarrow as pa

    n_queries = len(query_ids)

    def emit(ids, q, s):
        return pa.RecordBatch.from_arrays(
            [pa.array([query_ids[i] for i in q], out_id), pa.array(list(ids), id_type), pa.array(s, pa.float64())],
            ["query_id", "chunk_id", "score"])

    def best(ids, q, s):
        """Keep the best k rows of each query: score descending, id ascending."""
        order = np.lexsort((ids, -s, q))
        q, s, ids = q[order], s[order], ids[order]
        starts = np.r_[0, np.flatnonzero(np.diff(q)) + 1]
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        keep = place < k
        return ids[keep], q[keep], s[keep]

    def barred(labels):
        """Cells that a query's filters shut out; only filters that are set are looked at."""
        shut = np.zeros((len(labels[0]), n_queries), dtype=bool)
        for column, wanted in zip(labels, allowed, strict=True):
            names, codes = np.unique(column, return_inverse=True)
            for i, a in enumerate(wanted):
                if a is not None:
                    shut[:, i] |= ~np.isin(names, list(a))[codes]
        return shut

    tile = max(1, SCORES // max(1, n_queries))

    def tiles(batches):
        """Rows in parts whose scores for all queries of the block stay within a bound."""
        for batch in batches:
            if batch.num_rows:
                ids = np.asarray(batch.column(0).to_pylist())
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
                labels = [np.asarray(["" if v is None else str(v) for v in batch.column(2 + i).to_pylist()]) for i in range(len(allowed))]
                for low in range(0, len(ids), tile):
                    yield ids[low:low + tile], flat[low:low + tile], [c[low:low + tile] for c in labels]

    def score(batches):
        held, rows = [], 0
        for ids, vectors, labels in tiles(batches):
            n = len(ids)
            scores = np.round(vectors @ matrix.T, 6) + 0.0
            if allowed:
                shut = barred(labels)
                scores[shut] = -np.inf
            m = min(k, n)
            if m < n:
                # The k-th score of each query; rows that tie with it all go on to the exact cut.
                least = np.partition(scores, n - m, axis=0)[n - m]
                row, q = np.nonzero(scores >= least)
            else:
                row, q = np.divmod(np.arange(n * n_queries), n_queries)
            if allowed:
                row, q = row[~shut[row, q]], q[~shut[row, q]]
            held.append(best(ids[row], q, scores[row, q]))
            rows += len(held[-1][0])
            if rows > 16 * k * n_queries:
                held = [best(*(np.concatenate(c) for c in zip(*held)))]
                rows = len(held[0][0])
        if held:
            ids, q, s = (np.concatenate(c) for c in zip(*held))
            if len(ids):
                yield emit(*best(ids, q, s))

    return score


def nearest(chunks: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK, label: str | None = None) -> DataFrame:
    """Exact best ``k`` chunks per query by cosine of unit vectors.

    Chunks ``(chunk_id, vector)`` stream past a bounded block of query vectors, and
    every task hands on only its own best ``k`` per query, so no query-chunk pair is
    ever written out. Queries beyond one block take one more pass over the chunks.
    A query's filters (``params.FILTERS``: arrays, NULL for none) restrict its chunks where these have the column; ``allowed`` goes by
    the column that ``label`` names, if any.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    spark = chunks.sparkSession
    ship(spark)
    q_type, c_type = queries.schema["query_id"].dataType, chunks.schema["chunk_id"].dataType
    schema = T.StructType([
        T.StructField("query_id", q_type), T.StructField("chunk_id", c_type), T.StructField("score", T.DoubleType())])
    by = {**P.FILTERS, "allowed": label}
    filters = [c for c, of in by.items() if of and c in queries.columns and of in chunks.columns]
    scanned = chunks.select("chunk_id", "vector", *[by[c] for c in filters])
    found = None
    for part in _query_blocks(queries.select("query_id", "vector", *filters), block):
        table = part.toArrow()
        if table.num_rows == 0:
            continue
        ids = table.column(0).to_pylist()
        flat = pa.concat_arrays(table.column(1).chunks).flatten().to_numpy(zero_copy_only=False)
        allowed = [[None if a is None else frozenset(map(str, a)) for a in table.column(2 + i).to_pylist()] for i in range(len(filters))]
        shipped = spark.sparkContext.broadcast((ids, np.asarray(flat, dtype=np.float64).reshape(len(ids), -1), allowed))

        def run(batches, shipped=shipped):
            query_ids, matrix, allowed = shipped.value
            yield from _scorer(query_ids, matrix, allowed, k, to_arrow_type(q_type), to_arrow_type(c_type))(batches)

        hits = scanned.mapInArrow(run, schema)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = spark.createDataFrame([], schema)
    return top_n(found, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)


def search_dense(chunks: DataFrame, queries: DataFrame, k: int = P.CANDIDATES, label: str | None = None) -> DataFrame:
    """Embed both sides by hashing, then exact search."""
    units = embed(chunks.select("chunk_id", "text", *([label] if label else []))).drop("text")
    asked = embed(queries.select("query_id", "question", *(["allowed"] if label else [])), "question").drop("question")
    return nearest(units, asked, k, label=label)


def train_cells(chunks: DataFrame, cells: int, seed: int = 42, rounds: int = 10):
    """Cluster the chunk vectors; the model holds ``cells`` centres, a size the caller sets."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = chunks.select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    return KMeans(k=cells, seed=seed, maxIter=rounds).fit(points)


def assign_cells(chunks: DataFrame, model) -> DataFrame:
    """Add the ``cell`` of each chunk. A stored index is partitioned by this column."""
    from pyspark.ml.functions import array_to_vector

    placed = model.transform(chunks.withColumn("features", array_to_vector(F.col("vector").cast("array<double>"))))
    return placed.withColumn("cell", F.col("prediction").cast("string")).drop("features", "prediction")


def probe_cells(queries: DataFrame, model, probes: int) -> DataFrame:
    """Queries with the ``allowed`` cells: those of their nearest centres."""
    centres = queries.sparkSession.createDataFrame(
        [(str(i), [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "chunk_id string, vector array<double>")
    hits = nearest(centres, queries, probes)
    return queries.join(hits.groupBy("query_id").agg(F.collect_list("chunk_id").alias("allowed")), "query_id")


def nearest_approximate(placed: DataFrame, queries: DataFrame, model, k: int, probes: int) -> DataFrame:
    """Best ``k`` among the chunks of each query's nearest cells.

    A hot cell costs no more than its rows: chunks stream past the queries, no bucket is
    joined or collected. On a table partitioned by ``cell`` only probed cells are read.
    """
    asked = probe_cells(queries, model, probes)
    # At most as many names as the model has centres.
    wanted = [r["c"] for r in asked.select(F.explode("allowed").alias("c")).distinct().limit(len(model.clusterCenters())).collect()]
    return nearest(placed.where(F.col("cell").isin(wanted)), asked, k, label="cell")


def recall(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """Share of the exact hits that the approximate search found, per query."""
    hit = approximate.select("query_id", "chunk_id", F.lit(1).alias("hit"))
    return exact.join(hit, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(
        F.count("*").alias("n_exact"), F.coalesce(F.sum("hit"), F.lit(0)).alias("n_found"))
