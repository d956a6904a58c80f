"""Centroid clustering of quantised vectors, each distinct vector once with its multiplicity.

Weighted deduplication: components become whole numbers, identical vectors one row with the number of rows that have it;
Lloyd's rounds run on those rows with weighted integer sums; at the end the assignments are joined back to all ids. The
driver holds the centroids and, of each round, one sum for each centroid and component; tasks get the centroids and give
such sums. The distinct vectors are written to the shared folder once, so a lost executor costs no earlier round.

A vector that very many rows have is one row in the rounds. For the join back, vectors with more than one part in HOT of
all rows, of which there can be no more than HOT, are dealt to as many tasks as they fill.

All arithmetic is in whole numbers and exact: distances in 64 bits, for which components must stay within LIMIT (a larger
one is an error, as no 64-bit distance could be given); sums in 64 bits where they fit and in Python's numbers where not.

Defined results: a vector that is null, has another number of components, or has a null, a NaN or an infinite one is left
out; repeated ids are rows of their own; a null id is the id of an empty text among the seeds; fewer vectors than centroids
give fewer centroids; equal distances go to the smaller number, ids of equal hash (repeated ones) in order of their
vectors; no vectors give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release

#: Fixed values of the query: centroids, rounds, components, and the factor that makes them whole numbers.
CENTROIDS, ROUNDS, SIZE, SCALE = 16, 3, 64, 64
#: Components are below this in absolute value, so that 64 squared differences fit in 64 bits.
LIMIT = 2**27
#: A vector with more than one HOT-th of all rows is dealt to tasks of that many rows.
HOT = 64
#: Rows of distinct vectors that a task takes at once.
BATCH = 8192


def quantised(vectors: DataFrame, size: int = SIZE, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, q: floor(scale * x) of each component of the vectors that are whole."""
    x = F.col(vec_col).cast("array<double>")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    whole = vectors.select(F.col(id_col).alias("vec_id"), x.alias("x")).where(F.col("x").isNotNull() & (F.size("x") == size) & F.forall("x", finite))
    step = lambda v: F.when(F.abs(v * scale) < LIMIT, F.floor(v * scale).cast("int")).otherwise(F.raise_error(F.lit(f"a component times {scale} is not below {LIMIT}")).cast("int"))
    return whole.select("vec_id", F.transform("x", step).alias("q"))


def seeds(kept: DataFrame, k: int = CENTROIDS) -> np.ndarray:
    """The vectors with the smallest hashes of their ids, a row for each."""
    name = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.select(name.alias("h"), "q").orderBy("h", "q").limit(k).collect()
    return np.array([r.q for r in first], dtype=np.int64)


def _matrix(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column("q").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of v: the number of its nearest centroid, the smaller of equals, and the squared distance."""
    best, at = ((v - centroids[0]) ** 2).sum(1), np.zeros(len(v), np.int32)
    for k in range(1, len(centroids)):
        d = ((v - centroids[k]) ** 2).sum(1)
        nearer = d < best
        best[nearer], at[nearer] = d[nearer], k
    return at, best


def weighted_sums(v: np.ndarray, n: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """A row for each centroid: its vectors' components times n, summed, and then the sum of n. Whole Python numbers."""
    fits = int(n.max(initial=0)) * max(int(np.abs(v).max(initial=0)), 1) * len(v) < 2**62
    full = np.column_stack([v, np.ones(len(v), np.int64)])
    out = np.zeros((k, full.shape[1]), dtype=object)
    for c in np.unique(at):
        mine = at == c
        w, x = (n[mine], full[mine]) if fits else (n[mine].astype(object), full[mine].astype(object))
        out[c] = [int(s) for s in (x * w[:, None]).sum(0)]
    return out


def _sums(distinct: DataFrame, centroids: np.ndarray, size: int) -> np.ndarray:
    """weighted_sums over all rows: each task gives one number for each centroid and component, which Spark adds up."""
    k = len(centroids)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, size + 1), dtype=object)
        for b in batches:
            v = _matrix(b, size)
            total += weighted_sums(v, b.column("n").to_numpy(zero_copy_only=False), nearest(v, centroids)[0], k)
        c, i = np.nonzero(total)
        s = pa.array([Decimal(int(x)) for x in total[c, i]], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(i, pa.int32()), s], ["c", "i", "s"])

    out = np.zeros((k, size + 1), dtype=object)
    for r in distinct.mapInArrow(partial, "c int, i int, s decimal(38,0)").groupBy("c", "i").agg(F.sum("s").alias("s")).collect():  # one row for each centroid and component
        out[r.c, r.i] = int(r.s)
    return out


def moved(centroids: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Centroids at the floors of their vectors' means; those without vectors stay."""
    return np.array([[s // row[-1] for s in row[:-1]] if row[-1] else old for old, row in zip(centroids.tolist(), sums.tolist(), strict=True)], dtype=np.int64)


def _assigned(distinct: DataFrame, centroids: np.ndarray, size: int) -> DataFrame:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, d = nearest(_matrix(b, size), centroids)
            yield pa.RecordBatch.from_arrays([b.column("q"), b.column("n"), pa.array(at), pa.array(d)], ["q", "n", "cluster", "distance"])

    return distinct.mapInArrow(assign, "q array<int>, n long, cluster int, distance long")


def back(kept: DataFrame, assigned: DataFrame) -> DataFrame:
    """kept with the columns of its vectors' assignments."""
    total = assigned.agg(F.sum("n")).first()[0] or 0
    part = max(total // HOT, 1)
    hot = assigned.where(F.col("n") > part).select("q", F.ceil(F.col("n") / part).cast("int").alias("copies"))  # HOT rows at most
    one = F.lit(1)
    dealt = kept.join(F.broadcast(hot), "q", "left").withColumn("copy", F.pmod(F.xxhash64("vec_id"), F.coalesce("copies", one)).cast("int")).drop("copies")
    copies = assigned.join(F.broadcast(hot), "q", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce("copies", one) - 1))).drop("copies", "n")
    return dealt.join(copies, ["q", "copy"])


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of every vector that is whole."""
    spark = vectors.sparkSession
    kept = quantised(vectors, size, scale, id_col, vec_col)
    centroids = seeds(kept, k)
    if not len(centroids):
        nothing = {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string"}
        return kept.select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in nothing.items())).limit(0)
    distinct = cut(kept.groupBy("q").agg(F.count("*").alias("n")), "vectors")
    for _ in range(rounds):
        centroids = moved(centroids, _sums(distinct, centroids, size))
    assigned = cut(_assigned(distinct, centroids, size), "assigned")
    release(distinct)
    spent = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)") * F.col("n")).alias("s")).collect()}  # k rows
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame([(c, spent[c], sum(spent.values()), names[c]) for c in spent], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = back(kept, assigned).join(F.broadcast(facts), "cluster")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE) -> str:
    """The twin over the table embeddings: every round a step of its own, every vector by itself."""
    distance = "list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [
        f"v as (select vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as q from embeddings where len(embedding) = {size} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {size})",
        f"c0 as (select row_number() over (order by h, q) - 1 as k, q from (select sha256('1:' || coalesce(vec_id::varchar, '')) as h, q from v order by h, q limit {k}))",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} as (select vec_id, any_value(q) as q, min(d) as d, arg_min(k, (d, k)) as k from (select v.vec_id, v.q, c.k, {distance}::bigint as d from v, c{r} c) group by vec_id)")
        if r < rounds:
            steps.append(f"s{r} as (select k, i, sum(x)::bigint as s, count(*) as n from (select k, unnest(q) as x, generate_subscripts(q, 1) as i from a{r}) group by k, i)")
            steps.append(f"m{r} as (select k, list((s - ((s % n) + n) % n) // n order by i) as q from s{r} group by k)")
            steps.append(f"c{r + 1} as (select c.k, coalesce(m.q, c.q) as q from c{r} c left join m{r} m on c.k = m.k)")
    return f"""with {', '.join(steps)}
        select vec_id, a.k::int as cluster, a.d::bigint as distance, (sum(a.d) over (partition by a.k))::bigint as cluster_inertia, (sum(a.d) over ())::bigint as inertia, sha256(array_to_string(c.q, ',')) as centroid_sha256
        from a{rounds} a join c{rounds} c on a.k = c.k"""
