"""Centroid clustering by sort-means: exact k-means on integers with few distances.

Each round orders, for every centroid, the others by their distance from it.  A
vector starts from the centroid that it had; the others are looked at in that
order, until one lies strictly beyond twice the vector's distance from where it
started: by the triangle inequality neither that one nor any later one can be as
near.  All arithmetic is on integers, so results don't depend on how rows are
dealt out.  Rounds are written to the shared folder, each with the clusters that
the next one starts from; tasks sum components by cluster before the shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path

#: Clusters, rounds, components, and what components are multiplied with before they are cut to integers.
CLUSTERS, ROUNDS, SIZE, SCALE = 8, 10, 64, 1024
#: Below this, squared distances of 64 components and four times as much fit 64 bits; larger ones are computed in numbers without bounds.
LARGE = 1 << 26
#: Bits of a part of a task's sum.
LIMB = 40


def whole(values: np.ndarray) -> np.ndarray:
    """Whole doubles as integers; of unbounded size where 64 bits could be too few."""
    big = values.size and np.abs(values).max() * max(1.0, values.shape[1] / SIZE) >= LARGE
    return np.frompyfunc(int, 1, 1)(values) if big else values.astype(np.int64)


def _same(*arrays: np.ndarray) -> list[np.ndarray]:
    return [a.astype(object) for a in arrays] if any(a.dtype == object for a in arrays) else list(arrays)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    gap = x - y
    return (gap * gap).sum(axis=-1)


def assigned(x: np.ndarray, before: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance) of each row of x, from the centroids `before` on; ties go to the smaller number."""
    x, centres = _same(x, centres)
    apart = squared(centres[:, None], centres[None])
    start = squared(x, centres[before])
    now, best = before.copy(), start.copy()
    for c in np.unique(before).tolist():
        rows = np.flatnonzero(before == c)
        for other in np.argsort(apart[c], kind="stable").tolist():
            if other == c:
                continue
            rows = rows[(apart[c, other] <= 4 * start[rows]).astype(bool)]  # who stops here stops for good
            if not len(rows):
                break
            d = squared(x[rows], centres[other])
            nearer = ((d < best[rows]) | ((d == best[rows]) & (other < now[rows]))).astype(bool)
            now[rows[nearer]], best[rows[nearer]] = other, d[nearer]
    return now, best


def _limbs(total: int) -> list[int]:
    """A sum of any size in parts that tasks' parts can be added to; all but the last are in [0, 2**LIMB)."""
    out = []
    while not -(1 << LIMB) <= total < 1 << LIMB:
        out.append(total % (1 << LIMB))
        total >>= LIMB
    return [*out, total]


def _vectors(batch) -> np.ndarray:
    """The batch's vectors; all are of one length."""
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _sums(points: DataFrame, k: int) -> list[tuple[int, list[int]]]:
    """(rows, sums of components) of each cluster; a row a component and cluster comes to the driver."""

    def run(batches):
        n, total = [0] * k, [0] * k
        for b in batches:
            x, of = whole(_vectors(b)), b.column("cluster").to_numpy()
            for c in np.unique(of).tolist():
                mine = x[of == c]
                n[c] += len(mine)
                total[c] = total[c] + mine.astype(object).sum(axis=0) if mine.dtype == object else total[c] + mine.sum(axis=0).astype(object)
        rows = [(c, at, n[c], limb, part) for c in range(k) if n[c] for at, v in enumerate(total[c].tolist()) for limb, part in enumerate(_limbs(v))]
        for at in range(0, len(rows), 4096):
            columns = zip(zip(*rows[at : at + 4096], strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in columns], names=["cluster", "at", "n", "limb", "part"])

    parts = points.select("cluster", "v").mapInArrow(run, "cluster int, at int, n long, limb int, part long")
    out: dict[int, tuple[int, dict[int, int]]] = {}
    for r in parts.groupBy("cluster", "at", "limb").agg(F.sum("n").alias("n"), F.sum("part").alias("part")).collect():
        n, total = out.get(r.cluster, (0, {}))
        total[r.at] = total.get(r.at, 0) + r.part * (1 << LIMB * r.limb)
        out[r.cluster] = max(n, r.n), total  # every task gives limb 0
    return [(out[c][0], [out[c][1][i] for i in range(len(out[c][1]))]) if c in out else (0, []) for c in range(k)]


def integers(vectors: DataFrame, id_col: str, vec_col: str, size: int, scale: int) -> DataFrame:
    """(id, v: whole numbers as doubles) of the vectors with `size` components, none null, infinite or not a number, nor so after scaling."""
    scaled = vectors.select(F.col(id_col).alias("id"), F.transform(vec_col, lambda x: F.lit(float(scale)) * x.cast("double")).alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # an array holds doubles without a bound, which floor() would cut to 64 bits
    down = F.transform("v", lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x))
    return scaled.where((F.size("v") == size) & ~odd).select("id", down.alias("v"))


def sort_means(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", size: int = SIZE, k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, prefix: str = "3:") -> tuple[DataFrame, list[list[int]]]:
    """((id, cluster int, distance long), the centroids' components) of the kept vectors' rows.

    Kept are vectors of `size` components without null and non-finite ones, as
    floor(scale * component).  Centroids start as the k kept vectors (all, where
    there are fewer) with the smallest hashes of prefix and id; of equal ids the
    smaller vector is first, rows without an id are last.  An empty cluster
    keeps its centroid.  distance is squared, and null where 64 bits can't hold
    it.  Ids may be null and repeat; every kept row gives one row; without kept
    rows the result is empty.  Other columns are not read.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    points = integers(vectors, id_col, vec_col, size, scale)
    first = points.select("v", F.sha2(F.concat(F.lit(prefix), F.col("id").cast("string")), 256).alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    centres, points = [[int(x) for x in r.v] for r in first], points.withColumn("cluster", F.lit(0))
    names, path = ["id", "v", "cluster"], None

    def step(centres: list[list[int]]):
        at = np.array(centres, object)
        at = at.astype(np.int64) if at.size and abs(at).max() < LARGE and size <= SIZE else at

        def run(batches):
            for b in batches:
                if b.num_rows:
                    now, _ = assigned(whole(_vectors(b)), b.column("cluster").to_numpy(), at)
                    yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(now, pa.int32())], names=names)

        return run

    if centres:
        for _ in range(rounds):
            before, path = path, new_path(spark, "points")
            points.mapInArrow(step(centres), f"id {kind}, v array<double>, cluster int").write.parquet(path)
            if before:
                _dropped(spark, before)  # the new table is whole, so nothing reads the old one again
            points = spark.read.schema(f"id {kind}, v array<double>, cluster int").parquet(path)
            sums = _sums(points, len(centres))
            centres = [[t // n for t in total] if n else c for c, (n, total) in zip(centres, sums, strict=True)]
    at = np.array(centres, object)

    def last(batches):
        for b in batches:
            if b.num_rows:
                now, d = assigned(whole(_vectors(b)), b.column("cluster").to_numpy(), at.astype(np.int64) if abs(at).max() < LARGE and size <= SIZE else at)
                fits = [int(x) if x < 1 << 63 else None for x in d.tolist()]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(now, pa.int32()), pa.array(fits, pa.int64())], names=[id_col, "cluster", "distance"])

    return points.mapInArrow(last, f"`{id_col}` {kind}, cluster int, distance long"), centres


def _dropped(spark, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def op13_centroids(spark, sf_dir: str) -> DataFrame:
    """Cluster and squared distance of every kept vector, with inertias and the digest of its centroid; odd rows as in `sort_means`."""
    from .common import written

    found, centres = sort_means(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    found = written(found, "clusters")
    each = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # a row a cluster
    digests = {c: hashlib.sha256(",".join(map(str, centre)).encode()).hexdigest() for c, centre in enumerate(centres)}
    whole_sum = sum(int(r.s) for r in each if r.s is not None)
    rows = [(r.cluster, None if r.s is None else int(r.s), whole_sum, digests[r.cluster]) for r in each]
    told = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def op13_sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE) -> str:
    """DuckDB SQL: every round's distances in full, component by component."""
    parts = [
        f"kept as materialized (select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as v from embeddings where len(embedding) = {size} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"m0 as materialized (select row_number() over (order by sha256('3:' || vec_id::varchar)) - 1 as c, v from kept qualify c < {clusters})",
    ]
    nearest = "select row, vec_id, arg_min(struct_pack(c := c, d := d), struct_pack(d := d, c := c)) as best from (select k.row, k.vec_id, m.c, list_sum(list_transform(list_zip(k.v, m.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from kept k, m{r} m) group by row, vec_id"
    for r in range(rounds):
        parts.append(f"a{r} as materialized ({nearest.format(r=r)})")
        parts.append(f"s{r} as (select best.c as c, p, sum(x)::hugeint as s, count(*) as n from (select best, unnest(v) as x, unnest(range({size})) as p from a{r} join kept using (row)) group by all)")
        parts.append(f"m{r + 1} as materialized (select m.c, coalesce(t.v, m.v) as v from m{r} m left join (select c, list(((s - ((s % n) + n) % n) // n)::bigint order by p) as v from s{r} group by c) t using (c))")
    parts.append(f"last as materialized ({nearest.format(r=rounds)})")
    return "with " + ",\n".join(parts) + (
        f"\nselect vec_id, best.c::int as cluster, best.d as distance, (sum(best.d) over (partition by best.c))::bigint as cluster_inertia, (sum(best.d) over ())::bigint as inertia, sha256(array_to_string(m.v, ',')) as centroid_sha256 from last join m{rounds} m on m.c = best.c"
    )
