"""Embedding near-duplicates: spherical k-means cells, blocked cosine products within cells, one representative kept.

Equal embeddings are folded into one class first. The centroids come from a bounded, documented sample; every class is
assigned. A class also visits each other cell whose bisecting hyperplane is near enough. Two vectors at the threshold
angle differ by at most sqrt(1 - threshold^2) across any hyperplane through the origin that lies between them, which is
the exact reach (``margin=None``). The default reach is shorter where the data allow: MARGIN standard deviations of such
a difference across that hyperplane, if it is spread over the directions as the sample is within its cells; so it is the
full one where vectors vary in few directions. Recall is tested against brute force on even and on uneven vectors.
Links are counted for a class in its home cell, where classes of all linked partners are home or visitors. Cells are cut
into blocks, so no task holds more than two blocks, and links leave a block as counts and spanning trees, never as pairs.
Products are taken in single precision first; all that come within ROUNDING of the threshold are taken again in double.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, hash_bound, only, table
from .components import components

THRESHOLD = 0.95
MARGIN = 3.5
SAMPLE = 20_000
MOST_CELLS = 4096
CELL = 2048  # vectors that a cell is meant to hold
BLOCK = 4096
TILE = 512
ROUNDING = 1e-4
ITERATIONS = 8


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of finite numbers, none all zero, as unit vectors in double precision."""
    rows = rows.astype(np.float64)
    rows /= np.abs(rows).max(axis=1, initial=0, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def matrix(column, d: int) -> np.ndarray:
    """A list column whose rows all have ``d`` numbers."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def spherical_k_means(points: np.ndarray, cells: int, seed: int = 11) -> np.ndarray:
    """Unit centroids; an empty cell keeps its last centroid."""
    rng = np.random.default_rng(seed)
    centres = points[np.sort(rng.choice(len(points), min(cells, len(points)), replace=False))]
    for _ in range(ITERATIONS):
        own = np.concatenate([(points[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(points), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        norm = np.linalg.norm(sums, axis=1)
        centres = np.where(norm[:, None] > 0, sums / np.maximum(norm, 1e-300)[:, None], centres)
    return centres


def spread(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Covariance of the sample within its cells, with trace one."""
    total = np.zeros((points.shape[1], points.shape[1]))
    for i in range(0, len(points), 4096):
        part = points[i : i + 4096]
        rest = part - centres[(part @ centres.T).argmax(axis=1)]
        total += rest.T @ rest
    trace = np.trace(total)
    return total / trace if trace > 0 else np.eye(len(total)) / len(total)


def reaches(centres: np.ndarray, covariance: np.ndarray, threshold: float, margin: float | None) -> np.ndarray:
    """For each two cells how much nearer a vector may be to the first than to the second and still visit it."""

    def distances(gram):
        own = np.diag(gram)
        return np.sqrt(np.maximum(own[:, None] + own[None, :] - 2 * gram, 0))

    across = np.sqrt(max(0.0, 1 - threshold**2))
    exact = across * distances(centres @ centres.T) * (1 + 1e-9) + 1e-12
    return exact if margin is None else np.minimum(exact, margin * across * distances(centres @ covariance @ centres.T))


def cells_of(points: np.ndarray, centres: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, home) of each point: its nearest centroid, and each one whose bisecting hyperplane is near."""
    near = points @ centres.T
    home = near.argmax(axis=1)
    best = near[np.arange(len(points)), home]
    row, cell = np.nonzero(best[:, None] - near <= reach[home])
    return row, cell, cell == home[row]


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least member of each node's component among n nodes linked by a-b, by repeated minima and pointer jumping."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(key, group):
    """One block of homes against one block of members of the same cell -> counts and spanning links."""
    vectors = unit(matrix(group.column("embedding"), key[4].as_py()))
    side = group.column("side").to_numpy()
    ids, copies = group.column("id").to_numpy(), group.column("copies").to_numpy()
    home, member = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    threshold = key[3].as_py()
    names, place = np.unique(np.concatenate([ids[home], ids[member]]), return_inverse=True)
    linked, label = np.zeros(len(home), dtype=np.int64), np.arange(len(names))
    single = vectors.astype(np.float32)
    others = np.ascontiguousarray(single[member].T)
    for k in range(0, len(home), TILE):
        h, m = np.nonzero(single[home[k : k + TILE]] @ others >= threshold - ROUNDING)
        for i in range(0, len(h), 1 << 18):
            a, b = h[i : i + (1 << 18)] + k, m[i : i + (1 << 18)]
            near = np.einsum("ij,ij->i", vectors[home[a]], vectors[member[b]]) >= threshold
            near &= ids[home[a]] != ids[member[b]]
            a, b = a[near], b[near]
            linked += np.bincount(a, copies[member[b]], len(home)).astype(np.int64)
            if len(a):  # a spanning tree of what is linked so far
                label = _roots(np.concatenate([np.arange(len(names)), place[a]]), np.concatenate([label, place[len(home) + b]]), len(names))
    joined = np.flatnonzero(label != np.arange(len(names)))
    n = len(home)
    return pa.table(
        {
            "id": pa.array(np.concatenate([ids[home], names[joined]])),
            "links": pa.array(np.concatenate([linked, np.zeros(len(joined), dtype=np.int64)])),
            "root": pa.array(np.concatenate([np.zeros(n, dtype=np.int64), names[label[joined]]]), mask=np.arange(n + len(joined)) < n),
        }
    )


def near_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, margin: float | None = MARGIN, sample: int = SAMPLE, cell: int = CELL, block: int = BLOCK
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per input row. ``margin=None`` loses no link, with more visits.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing. Vectors of different
    lengths never link. Rows whose vec_id is null are kept, with links counted; their component is the least id that
    links reach, null if there is none. Repeated rows count as vectors of their own. An empty table gives no rows.
    """
    vectors = only(vectors, "vec_id", "embedding")
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), _numbers(vectors).alias("embedding"))
    good = F.coalesce(
        F.size("embedding") > 0, F.lit(False)
    ) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x).cast("double") == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    # the class number is a hash of the embedding and its least vec_id, so it is fixed and as good as unique
    classes = durable(
        given.filter(good).groupBy("embedding").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least_id"))
        .withColumn("id", F.xxhash64("embedding"))
    )
    row = classes.agg(F.count(F.lit(1)).alias("n")).first()
    links = None
    if row["n"]:
        lengths = [r["d"] for r in classes.groupBy(F.size("embedding").alias("d")).count().collect()]
        for d in lengths:
            found = _links(classes.filter(F.size("embedding") == d), d, threshold, margin, sample, cell, block)
            links = found if links is None else links.unionByName(found)
    if links is None:
        bare = given.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        return bare.withColumn("kept", F.col("vec_id").isNotNull())
    links = durable(links)
    labels = components(links.filter("root is not null").select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("id").agg(F.sum("links").alias("links"))
    each = (
        classes.join(counts, "id", "left").join(labels, classes["id"] == labels["node"], "left")
        .select("embedding", "least_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("label", "id").alias("label"))
    )
    least = each.groupBy("label").agg(F.min("least_id").alias("component_id"))
    member = each.join(least, "label").select(F.col("embedding").alias("_embedding"), "n_links", "component_id")
    joined = given.withColumn("_good", good).join(member, (F.col("_good")) & (F.col("embedding") == F.col("_embedding")), "left")
    component = F.when(F.col("_good"), F.col("component_id")).otherwise(F.col("vec_id"))
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept")
    )


def _numbers(vectors: DataFrame):
    """The embeddings as they are if they are float or double, else as double."""
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    return F.col("embedding") if kind in ("float", "double") else F.col("embedding").cast("array<double>")


def _links(classes: DataFrame, d: int, threshold: float, margin: float | None, sample: int, cell: int, block: int) -> DataFrame:
    """(id, links, root) of the classes of one length."""
    sc = classes.sparkSession.sparkContext
    n = classes.count()
    some = classes.filter(F.xxhash64("id", F.lit("cells")) <= hash_bound(1.2 * sample / n)).orderBy("id").limit(sample).select("embedding").toArrow()
    points = unit(matrix(some.column("embedding"), d)) if some.num_rows else np.eye(1, d)
    centres = spherical_k_means(points, int(min(MOST_CELLS, max(1, -(-n // cell)))))
    shared = sc.broadcast((centres, spread(points, centres)))

    def assign(batches):
        centres, covariance = shared.value
        reach = reaches(centres, covariance, threshold, margin)
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                row, cell, home = cells_of(unit(matrix(part.column("embedding"), d)), centres, reach)
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell.astype(np.int32)), pa.array(home)], [*taken.schema.names, "cell", "home"])

    kind = classes.schema["embedding"].dataType.simpleString()
    placed = durable(classes.select("id", "copies", "embedding").mapInArrow(assign, f"id long, copies long, embedding {kind}, cell int, home boolean"))
    sizes = placed.groupBy("cell").agg(
        F.ceil(F.count(F.lit(1)) / block).cast("int").alias("members"), F.ceil(F.sum(F.col("home").cast("int")) / block).cast("int").alias("homes")
    ).filter("homes > 0")
    sized = placed.join(F.broadcast(sizes), "cell")  # at most MOST_CELLS rows
    own = lambda blocks: F.pmod(F.xxhash64("id"), F.col(blocks)).cast("int")
    home = sized.filter("home").select(
        "cell", own("homes").alias("i"), F.explode(F.sequence(F.lit(0), F.col("members") - 1)).alias("j"), F.lit(0).alias("side"), "id", "copies", "embedding"
    )
    member = sized.select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("homes") - 1)).alias("i"), own("members").alias("j"), F.lit(1).alias("side"), "id", "copies", "embedding"
    )
    return home.unionByName(member).groupBy("cell", "i", "j", F.lit(threshold).alias("t"), F.lit(d).alias("d")).applyInArrow(_compare, "id long, links long, root long")


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and representatives of all embeddings at cosine 0.95. Edge cases as in ``near_vectors``."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
