"""Near-equal vectors by an exact metric range join.

On unit vectors a cosine of at least c is a distance of at most r = sqrt(2 - 2c). Vectors
of a label go to the cell of their nearest pivot. If y lives in cell j and x in cell i,
and they are within r, then by the triangle inequality d(x, j) - d(x, i) <= 2r, and
d(x, j) <= r + the radius of j: x visits the cells that meet both. Cells join on their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import pick
from faultline.llm.links import components
from faultline.session import materialize

# Vectors of a label for each of its pivots, and pivots of a label and of all labels at most.
CELL_ROWS, LABEL_PIVOTS, PIVOTS = 2048, 256, 8192
# Vectors of a cell that one task compares with as many others, and rows of a product.
CHUNK_ROWS, PRODUCT_ROWS = 4096, 512
# Room for rounding in the bounds; the cosine itself decides.
SLACK = 1e-9


def _unit(vector) -> bytes | None:
    """The direction of a vector, None where it has none."""
    if vector is None or not len(vector):
        return None
    values = np.array([math.nan if v is None else v for v in vector], dtype=np.float64)
    if not np.isfinite(values).all() or not values.any():
        return None
    values = values / np.abs(values).max()  # so that squares neither vanish nor overflow
    return (values / math.sqrt(float(values @ values)) + 0.0).astype("<f8").tobytes()


def _units(vectors: pd.Series) -> pd.Series:
    return pd.Series([_unit(v) for v in vectors], dtype=object)


def _matrix(units: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(units), dtype="<f8").reshape(len(units), -1)


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (rows @ pivots.T)))


def linked(rows: pd.DataFrame, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Within a block: how many vectors each is linked to, and the place of its component's first.

    ``rows`` has unit, copies, home and side (0 or 1); pairs are those across the two sides,
    or all if there is one side, with a vector at home in the cell among them.
    """
    matrix = _matrix(rows["unit"])
    copies, home = rows["copies"].to_numpy(), rows["home"].to_numpy()
    side = rows["side"].to_numpy()
    one = bool((side == side[0]).all())
    left = np.arange(len(rows)) if one else np.flatnonzero(side == 0)
    right = left if one else np.flatnonzero(side == 1)
    counts = np.zeros(len(rows), dtype=np.int64)
    root = np.arange(len(rows))
    for k in range(0, len(left), PRODUCT_ROWS):
        some = left[k : k + PRODUCT_ROWS]
        others = right[k + 1 :] if one else right
        near = matrix[some] @ matrix[others].T >= cosine
        near &= home[some][:, None] | home[others][None, :]
        a, b = np.nonzero(near)
        a, b = some[a], others[b]
        if one:
            a, b = a[a < b], b[a < b]
        counts += np.bincount(a, copies[b], len(rows)).astype(np.int64)
        counts += np.bincount(b, copies[a], len(rows)).astype(np.int64)
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                break
            np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while (root[root] != root).any():
                root = root[root]
    return counts, root


def near_vectors(vectors: DataFrame, cosine: float = 0.98, seed: int = 10) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors of one label and one length are linked where their cosine, in double precision,
    is ``cosine`` or more. A null label, or a vector that is null, empty, zero or holds a
    null or non-finite component, links with nothing. n_links counts the other vectors
    linked directly, component_id is the smallest vec_id reachable (a null vec_id has a
    null one and is not kept); kept is the vector that gives its component its id. Rows that
    repeat a vec_id are counted as vectors. An empty table gives an empty result.

    Equal directions of a label are folded to one vector with a count before anything is
    compared. A cell that many vectors call home or visit is cut into chunks, each pair of
    which is one task, so memory is bounded; a task returns counts and a spanning forest,
    never pairs. The driver sees the number of vectors of large labels, and radii.
    """
    spark = vectors.sparkSession
    plain = pick(vectors, "vec_id", "embedding", "label", vec_id="long", embedding="array<double>", label="long")
    plain = plain.select("vec_id", "label", F.pandas_udf(_units, "binary")("embedding").alias("unit"))
    plain = plain.withColumn("key", F.when(F.col("label").isNotNull(), F.unhex(F.md5("unit"))))
    plain = materialize(plain.withColumn("size", F.octet_length("unit")), "vectors")
    group = ["label", "size"]
    classes = plain.where("key IS NOT NULL").groupBy(*group, "key").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min("unit").alias("unit")
    )
    #: A class without any vec_id takes no part in components but counts as links.
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    sizes = classes.groupBy(*group).count().where(F.col("count") > CELL_ROWS)
    large = sizes.orderBy(F.desc("count"), *group).limit(PIVOTS // 2).collect()
    wanted, room = {}, PIVOTS
    for label, size, count in large:
        wanted[label, size] = min(LABEL_PIVOTS, math.ceil(count / CELL_ROWS), room)
        room -= wanted[label, size]
    by_hash = Window.partitionBy(*group).orderBy(F.xxhash64(F.lit(seed), "key"), "key")
    ranked = classes.join(F.broadcast(sizes.orderBy(F.desc("count"), *group).limit(PIVOTS // 2)), group)
    ranked = ranked.withColumn("rank", F.row_number().over(by_hash)).where(F.col("rank") <= LABEL_PIVOTS)
    pivots: dict[tuple, list] = {k: [] for k, n in wanted.items() if n > 1}
    for row in ranked.select(*group, "rank", "unit").orderBy("rank").collect() if pivots else []:
        place = row["label"], row["size"]
        if place in pivots and row["rank"] <= wanted[place]:
            pivots[place].append(np.frombuffer(row["unit"], dtype="<f8"))
    sent = spark.sparkContext.broadcast({k: np.stack(v) for k, v in pivots.items()})  # at most PIVOTS vectors
    reach = math.sqrt(max(0.0, 2.0 - 2.0 * cosine)) + SLACK

    def homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell, far = np.zeros(len(batch), dtype=np.int32), np.zeros(len(batch))
            for place, rows in batch.groupby(group).indices.items():
                if place in sent.value:
                    distance = _distances(_matrix(batch["unit"].iloc[rows]), sent.value[place])
                    cell[rows] = distance.argmin(axis=1)
                    far[rows] = distance.min(axis=1)
            yield pd.DataFrame({**{c: batch[c] for c in group}, "cell": cell, "far": far})

    at_home = classes.select(*group, "unit").mapInPandas(homes, "label long, size int, cell int, far double")
    radii = at_home.where(F.col("far") > 0).groupBy(*group, "cell").agg(F.max("far").alias("far"))
    radius = {(r[0], r[1], r[2]): r[3] for r in (radii.collect() if pivots else [])}  # at most PIVOTS rows

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(cell=0, home=True) if not sent.value else _placed(batch)

    def _placed(batch: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for place, rows in batch.groupby(group).indices.items():
            some = batch.iloc[rows]
            if place not in sent.value:
                parts.append(some.assign(cell=0, home=True))
                continue
            distance = _distances(_matrix(some["unit"]), sent.value[place])
            cell = distance.argmin(axis=1)
            parts.append(some.assign(cell=cell, home=True))
            limits = np.array([radius.get((*place, j), 0.0) for j in range(distance.shape[1])])
            visit = (distance - distance.min(axis=1)[:, None] <= 2 * reach) & (distance <= limits + reach)
            # A pair of two cells is compared in the later one.
            visit &= np.arange(distance.shape[1])[None, :] > cell[:, None]
            who, where = np.nonzero(visit)
            parts.append(some.iloc[who].assign(cell=where, home=False))
        return pd.concat(parts) if parts else batch.assign(cell=0, home=True)

    kinds = "label long, size int, node long, copies long, unit binary, cell int, home boolean"
    placed = classes.select(*group, "node", "copies", "unit").mapInPandas(visits, kinds)
    placed = materialize(placed, "vector-cells")
    chunks = placed.groupBy(*group, "cell").agg(F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias("chunks"))
    cut = placed.join(chunks, [*group, "cell"])
    own = F.pmod(F.xxhash64(F.lit(f"{seed}:chunk"), "node"), F.col("chunks")).cast("int")
    cut = cut.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cut = cut.withColumns({"first": F.least("own", "other"), "second": F.greatest("own", "other")})
    cut = cut.withColumn("side", (F.col("own") > F.col("first")).cast("int"))

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", kind="stable").reset_index(drop=True)
        if rows["first"].iloc[0] != rows["second"].iloc[0] and rows["side"].nunique() < 2:
            return pd.DataFrame({"node": [], "links": [], "root": []})
        counts, root = linked(rows, cosine)
        nodes = rows["node"].to_numpy()
        some = counts > 0
        return pd.DataFrame({"node": nodes[some], "links": counts[some], "root": nodes[root[some]]})

    columns = ["node", "unit", "copies", "home", "side", "first", "second"]
    found = cut.select(*group, "cell", *columns).groupBy(*group, "cell", "first", "second")
    found = materialize(found.applyInPandas(block, "node long, links long, root long"), "vector-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    whole = classes.select(*group, "key", "node", "rep", "copies").join(links, "node", "left")
    whole = whole.join(parts.withColumnRenamed("id", "node"), "node", "left")
    whole = whole.withColumn("component", F.coalesce("component", "node"))
    first = whole.groupBy("component").agg(F.min("rep").alias("component_id"))
    whole = whole.join(first, "component").select(
        *group, "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    alone = plain.where("key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    members = plain.where("key IS NOT NULL").select(*group, "key", "vec_id")
    members = members.join(whole, [*group, "key"]).select("vec_id", "n_links", "component_id")
    result = members.unionByName(alone)
    component = F.when(F.col("vec_id").isNotNull(), F.col("component_id"))
    result = result.withColumn("component_id", component)
    return result.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r AS (
    SELECT vec_id, vec_id AS c FROM embeddings
    UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.c = l.a
), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(any_value(n.n), 0)::BIGINT AS n_links, min(r.c) AS component_id,
       e.vec_id = min(r.c) AS kept
FROM embeddings e JOIN r ON r.vec_id = e.vec_id LEFT JOIN n ON n.a = e.vec_id
GROUP BY e.vec_id
"""
