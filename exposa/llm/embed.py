"""Near-duplicate vectors from randomised-rotation binary codes.

A vector's code is the signs of its coordinates after a random rotation; its stored correction
factor f is the inner product of the rotated unit vector with its own code (scaled to unit
length), so the angle between the two is acos(f).  By the triangle inequality of angles a vector
q whose angle to x is at most t has <code, q> >= cos(acos(f) + t).  Only pairs that reach this
bound are computed exactly, in double precision, and only those that then reach the threshold
are links.  The bound holds always, so it loses no pair.

Which pairs are estimated: every vector has its home in the cell of its nearest pivot (vectors
drawn from the table), and visits every cell of a lower number that can be the home of a vector
within the threshold's angle t.  If y lies at home with pivot q, then <y, p - q> <= 0 for any
other pivot p, and a vector x within t of y has <x, p - q> <= sin(t) |p - q|; x visits the cells
that fulfil this for its own p.  So of any two vectors within t one meets the other at home, in
one cell only: no pair is lost or counted twice, whatever the data.  Vectors without any
structure (unrelated directions in many dimensions) visit most cells, which amounts to a
comparison of all codes.

Equal vectors count once, with their number.  Home and visitors of a cell are dealt out in
parts, and a tile holds two parts, so a cell that fills a third of the table is many tasks; a
task gives out sums of links and a link to one vector a member, never its pairs.

Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing,
not even with copies of themselves; vectors of unequal lengths never link.  Rows that repeat are
vectors of their own.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposa.llm.components import components
from exposa.llm.tables import cut, shuffle_partitions

PARTS = 48


def rotations(d: int, count: int, seed: int = 7) -> np.ndarray:
    """``count`` random rotations of d dimensions, side by side (d x count * d)."""
    rng = np.random.default_rng([seed, d])
    parts = []
    for _ in range(count):
        q, r = np.linalg.qr(rng.standard_normal((d, d)))
        parts.append(q * np.sign(np.diag(r)))
    return np.concatenate(parts, axis=1)


def part_rows(n: int, d: int, most: int) -> int:
    """Vectors of a part: ``most``, or more where a vector would be copied over ``PARTS`` times, in 16 MB."""
    return max(most, min(-(-n // PARTS), (16 << 20) // (8 * d)))


def _pivots(classes: DataFrame, counts: dict[int, int], most: int, width: str) -> dict[int, np.ndarray]:
    """Up to ``PARTS`` unit vectors of each length that fills more than one part."""
    wanted = {d: -(-n // part_rows(n, d, most)) for d, n in counts.items()}
    wanted = {d: k for d, k in wanted.items() if k > 1}
    if not wanted:
        return {}
    chance = F.create_map(*[F.lit(x) for d, k in wanted.items()
                            for x in (d, int(min(1.0, 4 * min(k, PARTS) / counts[d]) * (1 << 30)))])
    drawn = classes.where(F.col("d").isin(*wanted)) \
        .where(F.pmod(F.xxhash64("digest", F.lit(11)), F.lit(1 << 30)) < F.element_at(chance, F.col("d"))) \
        .select("d", "digest", "vec").collect()
    out = {}
    for d, k in wanted.items():
        own = sorted((bytes(r["digest"]), bytes(r["vec"])) for r in drawn if r["d"] == d)[:min(k, PARTS)]
        if len(own) > 1:
            out[d] = unit([v for _, v in own], d, width)
    return out


def homes_and_visits(x: np.ndarray, pivots: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each unit vector, and (vectors x cells) the cells of lower number that it visits."""
    near = x @ pivots.T
    home = near.argmax(axis=1)
    gap = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0.0))      # |p - q|
    reach = math.sqrt(1 - threshold * threshold) if threshold > 0 else 1.0
    inside = near.max(axis=1)[:, None] - near <= (reach + 1e-7) * gap[home] + 1e-7
    return home, inside & (np.arange(len(pivots)) < home[:, None])


def unit(raw: list[bytes], d: int, width: str) -> np.ndarray:
    """Unit vectors in double precision of raw components (``width``: f4 or f8)."""
    x = np.frombuffer(b"".join(raw), width).reshape(-1, d).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] + 0.0


def _read(rows: DataFrame, width: str) -> DataFrame:
    """(id, digest, d, vec): components as bytes; digest (of the unit vector), d and vec are null for
    unusable vectors."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            out = []
            for v in batch.column("v").to_pylist():
                x = None if v is None or not len(v) or None in v else np.array(v, np.float64)
                if x is not None and np.isfinite(x).all() and (x != 0).any():
                    raw = x.astype(width).tobytes()
                    own = unit([raw], len(x), width).tobytes()
                    out.append((hashlib.blake2b(own, digest_size=16).digest(), len(x), raw))
                else:
                    out.append((None, None, None))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([o[0] for o in out], pa.binary()),
                 pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary())],
                names=["id", "digest", "d", "vec"])

    return rows.mapInArrow(run, f"id {kind}, digest binary, d int, vec binary")


def _codes(classes: DataFrame, pivots: dict[int, np.ndarray], threshold: float, width: str) -> DataFrame:
    """Adds factor, code (packed signs), home (cell) and visits (cells)."""
    def run(batches):
        import pyarrow as pa
        turn: dict[int, np.ndarray] = {}
        for batch in batches:
            ds = np.array(batch.column("d").to_pylist(), np.int64)
            vecs = batch.column("vec").to_pylist()
            factor, code, home, visits = [0.0] * len(vecs), [b""] * len(vecs), [0] * len(vecs), [[]] * len(vecs)
            for d in np.unique(ds).tolist():
                if d not in turn:
                    turn[d] = rotations(d, 1)
                at = np.flatnonzero(ds == d).tolist()
                x = unit([vecs[i] for i in at], d, width)
                turned = x @ turn[d]
                f = np.abs(turned).sum(1) / math.sqrt(d)
                packed = np.packbits(turned >= 0, axis=1)
                if d in pivots:
                    cell, to = homes_and_visits(x, pivots[d], threshold)
                for k, i in enumerate(at):
                    factor[i], code[i] = float(f[k]), packed[k].tobytes()
                    if d in pivots:
                        home[i], visits[i] = int(cell[k]), np.flatnonzero(to[k]).tolist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(factor), pa.array(code, pa.binary()), pa.array(home, pa.int32()),
                 pa.array(visits, pa.list_(pa.int32()))],
                names=[*batch.schema.names, "factor", "code", "home", "visits"])

    return classes.mapInArrow(run, "node bigint, d int, n bigint, vec binary, factor double, code binary, "
                                   "home int, visits array<int>")


def close_pairs(x, sign, factor, threshold: float, turned: np.ndarray, rows: np.ndarray,
                cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of ``rows`` with ``cols``) at the threshold: estimated from codes, bounded, then exact.

    turned: the rotated vectors of ``cols``."""
    d = x.shape[1]
    estimate = (sign[rows] @ turned.T) / np.float32(math.sqrt(d))
    angle = np.arccos(np.minimum(factor[rows], 1.0)) + math.acos(max(-1.0, min(1.0, threshold)))
    a, b = np.nonzero(estimate >= (np.cos(np.minimum(angle, math.pi)) - 1e-4)[:, None])
    a, b = rows[a], cols[b]
    ok = np.zeros(len(a), bool)
    for at in range(0, len(a), 1 << 16):
        s = slice(at, at + (1 << 16))
        ok[s] = np.einsum("ij,ij->i", x[a[s]], x[b[s]]) >= threshold
    return a[ok], b[ok]


def _tile(x, sign, factor, n, side, threshold, turn):
    """Links of each member counted here, and the least member it joins."""
    size = len(x)
    within = not side.any()                       # one part against itself, else only pairs across
    rows, cols = (np.arange(size),) * 2 if within else (np.flatnonzero(side == 0), np.flatnonzero(side))
    links, label = np.zeros(size, np.int64), np.arange(size)
    turned = (x[cols] @ turn).astype(np.float32)
    found_a, found_b = [rows[:0]], [rows[:0]]
    for at in range(0, len(rows), 256):
        skip = at if within else 0
        a, b = close_pairs(x, sign, factor, threshold, turned[skip:], rows[at:at + 256], cols[skip:])
        if within:
            keep = a < b
            a, b = a[keep], b[keep]
        np.add.at(links, a, n[b])
        np.add.at(links, b, n[a])
        found_a.append(a)
        found_b.append(b)
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    while len(a):
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            break
    return links, label


def near_duplicates(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", threshold: float = 0.95,
                    most: int = 2048) -> DataFrame:
    """(id, n_links, component_id, kept): vectors linked directly, least id reachable by links."""
    spark = vectors.sparkSession
    width = "f4" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "f8"
    rows = cut(_read(vectors.select(vectors[id].alias("id"), vectors[vector].alias("v")), width))
    classes = cut(rows.where("digest is not null").groupBy("digest").agg(
        F.min("id").alias("least"), F.count("*").alias("n"), F.first("d").alias("d"), F.first("vec").alias("vec"))
        .withColumn("node", F.monotonically_increasing_id()))
    counts = {r["d"]: r["count"] for r in classes.groupBy("d").count().where(F.col("count") > most).collect()}
    pivots = _pivots(classes, counts, most, width)
    coded = cut(_codes(classes.select("node", "d", "n", "vec"), pivots, threshold, width))
    in_cells = coded.select("*", F.explode(F.concat(
        F.array(F.struct(F.col("home").alias("cell"), F.lit(0).alias("visitor"))),
        F.transform("visits", lambda q: F.struct(q.alias("cell"), F.lit(1).alias("visitor"))))).alias("c")) \
        .drop("home", "visits").select("*", "c.*").drop("c")
    found = in_cells.where(F.col("d").isin(*counts)).groupBy("d", "cell").agg(
        F.sum(1 - F.col("visitor")).alias("homes"), F.sum("visitor").alias("visits")).collect()
    parts = {d: part_rows(n, d, most) for d, n in counts.items()}
    sizes = F.broadcast(spark.createDataFrame(
        [(r["d"], r["cell"], -(-r["homes"] // parts[r["d"]]), -(-r["visits"] // parts[r["d"]])) for r in found],
        "d int, cell int, homes int, visits int"))
    # tiles of a cell: any two parts of its home (kind 0), any part of it with any of the visitors (kind 1)
    tiles = in_cells.join(sizes, ["d", "cell"], "left").fillna({"homes": 1, "visits": 0}) \
        .withColumn("part", F.pmod(F.xxhash64("node"), F.when(F.col("visitor") == 1, F.col("visits"))
                                   .otherwise(F.greatest("homes", F.lit(1)))).cast("int")) \
        .withColumn("tile", F.explode(F.expr("""
            if(visitor = 1,
               transform(filter(sequence(0, homes), i -> i < homes),
                         i -> struct(1 AS kind, i AS a, part AS b, 1 AS side)),
               concat(transform(filter(sequence(0, homes), i -> i < homes),
                                i -> struct(0 AS kind, least(part, i) AS a, greatest(part, i) AS b, int(i < part) AS side)),
                      transform(filter(sequence(0, visits), j -> j < visits),
                                j -> struct(1 AS kind, part AS a, j AS b, 0 AS side))))""")))
    order = ["d", "cell", "kind", "a", "b"]
    tiles = tiles.select("d", "cell", "tile.*", "node", "n", "vec", "factor", "code") \
        .repartition(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    found = cut(tiles.mapInArrow(_tiles(threshold, width), "node bigint, links bigint, root bigint"))
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    of_node = joined.join(classes.select("node", "least"), "node")
    of_root = of_node.groupBy("root").agg(F.min("least").alias("least_of_all"))
    roots = of_node.join(of_root, "root").select("node", "least_of_all")
    result = classes.select("digest", "node", "least", "n").join(linked, "node", "left").join(roots, "node", "left") \
        .select(F.hex("digest").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                F.coalesce("least_of_all", "least").alias("component"))
    out = rows.select("id", F.hex("digest").alias("class")).join(result, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                      component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _tiles(threshold: float, width: str):
    """Task: sorted members of tiles to (node, links, root) of those that have links."""
    def work(group):
        import pyarrow as pa
        d, side = group.column("d")[0].as_py(), group.column("side").to_numpy()
        if (group.column("kind")[0].as_py() or group.column("a")[0] != group.column("b")[0]) and side.min() == side.max():
            return                                # the other part is empty
        x = unit(group.column("vec").to_pylist(), d, width)
        packed = np.frombuffer(b"".join(group.column("code").to_pylist()), np.uint8).reshape(len(x), -1)
        sign = np.unpackbits(packed, axis=1)[:, :d] * np.float32(2) - np.float32(1)
        node = group.column("node").to_numpy()
        if d not in turned:
            turned[d] = rotations(d, 1)
        links, label = _tile(x, sign, group.column("factor").to_numpy(), group.column("n").to_numpy(), side, threshold,
                             turned[d])
        has = np.flatnonzero(links)
        if len(has):
            yield pa.RecordBatch.from_arrays([pa.array(node[has]), pa.array(links[has]), pa.array(node[label[has]])],
                                             names=["node", "links", "root"])

    turned: dict[int, np.ndarray] = {}

    def run(batches):
        import pyarrow as pa
        tail = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            now = pa.concat_tables([tail, now]).combine_chunks() if tail is not None else now
            key = np.stack([now.column(c).to_numpy() for c in ("d", "cell", "kind", "a", "b")])
            cuts = np.concatenate(([0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if b - a > 1:
                    yield from work(now.slice(a, b - a))
            tail = now.slice(int(cuts[-1]))
        if tail is not None and tail.num_rows > 1:
            yield from work(tail)

    return run
