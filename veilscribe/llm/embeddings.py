"""Embedding near-duplicates by int8 tile products with error bounds.

Each unit vector x is stored as s * q, q of int8, with the exact norm e of what that
leaves out.  For two vectors |x.y - s_x s_y q_x.q_y| <= e_x |s_y q_y| + e_y, so a tile
product of the int8 blocks says which pairs may reach the threshold.  Only those are
computed again, in double precision from the full vectors.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscribe.llm.graph import components, with_least
from veilscribe.llm.store import Workspace, free, get, groups, put, there

#: Numbers in a block of vectors, about; and blocks in a stripe at most.
BLOCK_NUMBERS, STRIPE = 1 << 18, 8
#: Rows of a tile product at a time.
_ROWS = 512
#: Float products of int8 vectors of so many components are still exact.
_EXACT_FLOAT = (1 << 24) // (127 * 127)


def units(lists) -> list[bytes | None]:
    """Each list of an Arrow column of doubles over its norm, as bytes; None where it is null, empty, zero, or not all finite numbers."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    ends = lists.offsets.to_numpy()
    first, size = ends[:-1], np.diff(ends)
    values = lists.values
    raw = values.fill_null(np.nan).to_numpy(zero_copy_only=False) if values.null_count else values.to_numpy()
    usable = size > 0
    if lists.null_count:
        usable &= lists.is_valid().to_numpy(zero_copy_only=False)
    out: list[bytes | None] = [None] * len(lists)
    for length in np.unique(size[usable]).tolist():
        rows = np.flatnonzero(usable & (size == length))
        for at in range(0, len(rows), 4096):
            some = rows[at : at + 4096]
            x = raw[first[some][:, None] + np.arange(length)]
            top = np.abs(x).max(axis=1)
            fine = np.isfinite(top) & (top > 0)
            some, x = some[fine], x[fine]
            # frexp keeps the scaling exact
            x = np.ldexp(x, -np.frexp(top[fine])[1][:, None])
            x = x / np.sqrt((x * x).sum(axis=1))[:, None] + 0.0
            for k, row in zip(some.tolist(), x, strict=True):
                out[k] = row.tobytes()
    return out


def quantise(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """q (int8), scale, the norm of the error and the norm of scale * q, by row; norms are rounded up."""
    scale = np.abs(units).max(axis=1) / 127
    q = np.rint(units / scale[:, None]).astype(np.int8)
    near = q * scale[:, None]
    up = 1 + 1e-12
    return q, scale, np.sqrt(((units - near) ** 2).sum(axis=1)) * up + 1e-15, np.sqrt((near**2).sum(axis=1)) * up


class Written:
    """The blocks of a folder by number; None for one that was never written."""

    def __init__(self, uri: str):
        self.uri = uri

    def block(self, number: int) -> Block | None:
        return Block(self.uri, number) if there(f"{self.uri}/{number:010d}.q.npz") else None


def _cell(cell: int, cells: np.ndarray, stripes: np.ndarray) -> tuple[int, int, int]:
    """Which length, left and right stripe a number of the work is: the pairs of stripes of each length, row by row."""
    ends = np.cumsum(cells)
    kind = int(np.searchsorted(ends, cell, side="right"))
    cell, n = cell - int(ends[kind] - cells[kind]), int(stripes[kind])
    left = n - 1 - (math.isqrt(8 * (n * (n + 1) // 2 - 1 - cell) + 1) - 1) // 2
    return kind, left, left + cell - (left * n - left * (left - 1) // 2)


class Block:
    """Distinct vectors of one dimension: their nodes, copies and quantised form; full vectors come when asked for."""

    def __init__(self, uri: str, number: int):
        with np.load(io.BytesIO(get(f"{uri}/{number:010d}.q.npz"))) as held:
            self.nodes, self.copies, self.q, self.scale, self.error, self.norm = (held[k] for k in ("nodes", "copies", "q", "scale", "error", "norm"))
        self.uri, self._full = f"{uri}/{number:010d}.full.npy", None

    @staticmethod
    def write(uri: str, number: int, nodes: np.ndarray, copies: np.ndarray, units: np.ndarray) -> None:
        q, scale, error, norm = quantise(units)
        np.savez(out := io.BytesIO(), nodes=nodes, copies=copies, q=q, scale=scale, error=error, norm=norm)
        np.save(full := io.BytesIO(), units)
        put(f"{uri}/{number:010d}.full.npy", full.getvalue())
        put(f"{uri}/{number:010d}.q.npz", out.getvalue())

    @property
    def full(self) -> np.ndarray:
        if self._full is None:
            self._full = np.load(io.BytesIO(get(self.uri)))
        return self._full


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact product of int8 rows; it is taken in floats, for which there is a fast one."""
    kind = np.float32 if a.shape[1] <= _EXACT_FLOAT else np.float64
    return a.astype(kind) @ b.astype(kind).T


def linked_pairs(a: Block, b: Block, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and b with a cosine of ``least`` or more, each pair once if a is b."""
    slack = 1e-9
    found = [(np.zeros(0, np.int64),) * 2]
    for at in range(0, len(a.nodes), _ROWS):
        rows = slice(at, at + _ROWS)
        product = _product(a.q[rows], b.q)
        room = least - slack - a.error[rows] * b.norm.max() - b.error.max()
        # no pair of the row can reach the threshold below this product
        lowest = np.where(room > 0, room / (a.scale[rows] * b.scale.max()), -np.inf)
        i, j = np.nonzero(product >= lowest[:, None])
        may = a.scale[at + i] * b.scale[j] * product[i, j] + a.error[at + i] * b.norm[j] + b.error[j] >= least - slack
        i, j = at + i[may], j[may]
        if a is b:
            i, j = i[i < j], j[i < j]
        sure = np.zeros(len(i), bool)
        for k in range(0, len(i), 1 << 14):
            part = slice(k, k + (1 << 14))
            sure[part] = (a.full[i[part]] * b.full[j[part]]).sum(axis=1) >= least
        found.append((i[sure], j[sure]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the least node of their component, for those that are not it."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new, least = label.copy(), np.minimum(label[a], label[b])
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, least: float = 0.95) -> DataFrame:
    """One row for each row of ``vectors``: id, n_links, component_id, kept.

    Every pair of rows with a cosine of ``least`` (above 0, at most 1) or more is linked,
    whatever else the rows hold.  n_links counts the other rows linked directly, copies
    too; component_id is the smallest id that links reach, the row's own included; kept
    says that the row's id is it.  Vectors that are null, empty, zero or hold a null or
    non-finite component link with nothing, and vectors of different lengths do not
    link.  A null id counts only where a component has no other; component_id is then
    null and the row is kept.  Rows that repeat an id are rows of their own.  An empty
    table gives no row.  Other columns are ignored; a result named like the id has an
    underscore after it.

    Vectors in the same direction, to the last bit, are reduced to one with their number
    by map-side aggregation.  The distinct ones are written as blocks of bounded size into
    the shared folder, and up to eight blocks are a stripe.  A task holds one stripe and
    takes the blocks of another one at a time, so that its memory is the same for any
    number of vectors; all pairs of stripes are seen.  It gives for each vector the number
    of its links and a star forest of them, never the pairs.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    spark, space = vectors.sparkSession, Workspace(vectors.sparkSession, "embeddings")
    source = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    kind = source.schema["id"].dataType.simpleString()
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def keyed(with_units: bool):
        def run(batches):
            for batch in batches:
                found = units(batch.column(1))
                columns = [batch.column(0), pa.array([None if x is None else xxhash.xxh128_digest(x) for x in found], pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(found, pa.binary())] * with_units], ["id", "key", *["unit"] * with_units])

        return source.mapInArrow(run, f"id {kind}, key binary" + ", unit binary" * with_units)

    rows = space.table(keyed(False), "rows")
    counted = keyed(True).filter("key IS NOT NULL").groupBy("key").agg(F.first("unit").alias("unit"), F.min("id").alias("least"), F.count("*").alias("copies"))
    classes = space.table(counted.withColumn("length", (F.octet_length("unit") / 8).cast("int")), "classes")
    # a row for each length of vectors
    sizes = sorted(map(tuple, classes.groupBy("length").agg(F.count("*")).collect()))
    lengths = np.array([length for length, _ in sizes], np.int64)
    blocks = np.array([-(-n // max(64, BLOCK_NUMBERS // length)) for length, n in sizes], np.int64)
    base = np.cumsum(blocks) - blocks
    stripe = np.clip(blocks // (4 * STRIPE), 1, STRIPE)
    stripes = -(-blocks // stripe)
    cells = stripes * (stripes + 1) // 2
    n_blocks, n_cells = max(1, int(blocks.sum())), int(cells.sum())
    uri = space.folder("blocks")

    def build(batches):
        for number, whole in groups(batches, "block"):
            raw = whole["unit"].to_pylist()
            nodes = (number << 32) + np.arange(len(raw))
            Block.write(uri, number, nodes, whole["copies"].to_numpy(), np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1))
            t = pa.Table.from_arrays([whole["key"], pa.array(nodes, pa.int64()), whole["least"], whole["copies"]], ["key", "node", "least", "copies"])
            yield from t.combine_chunks().to_batches()

    plan = spark.createDataFrame(zip(lengths.tolist(), base.tolist(), blocks.tolist(), strict=True), "length int, base long, blocks long")
    dealt = classes.join(F.broadcast(plan), "length").withColumn("block", F.col("base") + F.pmod(F.xxhash64("key"), F.col("blocks"))).select("key", "unit", "least", "copies", "block")
    width = min(n_blocks, max(4 * shuffles, -(-n_blocks // 64)))
    dealt = dealt.repartitionById(width, F.pmod("block", F.lit(width)).cast("int")).sortWithinPartitions("block", "key")
    nodes = space.table(dealt.mapInArrow(build, f"key binary, node long, least {kind}, copies long"), "nodes")
    # a hash may leave a block without vectors
    written = Written(uri)

    def tiles(batches):
        held, lefts = None, []
        for batch in batches:
            for cell in batch.column(0).to_pylist():
                kind_, left, right = _cell(cell, cells, stripes)
                first, last = int(base[kind_]), int(base[kind_] + blocks[kind_])
                names = lambda k: range(first + k * int(stripe[kind_]), min(last, first + (k + 1) * int(stripe[kind_])))  # noqa: B023, E731
                if held != (kind_, left):
                    held, lefts = (kind_, left), [b for n in names(left) if (b := written.block(n))]
                degrees, ends_a, ends_b = [np.zeros(len(a.nodes), np.int64) for a in lefts], [], []
                counted_nodes, counts = [], []
                for r, b in enumerate(lefts) if left == right else ((None, b) for n in names(right) if (b := written.block(n))):
                    degree = np.zeros(len(b.nodes), np.int64)
                    for k, a in enumerate(lefts if r is None else lefts[: r + 1]):
                        i, j = linked_pairs(a, b, least)
                        if not len(i):
                            continue
                        degrees[k] += np.bincount(i, b.copies[j], len(a.nodes)).astype(np.int64)
                        degree += np.bincount(j, a.copies[i], len(b.nodes)).astype(np.int64)
                        moved, root = _stars(a.nodes[i], b.nodes[j])
                        ends_a.append(moved)
                        ends_b.append(root)
                    counted_nodes.append(b.nodes[degree > 0])
                    counts.append(degree[degree > 0])
                for a, degree in zip(lefts, degrees, strict=True):
                    counted_nodes.append(a.nodes[degree > 0])
                    counts.append(degree[degree > 0])
                if not ends_a:
                    continue
                counted_nodes, counts = np.concatenate(counted_nodes), np.concatenate(counts)
                moved, root = _stars(np.concatenate(ends_a), np.concatenate(ends_b))
                n, m = len(counts), len(moved)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([counted_nodes, moved]), pa.int64()), pa.concat_arrays([pa.array(counts, pa.int64()), pa.nulls(m, pa.int64())]), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(root, pa.int64())])],
                    ["node", "links", "root"],
                )

    work = spark.range(0, n_cells, 1, max(1, min(n_cells, max(8 * shuffles, -(-n_cells // 64)))))
    found = space.table(work.mapInArrow(tiles, "node long, links long, root long"), "found")
    degrees = found.filter("links IS NOT NULL").groupBy(F.col("node").alias("counted")).agg(F.sum("links").alias("links"))
    linked = components(found.filter("root IS NOT NULL"), space, "node", "root")
    rooted = nodes.join(linked.withColumnRenamed("node", "of"), nodes["node"] == F.col("of")).select("node", "root", "least")
    moved = with_least(rooted, "root", "least", "component_id").select(F.col("node").alias("moved"), "component_id")
    classes = nodes.join(degrees, nodes["node"] == degrees["counted"], "left").join(moved, nodes["node"] == F.col("moved"), "left")
    classes = space.table(classes.select(F.col("key").alias("at"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.when(F.col("moved").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component")), "result")
    space.drop("blocks", "classes")
    out = rows.select("id", "key").join(classes, F.col("key") == F.col("at"), "left")
    component = F.when(F.col("at").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select("id", F.coalesce("links", F.lit(0)).cast("long"), component, F.col("id").eqNullSafe(component)).toDF(id_col, *free([id_col], "n_links", "component_id", "kept"))
