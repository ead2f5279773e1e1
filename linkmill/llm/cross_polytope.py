"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations (operator 6).

A vector is scaled to length one and padded to a power of two. Three rounds of random signs and a
fast Hadamard transform rotate it; its hash is the axis, with sign, that it lies closest to. A bucket
of a table is named by ``functions`` such hashes. A vector stands in its own bucket of each table and
is also probed into the buckets that come next: each function's second axis in turn. Candidates of a
bucket are verified by cosine in double precision.

Equal vectors are one class, counted before any bucket is made. A bucket of many classes is cut into
blocks, and each pair of blocks is a group of its own, so that no task gets a whole hot bucket. Within
a group all cosines are one matrix product; what leaves it is a count and a root per member, not the
pairs. A pair that meets in several buckets is counted in the first one only, which both sides'
hashes tell.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and those
without a label, link with nothing; vectors of different lengths do not link; repeated rows with one
id are one vector each and link with one another; a null id keeps its row, with a null component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkmill.llm.components import component_labels, contracted
from linkmill.llm.pretoken import mixed
from linkmill.llm.runtime import blobs, staged

COSINE = 0.98
TABLES, FUNCTIONS, PROBES, SEED = 8, 2, 2, 1
#: Mean number of classes in a bucket beyond which another function is added, and four tables with it.
BUCKET = 256
BLOCK = 1024
#: Rows of a group that are multiplied with all of it at once; bounds the pairs held.
STEP = 64


def signs(size: int, table: int, function: int, turn: int, seed: int) -> np.ndarray:
    key = np.uint64(((seed * 1000 + table) * 100 + function) * 10 + turn + 1) << np.uint64(32)
    return np.where(mixed(key + np.arange(size, dtype=np.uint64)) >> np.uint64(63), 1.0, -1.0)


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width = x.shape
    h = 1
    while h < width:
        y = x.reshape(n, width // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(n, width)
        h *= 2
    return x


def bucket_names(unit: np.ndarray, tables: int, functions: int, probes: int, seed: int) -> np.ndarray:
    """For each vector and table its bucket and the probed ones: (n, tables, 1 + probes)."""
    n, dim = unit.shape
    width = 1 << max(1, (dim - 1).bit_length())
    x = np.zeros((n, width))
    x[:, :dim] = unit
    out = np.zeros((n, tables, 1 + probes), dtype=np.int64)
    for t in range(tables):
        best, second, gap = (np.zeros((n, functions), dtype=float if k == 2 else np.int64) for k in range(3))
        for f in range(functions):
            y = x
            for turn in range(3):
                y = hadamard(y * signs(width, t, f, turn, seed))
            size = np.abs(y)
            two = np.argpartition(size, width - 2, axis=1)[:, width - 2 :]
            value = np.take_along_axis(size, two, 1)
            two = np.where((value[:, :1] > value[:, 1:]) | ((value[:, :1] == value[:, 1:]) & (two[:, :1] < two[:, 1:])), two, two[:, ::-1])
            code = 2 * two + (np.take_along_axis(y, two, 1) < 0)
            best[:, f], second[:, f] = code[:, 0], code[:, 1]
            gap[:, f] = np.abs(value[:, 0] - value[:, 1])
        order = np.argsort(gap, axis=1, kind="stable")
        for p in range(1 + probes):
            codes = best.copy()
            if p:
                f = order[:, (p - 1) % functions]
                codes[np.arange(n), f] = second[np.arange(n), f]
            name = np.zeros(n, dtype=np.int64)
            for f in range(functions):
                name = name * (2 * width) + codes[:, f]
            out[:, t, p] = name
    return out


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, label, dim and the vector's bytes in double precision; dim 0: it links with nothing."""
    for batch in batches:
        column = batch["embedding"]
        flat = column.flatten()
        size = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
        value = np.asarray(pc.fill_null(flat.cast(pa.float64()), float("nan")))
        bounds = np.append(0, np.cumsum(size))
        bad = np.append(0, np.cumsum(~np.isfinite(value)))
        some = np.append(0, np.cumsum(np.where(np.isfinite(value), value != 0, False)))
        good = (bad[bounds[1:]] == bad[bounds[:-1]]) & (some[bounds[1:]] > some[bounds[:-1]]) & np.asarray(batch["label"].is_valid())
        kept = value[np.repeat(good, size)] + 0.0
        dim = np.where(good, size, 0)
        yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], pa.array(dim, pa.int32()), blobs(kept.view(np.uint8), np.append(0, np.cumsum(dim)) * 8)], names=["vec_id", "label", "dim", "vector"])


def unit_rows(column: pa.Array, dim: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(len(column), dim)
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)  # no overflow or underflow of squares
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _entries(batches: Iterator[pa.RecordBatch], tables: int, functions: int, probes: int, seed: int) -> Iterator[pa.RecordBatch]:
    """A row for each class and bucket."""
    for batch in batches:
        dims = np.asarray(batch["dim"])
        for dim in np.unique(dims).tolist():
            part = batch.filter(pa.array(dims == dim))
            for k in range(0, part.num_rows, 2048):
                rows = part.slice(k, 2048)
                names = bucket_names(unit_rows(rows["vector"], dim), tables, functions, probes, seed)
                n, each = rows.num_rows, tables * (1 + probes)
                take = pa.array(np.repeat(np.arange(n), each))
                table = np.tile(np.repeat(np.arange(tables), 1 + probes), n)
                own = np.tile(np.arange(1 + probes) == 0, n * tables)
                codes = blobs(np.repeat(names.reshape(n, -1), each, axis=0).reshape(-1).view(np.uint8), np.arange(n * each + 1) * (each * 8))
                wide = rows.take(take)
                yield pa.RecordBatch.from_arrays([wide["label"], wide["dim"], pa.array(table, pa.int32()), pa.array(names.reshape(-1), pa.int64()), pa.array(own), wide["id"], wide["copies"], wide["vector"], codes], names=["label", "dim", "bin", "bucket", "own", "id", "copies", "vector", "codes"])


def group_links(ids, vectors, codes, own, side, at: int, bucket: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one group that link and are counted here. side: the block of each member (0, 1; 2 both)."""
    found_i, found_j = [], []
    n = len(ids)
    for s in range(0, n, STEP):
        product = vectors[s : s + STEP] @ vectors.T
        i, j = np.nonzero(product >= cosine)
        i += s
        # Each pair once: by id; of two blocks only pairs across them; not two that are probed here.
        ok = (ids[i] < ids[j]) & (own[i] | own[j]) & ((side[i] == 2) | (side[i] != side[j]))
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        a, b = codes[i], codes[j]  # (pairs, tables, 1 + probes)
        before = np.zeros(len(i), dtype=bool)
        for t in range(at + 1):
            same = a[:, t, 0] == b[:, t, 0]
            left = (a[:, t, :1] == b[:, t, 1:]).any(axis=1)  # b is probed into a's bucket
            right = (b[:, t, :1] == a[:, t, 1:]).any(axis=1)
            if t < at:
                before |= same | left | right
            else:
                big = np.iinfo(np.int64).max
                first = np.where(same, a[:, t, 0], np.minimum(np.where(left, a[:, t, 0], big), np.where(right, b[:, t, 0], big)))
                before |= first != bucket
        found_i.append(i[~before])
        found_j.append(j[~before])
    none = np.zeros(0, np.int64)
    return np.concatenate(found_i or [none]), np.concatenate(found_j or [none])


def _linked(batches: Iterator[pa.RecordBatch], tables: int, probes: int, cosine: float) -> Iterator[pa.RecordBatch]:
    """Groups come sorted; a row for each member that links: id, links (copies counted), root."""
    key = ["label", "dim", "bin", "bucket", "low", "high"]
    held: list[pa.RecordBatch] = []

    def groups(part: pa.Table) -> Iterator[pa.RecordBatch]:
        part = part.combine_chunks()
        keys = [np.asarray(part[c]) for c in key]
        edge = np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0)))
        ends = np.append(edge[1:], part.num_rows)
        ids_all, copies_all, own_all, block_all = (np.asarray(part[c]) for c in ("id", "copies", "own", "block"))
        for s, e in zip(edge.tolist(), ends.tolist(), strict=True):
            if e - s < 2:
                continue
            rows = part.slice(s, e - s)
            _, once = np.unique(np.stack([ids_all[s:e], ~own_all[s:e]]), axis=1, return_index=True)
            ids, first = np.unique(ids_all[s:e][once], return_index=True)  # a class that is there twice counts as its own
            pick = once[first]
            if len(pick) < 2:
                continue
            dim = int(keys[1][s])
            vectors = unit_rows(rows["vector"].combine_chunks().take(pa.array(pick)), dim)
            raw = np.frombuffer(b"".join(rows["codes"].combine_chunks().take(pa.array(pick)).to_pylist()), np.int64).reshape(len(pick), tables, 1 + probes)
            low, high = int(keys[4][s]), int(keys[5][s])
            side = np.full(len(pick), 2) if low == high else (block_all[s:e][pick] == high).astype(int)
            i, j = group_links(ids, vectors, raw, own_all[s:e][pick], side, int(keys[2][s]), int(keys[3][s]), cosine)
            if not len(i):
                continue
            copies = copies_all[s:e][pick]
            count = np.bincount(i, weights=copies[j], minlength=len(ids)) + np.bincount(j, weights=copies[i], minlength=len(ids))
            node, root = contracted(ids[i], ids[j])
            roots = ids.copy()
            roots[np.searchsorted(ids, node)] = root
            some = count > 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[some], pa.int64()), pa.array(count[some].astype(np.int64), pa.int64()), pa.array(roots[some], pa.int64())], names=["id", "links", "root"])

    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= 20_000:
            part = pa.Table.from_batches(held)
            last = [part[c][-1] for c in key]
            same = np.ones(part.num_rows, dtype=bool)
            for c, v in zip(key, last, strict=True):
                same &= np.asarray(part[c]) == v.as_py()
            stop = part.num_rows - int(same.sum())
            if stop:
                yield from groups(part.slice(0, stop))
            held = part.slice(stop).to_batches()
            size = 0
    if held:
        yield from groups(pa.Table.from_batches(held))


def near_vectors(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, tables: int = TABLES, functions: int = FUNCTIONS, probes: int = PROBES, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept: see the module's docstring and the contract of op6."""
    plain = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    prepared = staged(plain.mapInArrow(_prepared, "vec_id long, label long, dim int, vector binary"), "vectors")
    usable = prepared.where("dim > 0 and vec_id is not null")
    classes = staged(usable.groupBy("label", "dim", "vector").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")), "classes")
    shape = classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"), F.min("dim").alias("dim")).first()
    if shape.n:
        width = 2 << max(1, (shape.dim - 1).bit_length())
        more = max(0, math.ceil(math.log(max(1.0, shape.n / BUCKET), width)) - functions)
        functions, tables = functions + more, tables + 4 * more
    entries = classes.mapInArrow(lambda b: _entries(b, tables, functions, probes, seed), "label long, dim int, bin int, bucket long, own boolean, id long, copies long, vector binary, codes binary")
    entries = staged(entries, "entries")
    key = ["label", "dim", "bin", "bucket"]
    sizes = entries.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("any")).where("n > 1 and any")
    sizes = sizes.select(*key, F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    met = entries.join(sizes, key).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("blocks", "other")
    group = [*key, "low", "high"]
    linked = met.repartition(*group).sortWithinPartitions(*group).mapInArrow(lambda b: _linked(b, tables, probes, cosine), "id long, links long, root long")
    linked = staged(linked, "linked")
    links = linked.groupBy("id").agg(F.sum("links").alias("links"))
    labels = component_labels(linked.select(F.col("id").alias("u"), F.col("root").alias("v"))).withColumnRenamed("label", "reached")
    answers = classes.join(links, "id", "left").join(labels, F.col("id") == F.col("node"), "left")
    answers = answers.select(*(F.col(c).alias(f"of_{c}") for c in ("label", "dim", "vector")), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("reached", "id").alias("component_id"))
    same = (F.col("label") == F.col("of_label")) & (F.col("dim") == F.col("of_dim")) & (F.col("vector") == F.col("of_vector")) & F.col("vec_id").isNotNull()
    out = prepared.join(answers, same, "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
