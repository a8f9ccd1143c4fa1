"""Embedding near-duplicates by a forest of random-projection trees with spill.

1. Equal vectors of a label are one class; from here on a class stands for its copies.
2. A forest of ``TREES`` trees, each over all classes of a label. A node splits on the projection on a random direction
   that its place in the tree gives, in the middle half at the place with the fewest classes within the spill; these go
   both ways. A node of which too many would is a leaf: its vectors are too close to be told apart. Two unit
   vectors with cosine ``c`` differ by at most ``sqrt(2 - 2c)`` and, along a random direction, by that over the square root
   of the dimension in root mean square; the spill is ``SPILL`` of this. So a pair is rarely cut in one tree and hardly
   ever in all, and few classes go both ways. Splits recurse until leaves hold at most ``LEAF`` classes, whatever their
   number: nodes of more than ``TASK_BYTES`` are split by rounds, several levels at a time, at places that a sample of
   their own gives; smaller ones whole, in one task each.
3. Within a leaf all pairs are verified by exact cosines in double precision;
   a large leaf is cut into blocks, and each two blocks are a task of their own. A pair that meets in several leaves counts
   in the first only, which each class's list of leaves tells without a shuffle of pairs. Tasks return sums and local
   components, never pairs.
4. Components follow from star edges of the tasks' local components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from ._shared import connected_components, stored

TREES, SPILL, LEAF = 4, 0.5, 40
#: Bytes of vectors that one task splits; larger nodes are split by rounds of ``LEVELS`` levels by about ``SAMPLE`` classes
#: of each.
TASK_BYTES, LEVELS, SAMPLE = 48 << 20, 6, 4096
#: Levels of a tree at most, and the part of a node that may go both ways. A node that can't be split so is a leaf, however
#: large, and compared in blocks.
MOST_LEVELS, MOST_SPILT = 56, 0.2
#: Classes in a task's block.
BLOCK = 1536
SALT = 16


def direction(dim: int, tree: int, node: int) -> np.ndarray:
    """The random unit direction of a node: its number is 1 for the root, ``2 k`` and ``2 k + 1`` below ``k``."""
    v = np.random.default_rng([5, tree, node >> 32, node & 0xFFFFFFFF]).standard_normal(dim)
    return v / np.linalg.norm(v)


def sides(projected: np.ndarray, middle: float, spill: float) -> tuple[np.ndarray, np.ndarray]:
    return projected <= middle + spill, projected > middle - spill


def place_of_cut(projected: np.ndarray, spill: float) -> float | None:
    """Where in the middle half of the projections a cut copies the fewest; None if that is too many."""
    at = np.sort(projected)
    places = at[(np.linspace(0.25, 0.75, 21) * (len(at) - 1)).astype(int)]
    both = np.searchsorted(at, places + spill, side="right") - np.searchsorted(at, places - spill, side="right")
    best = int(np.lexsort((np.abs(np.arange(21) - 10), both))[0])
    left, right = sides(projected, places[best], spill)
    return float(places[best]) if both[best] <= MOST_SPILT * len(at) and max(left.sum(), right.sum()) < len(at) else None


def leaves_of(x: np.ndarray, tree: int, node: int, spill: float, leaf: int = LEAF) -> list[tuple[int, np.ndarray]]:
    """Splits the unit vectors ``x`` below a node until leaves hold at most ``leaf``: node numbers with the rows of each."""
    found, todo = [], [(node, np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        if len(rows) > leaf and at < 1 << MOST_LEVELS:
            projected = x[rows] @ direction(x.shape[1], tree, at)
            cut = place_of_cut(projected, spill)
            if cut is not None:
                left, right = sides(projected, cut, spill)
                todo += [(2 * at, rows[left]), (2 * at + 1, rows[right])]
                continue
        found.append((at, rows))
    return found


def cuts(x: np.ndarray, tree: int, node: int, spill: float, levels: int = LEVELS) -> list[float]:
    """Where the nodes of some levels below ``node`` are cut, as a heap; NaN where a node isn't to be split."""
    found = [float("nan")] * ((1 << levels) - 1)
    todo = [(0, node, np.arange(len(x)))]
    while todo:
        place, at, rows = todo.pop()
        if place < len(found) and len(rows) >= 32 and at < 1 << MOST_LEVELS:
            projected = x[rows] @ direction(x.shape[1], tree, at)
            cut = place_of_cut(projected, spill)
            if cut is not None:
                found[place] = cut
                todo += [(2 * place + 1, 2 * at, rows[projected <= cut]), (2 * place + 2, 2 * at + 1, rows[projected > cut])]
    return found


def descend(x: np.ndarray, tree: int, node: int, spill: float, middle: list[float]) -> list[tuple[int, np.ndarray]]:
    """The nodes that the unit vectors ``x`` reach below ``node`` by a heap of cuts."""
    found, todo = [], [(0, node, np.arange(len(x)))]
    while todo:
        place, at, rows = todo.pop()
        if not len(rows):
            continue
        if place >= len(middle) or np.isnan(middle[place]):
            found.append((at, rows))
            continue
        left, right = sides(x[rows] @ direction(x.shape[1], tree, at), middle[place], spill)
        todo += [(2 * place + 1, 2 * at, rows[left]), (2 * place + 2, 2 * at + 1, rows[right])]
    return found


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that very large and very small components don't overflow or vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Validity, dimension, fingerprint and bytes of each vector."""
    import hashlib

    for batch in batches:
        vectors = batch.column("embedding")
        out = []
        for label, v in zip(batch.column("label").to_pylist(), vectors):
            x = None
            if label is not None and v.is_valid and len(v) and v.values.null_count == 0:
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(x).all() or not x.any():
                    x = None
            data = None if x is None else x.tobytes()
            out.append((data is not None, 0 if x is None else len(x), None if data is None else hashlib.sha256(data).hexdigest(), data))
        valid, dim, print_, data = zip(*out) if out else ([], [], [], [])
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("label"), pa.array(valid, pa.bool_()), pa.array(dim, pa.int32()), pa.array(print_, pa.string()), pa.array(data, pa.binary())],
            names=["vec_id", "label", "valid", "dim", "print", "vec"],
        )


def _local(link: np.ndarray) -> np.ndarray:
    """Component number of each row of a symmetric boolean matrix."""
    label = np.full(len(link), -1)
    for k in range(len(link)):
        if label[k] < 0:
            front = np.zeros(len(link), dtype=bool)
            front[k] = True
            while front.any():
                label[front] = k
                front = link[front].any(axis=0) & (label < 0)
    return label


def compare_block(x: np.ndarray, y: np.ndarray | None, least: float, lists: list[np.ndarray], leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a task with rows ``x`` and, if two blocks meet, ``y``: the boolean matrix over all rows, and the part of it
    that no earlier leaf holds. ``lists``: each row's sorted leaves. Within one block all pairs are compared, of two
    blocks those across."""
    whole = x if y is None else np.concatenate([x, y])
    n = len(x)
    norm = np.sqrt((whole * whole).sum(axis=1))
    link = np.zeros((len(whole), len(whole)), dtype=bool)
    if y is None:
        link[:] = (x @ x.T) / np.outer(norm, norm) >= least
        np.fill_diagonal(link, False)
    else:
        across = (x @ y.T) / np.outer(norm[:n], norm[n:]) >= least
        link[:n, n:], link[n:, :n] = across, across.T
    some = np.flatnonzero(link.any(axis=1))
    if not len(some):
        return link, link
    earlier = [own[own < leaf] for own in (lists[k] for k in some)]
    code, owner = np.concatenate(earlier), np.repeat(some, [len(e) for e in earlier])
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    counted = link.copy()
    cut = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1], [True]])) if len(code) else []
    for a, b in zip(cut[:-1], cut[1:]):
        if b - a > 1:
            counted[np.ix_(owner[a:b], owner[a:b])] = False
    return link, counted


_NODE = ("label", "dim", "tree", "node")


def _placed(classes: DataFrame, least: float, trees: int) -> DataFrame:
    """``label, dim, cid, rep, copies, vec, leaves`` of every class: the sorted codes of the leaves that it is in."""
    length = max(0.0, 2 - 2 * least) ** 0.5
    unit = lambda vec, dim: _unit(np.frombuffer(b"".join(v.as_py() for v in vec)).reshape(-1, dim))
    at = classes.select("label", "dim", "cid", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).withColumns({"node": F.lit(1).cast("long"), "final": F.lit(False)})
    narrow = "label string, dim int, cid long, tree int, node long, final boolean"
    vectors = classes.select("cid", "vec")

    def fit(table: pa.Table) -> pa.Table:
        label, dim, tree, node = (table.column(c)[0].as_py() for c in _NODE)
        found = cuts(unit(table.column("vec"), dim), tree, node, SPILL * length / dim**0.5)
        return pa.table({"label": [label], "dim": pa.array([dim], pa.int32()), "tree": pa.array([tree], pa.int32()), "node": [node], "middle": pa.array([found], pa.list_(pa.float64()))})

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[tuple, list[int]] = {}
            for k, key in enumerate(zip(*(batch.column(c).to_pylist() for c in _NODE))):
                rows.setdefault(key, []).append(k)
            for (label, dim, tree, node), own in rows.items():
                part = batch.take(pa.array(own))
                reached = descend(unit(part.column("vec"), dim), tree, node, SPILL * length / dim**0.5, part.column("middle")[0].as_py())
                code = np.concatenate([np.full(len(r), n) for n, r in reached])
                cid = part.column("cid").take(pa.array(np.concatenate([r for _, r in reached])))
                n = len(code)
                yield pa.RecordBatch.from_arrays([pa.array([label] * n, pa.string()), pa.array([dim] * n, pa.int32()), cid, pa.array([tree] * n, pa.int32()), pa.array(code), pa.array(code == node)], names=["label", "dim", "cid", "tree", "node", "final"])

    done = None
    while True:
        sizes = at.groupBy(*_NODE).agg(F.count("*").alias("n"), F.first("final").alias("final"))
        large = stored(sizes.where(F.col("n") * F.col("dim") * 8 > TASK_BYTES), "embedding-large")
        # a node that can't be split is a leaf as it stands
        stays = at.join(large.where("final").select(*_NODE), list(_NODE), "left_semi")
        done = stays if done is None else done.union(stays)
        todo = large.where("not final").select(*_NODE, "n")
        rest = at.join(large.select(*_NODE), list(_NODE), "left_anti")
        if todo.isEmpty():
            break
        sample = at.join(F.broadcast(todo), list(_NODE)).where(F.pmod(F.xxhash64("cid", F.lit(3)), F.col("n")) < SAMPLE)
        middle = sample.join(vectors, "cid").select(*_NODE, "vec").groupBy(*_NODE).applyInArrow(fit, "label string, dim int, tree int, node long, middle array<double>")
        deeper = at.join(F.broadcast(stored(middle, "embedding-cuts")), list(_NODE)).join(vectors, "cid")
        at = stored(rest.unionByName(deeper.select("label", "dim", "cid", "tree", "node", "middle", "vec").mapInArrow(split, narrow)), "embedding-nodes")

    def finish(table: pa.Table) -> pa.Table:
        label, dim, tree, node = (table.column(c)[0].as_py() for c in _NODE)
        found = leaves_of(unit(table.column("vec"), dim), tree, node, SPILL * length / dim**0.5)
        code = np.concatenate([np.full(len(r), n) for n, r in found])
        return pa.table({"cid": table.column("cid").take(pa.array(np.concatenate([r for _, r in found]))), "tree": pa.array([tree] * len(code), pa.int32()), "node": pa.array(code)})

    leaves = rest.join(vectors, "cid").select("label", "dim", "tree", "node", "cid", "vec").groupBy(*_NODE).applyInArrow(finish, "cid long, tree int, node long")
    leaves = leaves.unionByName(done.select("cid", "tree", "node"))
    code = F.shiftleft(F.col("tree").cast("long"), MOST_LEVELS + 2).bitwiseOR(F.col("node"))
    lists = leaves.groupBy("cid").agg(F.sort_array(F.collect_set(code)).alias("leaves"))
    return classes.select("label", "dim", "cid", "rep", "copies", "vec").join(lists, "cid")


def link_vectors(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", trees: int = TREES) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row: rows with equal labels are linked if their cosine, in double
    precision, is at least ``least`` and the forest brings them together. No pair below ``least`` is linked.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows whose label is null, are linked
    with nothing and are components of their own; vectors of different lengths are never linked. Rows that repeat a
    vec_id are rows of their own in counts and one vertex in components. A null vec_id is linked with nothing, has a null
    component and isn't kept. Extra columns are ignored, whatever their names; no rows give no rows.
    """
    spark = ship(vectors.sparkSession)
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    made = given.mapInArrow(_clean, "vec_id long, label string, valid boolean, dim int, print string, vec binary")
    rows = stored(made.withColumn("valid", F.col("valid") & F.col("vec_id").isNotNull()), "embedding-rows")
    classes = stored(rows.where("valid").groupBy("label", "print").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("dim").alias("dim"), F.first("vec").alias("vec")).withColumn("cid", F.monotonically_increasing_id()), "embedding-classes")
    placed = stored(_placed(classes, least, trees), "embedding-leaves")
    sizes = placed.select("label", "dim", F.explode("leaves").alias("leaf")).groupBy("label", "dim", "leaf").agg(F.count("*").alias("n")).where("n > 1")
    blocks = sizes.select("label", "dim", "leaf", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("blocks"))
    narrow = placed.select("label", "dim", "cid", F.explode("leaves").alias("leaf")).join(blocks, ["label", "dim", "leaf"])
    block = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    narrow = narrow.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    narrow = narrow.select("label", "dim", "cid", "leaf", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
    tasks = narrow.join(placed.drop("label", "dim"), "cid").repartition("label", "dim", "leaf", "bi", "bj").sortWithinPartitions("label", "dim", "leaf", "bi", "bj", "block")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, []
        keys = ("label", "dim", "leaf", "bi", "bj")

        def close() -> Iterator[pa.RecordBatch]:
            if len(own) < 2:
                return
            cid, rep, copies, block, vec, leaves = zip(*own)
            x = np.frombuffer(b"".join(vec)).reshape(len(own), -1)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            first = sum(b == key[3] for b in block)
            two = key[3] != key[4]
            if two and not 0 < first < len(own):
                return
            link, counted = compare_block(x[:first] if two else x, x[first:] if two else None, least, [np.array(v) for v in leaves], key[2])
            if not link.any():
                return
            reps = np.array(rep)
            label = _local(link)
            low = np.full(len(own), np.iinfo(np.int64).max)
            np.minimum.at(low, label, reps)
            n = counted @ np.array(copies, dtype=np.int64)
            some = link.any(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(cid)[some]), pa.array(reps[some]), pa.array(low[label][some]), pa.array(n[some])], names=["cid", "rep", "root", "n"])

        for batch in batches:
            now = list(zip(*(batch.column(c).to_pylist() for c in keys)))
            for k, row in enumerate(zip(*(batch.column(c).to_pylist() for c in ("cid", "rep", "copies", "block", "vec", "leaves")))):
                if now[k] != key:
                    if key is not None:
                        yield from close()
                    key, own = now[k], []
                own.append(row)
        if key is not None:
            yield from close()

    found = stored(tasks.select("label", "dim", "leaf", "bi", "bj", "block", "cid", "rep", "copies", "vec", "leaves").mapInArrow(verify, "cid long, rep long, root long, n long"), "embedding-links")
    counts = found.groupBy("cid").agg(F.sum("n").alias("n"))
    edges = found.select(F.col("rep").alias("a"), F.col("root").alias("b")).distinct()
    vertices = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    component = connected_components(vertices, edges, "embedding-components").select(F.col("id").alias("rep"), "component_id")
    # rows find their class by a salted key, as one class may hold a third of all rows
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALT)).cast("int")
    salts = F.when(F.col("copies") > 1, F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(salt("rep")))
    named = classes.select("label", "print", "cid", "rep", "copies").join(component, "rep", "left").join(counts, "cid", "left")
    named = named.select("label", "print", F.coalesce("component_id", "rep").alias("component_id"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.explode(salts).alias("salt"))
    out = rows.select("vec_id", "label", F.when(F.col("valid"), F.col("print")).alias("print"), salt("vec_id").alias("salt")).join(named, ["label", "print", "salt"], "left")
    root = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), F.coalesce(F.col("vec_id") == root, F.lit(False)).alias("kept"))


def op5_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Every pair of a label, by brute force.
ORACLE = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (
  SELECT vec_id AS id, vec_id AS other FROM embeddings
  UNION
  SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id)::BIGINT AS n_links, min(r.other) AS component_id, e.vec_id = min(r.other) AS kept
FROM embeddings e JOIN reach r ON r.id = e.vec_id GROUP BY e.vec_id
"""
