"""Near-duplicate vectors by randomised-rotation binary codes.

Vectors of the same label and the same components are one class. A class's unit
vector x is turned by random rotations; the signs of the turned components are
its code: the corner of the cube nearest to it, x̄. Stored beside the code is
the correction factor <x̄, x>: for a query q, <x̄, q> / <x̄, x> estimates
<x, q> without bias, and the part of q that the corner cannot see bounds the
error: sqrt((1 - <x̄, x>²) / <x̄, x>²) * ``WIDE`` / sqrt(dimension - 1) on either
side. A pair whose upper bound lies below the threshold is dropped; all others
are recomputed exactly, in double precision.

Candidates are pairs that agree in all bits of a band of the code. With
``BANDS`` bands of ``BAND_BITS`` bits a pair at cosine 0.98 is missed with
probability (1 - (1 - acos(0.98) / pi) ** 16) ** 16, about 0.1 %. Pairs are
compared within a task but never sent: a task sends, per class, how many rows
it found linked, and a spanning forest of the links it saw. A pair is counted
in the first band it agrees in. A band cell of over ``BLOCK`` classes is cut
into blocks, and each pair of blocks is a unit of work of its own, so no task
holds a whole cell.

Given rows: a null label, and a vector that is null, empty, zero or holds null
or non-finite components, links with nothing; vectors of different length never
link; repeated vectors (also of one id) link with each other; rows without an
id take part and are told apart by nothing but their count. An id that occurs
more than once has one row per occurrence.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.llm.components import components
from watchloom.llm.setsketch import column_of, whole_units
from watchloom.llm.stored import stored
from watchloom.session import ship_package

THRESHOLD = 0.98
BANDS = 16
BAND_BITS = 16
WIDE = 4.0
BLOCK = 1024


@functools.cache
def rotations(dimension: int, seed: int = 3) -> np.ndarray:
    """Random orthogonal matrices, one after the other: enough rows for all code bits."""
    rng = np.random.default_rng([seed, dimension])
    count = -(-BANDS * BAND_BITS // dimension)
    made = []
    for _ in range(count):
        q, r = np.linalg.qr(rng.normal(size=(dimension, dimension)))
        made.append(q * np.sign(np.diag(r)))
    return np.concatenate(made)


def band_numbers(turned: np.ndarray) -> np.ndarray:
    """One number of ``BAND_BITS`` bits per vector and band."""
    bits = (turned[:, : BANDS * BAND_BITS] > 0).reshape(len(turned), BANDS, BAND_BITS)
    return bits @ (1 << np.arange(BAND_BITS))


def bounds(units: np.ndarray, turn: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Upper confidence bounds for the cosines of ``others`` (rows) with ``units`` (columns), from codes."""
    dimension = units.shape[1]
    first = turn[:dimension]  # one whole rotation
    corners = np.where(units @ first.T > 0, 1.0, -1.0) / np.sqrt(dimension)
    factor = np.abs(units @ first.T).sum(axis=1) / np.sqrt(dimension)
    estimate = (others @ first.T) @ corners.T / factor
    spread = np.sqrt(np.maximum(1 - factor**2, 0)) / factor * WIDE / np.sqrt(max(dimension - 1, 1))
    return estimate + spread


CODED = "cls long, label int, n long, vec binary, dim int, bands array<int>"


def coded(classes: DataFrame) -> DataFrame:
    """(cls, label, n, unit vector, dim, band numbers) of usable classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            rows: list[tuple] = []
            for cls, label, n, vector in zip(*(batch.column(c).to_pylist() for c in ("cls", "label", "n", "vec"))):
                unit = np.array(vector, dtype=np.float64)
                scale = np.abs(unit).max()
                unit = unit / scale
                unit /= np.linalg.norm(unit)
                if len(unit) not in turns:
                    turns[len(unit)] = rotations(len(unit))
                bands = band_numbers((turns[len(unit)] @ unit)[None])[0]
                rows.append((cls, label, n, unit.tobytes(), len(unit), bands.tolist()))
            names = ["cls", "label", "n", "vec", "dim", "bands"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32())]
            columns = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    return classes.select("cls", "label", "n", "vec").mapInArrow(run, CODED)


def _forest(left: np.ndarray, right: np.ndarray) -> list[int]:
    """Positions of the links that join parts which were apart (a spanning forest)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for k, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[ra] = rb
            kept.append(k)
    return kept


KEYS = ["band", "cell", "dim", "label", "left", "right"]


def maybe_close(one: np.ndarray, two: np.ndarray, threshold: float) -> np.ndarray:
    """Rows of two matrices whose cosine may reach the threshold by the code of either side."""
    dimension = one.shape[1]
    first = rotations(dimension)[:dimension]
    turned = one @ first.T, two @ first.T
    fits = np.zeros(len(one), dtype=bool)
    for x, y in (turned, turned[::-1]):
        factor = np.abs(x).sum(axis=1) / np.sqrt(dimension)
        estimate = (np.where(x > 0, y, -y)).sum(axis=1) / np.sqrt(dimension) / factor
        spread = np.sqrt(np.maximum(1 - factor**2, 0)) / factor * WIDE / np.sqrt(max(dimension - 1, 1))
        fits |= estimate + spread >= threshold
    return fits


def compare(cells: DataFrame, threshold: float) -> DataFrame:
    """Compares the classes of each unit of work: rows (a, b, n).

    With b null, n rows were found linked to class a; with n null, a and b are
    linked classes of the spanning forest.
    """

    def pairs_of(units: np.ndarray, side: np.ndarray, left: int, right: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.flatnonzero(side == left), np.flatnonzero(side == right)
        turn, hits = rotations(units.shape[1]), []
        for k in range(0, len(a), 128):
            some = a[k : k + 128]
            maybe = bounds(units[b], turn, units[some]) >= threshold
            maybe |= bounds(units[some], turn, units[b]).T >= threshold  # the same verdict in every cell
            if left == right:
                maybe &= some[:, None] < b
            here, there = np.flatnonzero(maybe.any(axis=1)), np.flatnonzero(maybe.any(axis=0))
            sure = maybe[np.ix_(here, there)] & (units[some[here]] @ units[b[there]].T >= threshold)
            r, c = np.nonzero(sure)
            hits.append((some[here[r]], b[there[c]]))
        return tuple(np.concatenate([h[i] for h in hits]) if hits else np.zeros(0, np.int64) for i in (0, 1))

    def of_length(table: pa.Table, firsts: np.ndarray, sizes: np.ndarray, dim: int) -> list[pa.RecordBatch]:
        """Units of vectors of one length."""
        cls, count, band = (column_of(table, c) for c in ("cls", "n", "band"))
        units = np.frombuffer(b"".join(table.column("vec").to_pylist()), dtype=np.float64).reshape(-1, dim)
        bands = np.stack(table.column("bands").to_pylist())
        side, left, right = (column_of(table, c) for c in ("block", "left", "right"))
        twos = firsts[sizes == 2]
        twos = twos[(side[twos] != side[twos + 1]) == (left[twos] != right[twos])]
        twos = twos[maybe_close(units[twos], units[twos + 1], threshold)]
        twos = twos[np.einsum("ij,ij->i", units[twos], units[twos + 1]) >= threshold]
        rows, columns = [twos], [twos + 1]
        for first, size in zip(firsts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            s = slice(first, first + size)
            r, c = pairs_of(units[s], side[s], left[first], right[first])
            rows.append(r + first)
            columns.append(c + first)
        rows, columns = np.concatenate(rows), np.concatenate(columns)
        # Agreed in an earlier band: counted there.
        earlier = (bands[rows] == bands[columns]) & (np.arange(BANDS) < band[rows][:, None])
        once = ~earlier.any(axis=1)
        rows, columns = rows[once], columns[once]
        links = np.bincount(rows, count[columns], minlength=len(cls)) + np.bincount(columns, count[rows], minlength=len(cls))
        hit = np.flatnonzero(links)
        tree = _forest(rows, columns)
        return [pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([cls[hit], cls[rows[tree]]])),
            pa.concat_arrays([pa.nulls(len(hit), pa.int64()), pa.array(cls[columns[tree]])]),
            pa.concat_arrays([pa.array(links[hit].astype(np.int64)), pa.nulls(len(tree), pa.int64())]),
        ], ["a", "b", "n"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, firsts, sizes in whole_units(batches, KEYS):
            length = column_of(table, "dim")
            for dim in np.unique(length).tolist():
                mine = length == dim
                at = np.cumsum(mine) - 1  # place of a row among those of its length
                chosen = mine[firsts]
                yield from of_length(table.filter(pa.array(mine)), at[firsts[chosen]], sizes[chosen], dim)

    ordered = cells.repartition(*KEYS).sortWithinPartitions(*KEYS, "cls")
    columns = [*KEYS, "block", "cls", "n", "vec", "bands"]
    return ordered.select(*columns).mapInArrow(run, "a long, b long, n long")


def links(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
          threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    ship_package(vectors.sparkSession)
    given = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("int").alias("label"),
        F.col(vector).cast("array<double>").alias("vec"),
    )
    fine = F.expr("""label is not null and vec is not null and size(vec) > 0
      and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(vec, x -> x <> 0)""")
    given = given.withColumn("fine", F.coalesce(fine, F.lit(False)))
    # One class per label and vector; its number is the hash of both, its least id stands for it.
    number = F.xxhash64("label", "vec")
    classes = stored(
        given.where("fine").groupBy(number.alias("cls"), "label", "vec")
        .agg(F.count("*").alias("n"), F.min("vec_id").alias("least")), "vector-classes")
    codes = stored(coded(classes), "codes")
    cells = codes.select("cls", "label", "n", "dim", "vec", "bands", F.posexplode("bands").alias("band", "cell"))
    same = ["band", "cell", "dim", "label"]
    sizes = cells.groupBy(*same).agg(F.count("*").alias("in_cell")).where("in_cell > 1")
    blocks = F.ceil(F.col("in_cell") / BLOCK).cast("int")
    work = (
        cells.join(sizes, same).withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other"))
    )
    found = stored(compare(work, threshold), "vector-links")
    counts = found.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n_others"))
    # Components by least id: nodes are classes, named by their least id when it is known.
    names = classes.select("cls", "least")
    edges = found.where("b is not null").select("a", "b")
    roots = components(edges)
    groups = roots.join(names, roots["node"] == names["cls"]).groupBy("root").agg(F.min("least").alias("component"))
    of_class = roots.join(groups, "root").select(F.col("node").alias("cls"), "component")
    told = (
        classes.select("cls", "label", "vec", "n", "least").join(counts, "cls", "left").join(of_class, "cls", "left")
        .select("cls", (F.coalesce("n_others", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                F.coalesce("component", "least").alias("component"))
    )
    rows = given.withColumn("cls", F.when(F.col("fine"), number)).select("vec_id", "cls")
    component = F.coalesce("component", "vec_id")
    return rows.join(told, "cls", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), (F.col("vec_id") == component).alias("kept"),
    )
