"""Near-duplicate documents by SetSketch registers.

A document's set are its distinct runs of five lower-cased words, as 64-bit
hashes; of a shorter text the whole word sequence. Each of ``REGISTERS``
registers keeps, of exponentially distributed numbers drawn per element, the
least, truncated to a power of ``BASE``: so registers of two sets merge by
maximum, and equal registers are as likely as the sets are similar.

1. Documents of the same set are one class, so exact copies are settled here.
2. Bands of ``ROWS`` registers propose candidates: two sets at similarity 0.75
   share none of the bands with probability (1 - 0.75 ** 4) ** 32, 5 in a million.
3. In a cell (band and values), registers are compared jointly: counts of larger,
   smaller and equal registers and the two set sizes give the similarity of
   greatest likelihood. Pairs estimated below ``CUT`` (four standard deviations
   under the threshold) are dropped.
4. A maximum spanning forest over the estimates of a cell goes to verification
   on the full sets. Cells that still hold different parts are then compared
   whole, on the full sets, inside the tasks. Either way a unit of work sends a
   forest of links, so copies are never expanded into all pairs, and no link
   between different parts is lost.
5. Verified links are joined to components.

A cell of over ``BLOCK`` classes is cut into blocks. The first look takes each block
with two hubs of the cell, so its work grows with the number of classes. The second
takes pairs of blocks, but for pairs within the cell's largest part.

Given rows: a null text, and one without words, has an empty set and links with
nothing; repeated rows are copies, with one row each in the result; a row
without an id takes part, has the component of its group, and is kept only if
nothing in its group has an id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.llm.components import components
from watchloom.llm.stored import stored
from watchloom.llm.words import Words, pieces, run_hashes
from watchloom.session import ship_package

RUN = 5
PERCENT = 75
REGISTERS = 128
ROWS = 4
BANDS = REGISTERS // ROWS
BASE = 1.001
RATE = 20.0
CUT = 0.60
BLOCK = 1024
ELEMENTS = 4096  # of an incidence matrix at once


def shingles(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's set."""
    words = Words(texts, lower=True)
    hashes = words.hashes()
    runs = run_hashes(hashes, RUN)
    out = []
    for a, b in zip(words.starts[:-1].tolist(), words.starts[1:].tolist()):
        if b - a >= RUN:
            out.append(np.unique(runs[a : b - RUN + 1]))
        elif b > a:
            whole = xxhash.xxh3_64_intdigest(b"short" + hashes[a:b].tobytes())
            out.append(np.array([whole], dtype=np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


_RNG = np.random.default_rng(17)
_SALTS = _RNG.integers(0, 2**64, REGISTERS, dtype=np.uint64)
_FACTORS = _RNG.integers(0, 2**64, REGISTERS, dtype=np.uint64) | np.uint64(1)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers per set; an empty set has zeros."""
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), REGISTERS), dtype="<u2")
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat = np.concatenate([sets[k] for k in full])
    firsts = np.cumsum(sizes[full]) - sizes[full]
    least = np.empty((len(full), REGISTERS), dtype=np.uint64)
    for i in range(REGISTERS):
        x = (flat ^ _SALTS[i]) * _FACTORS[i]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        least[:, i] = np.minimum.reduceat(x, firsts)
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64 * (1 - 1e-16)) / RATE
    out[full] = np.clip(np.floor(1 - np.log(np.maximum(exponential, 1e-300)) / np.log(BASE)), 0, 65535)
    return out


def likeliest(one: np.ndarray, two: np.ndarray, n_one: np.ndarray, n_two: np.ndarray) -> np.ndarray:
    """Similarity of greatest likelihood for rows of registers and the sizes of their sets.

    With shares u, v of the two sizes, a register is larger on one side with
    probability p(u - vJ), on the other with p(v - uJ), where
    p(x) = -log_b(1 - x (b - 1) / b). The likelihood is concave in J; its slope is
    halved in on.
    """
    more, less = (one > two).sum(axis=-1), (one < two).sum(axis=-1)
    same = one.shape[-1] - more - less
    u = n_one / (n_one + n_two)
    v = 1 - u
    c = (BASE - 1) / BASE
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-x * c) / np.log(BASE)

    def slope(x: np.ndarray) -> np.ndarray:
        return c / ((1 - x * c) * np.log(BASE))

    tiny = 1e-12
    for _ in range(14):
        j = (low + high) / 2
        x, y = np.maximum(u - v * j, tiny), np.maximum(v - u * j, tiny)
        px, py = p(x), p(y)
        gradient = (-more * v * slope(x) / px - less * u * slope(y) / py
                    + same * (v * slope(x) + u * slope(y)) / np.maximum(1 - px - py, tiny))
        low, high = np.where(gradient > 0, j, low), np.where(gradient > 0, high, j)
    return (low + high) / 2


def close(regs: np.ndarray, n: np.ndarray, k: int, others: np.ndarray) -> np.ndarray:
    """Estimated similarity of set k with others; 0 where it is out of question."""
    out = np.zeros(len(others))
    equal = (regs[others] == regs[k]).mean(axis=1)
    fit = np.minimum(n[others], n[k]) * 100 >= np.maximum(n[others], n[k]) * PERCENT
    ask = np.flatnonzero(fit & (equal >= CUT - 0.12))
    if len(ask):
        o = others[ask]
        value = likeliest(np.broadcast_to(regs[k], (len(o), REGISTERS)), regs[o], np.full(len(o), n[k]), n[o])
        out[ask] = np.where(value >= CUT, value, 0)
    return out


def forest(regs: np.ndarray, n: np.ndarray, side: np.ndarray | None) -> list[tuple[int, int]]:
    """Maximum spanning forest over the estimates. With ``side``, only pairs of different sides count."""
    left = np.arange(1, len(n))
    best, near = np.zeros(len(n)), np.zeros(len(n), dtype=np.int64)
    k, found = 0, []
    while len(left):
        value = close(regs, n, k, left)
        if side is not None:
            value[side[left] == side[k]] = 0
        better = value > best[left]
        best[left[better]], near[left[better]] = value[better], k
        at = int(np.argmax(best[left]))
        nxt = int(left[at])
        if best[nxt] > 0:
            found.append((int(near[nxt]), nxt))
        left = np.delete(left, at)
        k = nxt
    return found


def linked(sets: list[np.ndarray], part: np.ndarray, side: np.ndarray | None) -> list[tuple[int, int]]:
    """A spanning forest of the links between different parts, from the full sets.

    Intersections of all pairs come from products of incidence matrices, some
    elements at a time; an element of one set alone is in no intersection.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, element, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[element] > 1
    owner, element = owner[shared], np.unique(element[shared], return_inverse=True)[1]
    order = np.argsort(element, kind="stable")
    owner, element = owner[order], element[order]
    common = np.zeros((n, n), dtype=np.float32)
    count = int(element[-1]) + 1 if len(element) else 0
    for start in range(0, count, ELEMENTS):
        a, b = np.searchsorted(element, [start, start + ELEMENTS])
        some = np.zeros((n, min(ELEMENTS, count - start)), dtype=np.float32)
        some[owner[a:b], element[a:b] - start] = 1
        common += some @ some.T
    link = 100 * common >= PERCENT * (sizes[:, None] + sizes - common)
    link &= part[:, None] != part
    if side is not None:
        link &= side[:, None] != side
    found, left = [], np.ones(n, dtype=bool)
    for first in range(n):
        todo = [first] if left[first] else []
        left[first] = False
        while todo:
            k = todo.pop()
            new = np.flatnonzero(link[k] & left)
            left[new] = False
            found += [(k, int(x)) for x in new]
            todo += new.tolist()
    return found


def sketched(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n, cls, regs): set size, hash of the set (null if empty) and registers."""
    given = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            sets = shingles(piece.column("text"))
            regs = registers(sets)
            cls = [xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([
                piece.column("doc_id"), piece.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array(cls, pa.int64()), pa.array([r.tobytes() for r in regs], pa.binary()),
            ], ["doc_id", "text_hash", "n", "cls", "regs"])

    return given.mapInArrow(run, "doc_id long, text_hash long, n long, cls long, regs binary")


UNIT = ["band", "cell", "one", "two"]


def banded(classes: DataFrame) -> DataFrame:
    """(band, cell, cls): the cell of each class in each band."""
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))
    return classes.select("cls", band.alias("band"), "regs").select(
        "cls", "band", F.expr(f"substring(regs, band * {2 * ROWS} + 1, {2 * ROWS})").alias("cell"))


def blocks_for(rows: Column) -> Column:
    return F.ceil(rows / F.lit(BLOCK)).cast("int")


def block_among(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("cls"), blocks).cast("int")


def cells(classes: DataFrame) -> DataFrame:
    """(band, cell, one, two, block, cls, part): members of cells with two classes or more, part null.

    A block is a unit of work. Two hubs of a cell, the classes of least and greatest
    number, are in all of its blocks, so that the parts of a group of copies in
    different blocks meet; what they leave apart is for ``open_cells``.
    """
    light = banded(classes)
    sizes = light.groupBy("band", "cell").agg(
        F.count("*").alias("in_cell"), F.min("cls").alias("low"), F.max("cls").alias("high")).where("in_cell > 1")
    blocks = blocks_for(F.col("in_cell"))
    is_hub = F.col("cls").isin(F.col("low"), F.col("high"))
    homes = F.when(is_hub, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(block_among(blocks)))
    members = light.join(sizes, ["band", "cell"]).select("band", "cell", "cls", F.explode(homes).alias("block"))
    return members.select(
        "band", "cell", F.col("block").alias("one"), F.col("block").alias("two"), "block", "cls",
        F.lit(None).cast("long").alias("part"))


def open_cells(classes: DataFrame, parts: DataFrame) -> DataFrame:
    """As ``cells``, for cells that hold more than one part of ``parts`` (cls, part), by pairs of blocks.

    The largest part of a cell is cut into blocks of its own, of which no two are
    compared: they hold no pair of different parts.
    """
    light = banded(classes).join(parts, "cls", "left").withColumn("part", F.coalesce("part", "cls"))
    sizes = (
        light.groupBy("band", "cell", "part").agg(F.count("*").alias("n"))
        .groupBy("band", "cell").agg(
            F.sum("n").alias("in_cell"), F.max(F.struct("n", "part")).alias("largest"))
        .select("band", "cell", "in_cell", F.col("largest.part").alias("main"), F.col("largest.n").alias("in_main"))
        .where("in_cell > in_main")
    )
    in_main = F.col("part") == F.col("main")
    whole = F.col("in_cell") <= BLOCK  # the cell is one block
    others, mains = blocks_for(F.col("in_cell") - F.col("in_main")), blocks_for(F.col("in_main"))
    block = F.when(whole, 0).when(in_main, others + block_among(mains)).otherwise(block_among(others))
    last = F.when(whole, 0).when(in_main, others - 1).otherwise(others + mains - 1)
    members = (
        light.join(sizes, ["band", "cell"])
        .select("band", "cell", "cls", "part", block.alias("block"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
        .withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other"))
    )
    return members.select(*UNIT, "block", "cls", "part")


def in_units(members: DataFrame, details: DataFrame) -> DataFrame:
    """Joins ``details`` by class and brings units together, each in one piece."""
    return members.join(details, "cls").repartition(*UNIT).sortWithinPartitions(*UNIT, "cls")


def whole_units(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Tables of whole units out of sorted batches, with each unit's first row and size."""

    def bounded(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        change = np.zeros(table.num_rows, dtype=bool)
        change[0] = True
        for name in keys:
            codes = np.asarray(table.column(name).combine_chunks().dictionary_encode().indices)
            change[1:] |= codes[1:] != codes[:-1]
        firsts = np.flatnonzero(change)
        return table, firsts, np.diff(np.append(firsts, table.num_rows))

    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        last = table.slice(table.num_rows - 1).to_pylist()[0]
        same = np.ones(table.num_rows, dtype=bool)
        for name in keys:
            value = pa.scalar(last[name], table.schema.field(name).type)
            same &= np.asarray(pc.equal(table.column(name), value).combine_chunks())
        done = int(np.argmax(same))  # rows of the last unit stay, it may go on in the next batch
        held = table.slice(done)
        if done:
            yield bounded(table.slice(0, done))
    if held is not None:
        yield bounded(held)


def column_of(table: pa.Table, name: str) -> np.ndarray:
    return np.asarray(table.column(name).combine_chunks(), dtype=np.int64)


def side_of(table: pa.Table) -> np.ndarray | None:
    """Block of each row of a unit of two blocks."""
    two_sided = table.column("one")[0].as_py() != table.column("two")[0].as_py()
    return column_of(table, "block") if two_sided else None


def pair_batch(pairs: set[tuple[int, int]]) -> pa.RecordBatch:
    rows = sorted(pairs)
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["a", "b"])


def proposed(units: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of classes to verify, a < b: a forest per unit."""

    def registers_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, REGISTERS)

    def pairs_of(table: pa.Table) -> np.ndarray:
        found = forest(registers_of(table.column("regs")), column_of(table, "n"), side_of(table))
        return column_of(table, "cls")[np.array(found, dtype=np.int64).reshape(-1, 2)]

    def twos(table: pa.Table, firsts: np.ndarray) -> np.ndarray:
        """Units of two members, all at once."""
        if not len(firsts):
            return np.zeros((0, 2), np.int64)
        cls, n = column_of(table, "cls"), column_of(table, "n")
        flat = table.column("regs").combine_chunks()
        one, two = registers_of(flat.take(pa.array(firsts))), registers_of(flat.take(pa.array(firsts + 1)))
        a, b = n[firsts], n[firsts + 1]
        good = np.minimum(a, b) * 100 >= np.maximum(a, b) * PERCENT
        good[good] = likeliest(one[good], two[good], a[good], b[good]) >= CUT
        return np.stack([cls[firsts], cls[firsts + 1]], axis=1)[good]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # the same pair in several cells; forgotten when it grows
        for table, firsts, sizes in whole_units(batches, UNIT):
            found = [twos(table, firsts[sizes == 2])]
            for first, size in zip(firsts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                found.append(pairs_of(table.slice(first, size)))
            if len(seen) > 500_000:
                seen = set()
            new = {(min(p), max(p)) for p in np.concatenate(found).tolist()} - seen
            seen |= new
            yield pair_batch(new)

    return units.mapInArrow(run, "a long, b long").distinct()


def remaining(units: DataFrame) -> DataFrame:
    """Verified links (a, b) between different parts, from full sets (column ``elements``): a forest per unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, firsts, sizes in whole_units(batches, UNIT):
            found: set[tuple[int, int]] = set()
            for first, size in zip(firsts.tolist(), sizes.tolist()):
                unit = table.slice(first, size)
                sets = [np.frombuffer(e, dtype=np.uint64) for e in unit.column("elements").to_pylist()]
                cls = column_of(unit, "cls").tolist()
                for a, b in linked(sets, column_of(unit, "part"), side_of(unit)):
                    found.add((min(cls[a], cls[b]), max(cls[a], cls[b])))
            yield pair_batch(found)

    return units.mapInArrow(run, "a long, b long").distinct()


def elements(texts: DataFrame) -> DataFrame:
    """(cls, elements): the full set of each text's class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            sets = [s.tobytes() for s in shingles(piece.column("text"))]
            yield pa.RecordBatch.from_arrays([piece.column("cls"), pa.array(sets, pa.binary())], ["cls", "elements"])

    return texts.select("cls", "text").mapInArrow(run, "cls long, elements binary")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs whose full sets, from ``texts`` (cls, text), are similar enough."""
    both = pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text_a", 1 << 20):
            one, two = shingles(piece.column("text_a")), shingles(piece.column("text_b"))
            common = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(one, two)], dtype=np.int64)
            union = np.array([len(x) + len(y) for x, y in zip(one, two)]) - common
            good = pa.array(100 * common >= PERCENT * union)
            yield pa.RecordBatch.from_arrays(
                [piece.column("a").filter(good), piece.column("b").filter(good)], ["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def groups(documents: DataFrame) -> DataFrame:
    """One row per document (doc_id, text): doc_id, text_hash, n_shingles, component_id, kept, group.

    ``group`` numbers the components; it is null for an empty set.
    """
    ship_package(documents.sparkSession)
    sketches = stored(sketched(documents), "sketches")
    classes = stored(
        sketches.where("cls is not null").groupBy("cls").agg(
            F.first("n").alias("n"), F.first("regs").alias("regs"), F.min("doc_id").alias("least"),
            F.min(F.struct("doc_id", "text_hash")).alias("speaker"),
        ), "classes")
    texts_of = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")

    def texts(wanted: DataFrame) -> DataFrame:
        """The text of one member of each class."""
        speakers = classes.join(wanted.distinct(), "cls", "left_semi").select("cls", "speaker.doc_id", "speaker.text_hash")
        found = texts_of.join(
            speakers.withColumnRenamed("doc_id", "id"),
            F.col("doc_id").eqNullSafe(F.col("id")) & (texts_of["text_hash"] == speakers["text_hash"]))
        return found.select("cls", "text").groupBy("cls").agg(F.first("text").alias("text"))

    registers_and_sizes = classes.select("cls", "n", "regs")
    first = stored(proposed(in_units(cells(classes), registers_and_sizes)), "first-pairs")
    asked = first.select(F.col("a").alias("cls")).unionAll(first.select("b"))
    links = stored(verified(first, stored(texts(asked), "texts")), "first-links")
    parts = stored(components(links).select(F.col("node").alias("cls"), F.col("root").alias("part")), "parts")
    still_open = stored(open_cells(classes, parts), "open-cells")
    sets = stored(elements(texts(still_open.select("cls"))), "sets")
    more = stored(remaining(in_units(still_open, sets)), "more-links")
    roots = components(links.unionAll(more))
    least = roots.join(classes.select(F.col("cls").alias("node"), "least"), "node").groupBy("root").agg(
        F.min("least").alias("component"))
    of_class = classes.select("cls", "least").join(
        roots.join(least, "root").select(F.col("node").alias("cls"), "root", "component"), "cls", "left"
    ).select("cls", F.coalesce("component", "least").alias("component"), F.coalesce("root", "cls").alias("group"))
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return sketches.select("doc_id", "text_hash", "n", "cls").join(of_class, "cls", "left").select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"), "group",
    )


def deduplicated(documents: DataFrame) -> DataFrame:
    """One document of each group, the one of least id, and all documents without words. Columns are as given."""
    row = F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text"))
    best = groups(documents).where("group is not null").groupBy("group").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("best"))
    chosen = best.select(F.xxhash64("best.doc_id", "best.text_hash").alias("row"))
    wordy = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = documents.where(wordy).withColumn("row", row).join(chosen, "row", "left_semi").dropDuplicates(["row"])
    return kept.drop("row").unionAll(documents.where(~wordy))
