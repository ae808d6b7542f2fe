"""Cells of many classes: which pairs share a unit of work, and how many rows that takes."""

from __future__ import annotations

import collections
import itertools

import pytest

from watchloom.llm import setsketch


@pytest.fixture
def classes(spark, monkeypatch):
    monkeypatch.setattr(setsketch, "BLOCK", 10)
    regs = bytearray(2 * setsketch.REGISTERS)  # the same cell in every band
    return spark.createDataFrame([(k * 7919 - 400_000, 9, regs) for k in range(200)], "cls long, n long, regs binary")


def units_of(frame):
    units = collections.defaultdict(list)
    for row in frame.where("band = 3").collect():
        units[row["one"], row["two"]].append(row)
    return units


def test_first_look_grows_with_the_number_of_classes(classes):
    found = setsketch.cells(classes)
    units = units_of(found)
    assert len(units) == 20 and all(one == two for one, two in units)
    ids = sorted(r["cls"] for r in classes.collect())
    assert all({ids[0], ids[-1]} <= {r["cls"] for r in rows} for rows in units.values())
    assert sorted({r["cls"] for rows in units.values() for r in rows}) == ids
    assert found.count() == setsketch.BANDS * (198 + 2 * 20)


@pytest.mark.parametrize("small", [1, 35, 120])
def test_all_pairs_of_different_parts_meet(spark, classes, small):
    ids = sorted(r["cls"] for r in classes.collect())
    part = {c: (c if k < small and k % 3 else 1 if k < small else 2) for k, c in enumerate(ids)}
    parts = spark.createDataFrame([(c, p) for c, p in part.items() if p != c], "cls long, part long")
    met = set()
    for (one, two), rows in units_of(setsketch.open_cells(classes, parts)).items():
        for a, b in itertools.combinations(rows, 2):
            assert a["cls"] != b["cls"]
            if one == two or a["block"] != b["block"]:
                met.add(frozenset((a["cls"], b["cls"])))
    assert met >= {frozenset(p) for p in itertools.combinations(ids, 2) if part[p[0]] != part[p[1]]}


def test_one_stray_among_copies_takes_few_rows(spark, classes):
    ids = [r["cls"] for r in classes.collect()]
    parts = spark.createDataFrame([(c, 2) for c in ids[1:]], "cls long, part long")
    assert setsketch.open_cells(classes, parts).where("band = 3").count() == 199 + 1 + 20


def test_cells_of_one_part_are_closed(spark, classes):
    parts = classes.selectExpr("cls", "2L as part")
    assert setsketch.open_cells(classes, parts).count() == 0
