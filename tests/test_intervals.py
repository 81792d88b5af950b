"""Ranges of any height, and numbers that are free, against plain loops."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyfold.operators import corpus, intervals, ledger


def test_blocks_cover_a_range_exactly(spark):
    chance = random.Random(1)
    ranges = [(i, a, a + chance.randrange(0, 300)) for i, a in enumerate(chance.randrange(0, 400) for _ in range(80))] + [(99, 5, 4)]
    out = intervals.dyadic_blocks(spark.createDataFrame(ranges, "id int, low int, high int"), "low", "high").collect()
    for i, a, b in ranges:
        held = sorted(n for r in out if r.id == i for n in range(r._block << r._level, (r._block + 1) << r._level))
        assert held == list(range(a, b + 1))


def test_a_tall_range_costs_few_rows(spark):
    tall = spark.createDataFrame([("S", 1, 1_048_576)], "sheet string, low int, high int")
    assert 1 <= intervals.dyadic_blocks(tall, "low", "high").count() <= 40


def test_points_in_ranges(spark):
    chance = random.Random(2)
    points = [(chance.choice("ab"), chance.randrange(0, 100)) for _ in range(200)]
    ranges = [(chance.choice("ab"), a, a + chance.randrange(0, 40), i) for i, a in enumerate(chance.randrange(0, 90) for _ in range(25))]
    got = intervals.points_in_ranges(spark.createDataFrame(points, "k string, p int"), spark.createDataFrame(ranges, "k string, low int, high int, id int"), ["k"], "p", "low", "high")
    assert sorted((r.k, r.p, r.id) for r in got.collect()) == sorted((k, p, i) for k, p in points for q, a, b, i in ranges if q == k and a <= p <= b)
    assert intervals.points_in_ranges(spark.createDataFrame(points, "k string, p int"), spark.createDataFrame([], "k string, low int, high int, id int"), ["k"], "p", "low", "high").count() == 0


def test_tall_merged_label(spark):
    cells = spark.createDataFrame([("S", 2, 4, "Deposit tall"), ("S", 500_000, 2, "600"), ("S", 500_000, 4, "hidden Deposit"), ("S", 1_000_003, 2, "7"), ("S", 1_000_005, 4, "Deposit low")],
                                  "sheet string, row int, col int, value string")
    merges = spark.createDataFrame([("S", 2, 4, 1_000_001, 4)], "sheet string, min_row int, min_col int, max_row int, max_col int")
    filled = {(r.row, r.col): r.value for r in ledger.merged_range_fill(cells, merges).collect()}
    assert filled == {(2, 4): "Deposit tall", (500_000, 2): "600", (500_000, 4): "Deposit tall", (1_000_003, 2): "7", (1_000_005, 4): "Deposit low"}
    ahead = {r.row: r.label for r in ledger.lookahead_label(cells, merges, "Deposit").collect()}
    assert ahead == {2: "Deposit tall", 500_000: "Deposit tall", 1_000_003: "Deposit low"}


def test_rows_without_cells_look_ahead(spark):
    cells = spark.createDataFrame([("S", 3, 4, "Deposit a"), ("S", 10, 4, "Deposit b")], "sheet string, row int, col int, value string")
    merges = spark.createDataFrame([("S", 10, 4, 12, 4)], "sheet string, min_row int, min_col int, max_row int, max_col int")
    ahead = {r.row: r.label for r in ledger.lookahead_label(cells, merges, "Deposit", every_row=True).collect()}
    assert ahead == {**dict.fromkeys((1, 2), "Deposit a"), **dict.fromkeys(range(6, 12), "Deposit b")}


def moved(incoming, present):
    """One file after the other; those that keep their names first."""
    there, out, rest = set(present), {}, []
    free = set()
    for i, category, name in incoming:
        if (category, name) not in there and (category, name) not in free:
            out[i] = name
            free.add((category, name))
        else:
            rest.append((i, category, name))
    there |= free
    for i, category, name in rest:
        stem, dot, ext = name.rpartition(".") if "." in name.lstrip(".") else (name, "", "")
        n = 1
        while (category, f"{stem} ({n}){dot}{ext}") in there:
            n += 1
        out[i] = f"{stem} ({n}){dot}{ext}"
        there.add((category, out[i]))
    return out


@settings(max_examples=3, deadline=None)
@given(st.randoms(use_true_random=False))
def test_collision_suffix_equals_moving_one_by_one(spark, chance):
    names = ["a.txt", "a (1).txt", "a (2).txt", "a (4).txt", "b", "b (1)", ".rc", "c.tar.gz", "a (1) (1).txt", "a (7).txt"]
    incoming = [(i, chance.choice("xy"), chance.choice(names)) for i in range(120)]
    present = [(chance.choice("xy"), chance.choice(names)) for _ in range(12)]
    got = corpus.collision_suffix(spark.createDataFrame(incoming, "id int, category string, name string"), spark.createDataFrame(present, "category string, name string")).collect()
    assert {r.id: r.target_name for r in got} == moved(incoming, present)
    assert len({(r.category, r.target_name) for r in got}) == len(incoming)
