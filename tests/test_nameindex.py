"""The index of names against all pairs of a day."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import matching, nameindex

WORDS = ("storm", "falcon", "tiger", "serpent", "harbor", "crown", "wolves", "lake", "quiet", "velvet", "kestrel", "zephyr", "quartz", "mirage", "onyx", "ember")
DAYS = "_day int, name string"


def varied(rng: random.Random, name: str) -> str:
    how = rng.randrange(8)
    if how == 0:
        return name.upper() + " Esports"
    if how == 1:
        return "".join(w[0] for w in name.split())
    if how == 2:
        return name.replace(" ", "")
    if how == 3:
        return name[: max(3, len(name) // 2)]
    if how == 4:
        return name.split()[-1]
    letters = list(name)
    for _ in range(rng.randrange(1, 4)):  # spelling: a letter lost, gained or changed
        at = rng.randrange(len(letters))
        letters[at : at + rng.randrange(2)] = rng.choice(("", "x", "e", "qu"))
    return "".join(letters)


def day_of_names(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    names = [" ".join(rng.sample(WORDS, rng.randrange(1, 4))) + rng.choice(("", " academy", f" {rng.randrange(99)}")) for _ in range(n)]
    return names + [varied(rng, rng.choice(names)) for _ in range(n)]


def of_days(spark, days):
    return spark.createDataFrame([(d, n) for d, names in days.items() for n in names], DAYS)


@pytest.mark.parametrize("threshold", [0.85, 0.6, 1.0])
def test_no_pair_is_lost(spark, threshold):
    left, right = of_days(spark, {d: day_of_names(d, 25) for d in (1, 2)}), of_days(spark, {d: day_of_names(d + 10, 25) + day_of_names(d, 10) for d in (1, 2)})
    met = left.distinct().join(right.distinct().withColumnRenamed("name", "r"), "_day").select(F.col("name").alias("l"), "r").distinct()
    wanted = {tuple(x) for x in matching.same_of(met, threshold).collect()}
    found = {tuple(x) for x in matching.same_names(left, right, threshold).collect()}
    assert found == wanted and len(wanted) > 100


def test_the_ratio_decides_some_pairs(spark):
    rows = of_days(spark, {1: ["Copper Crown", "Coper Crowns", "Cobber Crowm", "Jade Serpents", "Jadde Sxrpents"]})
    found = {tuple(x) for x in matching.same_names(rows, rows).collect() if x[0] < x[1]}
    ruled = {tuple(x[:2]) for x in matching.ruled_pairs(nameindex.candidates(rows, rows)).where("same").select("l", "r").collect()}
    assert ("Coper Crowns", "Copper Crown") in found  # initials agree: a rule
    rows = of_days(spark, {1: ["Coppercrown", "Dcoppercrwn", "Onyx"]})
    found = {tuple(x) for x in matching.same_names(rows, rows).collect() if x[0] < x[1]}
    assert found == {("Coppercrown", "Dcoppercrwn")} and not found & ruled  # other initials: spelling alone


def test_few_names_meet(spark):
    rng = random.Random(5)
    names = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) + " " + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(1500)]
    rows = of_days(spark, {1: names})
    made = nameindex.candidates(rows, rows).count()
    assert made < len(names) ** 2 / 25


def test_awkward_names(spark):
    long = "ab " * 700
    rows = spark.createDataFrame([(1, None), (1, ""), (1, "team"), (1, "x"), (1, "x"), (None, "x"), (1, long), (1, long + "c"), (1, "Ünïx")], DAYS)
    found = {tuple(x) for x in matching.same_names(rows, rows).collect()}
    assert found >= {("x", "x"), (long, long + "c"), (long + "c", long)} and not any("" in x or "team" in x for x in found)
    assert nameindex.candidates(rows.limit(0), rows).count() == 0
    with pytest.raises(ValueError, match="threshold"):
        nameindex.candidates(rows, rows, 0.0)
