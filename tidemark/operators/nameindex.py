"""An index of names: which of them can mean one team at all, so that not all names of a day meet.

Every way in which two names can be found the same has entries of its own, and two names that
are the same share at least one:

* **Short forms.**  The normal form without blanks, the compact form and the acronym of each
  name; equal names and abbreviations agree in one of them.
* **Beginnings.**  A name posts the beginnings of its compact form of 3, 6, 12, ... letters. Where the
  shorter name begins the longer one, the longest of its own is among the other one's.
* **Parts.**  A name posts all pieces of 4, 8 and 16 letters of its normal form, and is looked up by
  its first letters, as many of these as it has.
* **Spelling.**  The ratio counts letters in common blocks that stand in the same order in both names, M
  of them: with a ratio of at least t, M >= t (|x| + |y|) / 2, so the lengths differ by a factor of at
  most c = (2 - t) / t.  A letter left out of x breaks two of its |x| + 1 pairs of neighbours (blanks
  around it), one put into it breaks one, so 3 M + 1 - |x| - |y| pairs stay, in their order.  Of
  each name's pairs, the rarest first, so many are posted that the first one that stays is among
  them in both; it is moved by at most the longer length less M.  Up to t = 2/3, where no pair need
  stay, single letters take the place of pairs, and M of them stay.  Lengths are put into classes of a
  factor c, of which neighbours are looked up.

The number of a name's entries grows with its length and not with the number of names.  Entries
are hashes: whatever meets is decided by the rules and the ratio themselves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.tables import materialise

PIECES = (4, 8, 16)
BEGINNINGS = tuple(3 << k for k in range(6))


def _entry(kind: str, *values: Column) -> Column:
    return F.xxhash64(F.lit(kind), *values)


def _none() -> Column:
    return F.array().cast("array<bigint>")


def _short_forms(form: Column) -> Column:
    """Without an empty one, in which nothing is alike."""
    kept = F.filter(F.array(form["joined"], form["compact"], form["acronym"]), lambda x: x != "")
    return F.transform(kept, lambda x: _entry("form", x))


def _beginnings(form: Column, longest: bool) -> Column:
    """Entries of a compact form's beginnings: all, or the longest only."""
    whole = form["compact"]
    if longest:
        return F.coalesce(*[F.when(F.length(whole) >= n, F.array(_entry("begin", F.substring(whole, 1, n)))) for n in reversed(BEGINNINGS)], _none())
    return F.concat(*[F.when(F.length(whole) >= n, F.array(_entry("begin", F.substring(whole, 1, n)))).otherwise(_none()) for n in BEGINNINGS])


def _pieces(form: Column, first: bool) -> Column:
    """Entries of a normal form's pieces: all, or the longest that the name begins with."""
    whole = form["normal"]
    if first:
        return F.coalesce(*[F.when(F.length(whole) >= n, F.array(_entry("part", F.substring(whole, 1, n)))) for n in reversed(PIECES)], _none())

    def each(n: int) -> Column:
        places = F.sequence(F.lit(1), F.length(whole) - n + 1)
        return F.when(F.length(whole) >= n, F.transform(places, lambda at: _entry("part", F.substr(whole, at, F.lit(n))))).otherwise(_none())

    return F.concat(*[each(n) for n in PIECES])


def _rare_grams(form: Column, shares: list[float], threshold: float) -> Column:
    """The rarest pairs of neighbouring letters (or letters) of a normal form, as many as the bound asks for: each with its first and last place."""
    length, size = F.length(form["normal"]), 2 if threshold > 2 / 3 else 1
    whole, grams = (F.col("_padded"), length + 1) if size == 2 else (form["normal"], length)
    stay = 1 + length * (2 * (1.5 * threshold - 1) / (2 - threshold)) if size == 2 else length * (threshold / (2 - threshold))
    share_of = F.array(*[F.lit(x) for x in shares])

    def share(at: Column) -> Column:
        return F.get(share_of, F.position(F.substr(whole, at, F.lit(1)), F.lit(text.LETTERS)) - 1)

    def gram(at: Column) -> Column:
        return F.struct((share(at) * share(at + 1) if size == 2 else share(at)).alias("share"), F.substr(whole, at, F.lit(size)).alias("gram"), at.alias("at"))

    wanted = grams - F.ceil(stay - 1e-9).cast("int") + 1
    rarest = F.slice(F.array_sort(F.transform(F.sequence(F.lit(1), grams), gram)), F.lit(1), wanted)
    return F.when(length > 0, rarest)


def _once(rare: Column) -> Column:
    """Each gram once, with its first and last place: a long name that repeats itself has no more entries than there are grams."""

    def places(gram: Column) -> Column:
        at = F.transform(F.filter(rare, lambda x: x["gram"] == gram), lambda x: x["at"])
        return F.struct(gram.alias("gram"), F.array_min(at).alias("first"), F.array_max(at).alias("last"))

    return F.transform(F.array_distinct(F.transform(rare, lambda x: x["gram"])), places)


def _length_classes(form: Column, threshold: float, around: bool) -> Column:
    """The class of a normal form's length, or it and its neighbours."""
    base = math.log(max((2 - threshold) / threshold, 1.05) * (1 + 1e-9))  # a little wider than the bound, for the last digit
    own = F.floor(F.log(F.length(form["normal"]).cast("double")) / base)
    return F.array(own - 1, own, own + 1) if around else F.array(own)


def _letter_shares(known: DataFrame) -> list[float]:
    """The share of names with each letter (one row); any values give right results, rarer ones first give few candidates."""
    counted = known.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.get("_letters", F.lit(i)) > 0).alias(f"c{i}") for i in range(len(text.LETTERS))]).first()
    return [(counted[f"c{i}"] + 1) / (counted["n"] + 2) for i in range(len(text.LETTERS))]


def candidates(left: DataFrame, right: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Distinct ``l``, ``r``: names of ``left`` and ``right`` (``_day``, ``name``) that are seen on one day and share an entry.

    No two names that the rules or a ratio of ``threshold`` (over 0, at most 1) find the same are left
    out.  Missing names have no entries; repeated rows count once; an empty table gives none.
    """
    if not 0 < threshold <= 1:
        raise ValueError("a threshold lies over 0 and is 1 at most")
    left, right = (x.select("_day", "name").where("name IS NOT NULL AND _day IS NOT NULL").distinct() for x in (left, right))
    known = left.select("name").union(right.select("name")).distinct().withColumn("_form", text.forms(F.col("name")))
    # Written first: the optimizer would put the forms' regular expressions into every function over letters.
    known = materialise(known.withColumn("_letters", text.letters(F.col("_form.normal"))).withColumn("_padded", F.concat(F.lit(" "), F.col("_form.normal"), F.lit(" "))), "names-forms")
    form = F.col("_form")
    # Either name may be the shorter one, so each side is looked up in the other: these entries come as a pair.
    rare = materialise(known.select("name", _rare_grams(form, _letter_shares(known), threshold).alias("_rare")), "names-grams")
    index = materialise(known.join(rare, "name").select(
        "name", F.length(form["normal"]).alias("_length"), _once(F.col("_rare")).alias("_rare"),
        F.array_distinct(F.concat(_short_forms(form), _beginnings(form, True), _pieces(form, True))).alias("_asked"), F.array_distinct(F.concat(_beginnings(form, False), _pieces(form, False), _short_forms(form))).alias("_posted"),
        _length_classes(form, threshold, True).alias("_around"), _length_classes(form, threshold, False).alias("_own"),
    ), "names-index")

    def entries(rows: DataFrame, side: str, name: str) -> DataFrame:
        return rows.join(index.select("name", side), "name").select("_day", F.explode(side).alias("_entry"), F.col("name").alias(name))

    def grams(rows: DataFrame, classes: str, name: str) -> DataFrame:
        spread = rows.join(index.select("name", "_length", "_rare", classes), "name").withColumn("_class", F.explode(classes)).withColumn("_x", F.explode("_rare"))
        return spread.select("_day", F.xxhash64("_class", "_x.gram").alias("_entry"), F.col("name").alias(name), F.col("_x.first").alias(f"_first_{name}"), F.col("_x.last").alias(f"_last_{name}"), F.col("_length").alias(f"_length_{name}"))

    one = entries(left, "_asked", "l").join(entries(right, "_posted", "r"), ["_day", "_entry"])
    other = entries(left, "_posted", "l").join(entries(right, "_asked", "r"), ["_day", "_entry"])
    spelt = grams(left, "_around", "l").join(grams(right, "_own", "r"), ["_day", "_entry"])
    least = (F.col("_length_l") + F.col("_length_r")) * (threshold / 2) - 1e-9  # letters in common
    moved = F.greatest("_length_l", "_length_r") - least
    near = (F.least("_length_l", "_length_r") >= least) & (F.col("_first_l") - F.col("_last_r") <= moved) & (F.col("_first_r") - F.col("_last_l") <= moved)
    return one.select("l", "r").union(other.select("l", "r")).union(spelt.where(near).select("l", "r")).distinct()
