"""Fill-in-middle transformation by relational units.

A text is cut into units (a run of ASCII letters, or one other code point) and two cuts between
units part it into prefix, middle and suffix.  Where a cut lies in code points is found by rows:
matches are exploded with their ordinal, a window adds up the lengths before each, the cut
requests meet the match of their ordinal, and an aggregate gives a document its offsets.  This
is done twice, first for runs of ``RUN`` units, then for the units of the runs that hold a cut,
so a document gives rows for its runs and for two of them and not for every unit.

The requests travel with their document's rows and meet a run by an equality of ordinals, so
no second table is read.  One shuffle, by document, carries each text once, as its runs; all that follows it keeps
that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNIT = "[A-Za-z]+|[^A-Za-z]"
RUN = 64  # units of a run
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def draws(id_text: Column, seed: int, n: int = 4) -> list[Column]:
    """Unsigned numbers from the first 8-digit groups of the hex SHA-256 of seed, colon and id; a null id counts as ''."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_text, F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(n)]


def has_marker(text: Column) -> Column:
    return F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))


def before(length: Column, by: list[str], order: str) -> Column:
    """The sum of the lengths of what comes before a match."""
    return F.coalesce(F.sum(length).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def transform(docs: DataFrame, seed: int = 1, percent: int = 90, spm_percent: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n`` (units), ``form``, ``text``, ``output``, ``prefix_chars`` and ``middle_chars`` (code points; null if plain).

    ``percent`` of the documents are transformed, ``spm_percent`` of these with the suffix first.  Cuts
    and form depend on seed and id alone.  Plain, that is unchanged, are also empty texts and
    those that hold a marker.  Null counts as the empty text; rows that repeat an id get the
    same draws and a row each, as do null ids; an empty table gives no rows.
    """
    spark_rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    h1, h2, h3, h4 = draws(F.col("doc_id").cast("string"), seed)
    rows = spark_rows.select("*", F.char_length(F.regexp_replace("text", "[A-Za-z]+", "a")).cast("bigint").alias("n"), h1.alias("_h1"), h2.alias("_h2"), h3.alias("_h3"), h4.alias("_h4"))
    plain = (F.col("text") == "") | has_marker(F.col("text")) | (F.col("_h3") % 100 >= percent)
    rows = rows.withColumn("form", F.when(plain, "plain").when(F.col("_h4") % 100 < spm_percent, "spm").otherwise("psm"))
    u1, u2 = F.col("_h1") % (F.col("n") + 1), F.col("_h2") % (F.col("n") + 1)
    rows = rows.withColumn("_cuts", F.when(F.col("form") != "plain", F.array(F.struct(F.lit(1).alias("cut"), F.least(u1, u2).alias("u")), F.struct(F.lit(2).alias("cut"), F.greatest(u1, u2).alias("u")))))

    runs = rows.select("_row", "doc_id", "n", "form", "_cuts", F.posexplode_outer(F.regexp_extract_all("text", F.lit(f"(?:{UNIT}){{1,{RUN}}}"), F.lit(0))).alias("_k", "_run"))
    asked = F.filter("_cuts", lambda c: F.floor(c["u"] / RUN) == F.col("_k"))  # a cut after the last unit meets none
    once = F.coalesce("_k", F.lit(0)) == 0  # what a document has once goes with its first run
    runs = runs.select("_row", *[F.when(once, F.col(c)).alias(c) for c in ("doc_id", "n", "form")], "_k", "_run", F.when(F.size(asked) > 0, asked).alias("_asked"))
    runs = runs.repartition("_row").withColumn("_start", before(F.char_length("_run"), ["_row"], "_k"))
    met = runs.withColumn("_cut", F.explode_outer("_asked"))
    first = F.coalesce(F.col("_cut.cut") == F.get("_asked", F.lit(0))["cut"], F.lit(True))  # a run that two cuts meet is here twice
    units = met.select("_row", "doc_id", "n", "form", "_k", "_start", "_cut", "_run", first.alias("_first"), F.posexplode_outer(F.when(F.col("_cut").isNotNull(), F.regexp_extract_all("_run", F.lit(UNIT), F.lit(0)))).alias("_pos", "_unit"))
    own = F.col("_first") & (F.coalesce("_pos", F.lit(0)) == 0)
    units = units.withColumn("_run", F.when(own, F.col("_run"))).withColumn("_c", F.col("_cut.cut"))
    units = units.withColumn("_at", F.col("_start") + before(F.char_length("_unit"), ["_row", "_k", "_c"], "_pos"))
    hit = F.col("_pos") == F.col("_cut.u") % RUN
    found = units.groupBy("_row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("form").alias("form"),
        F.array_sort(F.collect_list(F.when(F.col("_run").isNotNull(), F.struct("_k", "_run")))).alias("_runs"), *[F.max(F.when(hit & (F.col("_c") == c), F.col("_at"))).alias(f"_at{c}") for c in (1, 2)],
    )
    whole = found.withColumn("text", F.array_join(F.transform("_runs", lambda r: r["_run"]), "")).drop("_runs")
    ends = [F.when(F.col("form") != "plain", F.coalesce(f"_at{c}", F.char_length("text"))) for c in (1, 2)]
    cut = whole.withColumn("_a", ends[0]).withColumn("_b", ends[1])
    prefix, middle, suffix = F.substring("text", F.lit(1), F.col("_a")), F.substring("text", F.col("_a") + 1, F.col("_b") - F.col("_a")), F.substring("text", F.col("_b") + 1, F.char_length("text"))
    output = F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    output = output.when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(F.col("text"))
    return cut.select("doc_id", "n", "form", "text", output.alias("output"), F.col("_a").cast("bigint").alias("prefix_chars"), (F.col("_b") - F.col("_a")).cast("bigint").alias("middle_chars"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of.

    A transformed text holds no marker, and no marker can arise where a part meets one, so the
    first place of each is that of the transformation.
    """
    p, s, m = (F.locate(x, output) for x in (PREFIX, SUFFIX, MIDDLE))
    part = lambda begin, end: F.substring(output, begin + 3, end - begin - 3)
    rest = F.substring(output, m + 3, F.char_length(output))
    return F.when(form == "psm", F.concat(part(p, s), rest, part(s, m))).when(form == "spm", F.concat(part(p, m), rest, part(s, p))).otherwise(output)
