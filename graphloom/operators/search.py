"""Search for a text within the columns of a table, by an index of its grams.

Equal folded values are one; the index holds for each the distinct runs of one, two and three characters as postings (gram,
value), and how many values have each gram. A text is looked up by the rarest of its own grams: values that have all of them
are candidates, these alone are compared, and the rows that hold them are found by their values' numbers. A text of one or
two characters is a gram itself. An empty text is in every value.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.unicode import bind, casefold
from graphloom.sources.tables import written


class TextIndex(NamedTuple):
    """rows: the table with `_row`; cells: _row, _value; values: _value, value (folded); postings: gram, _value; counts: gram, n."""

    rows: DataFrame
    cells: DataFrame
    values: DataFrame
    postings: DataFrame
    counts: DataFrame


def grams(value: Column) -> Column:
    """Distinct runs of one to three characters, in time linear in the value's length."""

    def runs(chars: Column) -> Column:
        run = lambda k: F.transform(chars, lambda c, i: F.concat(c, *(F.get(chars, i + j) for j in range(1, k))))
        return F.array_distinct(F.array_compact(F.concat(*map(run, (1, 2, 3)))))  # a run over the end is null

    return F.when(value == "", F.array().cast("array<string>")).otherwise(bind(F.split(value, ""), runs))


def build(rows: DataFrame, columns: tuple[str, ...]) -> TextIndex:
    """Index of the columns; nulls are no values. Rows may repeat."""
    kept = written(rows.withColumn("_row", F.monotonically_increasing_id()))
    texts = F.array_distinct(F.array_compact(F.array(*(casefold(F.col(c).cast("string")) for c in columns))))
    held = kept.select("_row", F.explode(texts).alias("value"))
    values = written(held.select("value").distinct().withColumn("_value", F.monotonically_increasing_id()))
    cells = written(held.join(values, "value").select("_row", "_value"))
    postings = written(values.select(F.explode(grams(F.col("value"))).alias("gram"), "_value").repartitionByRange("gram", "_value"))
    return TextIndex(kept, cells, values, postings, written(postings.groupBy("gram").agg(F.count("*").alias("n"))))


def rarest(index: TextIndex, text: str, most: int = 4) -> list[str] | None:
    """At most `most` of the text's longest grams, the rarest in the table; None if the table lacks one of them."""
    k = min(3, len(text))
    mine = sorted({text[i : i + k] for i in range(len(text) - k + 1)})
    found = index.counts.where(F.col("gram").isin(*mine)).orderBy("n", "gram").collect()  # a row for each gram of the text
    return None if len(found) < len(mine) else [r["gram"] for r in found[:most]]


def search(index: TextIndex, text: str) -> DataFrame:
    """Rows with the text, of any case, in one of the index's columns."""
    folded = text.casefold()
    if not folded:
        found = index.cells
    else:
        picked = rarest(index, folded)
        if picked is None:
            return index.rows.limit(0).drop("_row")
        values = index.postings.where(F.col("gram").isin(*picked)).groupBy("_value").agg(F.count("*").alias("n")).where(F.col("n") == len(picked))
        if len(folded) > 3:
            values = index.values.join(values, "_value", "left_semi").where(F.contains("value", F.lit(folded)))
        found = index.cells.join(values, "_value", "left_semi")
    return index.rows.join(found.select("_row").distinct(), "_row", "left_semi").drop("_row")
