"""The line packer as a fold over a text's lines: chunks are ranges of lines with an overlap of five lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, MOST, OVERLAP = 100, 2000, 5


def line_ranges(df: DataFrame, text: str = "content") -> DataFrame:
    """df with ranges array<struct<start_line, end_line, n_chars>> (lines from 0, n_chars with one break a line).

    A text of MOST characters or less is one range. Else a range ends before the line that would take it beyond MOST, if it has more than LEAST
    characters by then; the next one starts OVERLAP lines earlier. The last one is kept if it has more than LEAST.
    """
    # the state holds the open range's first line and size and the lengths of the last OVERLAP lines
    size = "(a.n + x)"
    again = f"slice(a.last, size(a.last) - least(a.i - a.s, {OVERLAP}) + 1, least(a.i - a.s, {OVERLAP}))"
    last = f"if(size(a.last) < {OVERLAP}, array_append(a.last, x), array_append(slice(a.last, 2, {OVERLAP - 1}), x))"
    expr = f"""
      if(length({text}) <= {MOST},
        array(struct(0 AS start_line, size(split({text}, '\n', -1)) - 1 AS end_line, cast(length({text}) + 1 AS int) AS n_chars)),
        aggregate(
          transform(split({text}, '\n', -1), x -> length(x) + 1),
          struct(0 AS i, 0 AS s, 0 AS n, cast(array() AS array<int>) AS last, cast(array() AS array<struct<start_line:int,end_line:int,n_chars:int>>) AS done),
          (a, x) -> if({size} > {MOST} AND a.n > {LEAST},
            struct(a.i + 1 AS i, a.i - least(a.i - a.s, {OVERLAP}) AS s, aggregate({again}, x, (t, y) -> t + y) AS n, {last} AS last,
              array_append(a.done, struct(a.s AS start_line, a.i - 1 AS end_line, a.n AS n_chars)) AS done),
            struct(a.i + 1 AS i, a.s AS s, {size} AS n, {last} AS last, a.done AS done)),
          a -> if(a.n > {LEAST}, array_append(a.done, struct(a.s AS start_line, a.i - 1 AS end_line, a.n AS n_chars)), a.done)))"""
    return df.withColumn("ranges", F.expr(expr))


def line_chunks(df: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """(key, chunk_no, start_line, end_line, n_chars, content) of the packer's ranges."""
    rows = line_ranges(df.select(key, text), text).select(key, F.split(text, "\n", -1).alias("_lines"), F.posexplode("ranges").alias("chunk_no", "r"))
    return rows.select(key, "chunk_no", "r.start_line", "r.end_line", "r.n_chars", F.array_join(F.slice("_lines", F.col("r.start_line") + 1, F.col("r.end_line") - F.col("r.start_line") + 1), "\n").alias("content"))
