"""How large sides of joins meet."""

from __future__ import annotations

from pyspark.sql import DataFrame


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join for which both sides are shuffled, however small it seems.

    Spark guesses a side's size from that of its files and the width of its rows: rows that an explode
    makes and the elements of arrays and maps do not count, nor how well a column packs. So it takes
    millions of edges or references for a few MB, and collects them on the driver to broadcast them.
    """
    return df.hint("merge")
