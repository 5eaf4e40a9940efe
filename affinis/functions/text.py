"""String expressions on which keys are made and compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import col

SEPARATOR = "</s>"


def serialize(columns: list[str], sep: str = SEPARATOR) -> Column:
    """One text of several columns; a null is an empty field, and the
    separators stand whatever the fields hold."""
    if not columns:
        raise ValueError("no columns to serialise")
    return F.concat_ws(sep, *[F.coalesce(col(c).cast("string"), F.lit("")) for c in columns])


def ascii_only(column: Column) -> Column:
    return F.regexp_replace(column, r"[^\x00-\x7F]", "")


def lower_strings(df: DataFrame) -> DataFrame:
    """All string columns in lower case."""
    return df.select(*[F.lower(col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else col(f.name) for f in df.schema])


def ngrams(column: Column, n: int = 3) -> Column:
    """The character n-grams of a text in lower case, with repeats. A shorter
    text is its own n-gram; an empty one has none."""
    text = F.lower(column)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.length(text) > 0, grams).otherwise(F.array().cast("array<string>"))


def ngram_cosine(a: Column, b: Column, n: int = 3) -> Column:
    """Cosine of the n-gram counts of two texts; null if either has none. The
    n-grams of both are sorted together, so the work is in proportion to them."""

    def let(value: Column, body) -> Column:
        # a lambda's argument is computed once; an expression inside its body would be for every n-gram
        return F.transform(F.array(value), body)[0]

    def tagged(column: Column, side: int) -> Column:
        return F.transform(ngrams(column, n), lambda g: F.struct(g.alias("g"), F.lit(side).alias("s")))

    def runs(grams: Column) -> Column:
        """Each n-gram of a side with its count, in order."""
        places = F.sequence(F.lit(0), F.greatest(F.size(grams) - 1, F.lit(0)))
        ends = F.filter(places, lambda i: ~F.get(grams, i).eqNullSafe(F.get(grams, i + 1)))
        return let(ends, lambda e: F.transform(e, lambda end, j: F.struct(F.get(grams, end)["g"].alias("g"), F.get(grams, end)["s"].alias("s"), (end - F.coalesce(F.get(e, j - 1), F.lit(-1))).cast("long").alias("c"))))

    def cosine(r: Column) -> Column:
        def total(side: int) -> Column:
            return F.aggregate(r, F.lit(0).cast("long"), lambda t, x: t + F.when(x["s"] == side, x["c"] * x["c"]).otherwise(0))

        # a run of the first side is followed by that of the second with the same n-gram, if there is one
        both = F.transform(r, lambda x, j: let(F.get(r, j + 1), lambda y: F.when((x["s"] == 0) & (y["g"] == x["g"]), x["c"] * y["c"]).otherwise(0)))
        size = total(0).cast("double") * total(1)
        return F.when(size > 0, F.aggregate(both, F.lit(0).cast("long"), lambda t, x: t + F.coalesce(x, F.lit(0))) / F.sqrt(size))

    return let(F.sort_array(F.concat(tagged(a, 0), tagged(b, 1))), lambda grams: let(runs(grams), cosine))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / length of the longer text; 1 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)
