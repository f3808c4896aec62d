"""Jaro-Winkler similarity, which Spark lacks, as folds over arrays of characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TAKEN = "\uffff"  # stands for a character that is matched; no character of text


def _bound(value: Column, f) -> Column:
    """f of a value that is evaluated once, as a lambda's variable."""
    return F.transform(F.array(value), f)[0]


def _matched(x: Column) -> Column:
    """(left, rest) of texts a and b: the characters of a that find an equal one in b within reach, in order, and b with those taken out.

    Each character of a takes the first free place of b that is not farther than the reach, half the longer length less one.
    """
    reach = F.greatest(F.floor(F.greatest(F.length(x["a"]), F.length(x["b"])) / 2).cast("int") - 1, F.lit(0))

    def step(acc: Column, ch: Column) -> Column:
        i = acc["i"] + 1  # from 1
        at = F.call_function("locate", ch, acc["rest"], F.greatest(i - acc["reach"], F.lit(1)))
        found = (at > 0) & (at <= i + acc["reach"])
        return F.struct(
            i.alias("i"), acc["reach"].alias("reach"), F.when(found, F.overlay(acc["rest"], F.lit(_TAKEN), at, F.lit(1))).otherwise(acc["rest"]).alias("rest"),
            F.when(found, F.concat(acc["left"], ch)).otherwise(acc["left"]).alias("left"),
        )

    first = F.struct(F.lit(0).alias("i"), reach.alias("reach"), x["b"].alias("rest"), F.lit("").alias("left"))
    return F.aggregate(F.split(x["a"], ""), first, step)


def _score(x: Column) -> Column:
    """Of the texts a and b, neither empty, and what is matched, m."""
    left = x["m"]["left"]
    m = F.length(left)
    right = F.array_compact(F.zip_with(F.split(x["b"], ""), F.split(x["m"]["rest"], ""), lambda ch, r: F.when(r == F.lit(_TAKEN), ch)))
    swaps = F.floor(F.size(F.filter(F.zip_with(F.split(left, ""), right, lambda p, q: p != q), lambda y: y)) / 2)
    jaro = (m / F.length(x["a"]) + m / F.length(x["b"]) + (m - swaps) / m) / 3
    heads = F.zip_with(F.split(F.substring(x["a"], 1, 4), ""), F.split(F.substring(x["b"], 1, 4), ""), lambda p, q: F.coalesce(p == q, F.lit(False)))
    prefix = F.coalesce(F.nullif(F.array_position(heads, False), F.lit(0)) - 1, F.size(heads))
    return _bound(F.when(m > 0, jaro).otherwise(0.0), lambda j: F.when(j > 0.7, j + 0.1 * prefix * (1 - j)).otherwise(j))


def jaro_winkler(a: Column | str, b: Column | str) -> Column:
    """On code points; the prefix boost applies above 0.7; either side empty or null gives 0, equal texts 1."""
    a, b = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in (a, b))
    clean = F.struct(F.translate(a, _TAKEN, "\ufffe").alias("a"), F.translate(b, _TAKEN, "\ufffe").alias("b"))
    whole = _bound(clean, lambda x: _bound(F.struct(x["a"].alias("a"), x["b"].alias("b"), _matched(x).alias("m")), _score))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(whole)
