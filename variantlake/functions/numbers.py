"""Numeric expressions: significant figures, frequencies, tolerant comparison, scores."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .text import blank_to_null


def number(c: Column) -> Column:
    """The double in a text; NULL if there is none."""
    return blank_to_null(c.cast("string")).try_cast("double")


def significant(x: Column, figures: int) -> Column:
    """``x`` rounded to significant figures by scaling and rounding half to even; 0 stays 0."""
    scale = F.pow(F.lit(10.0), F.lit(figures - 1.0) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.rint(x * scale) / scale)


@F.pandas_udf(DoubleType())
def significant_exact(x: pd.Series, figures: pd.Series) -> pd.Series:
    """As ``significant``, but deciding by the exact binary value, as decimal printing does."""
    return pd.Series([None if v is None or math.isnan(v) else float(f"{v:.{int(f) - 1}e}") for v, f in zip(x, figures)])


def frequency(count: Column, total: Column, figures: int = 3) -> Column:
    """count / total in significant figures; NULL if the total is zero or either is missing."""
    return significant(F.try_divide(number(count), number(total)), figures)


def combined_frequency(counts: list[Column], totals: list[Column], figures: int = 4) -> Column:
    """The frequency over several sets; missing numbers count 0."""
    add = lambda cs: sum((F.coalesce(number(c), F.lit(0.0)) for c in cs[1:]), F.coalesce(number(cs[0]), F.lit(0.0)))
    return significant(F.try_divide(add(counts), add(totals)), figures)


def frequency_by_precedence(labelled: list[tuple[Column, str]]) -> Column:
    """``value (label)`` of the first source that has a value, else ``-``."""
    return F.coalesce(*[F.concat(blank_to_null(c.cast("string")), F.lit(f" ({label})")) for c, label in labelled], F.lit("-"))


def last_percent(c: Column) -> Column:
    """The last number of a comma list of percentages, as a fraction."""
    return F.try_element_at(F.split(c, ","), F.lit(-1)).try_cast("double") / 100


def percent_triple(c: Column) -> list[Column]:
    """The three percentages of a comma list as fractions."""
    return [F.try_element_at(F.split(c, ","), F.lit(i)).try_cast("double") / 100 for i in (1, 2, 3)]


def z_score(x: Column, mean: float, std: float) -> Column:
    return (x - mean) / std


def same_value(a: Column, b: Column) -> Column:
    """Equal as numbers if both are, else as texts; two NULLs are equal."""
    return F.coalesce(number(a) == number(b), F.lit(False)) | a.eqNullSafe(b)


def close(a: Column, b: Column, relative: float = 1e-9, absolute: float = 0.0) -> Column:
    return (a == b) | (F.abs(a - b) <= F.greatest(F.greatest(F.abs(a), F.abs(b)) * relative, F.lit(absolute)))


def greatest_number(*columns: Column) -> Column:
    """The largest of the values that are numbers; NULL if none is."""
    return F.greatest(*[number(c) for c in columns], F.lit(None).cast("double")) if len(columns) == 1 else F.greatest(*[number(c) for c in columns])


def change_size(ref: Column, alt: Column) -> dict[str, Column]:
    """Bases changed, deleted and inserted by an edit: the shared length, and what is left of each allele."""
    same = F.least(F.length(ref), F.length(alt))
    return {"changed": same, "deleted": F.length(ref) - same, "inserted": F.length(alt) - same}


def site_score_udf(table: dict[str, np.ndarray], background: float = 0.25, decimals: int = 2):
    """A vectorised scorer of equally long sequences by a position weight table: log2 of the product over positions.

    ``table`` gives each base's probabilities by position. Sequences of another length or with other letters get NULL.
    The table is an argument, as published score tables carry licences of their own.
    """
    size = len(next(iter(table.values())))

    @F.pandas_udf("double")
    def score(seqs: pd.Series) -> pd.Series:
        def one(s):
            if s is None or len(s) != size or any(c not in table for c in s):
                return None
            return round(sum(math.log2(table[c][i] / background) for i, c in enumerate(s)), decimals)

        return seqs.map(one, na_action="ignore").astype("float64")

    return score


class WindowScorer:
    """Scores of sequences of ``length`` bases by overlapping sub-windows: log2 of a product of table values.

    A factor is (positions, table, power): the bases at the positions, read as a number of base 4 (A, C, G, T), choose a
    value of the table, which counts with the power: 1, or -1 where windows overlap and the shared part is taken out.
    ``fixed`` gives positions with factors by base, such as a consensus over its background. Tables are arguments, as
    published ones carry licences of their own. Sequences that are null, of another length or hold other letters get no
    score; case doesn't count.
    """

    def __init__(self, length: int, factors: list[tuple[tuple[int, ...], np.ndarray, int]], fixed: dict[int, dict[str, float]] | None = None, decimals: int = 2):
        for p, t, _ in factors:
            if len(t) != 4 ** len(p):
                raise ValueError("a table has one value for each word of its positions")
        self.length, self.decimals = length, decimals
        self.logs = [(np.array(p), np.log2(np.asarray(t, float)) * power) for p, t, power in factors]
        self.single = [(p, np.log2([t[c] for c in "ACGT"])) for p, t in (fixed or {}).items()]
        self.code = np.full(256, -1, np.int64)
        self.code[[ord(c) for c in "ACGTacgt"]] = [0, 1, 2, 3] * 2

    def __call__(self, seqs: list[str | None]) -> np.ndarray:
        """NaN stands for no score."""
        out = np.full(len(seqs), np.nan)
        fits = np.flatnonzero([isinstance(s, str) and len(s) == self.length and s.isascii() for s in seqs])
        if len(fits):
            x = self.code[np.frombuffer("".join(seqs[i] for i in fits).encode(), np.uint8)].reshape(-1, self.length)
            ok = (x >= 0).all(1)
            fits, x = fits[ok], x[ok]
            total = np.zeros(len(x))
            for p, t in self.logs:
                total += t[x[:, p] @ (4 ** np.arange(len(p) - 1, -1, -1))]
            for p, t in self.single:
                total += t[x[:, p]]
            out[fits] = np.round(total, self.decimals)
        return out


def score_udf(scorer):
    """A column function from a sequence to its score, by a function from lists of sequences to arrays; NaN becomes NULL."""
    return F.arrow_udf(lambda seqs: pa.array(scorer(seqs.to_pylist()), from_pandas=True), "double")


def array_score_udf(scorer):
    """The same from an array of sequences to the array of their scores, all sequences of a batch in one call."""
    def score(lists: pa.Array) -> pa.Array:
        flat = pa.array(scorer(lists.flatten().to_pylist()), pa.float64(), from_pandas=True)
        offsets = np.concatenate([[0], np.cumsum([len(x) if x is not None else 0 for x in lists.to_pylist()])])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)

    return F.arrow_udf(score, "array<double>")
