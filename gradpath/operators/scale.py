"""Imputation by exact medians and scaling by population statistics, as ML stages.

Statistics are learnt on the training rows only and kept as parameters, so applying them
is a plain expression on any table of profiles.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F

ACCURACY = 10_000  # accuracy of the approximate quantiles that bracket a median
INLINE_VALUES = 200_000  # distinct values of a bracket that may go to the driver


def exact_medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Exact median of each column, the midpoint of the two middle values for an even count.

    Three passes for all columns together: approximate quantiles bracket every middle, the
    rows below and inside each bracket are counted, and the values inside are counted one by
    one. Only those values reach the driver, and their number is checked; a column with too
    many of them, or whose bracket missed the middle, is narrowed down on its own.
    """
    margin = 4.0 / ACCURACY
    value = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns}
    spots = [0.5 - margin, 0.5 + margin]
    first = df.agg(
        *[F.count(value[c]).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.percentile_approx(value[c], spots, ACCURACY).alias(f"q{i}") for i, c in enumerate(columns)],
    ).first()
    out: dict[str, float | None] = {c: None for c in columns}
    nr = {c: i for i, c in enumerate(columns) if first[f"n{i}"] > 0}
    if not nr:
        return out
    bracket = {c: tuple(first[f"q{i}"]) for c, i in nr.items()}
    inside = {c: value[c].between(*bracket[c]) for c in nr}
    counted = df.agg(
        *[F.count_if(value[c] < bracket[c][0]).alias(f"b{i}") for c, i in nr.items()],
        *[F.count_if(inside[c]).alias(f"w{i}") for c, i in nr.items()],
    ).first()
    entries = F.array(*[F.when(inside[c], F.struct(F.lit(c).alias("name"), value[c].alias("value"))) for c in nr])
    picked = df.select(F.explode(F.array_compact(entries)).alias("e")).groupBy("e.name", "e.value").count()
    head = picked.limit(INLINE_VALUES + 1).collect()
    for c, i in nr.items():
        n, below, width = first[f"n{i}"], counted[f"b{i}"], counted[f"w{i}"]
        hit = below <= (n - 1) // 2 and n // 2 < below + width
        if hit and len(head) <= INLINE_VALUES:
            out[c] = _middle({r["value"]: r["count"] for r in head if r["name"] == c}, n, below)
        else:
            alone = df.select(value[c].alias("value")).filter(F.col("value").isNotNull())
            out[c] = _median_between(alone, n, *bracket[c])
    return out


def _middle(counts: dict[float, int], n: int, below: int) -> float:
    """Mean of the two middle values, given those of a bracket and the rows below it."""
    picked, seen = {}, below
    for v, times in sorted(counts.items()):
        for rank in ((n - 1) // 2, n // 2):
            if seen <= rank < seen + times:
                picked[rank] = v
        seen += times
    return (picked[(n - 1) // 2] + picked[n // 2]) / 2.0


def _median_between(values: DataFrame, n: int, low: float, high: float) -> float:
    """The median of ``values``, looked for between ``low`` and ``high``."""
    lower_rank, upper_rank = (n - 1) // 2, n // 2

    def holds(a: float, b: float) -> tuple[bool, int, int]:
        r = values.agg(F.count_if(F.col("value") < a).alias("below"), F.count_if(F.col("value").between(a, b)).alias("inside")).first()
        return r["below"] <= lower_rank and upper_rank < r["below"] + r["inside"], r["below"], r["inside"]

    found, below, width = holds(low, high)
    if not found:  # a bracket is only trusted when it has been counted
        low, high = values.agg(F.min("value"), F.max("value")).first()
        _, below, width = holds(low, high)
    margin = 4.0 / ACCURACY
    while True:
        inside = values.filter(F.col("value").between(low, high))
        counts = inside.groupBy("value").count().limit(INLINE_VALUES + 1).collect()
        if len(counts) <= INLINE_VALUES:
            break
        spot = [max(0.0, (lower_rank - below) / width - margin), min(1.0, (upper_rank - below) / width + margin)]
        a, b = inside.agg(F.percentile_approx("value", spot, ACCURACY).alias("q")).first()["q"]
        found, new_below, new_width = holds(a, b)
        if found:
            low, high, below, width = a, b, new_below, new_width
        else:
            margin *= 2
    return _middle({r["value"]: r["count"] for r in counts}, n, below)


class _Columns(HasInputCols):
    def _cols(self) -> list[str]:
        return self.getOrDefault(self.inputCols)


class MedianImputer(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Fills gaps with the exact median of the training rows."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "MedianImputerModel":
        medians = exact_medians(dataset, self._cols())
        empty = [c for c, m in medians.items() if m is None]
        if empty:
            raise ValueError(f"no values to take a median of in {empty}")
        return MedianImputerModel(inputCols=self._cols(), medians=[medians[c] for c in self._cols()])


class MedianImputerModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    medians = Param(Params._dummy(), "medians", "median per input column", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, medians: list[float] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def expression(self, name: str, value: Column) -> Column:
        return F.coalesce(value.cast("double"), F.lit(self.getOrDefault(self.medians)[self._cols().index(name)]))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns({c: self.expression(c, F.col(c)) for c in self._cols()})


class PopulationScaler(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Centres and scales by mean and population deviation; a constant column is divided by 1."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "PopulationScalerModel":
        cols = self._cols()
        row = dataset.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
        means = [float(row[f"m{i}"]) for i in range(len(cols))]
        deviations = [float(row[f"s{i}"]) or 1.0 for i in range(len(cols))]
        return PopulationScalerModel(inputCols=cols, means=means, deviations=deviations)


class PopulationScalerModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    means = Param(Params._dummy(), "means", "mean per input column", TypeConverters.toListFloat)
    deviations = Param(Params._dummy(), "deviations", "divisor per input column", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, means: list[float] | None = None, deviations: list[float] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def expression(self, name: str, value: Column) -> Column:
        i = self._cols().index(name)
        return (value - F.lit(self.getOrDefault(self.means)[i])) / F.lit(self.getOrDefault(self.deviations)[i])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns({c: self.expression(c, F.col(c)) for c in self._cols()})
