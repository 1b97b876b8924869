"""Validation, coercion and encoding of profiles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from gradpath.functions.numbering import number_rows
from gradpath.functions.sizing import broadcast_if_small
from gradpath.functions.text import blank_to_null, strip
from gradpath.session import cut_lineage

# Limits of the request format; the web form has an upper age of 50.
LIMITS = {
    "Age": (15, 40),
    "Internships": (0, None),
    "CGPA": (0, 10),
    "Hostel": (0, 1),
    "HistoryOfBacklogs": (0, 1),
}
REQUIRED_TEXT = ["Gender", "Stream"]
#: Values that a dictionary holds as literals; they are searched one after the other.
INLINE_LIMIT = 50


def violations(limits: dict = LIMITS, required: list[str] = REQUIRED_TEXT) -> Column:
    """Array of reasons, in field order; empty for a valid profile."""
    checks = []
    for field, (low, high) in limits.items():
        checks.append(F.when(F.col(field).isNull(), f"{field} missing"))
        if low is not None:
            checks.append(F.when(F.col(field) < low, f"{field} below {low}"))
        if high is not None:
            checks.append(F.when(F.col(field) > high, f"{field} above {high}"))
    checks += [F.when(F.col(field).isNull(), f"{field} missing") for field in required]
    return F.array_compact(F.array(*checks))


def mark_violations(df: DataFrame, limits: dict = LIMITS) -> DataFrame:
    return df.withColumn("violations", violations(limits))


def split_valid(df: DataFrame, limits: dict = LIMITS) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their ``violations``)."""
    marked = mark_violations(df, limits)
    bad = F.size("violations") > 0
    return marked.filter(~bad).drop("violations"), marked.filter(bad)


def flag(c: Column) -> Column:
    """1 for the value 1, else 0."""
    return F.when(c.cast("int") == 1, 1).otherwise(0)


def normalise_flags(df: DataFrame) -> DataFrame:
    return df.withColumns({c: flag(F.col(c)) for c in ("Hostel", "HistoryOfBacklogs")})


def coerce_form(df: DataFrame) -> DataFrame:
    """Typed columns from form text: unreadable numbers become 0 and so do counts that no
    integer holds; an age is the integer its text begins with, or null. The skill list is
    split, trimmed and rid of blanks, an empty role becomes null."""
    number = lambda c: F.coalesce(F.nanvl(strip(F.col(c)).try_cast("double"), F.lit(None)), F.lit(0.0))
    return df.withColumns(
        {
            "Age": F.regexp_extract(strip(F.col("age_text")), r"^[+-]?[0-9]+", 0).try_cast("int"),
            "Internships": F.coalesce(number("internships_text").try_cast("int"), F.lit(0)),
            "CGPA": number("cgpa_text"),
            "skills": F.filter(F.transform(F.split("skills_text", ","), strip), lambda s: s != ""),
            "desired_role": blank_to_null(F.col("role_text")),
        }
    )


@dataclass
class LabelDictionary:
    """Codes of one categorical column: sorted distinct values, numbered from 0.

    Up to ``inline_limit`` values the dictionary is held as literals and looked up inside
    the row, without join or shuffle; beyond, it is a table that is joined, broadcast when
    it was measured to be small. Codes and results are the same either way.
    """

    column: str
    table: DataFrame  # (value, code)
    values: list[str] | None  # None when there are too many to hold

    @classmethod
    def fit(cls, df: DataFrame, column: str, inline_limit: int = INLINE_LIMIT) -> "LabelDictionary":
        distinct = df.select(F.col(column).alias("value")).filter(F.col("value").isNotNull()).distinct()
        head = distinct.limit(inline_limit + 1).collect()
        spark = df.sparkSession
        if len(head) <= inline_limit:
            values = sorted((r["value"] for r in head), key=lambda v: v.encode())
            rows = [(v, i) for i, v in enumerate(values)]
            return cls(column, spark.createDataFrame(rows, "value string, code int"), values)
        numbered = number_rows(distinct, F.col("value"), out="code")
        return cls(column, cut_lineage(numbered.select("value", F.col("code").cast("int").alias("code"))), None)

    @classmethod
    def from_table(cls, table: DataFrame, column: str, inline_limit: int = INLINE_LIMIT) -> "LabelDictionary":
        """From a saved (value, code) table."""
        head = table.limit(inline_limit + 1).collect()
        small = len(head) <= inline_limit
        return cls(column, table, [r["value"] for r in sorted(head, key=lambda r: r["code"])] if small else None)

    @classmethod
    def of(cls, spark, column: str, values: list[str]) -> "LabelDictionary":
        return cls(column, spark.createDataFrame([(v, i) for i, v in enumerate(values)], "value string, code int"), list(values))

    def code_of(self, c: Column) -> Column:
        if not self.values:
            return F.lit(None).cast("int")
        pairs = [F.lit(x) for i, v in enumerate(self.values) for x in (v, i)]
        return F.try_element_at(F.create_map(*pairs), c)

    def attach(self, df: DataFrame, out: str) -> DataFrame:
        """``df`` with the code in ``out``; null where the value is unknown."""
        if self.values is not None:
            return df.withColumn(out, self.code_of(F.col(self.column)))
        codes = self.table.select(F.col("value").alias("_value"), F.col("code").cast("int").alias(out))
        return df.join(broadcast_if_small(codes), df[self.column] == F.col("_value"), "left").drop("_value")

    def code_of_value(self, value: str) -> int | None:
        """The code of one value, None if it is unknown."""
        if self.values is not None:
            return self.values.index(value) if value in self.values else None
        found = self.table.filter(F.col("value") == value).select("code").first()
        return None if found is None else int(found["code"])


def encode(df: DataFrame, gender: LabelDictionary, stream: LabelDictionary) -> DataFrame:
    """Numeric features in place of the raw ones.

    One unknown value sets both codes to 0. Flags are normalised. The texts stay as
    ``GenderName`` and ``StreamName``; ``GenderCode`` is the gender's own code, null where
    it is unknown, for changed profiles whose stream is known.
    """
    coded = stream.attach(gender.attach(df, "_g"), "_s")
    known = F.col("_g").isNotNull() & F.col("_s").isNotNull()
    return (
        normalise_flags(coded)
        .withColumnsRenamed({"Gender": "GenderName", "Stream": "StreamName"})
        .withColumns({"Gender": F.when(known, F.col("_g")).otherwise(0), "Stream": F.when(known, F.col("_s")).otherwise(0), "GenderCode": F.col("_g")})
        .drop("_g", "_s")
    )


def class_listing(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("value")).filter(F.col("value").isNotNull()).distinct().orderBy("value")
