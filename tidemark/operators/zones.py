"""What tells zones apart beyond the order of one column: a space-filling order and bitsets.

The space-filling order ranks each column among its approximate quantiles and interleaves the bits
of the ranks (Z-order), so that rows near in all columns lie near each other and each column alone
rules most zones out. Bitsets (Bloom filters) hold a few hashed places for each value of a column
in a zone; a zone where one of a value's places is not set does not hold it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.predicates import LOOKED_UP, ColumnTest

# Ranks of a column in the space-filling order have so many bits, fewer if columns are many.
RANK_BITS = 8
# Places for each value, and bits for each row of the largest zone: 1.2 % false alarms.
PLACES, BITS_PER_ROW = 4, 10


def as_number(column: Column, dtype: T.DataType) -> Column:
    """A double in the order of an atomic column; text goes by its first six bytes."""
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        data = F.encode(column, "UTF-8") if isinstance(dtype, T.StringType) else column
        first = F.rpad(F.hex(F.substring(data, 1, 6)), 12, "0")
        return F.conv(first, 16, 10).cast("double")
    if isinstance(dtype, T.DateType):
        return F.unix_date(column).cast("double")
    if isinstance(dtype, T.TimestampNTZType):
        # Any fixed zone keeps the order.
        return F.unix_micros(F.to_utc_timestamp(column.cast("timestamp"), "UTC")).cast("double")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(column).cast("double")
    return column.cast("double")


def z_key(rows: DataFrame, columns: Sequence[str]) -> Column:
    """The place of a row in the space-filling order of ``columns``; one pass finds quantiles."""
    numbers = [as_number(F.col(f"`{name}`"), rows.schema[name].dataType) for name in columns]
    bits = max(1, min(RANK_BITS, 63 // len(columns)))
    shares = [n / (1 << bits) for n in range(1, 1 << bits)]
    cuts = rows.agg(
        *[F.percentile_approx(number, shares, 10_000).alias(f"c{at}") for at, number in enumerate(numbers)]
    ).first()
    cuts = [np.array(cut if cut is not None else [0.0] * len(shares)) for cut in cuts]

    @F.arrow_udf("long")
    def key(values: pa.Array) -> pa.Array:
        matrix = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), len(cuts))
        found = np.zeros(len(matrix), np.int64)
        ranks = [np.searchsorted(cut, column, side="right") for cut, column in zip(cuts, matrix.T)]
        for bit in range(bits):
            for at, rank in enumerate(ranks):
                found |= (rank >> bit & 1) << bit * len(ranks) + at
        return pa.array(found)

    # Nulls go with what is not a number, to the end.
    return key(F.array(*[F.coalesce(number, F.lit(float("nan"))) for number in numbers]))


def bits_for(largest_zone: int) -> int:
    """Bits of each zone's set, a whole number of longs."""
    return 64 * max(1, -(-BITS_PER_ROW * largest_zone // 64))


def _places(value: Column, bits: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(value, F.lit(n)), F.lit(bits)) for n in range(PLACES)])


def bitsets(rows: DataFrame, zone: str, column: str, bits: int) -> DataFrame:
    """(zone, word, bits): the longs of each zone's set for one column that are not zero."""
    value = F.col(f"`{column}`")
    place = rows.where(value.isNotNull()).select(zone, F.explode(_places(value, bits)).alias("place"))
    word = F.floor(F.col("place") / 64).cast("long")
    bit = F.expr("shiftleft(1L, CAST(place % 64 AS INT))")
    return place.groupBy(zone, word.alias("word")).agg(F.bit_or(bit).alias("bits"))


def looked_up(
    spark, path: str, zone: str, tests: Sequence[ColumnTest], columns: Sequence[str], bits: int
) -> DataFrame:
    """(zone, LOOKED_UP): the numbers of the tests for which a zone may hold one of the values.

    The sets are read where the values have their places; these are as many as the predicate has
    literals, and go to the tasks.
    """
    found = None
    for number, test in enumerate(tests):
        literals = F.array(*test.literals) if test.literals else F.array().cast("array<long>")
        values = spark.range(1).select(F.posexplode(literals).alias("at", "value"))
        places = values.select("at", F.explode(F.array_distinct(_places(F.col("value"), bits))).alias("place"))
        wanted = [(row["at"], row["place"] // 64, row["place"] % 64) for row in places.collect()]
        if not wanted:
            continue
        asked = spark.createDataFrame(wanted, "at int, word long, bit int")
        needed = asked.groupBy("at").agg(F.count("*").alias("needed"))
        words = spark.read.parquet(f"{path}/bitsets/{list(columns).index(test.field.name)}")
        words = words.where(F.col("word").isin(sorted({word for _, word, _ in wanted})))
        hit = F.expr("shiftright(bits, bit) & 1") == 1
        met = words.join(F.broadcast(asked), "word").where(hit).groupBy(zone, "at").agg(F.count("*").alias("n"))
        full = met.join(F.broadcast(needed), "at").where("n = needed").select(zone, F.lit(number).alias("test"))
        found = full if found is None else found.unionByName(full)
    if found is None:
        found = spark.createDataFrame([], f"{zone} int, test int")
    return found.groupBy(zone).agg(F.collect_set("test").alias(LOOKED_UP))
