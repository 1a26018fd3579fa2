"""Six significant digits against C's printf, which Python's % is."""

from __future__ import annotations

import math
import random
import struct

from pyspark.sql import functions as F

from vouch.functions.numbers import six_digits


def numbers():
    rng = random.Random(7)
    out = [0.0, -0.0, 1.0, -1.5, 999999.5, 999999.49, 1e6, 123456.5, 100000.5, 100001.5, 0.0001, 0.00009999995, 1e-5, 12.34375, 1.234565, 1.234575, 2.5, 1e15, 1e16, 1e22, 1e300, math.inf, -math.inf, math.nan]
    out += [rng.randint(0, 10**7) * 10.0 ** -rng.randint(0, 9) for _ in range(20_000)]
    out += [(rng.randint(10**5, 10**6) * 10 + 5) / 10.0 ** rng.randint(0, 18) for _ in range(20_000)]
    out += [rng.randint(0, 1 << 24) / (1 << rng.randint(0, 12)) for _ in range(20_000)]
    out += [rng.uniform(-1000, 1000) * 1.5 for _ in range(20_000)]
    out += [x for x in (struct.unpack("<d", rng.randbytes(8))[0] for _ in range(20_500)) if not math.isnan(x) and abs(x) > 2.3e-308]
    return out


def test_as_printf(spark):
    given = numbers()
    assert len(given) > 100_000
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i long, x double").repartition(8).select("i", six_digits("x").alias("s")).collect()
    found = {r.i: r.s for r in rows}
    assert [(x, found[i], "%g" % x) for i, x in enumerate(given) if found[i] != "%g" % x] == []


def test_floats_and_nulls(spark):
    rows = spark.sql("SELECT CAST(15.75 AS FLOAT) AS a, CAST(NULL AS DOUBLE) AS b, 7 AS c").select(*(six_digits(c).alias(c) for c in "abc"), F.lit(1)).first()
    assert (rows.a, rows.b, rows.c) == ("15.75", None, "7")
