"""Wide rows: rounding without printing numbers, code that the JVM compiles."""

import random
import struct

from pyspark.sql import functions as F

from buildlode.domain import Domain
from buildlode.functions.scalars import rounded


def test_rounding_is_round_to_the_last_bit(spark):
    draw = random.Random(7)
    values = [draw.uniform(-1, 1) * 10 ** draw.randint(-12, 12) for _ in range(20000)]
    values += [k / 2**j for j in range(40) for k in (1, 3, 5, -7)]
    values += [k / 10**j * s for j in range(14) for k in (5, 15, 25, 49999, 50001) for s in (1, -1)]
    values += [struct.unpack("d", struct.pack("Q", draw.getrandbits(64)))[0] for _ in range(5000)]
    values += [0.0, -0.0, float("inf"), float("-inf"), float("nan"), 0.0000005, 1e12, 2.5e-6, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (6, 8, 9):
        both = df.selectExpr("v", f"{rounded('v', digits)} AS a", f"round(v, {digits}) AS b")
        assert both.schema["a"].dataType == both.schema["b"].dataType
        assert both.where(~F.col("a").eqNullSafe(F.col("b"))).collect() == []


def test_no_code_longer_than_the_jvm_compiles(spark):
    Domain(spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
