"""Numbers as text where decimal and binary values part."""

from decimal import Decimal

from pyspark.sql import functions as F

from tesserae.functions import annotations as A
from tesserae.plans import queries_meta


def test_decimal_ties_go_away_from_zero(spark, tmp_path):
    """9780 quarters of a micron are 2.445 mm; 976,562 of 4096 square microns each are 10^9 less 512."""
    spark.createDataFrame([(k,) for k in (9780, 9820, 3999, 4000, 4020, 976562, 72_000_020)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    got = {r["p_partkey"]: (r["length"], r["area"]) for r in queries_meta.format_microns(spark, str(tmp_path)).collect()}
    assert got == {
        9780: ("2.45 mm", "10.01 mm²"),
        9820: ("2.46 mm", "10.06 mm²"),
        3999: ("999.8 µm", "4.09 mm²"),
        4000: ("1.00 mm", "4.10 mm²"),
        4020: ("1.01 mm", "4.12 mm²"),
        976562: ("244.14 mm", "1000.00 mm²"),
        72_000_020: ("18000.01 mm", "73728.02 mm²"),
    }


def test_doubles_keep_their_exact_value(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(A.format_length(F.lit(2445.0))) == "2.44 mm" and one(A.format_length(F.lit(Decimal("2445")), A.fixed_decimal)) == "2.45 mm"
    assert one(A.format_area(F.lit(Decimal("0.25")), A.fixed_decimal)) == "0.3 µm²" and one(A.format_length(F.lit(None).cast("double"))) is None
