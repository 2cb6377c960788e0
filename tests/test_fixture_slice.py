"""The minimum slice reproduces FIXTURES.md section 4 at every scale factor."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as se

EXPECTED = {  # sf: (rows, triggered, tp, fp, fn, tn)
    "0.001": (200, 51, 2, 23, 9, 53),
    "0.01": (500, 151, 8, 54, 19, 127),
    "0.1": (2000, 909, 51, 307, 54, 378),
}


@pytest.mark.parametrize("sf", sorted(EXPECTED))
def test_slice_counts(spark, sf):
    s = se.queries()["trigger_samples"](spark, f"/root/testdata/sf{sf}")
    t, y = F.col("trigger"), F.col("toxic")
    r = s.agg(F.count(F.lit(1)), F.count_if(t), F.count_if((y == 1) & t), F.count_if((y == 0) & t),
              F.count_if((y == 1) & ~t), F.count_if((y == 0) & ~t)).first()
    assert tuple(r) == EXPECTED[sf]
