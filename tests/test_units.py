import pytest
from pyspark.sql import functions as F

from taintgraph.operators import units

SCHEMA = "activity_id long, standard_type string, standard_value double, standard_units string, pchembl_value double, mol_weight double, activity_comment string, value double, unit string"


def pm(spark, rows):
    df = spark.createDataFrame([(i, *r, 0.0, "x") for i, r in enumerate(rows)], SCHEMA)
    return {r["activity_id"]: (r["value_pm"], r["origin"], r["is_plain_nm"]) for r in units.potencies(df).collect()}


CASES = [
    (("IC50", 1.5, "nM", None, None, None), 1500),
    (("IC50", 0.0125, "nM", None, None, None), 13),  # half up
    (("ic50 ", 26.2, "uM", None, None, None), 26_200_000),
    (("Ki", 26.2, "μM", None, None, None), 26_200_000),
    (("Kd (µM)", 2.0, "-", None, None, None), 2_000_000),
    (("EC50_nM", 2.0, None, None, None, None), 2000),
    (("EC50 [pM]", 7.0, "n/a", None, None, None), 7),
    (("IC50", 3.0, "10^-8 M", None, None, None), 30_000),
    (("IC50", 3.0, "nmol.dm-3", None, None, None), 3000),
    (("IC50", 3.0, "umol l-1", None, None, None), 3_000_000),
    (("IC50", 3.0, "micromolar", None, None, None), 3_000_000),
    (("IC50", 3.0, "ug.mL-1", None, 300.0, None), 10_000_000),
    (("IC50", 3.0, "ug/mL", None, None, None), None),  # no molecular weight
    (("pIC50", 9.0, "-log M", None, None, None), 1000),
    (("-Log Ki", 6.0, "M", None, None, None), 1_000_000),
    (("log10 Ki", -6.0, "log(M)", None, None, None), 1_000_000),
    (("IC50", -6.0, "Log M", None, None, None), 1_000_000),
    (("IC50", 50.0, "%", None, None, None), None),
    (("IC50", 50.0, "furlong", 6.0, None, None), None),
    (("Inhibition", 50.0, "nM", None, None, None), "absent"),
    ((None, 50.0, "nM", None, None, None), "absent"),
    (("IC50", 0.0, "uM", None, None, None), None),
    (("IC50", None, None, None, None, "5,510 nM"), 5_510_000),
    (("IC50", None, None, None, None, "0,00102 μM"), 1020),
    (("IC50", None, None, None, None, "1,640,000 pM"), 1_640_000),
    (("IC50", None, None, None, None, "see text; IC50 4.22e-07 M, ATP at 700 uM"), 422_000),
    (("IC50", None, None, None, None, "value given in the figure legend (IC50=1.00e-09M)"), 1000),
    (("IC50", None, None, None, None, "between 10 and 66 nM"), None),
    (("IC50", None, None, None, None, "IC50 10-20 nM"), None),
    (("IC50", None, None, None, None, "IC50 = 10 nM to 20 nM"), None),
    (("IC50", None, None, None, None, "IC50 = 1 nM, later IC50 = 2 nM"), None),
    (("IC50", None, None, 6.0, None, "10% at 1 uM"), 1_000_000),
    (("IC50", None, None, None, None, "insoluble above 30 uM"), None),
]


def test_written_forms(spark):
    got = pm(spark, [c for c, _ in CASES])
    for i, (case, want) in enumerate(CASES):
        if want == "absent":
            assert i not in got, case
        else:
            assert got[i][0] == want, (case, got[i])


def test_missing_units_are_inferred_or_flagged(spark):
    rows = [("IC50", 1.2 * 10**k, u, 9 - e - k - 0.08, None, None) for k in range(2, 6) for e, u in ((0, None), (3, ""), (-3, "n/a"), (9, "-"), (6, None))]
    rows += [("IC50", 100.0, None, 5.5, None, None), ("IC50", 100.0, None, None, None, None)]
    got = pm(spark, rows)
    for i, (_, v, _, p, _, _) in enumerate(rows[:-2]):
        assert got[i][1] == "inferred"
        assert abs(12 - __import__("math").log10(got[i][0]) - p) < 0.05
    assert got[len(rows) - 2][:2] == (None, "unsure") and got[len(rows) - 1][:2] == (None, "unsure")


def test_plain_nanomolar_repeats_and_empty(spark):
    rows = [("IC50", 1.0, " nM", None, None, None)]
    assert pm(spark, rows)[0] == (1000, "value", True)
    df = spark.createDataFrame([(1, "IC50", 1.0, "uM", None, None, None, 0.0, "x")] * 3, SCHEMA)
    assert units.potencies(df).count() == 1
    assert units.potencies(df.limit(0)).count() == 0


@pytest.mark.parametrize("text,code", [("nM", -9), ("NM", None), ("mol/L", 0), ("g/L", units.MASS), ("mg/dL", units.MASS - 2), ("", units.NONE), ("log units", units.LOGUNIT), ("%", None)])
def test_unit_codes(spark, text, code):
    assert spark.range(1).select(units.unit_code(F.lit(text)).alias("c")).first()["c"] == code
