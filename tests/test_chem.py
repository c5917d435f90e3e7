import pytest
from pyspark.sql import functions as F

from peakloom.functions import chem, keys, vectors
from peakloom.functions.peak_arrays import PROFILES, PeakProfile, merged, preprocessed, profile, transformed, zipped


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


@pytest.mark.parametrize("name,charge,multimer,shift,trusted", chem.ADDUCTS)
def test_adduct_round_trip(spark, name, charge, multimer, shift, trusted):
    mz = chem.precursor_mz(F.lit(300.0), F.lit(charge), F.lit(multimer), F.lit(shift))
    back = one(spark, chem.neutral_mass(mz, F.lit(charge), F.lit(multimer), F.lit(shift)))[0]
    assert back == pytest.approx(300.0, abs=1e-9)
    assert trusted is (name != "[M+2H]2+")


def test_unknown_adduct_is_unsupported(spark):
    df = spark.createDataFrame([("[M+H]+",), ("[M+X]+",), (None,)], "adduct string")
    got = {r.adduct: (r.supported, r.trusted) for r in chem.with_adducts(df).collect()}
    assert got == {"[M+H]+": (True, True), "[M+X]+": (False, False), None: (False, False)}


def test_two_ppm_conventions_have_opposite_signs(spark):  # H1
    hit, rerank = one(spark, chem.hit_ppm(F.lit(100.001), F.lit(100.0)), chem.error_ppm(F.lit(100.0), F.lit(100.001)))
    assert hit == pytest.approx(10.0) and rerank == pytest.approx(-9.9999, abs=1e-4)
    assert one(spark, chem.error_ppm(F.lit(1.0), F.lit(0.0))) == (None,)


def test_tolerance(spark):
    assert one(spark, chem.tolerance_da(F.lit(500.0), 10.0))[0] == pytest.approx(0.005)
    assert one(spark, chem.tolerance_da(F.lit(-1.0), 10.0), chem.tolerance_da(F.lit(1.0), -1.0)) == (None, None)
    assert one(spark, chem.within_ppm(F.lit(100.001), F.lit(100.0), 10.0001), chem.within_ppm(F.lit(100.002), F.lit(100.0), 10.0)) == (True, False)


@pytest.mark.parametrize(
    "text,counts",
    [("C6H12O6", {"C": 6, "H": 12, "O": 6}), ("C10H12ClNO", {"C": 10, "H": 12, "Cl": 1, "N": 1, "O": 1}), ("C12H19N2O2+", {"C": 12, "H": 19, "N": 2, "O": 2}), ("C10H20N2-2", {"C": 10, "H": 20, "N": 2}), ("CH3CH2OH", {"C": 2, "H": 6, "O": 1}), ("c6", None), ("", None), ("+", None)],
)
def test_formula(spark, text, counts):
    assert one(spark, chem.parse_formula(F.lit(text)))[0] == counts


def test_formula_mass(spark):
    assert one(spark, chem.formula_mass(F.lit("C6H12O6")))[0] == pytest.approx(180.0633881, abs=1e-6)
    assert one(spark, chem.formula_mass(F.lit("Xx2"))) == (None,)
    with pytest.raises(Exception, match="no molecular formula"):
        one(spark, chem.formula_checked(F.lit("c6")))


@pytest.mark.parametrize(
    "supported,trusted,instrument,source,inference,want",
    [
        (False, True, None, None, False, (False, None, "unsupported")),
        (True, False, None, None, False, (False, None, "untrusted_adduct")),
        (True, True, " timsTOF", None, True, (True, 10.0, "high")),
        (True, True, "qtof", None, True, (True, 20.0, "medium")),
        (True, True, None, "msdial", False, (True, 10.0, "high")),
        (True, True, "TIMSTOF", "gnps", False, (True, 10.0, "high")),
        (True, True, "qtof", "gnps", False, (False, None, "low")),
        (True, True, None, None, False, (False, None, "unknown")),
    ],
)
def test_policy(spark, supported, trusted, instrument, source, inference, want):
    x = chem.policy_decision(F.lit(supported), F.lit(trusted), F.lit(instrument).cast("string"), F.lit(source).cast("string"), F.lit(inference))
    *decision, reason = one(spark, x)[0]
    assert tuple(decision) == want and reason


def test_registries_differ(spark):  # H10
    config = chem.ChemistryConfig()
    trusted = {a[0] for a in chem.ADDUCTS if a[4]}
    assert set(config.soft_adducts) <= trusted and "[M-2H]2-" not in config.hard_adducts + config.soft_adducts + config.disabled_adducts


def test_verdict(spark):
    v = chem.candidate_verdict(F.lit(100.0), F.lit(101.0), F.lit("C"), F.lit(None).cast("string"), F.lit(False))
    assert one(spark, v["mass_ok"], v["formula_ok"], v["accepted"]) == (True, True, True)
    v = chem.candidate_verdict(F.lit(100.0), F.lit(100.0), F.lit("C"), F.lit("N"), F.lit(True))
    assert one(spark, v["mass_ok"], v["accepted"]) == (True, False)


def test_scalars(spark):
    assert one(spark, chem.safe_float(F.lit("x")), chem.safe_float(F.lit(float("nan"))), chem.safe_float(F.lit("2.5"))) == (0.0, 0.0, 2.5)
    assert one(spark, chem.availability(F.lit(3), F.lit(2)), chem.availability(F.lit(1), F.lit(0))) == (1.0, 0.0)
    assert one(spark, chem.reciprocal_rank(F.lit(4)), chem.reciprocal_rank(F.lit(0)), chem.reciprocal_rank(F.lit(None).cast("int"))) == (0.25, 0.0, 0.0)
    assert one(spark, chem.mass_key(F.lit(1.5)))[0] == 1.5  # H24
    assert one(spark, chem.warmup_cosine(F.lit(0), 10, 20, 1.0), chem.warmup_cosine(F.lit(20), 10, 20, 1.0))[0] == pytest.approx(0.1)


def test_hash_fraction_is_portable(spark):  # H16
    import hashlib

    want = int(hashlib.sha256(b"split-v1|abc").hexdigest()[:16], 16) / 16**16
    assert one(spark, keys.stable_fraction(F.lit("abc")))[0] == want
    assert one(spark, keys.molecule_of(keys.query_id(F.lit("AB"), F.lit("lib"))), keys.same_label(F.lit(" timsTOF "), "TIMSTOF"), keys.same_label(F.lit(None).cast("string"), "x")) == ("AB", True, False)


def peaks(spark, mzs, ints, config, precursor=None):
    p = zipped(F.array(*[F.lit(float(x)) for x in mzs]) if mzs else F.array().cast("array<double>"), F.array(*[F.lit(float(x)) for x in ints]) if ints else F.array().cast("array<double>"))
    return [tuple(x) for x in one(spark, preprocessed(p, precursor, config))[0]]


def test_peak_arrays(spark):
    plain = {"intensity_transform": "none", "normalize_intensity": False}
    assert peaks(spark, [100, 200, 300], [0.01, 1, 0.2], PeakProfile(min_relative_intensity=0.05, **plain)) == [(200.0, 1.0), (300.0, 0.2)]
    assert [m for m, _ in peaks(spark, [100, 200, 303], [1, 1, 1], PeakProfile(precursor_tolerance_da=2.0, **plain), F.lit(300.0))] == [100.0, 200.0]
    assert [m for m, _ in peaks(spark, [100, 200, 300, 400], [0.1, 0.9, 0.5, 1.0], PeakProfile(max_peaks=2, **plain))] == [200.0, 400.0]
    assert peaks(spark, [100, 100, 200], [0.2, 0.3, 1.0], PeakProfile(**plain)) == [(100.0, 0.5), (200.0, 1.0)]
    assert [i for _, i in peaks(spark, [1, 2], [0.25, 1.0], PeakProfile())] == [0.5, 1.0]
    assert peaks(spark, [], [], PeakProfile()) == []
    assert [m for m, _ in peaks(spark, [3, 1, 2], [1, 1, 1], PeakProfile(max_peaks=2, **plain))] == [1.0, 2.0]  # H8
    assert peaks(spark, [1], [0.0], PeakProfile()) == [(1.0, 0.0)]


def test_peak_rules(spark):
    with pytest.raises(Exception, match="differ in length"):
        one(spark, zipped(F.array(F.lit(1.0)), F.array().cast("array<double>")))
    with pytest.raises(Exception, match="not finite"):
        one(spark, zipped(F.array(F.lit(float("nan"))), F.array(F.lit(1.0))))
    with pytest.raises(KeyError, match="baseline"):
        profile("none such")
    with pytest.raises(ValueError):
        transformed(F.lit(1.0), "cube")
    with pytest.raises(ValueError):
        preprocessed(F.array(), None, PROFILES["precursor_plus_2"])
    assert one(spark, transformed(F.lit(1.0), "log1p"))[0] == pytest.approx(0.6931471805599453)
    assert PROFILES["baseline"].intensity_transform == "sqrt" and PROFILES["raw"].intensity_transform == "none"  # H9
    assert one(spark, F.size(merged(F.array(F.struct(F.lit(1.0).alias("mz"), F.lit(1.0).alias("intensity")))))) == (1,)


def test_vectors(spark):
    a, z = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vectors.norm(a), vectors.cosine(a, a), vectors.cosine(a, z)) == (5.0, 1.0, 0.0)
    assert one(spark, vectors.padded(a, 3), vectors.pad_mask(a, 3)) == ([3.0, 4.0, 0.0], [True, True, False])
    assert one(spark, vectors.flattened_finite(F.array(F.lit(1.0), F.lit(None), F.lit(float("nan")))))[0] == [1.0]
