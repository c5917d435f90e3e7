"""SMILES texts against known formulas and masses, and fingerprints that don't depend on how a molecule is written."""

import random

import pytest
from pyspark.sql import functions as F

from peakloom.functions import smiles as s

KNOWN = {
    "C": ("CH4", 16.031300, 0),
    "CCO": ("C2H6O", 46.041865, 0),
    "CN1C=NC2=C1C(=O)N(C(=O)N2C)C": ("C8H10N4O2", 194.080376, 0),
    "CC(=O)Oc1ccccc1C(=O)O": ("C9H8O4", 180.042259, 0),
    "OC[C@H]1OC(O)[C@H](O)[C@@H](O)[C@@H]1O": ("C6H12O6", 180.063388, 0),
    "c1ccc2[nH]ccc2c1": ("C8H7N", 117.057849, 0),
    "c1ccsc1": ("C4H4S", 84.003371, 0),
    "Cn1cccc1": ("C5H7N", 81.057849, 0),
    "c1cc[n+]([O-])cc1": ("C5H5NO", 95.037114, 0),
    "O=c1cc[nH]cc1": ("C5H5NO", 95.037114, 0),
    "[O-][N+](=O)c1ccccc1": ("C6H5NO2", 123.032028, 0),
    "O=N(=O)c1ccccc1": ("C6H5NO2", 123.032028, 0),
    "C[N+](C)(C)C": ("C4H12N+", 74.096974, 1),
    "[Ca+2]": ("Ca+2", 39.962591, 2),
    "[O--]": ("O-2", 15.994915, -2),
    "[Na+].[Cl-]": ("ClNa", 57.958622, 0),
    "OS(=O)(=O)O": ("H2O4S", 97.967379, 0),
    "CS(C)(=O)=O": ("C2H6O2S", 94.008850, 0),
    "OP(=O)(O)O": ("H3O4P", 97.976895, 0),
    "FC(Cl)(Br)I": ("CBrClFI", 271.790, 0),
    "C%12CCCC%12": ("C5H10", 70.078250, 0),
    "C=1CCCCC=1": ("C6H10", 82.078250, 0),
    "F/C=C/F": ("C2H2F2", 64.012456, 0),
    "[2H]O[2H]": ("H2O", 20.023119, 0),
    "[H]O[H]": ("H2O", 18.010565, 0),
    "[H][H]": ("H2", 2.015650, 0),
    "[13CH4]": ("CH4", 17.034655, 0),
    "C[Si](C)(C)C": ("C4H12Si", 88.070827, 0),
    "[CH3:1][OH:2]": ("CH4O", 32.026215, 0),
    "C1CC1C1CC1": ("C6H10", 82.078250, 0),
}
NOT_READ = {None: "empty", "": "empty", " \t": "empty", "C1CC": "malformed", "C(C": "malformed", "C)C": "malformed", "C=": "malformed", "=C": "malformed", "CX": "malformed", "C()C": "malformed", "C11": "malformed", "C1C1": "malformed", "C==C": "malformed", "C=1CC#1": "malformed", "C..C": "malformed", "[CH4": "malformed", "C*": "malformed", "[Xx]": "unknown element", "C(C)(C)(C)(C)C": "valence", "F(C)C": "valence"}


def read(spark, texts):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id long, smiles string, smiles_fate string")
    return {r.id: r for r in s.with_smiles(df).collect()}


def test_known_molecules(spark):
    rows = read(spark, list(KNOWN))
    got = {t: (rows[i].smiles_fate, rows[i].smiles_formula, rows[i].smiles_charge) for i, t in enumerate(KNOWN)}
    assert got == {t: ("read", f, c) for t, (f, _, c) in KNOWN.items()}
    for i, (t, (_, mass, _)) in enumerate(KNOWN.items()):
        assert rows[i].smiles_mass == pytest.approx(mass, abs=2e-3 if "I" in t else 2e-6), t


def test_texts_that_are_not_read(spark):
    rows = read(spark, list(NOT_READ))
    assert {t: rows[i].smiles_fate for i, t in enumerate(NOT_READ)} == NOT_READ
    assert all(r.smiles_formula is None and r.smiles_mass is None and r.smiles_charge is None for r in rows.values())
    assert read(spark, []) == {}
    rows = read(spark, ["[15NH3]", "[17OH2]", "C" * 5000])
    assert rows[0].smiles_mass == pytest.approx(18.023584, abs=1e-6) and rows[1].smiles_mass is None and rows[1].smiles_formula == "H2O"
    assert rows[2].smiles_formula == "C5000H10002"


def test_formula_matches(spark):
    df = spark.createDataFrame([("CCO", "C2H6O"), ("CCO", "H6C2O"), ("CCO", None), ("C1", "C")], "smiles string, formula string")
    got = [r[0] for r in df.select(s.formula_matches(F.col("formula"), s.smiles_graph(F.col("smiles")))).collect()]
    assert got == [True, False, None, None]


def prints(spark, texts, radius=2):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, smiles string").withColumn("g", s.smiles_graph(F.col("smiles")))
    rows = df.select("id", s.environments(F.col("g"), radius).alias("e"), s.active_bits(F.col("g"), radius=radius).alias("b")).collect()
    return {texts[r.id]: (r.e, r.b) for r in rows}


def test_number_of_environments(spark):
    """Counted by hand: distinct environments without those whose bonds a smaller one has."""
    want = {"C": 1, "CC": 2, "CCC": 4, "CCCC": 5, "c1ccccc1": 3, "CO": 3, "C.C": 1, "C1CC1": 2 + 1}
    got = prints(spark, list(want))
    assert {t: len(e) for t, (e, _) in got.items()} == want
    assert {t: len(e) for t, (e, _) in prints(spark, list(want), radius=0).items()} == {"C": 1, "CC": 1, "CCC": 2, "CCCC": 2, "c1ccccc1": 1, "CO": 2, "C.C": 1, "C1CC1": 1}
    assert all(b == sorted({x % 2048 for x in e}) for e, b in got.values())
    assert prints(spark, ["C1CC", ""]) == {"C1CC": (None, None), "": (None, None)}


def written(tree, labels, at, rng, parent=None):
    below = [x for x in tree[at] if x != parent]
    rng.shuffle(below)
    parts = [written(tree, labels, x, rng, at) for x in below]
    return labels[at] + "".join(f"({p})" for p in parts[:-1]) + "".join(parts[-1:])


def test_a_molecule_has_one_fingerprint_however_written(spark):
    rng = random.Random(3)
    pairs = []
    for _ in range(30):
        n = rng.randint(2, 14)
        tree = {i: [] for i in range(n)}
        for i in range(1, n):
            j = rng.choice([k for k in range(i) if len(tree[k]) < 3])
            tree[i].append(j)
            tree[j].append(i)
        labels = [rng.choice("CCCNS" if len(tree[i]) == 3 else "CCCNOS") if len(tree[i]) != 3 else rng.choice("CCN") for i in range(n)]
        labels = [x if x != "S" or len(tree[i]) <= 2 else "C" for i, x in enumerate(labels)]
        pairs.append([written(tree, labels, rng.randrange(n), rng) for _ in range(3)])
    pairs += [["CC(=O)Oc1ccccc1C(=O)O", "OC(=O)c1ccccc1OC(C)=O", "c1ccc(C(=O)O)c(c1)OC(=O)C"], ["[H]OC", "CO", "OC"]]
    got = prints(spark, sorted({t for p in pairs for t in p}))
    formulas = read(spark, [t for p in pairs for t in p])
    for i, p in enumerate(pairs):
        assert len({tuple(got[t][0]) for t in p}) == 1, p
        assert len({formulas[3 * i + j].smiles_formula for j in range(3)}) == 1, p
    isomers = prints(spark, ["CCCO", "CC(C)O", "CCOC", "C1CC1", "C=CC"])
    assert len({tuple(e) for e, _ in isomers.values()}) == 5


def test_fingerprint_is_its_active_bits(spark):
    df = spark.createDataFrame([("CC(=O)Oc1ccccc1C(=O)O",), ("C1",)], "smiles string").withColumn("g", s.smiles_graph(F.col("smiles")))
    got = df.select(s.fingerprint(F.col("g"), 256).alias("f"), s.active_bits(F.col("g"), 256).alias("b")).collect()
    assert len(got[0].f) == 256 and [i for i, x in enumerate(got[0].f) if x] == got[0].b and got[1].f is None


def test_first_environments_are_kinds_of_atoms(spark):
    """At radius 0 an identifier is an atom's kind; later ones are no more than atoms and sets of bonds within reach."""
    for text in ("CC(=O)Oc1ccccc1C(=O)O", "CN1C=NC2=C1C(=O)N(C(=O)N2C)C", "C1CC1C1CC1", "CC.O"):
        g = s.read_graph(text)
        ends = [{j for j, x in enumerate(g["bonds"]) if i in (x["a"], x["b"])} for i in range(len(g["atoms"]))]
        kinds = {(a["element"], a["charge"], a["hydrogens"], a["aromatic"], len(n)) for a, n in zip(g["atoms"], ends, strict=True)}
        assert len(prints(spark, [text], radius=0)[text][0]) == len(kinds)
        near = [frozenset(e) for e in ends]
        far = [frozenset(e.union(*(ends[x["a"]] | ends[x["b"]] for j, x in enumerate(g["bonds"]) if j in e))) for e in ends]
        assert len(kinds) < len(prints(spark, [text])[text][0]) <= len(g["atoms"]) + len({e for e in near + far if e})
