"""Connection tables written by hand, against their formulas."""

import pytest

from peakloom.functions.molfile import with_connection_table
from peakloom.sources import files


def molfile(atoms, bonds, extra=(), version=" V2000", title="t"):
    """``atoms``: element or (element, charge code, valence); ``bonds``: (a, b, order)."""
    lines = [title, "  made", "", f"{len(atoms):3}{len(bonds):3}  0  0  0  0  0  0  0  0999{version}"]
    for a in atoms:
        e, code, valence = (*((a,) if isinstance(a, str) else a), 0, 0)[:3]
        lines.append(f"{0.0:10.4f}{1.5:10.4f}{0.0:10.4f} {e:<3} 0{code:3}  0  0  0{valence:3}  0  0  0  0  0  0")
    lines += [f"{a:3}{b:3}{o:3}  0  0  0  0" for a, b, o in bonds]
    return "\n".join([*lines, *extra, "M  END"])


RING = [(i, i % 6 + 1, 4) for i in range(1, 7)]
CASES = {
    "methane": (molfile(["C"], []), "CH4", 0),
    "ethanol": (molfile(["C", "C", "O"], [(1, 2, 1), (2, 3, 1)]), "C2H6O", 0),
    "benzene": (molfile(["C"] * 6, RING), "C6H6", 0),
    "pyridine": (molfile(["C"] * 5 + ["N"], RING), "C5H5N", 0),
    "acetonitrile": (molfile(["C", "C", "N"], [(1, 2, 1), (2, 3, 3)]), "C2H3N", 0),
    "glycine zwitterion": (molfile(["N", "C", "C", "O", "O"], [(1, 2, 1), (2, 3, 1), (3, 4, 2), (3, 5, 1)], ["M  CHG  2   1   1   5  -1"]), "C2H5NO2", 0),
    "ammonium by code": (molfile([("N", 3)], []), "H4N", 1),
    "codes are replaced": (molfile([("N", 3), "C"], [(1, 2, 1)], ["M  CHG  1   2  -1"]), "CH4N", -1),
    "sulfone": (molfile(["C", "S", "C", "O", "O"], [(1, 2, 1), (2, 3, 1), (2, 4, 2), (2, 5, 2)]), "C2H6O2S", 0),
    "phosphate": (molfile(["P", "O", "O", "O", "O"], [(1, 2, 2), (1, 3, 1), (1, 4, 1), (1, 5, 1)]), "H3O4P", 0),
    "chloroform": (molfile(["C", "Cl", "Cl", "Cl"], [(1, 2, 1), (1, 3, 1), (1, 4, 1)]), "CHCl3", 0),
    "drawn hydrogen": (molfile(["O", "H"], [(1, 2, 1)]), "H2O", 0),
    "given valence": (molfile([("C", 0, 15)], []), "C", 0),
    "borohydride": (molfile([("B", 5)], []), "H4B".replace("H4B", "BH4"), -1),
    "no version": (molfile(["C"], [], version=""), "CH4", 0),
}
FAULTS = {
    "cut": (molfile(["C", "C"], [(1, 2, 1)]).split("\n")[:5], "malformed"),
    "no such atom": (molfile(["C"], [(1, 2, 1)]).split("\n"), "malformed"),
    "odd order": (molfile(["C", "C"], [(1, 2, 9)]).split("\n"), "malformed"),
    "a metal": (molfile(["Na", "Cl"], [(1, 2, 1)]).split("\n"), "unknown element"),
    "blank": ([""], "empty"),
    "no atoms": (molfile([], []).split("\n"), "empty"),
    "letters": (["t", "", "", "abcdef  V2000", "M  END"], "malformed"),
}


def test_tables(spark):
    rows = [(k, m) for k, (m, *_) in CASES.items()] + [(k, "\n".join(m)) for k, (m, _) in FAULTS.items()] + [("null", None)]
    got = {r.name: r for r in with_connection_table(spark.createDataFrame(rows, "name string, molfile string")).collect()}
    for name, (_, formula, charge) in CASES.items():
        assert (got[name].table_fate, got[name].table_formula, got[name].table_charge) == ("read", formula, charge), name
    for name, (_, fate) in FAULTS.items():
        assert got[name].table_fate == fate and got[name].table_mass is None, name
    assert got["null"].table_fate == "empty"
    assert got["ethanol"].table_mass == pytest.approx(46.0418648, abs=1e-6) and got["benzene"].table_mass == pytest.approx(78.0469502, abs=1e-6)


def test_mass_from_the_table_where_no_item_has_one(spark, tmp_path):
    key = "> <KEY>\nABCDEFGHIJKLMN-OP\n\n"
    text = "".join(f"{m}\n{key}{item}$$$$\n" for m, item in [(CASES["ethanol"][0], ""), (CASES["benzene"][0], "> <MASS>\n7.5\n\n"), (molfile(["Na"], []), ""), ("\n" + molfile(["C"], [], title="").lstrip("\n"), "")])
    (tmp_path / "a.sdf").write_text(text)
    records = files.read_sdf(spark, str(tmp_path / "a.sdf"), {"KEY": "inchikey", "MASS": "exact_mass"})
    rows = files.with_fate(records, table=True).collect()
    assert [(r.fate, r.exact_mass and round(r.exact_mass, 4)) for r in rows] == [("kept", 46.0419), ("kept", 7.5), ("bad mass", None), ("kept", 16.0313)]
    assert [r.table_formula for r in rows] == ["C2H6O", "C6H6", None, "CH4"]
