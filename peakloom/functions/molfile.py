"""Formula and mass from the connection table of a structure-data record (V2000), as columns over its lines.

Counts, atom, bond and charge lines are read by their fixed places. Hydrogens that aren't drawn are those that fill an atom's
lowest allowed valence above its bonds: charges shift it, a valence given in the atom line replaces it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chem import ELEMENT_MASSES

# Allowed valences of uncharged atoms; how a positive charge changes them (by group of the periodic table);
# the charges that an atom line's codes stand for.
VALENCES = {"H": [1], "B": [3], "C": [4], "Si": [4], "N": [3], "P": [3, 5], "O": [2], "S": [2, 4, 6], "F": [1], "Cl": [1], "Br": [1], "I": [1]}
GAINS_WITH_CHARGE = ["N", "P", "O", "S", "F", "Cl", "Br", "I"]
LOSES_WITH_CHARGE = ["B"]
CHARGE_CODES = {1: 3, 2: 2, 3: 1, 5: -1, 6: -2, 7: -3}


def _number(line: Column, start: int, length: int) -> Column:
    return F.trim(F.substring(line, start, length)).try_cast("int")


def _element(table: dict, key: Column) -> Column:
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v))])[key]


def with_connection_table(records: DataFrame, molfile: str = "molfile") -> DataFrame:
    """``records`` with table_fate (read, empty, malformed or unknown element), table_formula (Hill order), table_mass and
    table_charge; null where the table isn't read."""
    kept = records.columns
    lines = F.split(F.coalesce(molfile, F.lit("")), "\n")
    x = records.withColumn("__lines", lines)
    # the counts line says V2000; where none does it is the fourth
    marked = F.array_position(F.transform("__lines", lambda s: F.contains(s, F.lit("V2000"))), True)
    x = x.withColumn("__at", F.when(marked > 0, marked).otherwise(4).cast("int"))
    counts = F.get("__lines", F.col("__at") - 1)
    x = x.withColumns({"__n": _number(counts, 1, 3), "__m": _number(counts, 4, 3)})
    enough = F.coalesce((F.col("__n") >= 0) & (F.col("__m") >= 0) & (F.size("__lines") >= F.col("__at") + F.col("__n") + F.col("__m")), F.lit(False))
    x = x.withColumn("__enough", enough)
    n, m = (F.when(F.col("__enough"), F.col(c)).otherwise(0) for c in ("__n", "__m"))
    atoms = F.transform(F.slice("__lines", F.col("__at") + 1, n), lambda s: F.struct(F.trim(F.substring(s, 32, 3)).alias("element"), F.coalesce(_element(CHARGE_CODES, _number(s, 37, 3)), F.lit(0)).alias("charge"), F.coalesce(_number(s, 49, 3), F.lit(0)).alias("valence")))
    bonds = F.transform(F.slice("__lines", F.col("__at") + 1 + n, m), lambda s: F.struct(_number(s, 1, 3).alias("a"), _number(s, 4, 3).alias("b"), F.when(_number(s, 7, 3) == 4, 1.5).when(_number(s, 7, 3).between(1, 3), _number(s, 7, 3).cast("double")).alias("order")))
    # "M  CHG  n  atom charge ..." lines, which replace the codes of all atom lines
    numbers = F.flatten(F.transform(F.filter("__lines", lambda s: s.startswith("M  CHG")), lambda s: F.transform(F.slice(F.split(F.trim(F.substring(s, 10, 200)), " +"), 1, 16), lambda v: v.try_cast("int"))))
    x = x.withColumns({"__atoms": atoms, "__bonds": bonds, "__numbers": numbers})
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("__numbers") / 2).cast("int") - 1), lambda i: F.struct(F.get("__numbers", 2 * i).alias("atom"), F.get("__numbers", 2 * i + 1).alias("charge")))
    x = x.withColumn("__charges", F.when(F.size("__numbers") >= 2, pairs))
    ends = F.concat(F.transform("__bonds", lambda b: F.struct(b["a"].alias("atom"), b["order"].alias("order"))), F.transform("__bonds", lambda b: F.struct(b["b"].alias("atom"), b["order"].alias("order"))))
    x = x.withColumn("__ends", ends)

    def whole(atom: Column, i: Column) -> Column:
        own = F.aggregate(F.filter("__ends", lambda e: e["atom"] == i + 1), F.lit(0.0), lambda acc, e: acc + e["order"])
        charge = F.when(F.col("__charges").isNotNull(), F.aggregate(F.filter("__charges", lambda c: c["atom"] == i + 1), F.lit(0), lambda acc, c: acc + c["charge"])).otherwise(atom["charge"])
        return F.struct(atom["element"].alias("element"), charge.alias("charge"), atom["valence"].alias("valence"), F.floor(own).cast("int").alias("bonds"))

    x = x.withColumn("__bonded", F.transform("__atoms", whole))

    def hydrogens(a: Column) -> Column:
        shift = F.when(a["element"].isin(GAINS_WITH_CHARGE), a["charge"]).when(a["element"].isin(LOSES_WITH_CHARGE), -a["charge"]).otherwise(-F.abs(a["charge"]))
        allowed = F.filter(_element(VALENCES, a["element"]), lambda v: v + shift >= a["bonds"])
        given = F.greatest(F.when(a["valence"] == 15, 0).otherwise(a["valence"]) - a["bonds"], F.lit(0))
        return F.when(a["valence"] > 0, given).otherwise(F.coalesce(F.get(allowed, 0) + shift - a["bonds"], F.lit(0)))

    ordered = sorted(VALENCES, key=lambda e: (e != "C", e != "H", e))  # Hill order of molecules with carbon

    def drawn_atoms(element: str) -> Column:
        return F.size(F.filter("__bonded", lambda a: a["element"] == element))

    count = {e: drawn_atoms(e) for e in ordered}
    drawn = F.aggregate("__bonded", F.lit(0), lambda acc, a: acc + hydrogens(a))
    x = x.withColumns({f"__count_{e}": c + (drawn if e == "H" else 0) for e, c in count.items()})
    mass = F.lit(0.0)
    for e in ordered:
        mass = mass + F.lit(ELEMENT_MASSES[e]) * F.col(f"__count_{e}")

    def part(e: str) -> Column:
        c = F.col(f"__count_{e}")
        return F.when(c == 0, "").when(c == 1, e).otherwise(F.concat(F.lit(e), c.cast("string")))

    formula = F.when(F.col("__count_C") > 0, F.concat(*map(part, ordered))).otherwise(F.concat(*map(part, sorted(ordered))))
    sound_bond = lambda b: F.coalesce(b["a"].between(1, F.col("__n")) & b["b"].between(1, F.col("__n")) & (b["a"] != b["b"]) & b["order"].isNotNull(), F.lit(False))
    sound = F.col("__enough") & F.forall("__bonds", sound_bond) & F.forall("__atoms", lambda a: a["element"] != "") & F.forall(F.coalesce("__numbers", F.array()), lambda v: v.isNotNull())
    known = F.forall("__atoms", lambda a: a["element"].isin(list(VALENCES)))
    blank = ~F.coalesce(F.col(molfile), F.lit("")).rlike(r"\S")
    fate = F.when(blank, "empty").when(~sound, "malformed").when(F.size("__atoms") == 0, "empty").when(~known, "unknown element").otherwise("read")
    x = x.withColumn("table_fate", fate)
    read = F.col("table_fate") == "read"
    charge = F.aggregate("__bonded", F.lit(0), lambda acc, a: acc + a["charge"])
    return x.select(*kept, "table_fate", F.when(read, formula).alias("table_formula"), F.when(read, mass).alias("table_mass"), F.when(read, charge).alias("table_charge"))
