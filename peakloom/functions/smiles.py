"""Formula, mass, charge and circular fingerprints from SMILES texts.

A text is read into a graph, an array of atoms and one of bonds, by a small Python function over Arrow batches, as branches and ring
closures are nested; everything else is columns over these arrays, so nothing is shuffled.

Hydrogens follow the open SMILES rules: bracket atoms say theirs, others fill the lowest usual valence that holds their bonds, aromatic
atoms the lowest one with one bond more than drawn. A text with more bonds than an atom's valences allow isn't read. Whether an aromatic
system can be written with alternating bonds isn't checked; a bond without a sign between two aromatic atoms is taken as aromatic. Atoms
that stand for any element (``*``) and ring numbers over 99 aren't read.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chem import ELEMENT_MASSES

# Usual valences of atoms without brackets; monoisotopic masses of further elements; masses of labelled isotopes;
# bond orders by sign.
VALENCES = {"B": (3,), "C": (4,), "N": (3, 5), "O": (2,), "P": (3, 5), "S": (2, 4, 6), "F": (1,), "Cl": (1,), "Br": (1,), "I": (1,)}
MORE_MASSES = {
    "Li": 7.0160034366,
    "Na": 22.989769282,
    "Mg": 23.985041697,
    "Al": 26.98153853,
    "K": 38.9637064864,
    "Ca": 39.962590863,
    "Fe": 55.93493633,
    "Cu": 62.92959772,
    "Zn": 63.92914201,
    "As": 74.92159457,
    "Se": 79.9165218,
}
ISOTOPE_MASSES = {"2H": 2.01410177812, "13C": 13.00335483507, "15N": 15.00010889888, "18O": 17.99915961286}
BOND_ORDERS = {"-": 1.0, "/": 1.0, "\\": 1.0, ":": 1.5, "=": 2.0, "#": 3.0, "$": 4.0}

MASSES = ELEMENT_MASSES | MORE_MASSES

_TOKEN = re.compile(r"(?P<bracket>\[[^\[\]]*\])|(?P<atom>Cl|Br|[BCNOPSFI]|[bcnops])|(?P<bond>[-=#$:/\\])|(?P<ring>%\d\d|\d)|(?P<mark>[().])")
_BRACKET = re.compile(r"\[(\d*)([A-Z][a-z]?|[bcnops]|se|as)(?:@(?:@|(?:TH|AL|SP|TB)\d+)?)?(?:(H)(\d*))?(\++\d*|-+\d*)?(?::\d+)?\]")

_ATOM = "struct<element:string,isotope:int,charge:int,hydrogens:int,aromatic:boolean>"
GRAPH = f"struct<fate:string,atoms:array<{_ATOM}>,bonds:array<struct<a:int,b:int,order:double>>>"
_ARROW = pa.struct(
    {
        "fate": pa.string(),
        "atoms": pa.list_(pa.struct({"element": pa.string(), "isotope": pa.int32(), "charge": pa.int32(), "hydrogens": pa.int32(), "aromatic": pa.bool_()})),
        "bonds": pa.list_(pa.struct({"a": pa.int32(), "b": pa.int32(), "order": pa.float64()})),
    }
)


def _charge(text: str | None) -> int:
    if not text:
        return 0
    digits = text.lstrip("+-")
    size = int(digits) if digits else len(text)
    return size if text[0] == "+" else -size


def read_graph(text: str | None) -> dict:
    """One SMILES text as fate (read, empty, malformed, unknown element or valence), atoms and bonds (from 0)."""

    def nothing(fate: str) -> dict:
        return {"fate": fate, "atoms": None, "bonds": None}

    text = (text or "").strip()
    if not text:
        return nothing("empty")
    atoms: list[dict] = []
    bonds: list[dict] = []
    branches: list[int] = []
    rings: dict[str, tuple[int, str | None]] = {}
    last, sign, at = None, None, 0  # the atom to bond to, the bond sign before the next

    def bond(a: int, b: int, kind: str | None) -> None:
        order = BOND_ORDERS[kind] if kind else 1.5 if atoms[a]["aromatic"] and atoms[b]["aromatic"] else 1.0
        bonds.append({"a": a, "b": b, "order": order})

    for token in _TOKEN.finditer(text):
        if token.start() != at:
            return nothing("malformed")
        at, kind, word = token.end(), token.lastgroup, token[0]
        if kind in ("bracket", "atom"):
            if kind == "atom":
                atom = {"element": word.capitalize(), "isotope": None, "charge": 0, "hydrogens": None, "aromatic": word.islower()}
            elif parts := _BRACKET.fullmatch(word):
                isotope, symbol, has_h, n_h, charge = parts.groups()
                hydrogens = (int(n_h) if n_h else 1) if has_h else 0
                atom = {"element": symbol.capitalize(), "isotope": int(isotope) if isotope else None, "charge": _charge(charge), "hydrogens": hydrogens, "aromatic": symbol.islower()}
            else:
                return nothing("malformed")
            atoms.append(atom)
            if last is not None:
                bond(last, len(atoms) - 1, sign)
            elif sign:
                return nothing("malformed")
            last, sign = len(atoms) - 1, None
        elif last is None or (sign and kind != "ring"):
            return nothing("malformed")
        elif kind == "bond":
            sign = word
        elif kind == "ring":
            label = word.lstrip("%").lstrip("0") or "0"
            if label not in rings:
                rings[label] = last, sign
            else:
                other, before = rings.pop(label)
                agree = not (sign and before) or BOND_ORDERS[sign] == BOND_ORDERS[before]
                if not agree or other == last or any({other, last} == {x["a"], x["b"]} for x in bonds):
                    return nothing("malformed")
                bond(other, last, sign or before)
            sign = None
        elif word == "(":
            branches.append(last)
        elif word == ")":
            if not branches or text[token.start() - 1] == "(":
                return nothing("malformed")
            last = branches.pop()
        else:
            if branches:
                return nothing("malformed")
            last = None
    if at != len(text) or last is None or sign or branches or rings:
        return nothing("malformed")
    if any(x["element"] not in MASSES for x in atoms):
        return nothing("unknown element")
    used = [0.0] * len(atoms)
    for x in bonds:
        # an aromatic bond counts once here; what its atom shares in the ring counts below
        order = 1.0 if x["order"] == 1.5 else x["order"]
        used[x["a"]] += order
        used[x["b"]] += order
    for x, bonded in zip(atoms, used, strict=True):
        if x["hydrogens"] is None:
            allowed = VALENCES[x["element"]]
            room = [v for v in allowed if v >= bonded]
            if not room:
                return nothing("valence")
            x["hydrogens"] = max(allowed[0] - int(bonded) - 1, 0) if x["aromatic"] else room[0] - int(bonded)
    return {"fate": "read", **_folded(atoms, bonds)}


def _folded(atoms: list[dict], bonds: list[dict]) -> dict:
    """The graph with plain drawn hydrogens, of one single bond to another element, among their neighbours' own."""
    ends: dict[int, list[tuple[int, float]]] = {}
    for x in bonds:
        ends.setdefault(x["a"], []).append((x["b"], x["order"]))
        ends.setdefault(x["b"], []).append((x["a"], x["order"]))
    place: dict[int, int] = {}
    for i, x in enumerate(atoms):
        plain = x["element"] == "H" and x["isotope"] is None and not x["charge"] and not x["hydrogens"]
        bound = ends.get(i, [])
        if plain and len(bound) == 1 and bound[0][1] == 1.0 and atoms[bound[0][0]]["element"] != "H":
            atoms[bound[0][0]]["hydrogens"] += 1
        else:
            place[i] = len(place)
    left = [{"a": place[x["a"]], "b": place[x["b"]], "order": x["order"]} for x in bonds if x["a"] in place and x["b"] in place]
    return {"atoms": [atoms[i] for i in place], "bonds": left}


def smiles_graph(smiles: Column) -> Column:
    """The text's graph: fate, atoms, bonds."""

    @F.arrow_udf(GRAPH)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([read_graph(x) for x in texts.to_pylist()], _ARROW)

    return run(smiles)


def graph_formula(graph: Column) -> Column:
    """Formula in Hill order with the charge behind it, as ``C4H12N+`` or ``Ca+2``; null where the text wasn't read."""
    atoms = graph["atoms"]
    hydrogens = F.aggregate(atoms, F.lit(0), lambda acc, a: acc + a["hydrogens"])
    every = F.concat(F.transform(atoms, lambda a: a["element"]), F.array_repeat(F.lit("H"), hydrogens))

    def hill(all_: Column) -> Column:
        names = F.array_sort(F.array_distinct(all_))
        carbon_first = F.concat(F.array(F.lit("C")), F.filter(names, lambda e: e == "H"), F.filter(names, lambda e: ~e.isin("C", "H")))

        def part(e: Column) -> Column:
            n = F.size(F.filter(all_, lambda x: x == e))
            return F.when(n == 1, e).otherwise(F.concat(e, n.cast("string")))

        return F.array_join(F.transform(F.when(F.array_contains(all_, "C"), carbon_first).otherwise(names), part), "")

    charge = graph_charge(graph)
    size = F.when(F.abs(charge) > 1, F.abs(charge).cast("string")).otherwise("")
    suffix = F.when(charge > 0, F.concat(F.lit("+"), size)).when(charge < 0, F.concat(F.lit("-"), size)).otherwise("")
    return F.when(graph["fate"] == "read", F.concat(F.get(F.transform(F.array(every), hill), 0), suffix))


def graph_charge(graph: Column) -> Column:
    return F.when(graph["fate"] == "read", F.aggregate(graph["atoms"], F.lit(0), lambda acc, a: acc + a["charge"]))


def graph_mass(graph: Column) -> Column:
    """Monoisotopic mass, of the isotopes named; null where one isn't in ``ISOTOPE_MASSES``. No electron is taken off for a charge."""
    table = F.create_map(*[F.lit(x) for item in (MASSES | ISOTOPE_MASSES).items() for x in item])

    def mass(a: Column) -> Column:
        return table[F.concat(F.coalesce(a["isotope"].cast("string"), F.lit("")), a["element"])] + a["hydrogens"] * F.lit(MASSES["H"])

    return F.when(graph["fate"] == "read", F.aggregate(graph["atoms"], F.lit(0.0), lambda acc, a: acc + mass(a)))


def with_smiles(df: DataFrame, smiles: str = "smiles") -> DataFrame:
    """``df`` with smiles_fate, smiles_formula, smiles_mass and smiles_charge. A column of that name in ``df`` is replaced."""
    graph = df.withColumn("__graph", smiles_graph(F.col(smiles)))
    g = F.col("__graph")
    out = {"smiles_fate": g["fate"], "smiles_formula": graph_formula(g), "smiles_mass": graph_mass(g), "smiles_charge": graph_charge(g)}
    return graph.withColumns(out).drop("__graph")


def formula_matches(formula: Column, graph: Column) -> Column:
    """Whether the text's formula is exactly the one given; null where either is none."""
    return graph_formula(graph) == formula


def environments(graph: Column, radius: int = 2) -> Column:
    """Identifiers of the circular environments of every atom, up to ``radius`` bonds, sorted; null where the text wasn't read.

    An atom starts from its element, isotope, charge, hydrogens, number of bonds and whether it is aromatic. A round hashes it with the
    sorted (bond order, identifier) of its neighbours. Of environments with equal bonds the one of the smallest radius, then identifier,
    is kept; a round that reaches no further bond thus adds nothing. The identifiers are hashes of their own, not another toolkit's.
    """
    atoms, bonds = graph["atoms"], graph["bonds"]
    places = F.sequence(F.lit(0), F.size(bonds) - 1)

    def touching(i: Column) -> Column:
        return F.when(F.size(bonds) > 0, F.filter(places, lambda p: (F.get(bonds, p)["a"] == i) | (F.get(bonds, p)["b"] == i))).otherwise(F.array().cast("array<int>"))

    def other(p: Column, i: Column) -> Column:
        return F.get(bonds, p)["a"] + F.get(bonds, p)["b"] - i

    def first(a: Column, i: Column) -> Column:
        own = F.xxhash64(a["element"], a["isotope"], a["charge"], a["hydrogens"], a["aromatic"], F.size(touching(i)))
        return F.struct(own.alias("id"), F.array().cast("array<int>").alias("covers"))

    def grown(state: Column, r: int) -> Column:
        def one(x: Column, i: Column) -> Column:
            ways = F.array_sort(F.transform(touching(i), lambda p: F.struct(F.get(bonds, p)["order"].alias("order"), F.get(state, other(p, i))["id"].alias("id"))))
            reach = F.array_distinct(F.concat(touching(i), F.flatten(F.transform(touching(i), lambda p: F.get(state, other(p, i))["covers"])), x["covers"]))
            return F.struct(F.xxhash64(F.lit(r), x["id"], ways).alias("id"), F.array_sort(reach).alias("covers"))

        return F.transform(state, one)

    def marked(state: Column, r: int) -> Column:
        return F.transform(state, lambda x: F.struct(x["covers"].alias("covers"), F.lit(r).alias("r"), x["id"].alias("id")))

    # each round's state is bound once, as the argument of a lambda, so that no round is computed again by the next
    def rounds(state: Column, r: int) -> Column:
        own = marked(state, r)
        if r == radius:
            return own
        return F.concat(own, F.flatten(F.transform(F.array(grown(state, r + 1)), lambda nxt: rounds(nxt, r + 1))))

    every = F.flatten(F.transform(F.array(F.transform(atoms, first)), lambda state: rounds(state, 0)))
    # sorted by bonds, radius and identifier: the first of each run of equal bonds stays; radius 0 covers none and stays whole
    kept = F.flatten(
        F.transform(
            F.array(F.array_sort(every)),
            lambda s: F.filter(s, lambda x, i: (x["r"] == 0) | ((F.size(x["covers"]) > 0) & ((i == 0) | (F.get(s, i - 1)["covers"] != x["covers"])))),
        )
    )
    return F.when(graph["fate"] == "read", F.array_sort(F.array_distinct(F.transform(kept, lambda x: x["id"]))))


def active_bits(graph: Column, bits: int = 2048, radius: int = 2) -> Column:
    """The places of the fingerprint's set bits, ascending; null where the text wasn't read."""
    return F.array_sort(F.array_distinct(F.transform(environments(graph, radius), lambda x: F.pmod(x, F.lit(bits)).cast("int"))))


def fingerprint(graph: Column, bits: int = 2048, radius: int = 2) -> Column:
    """The fingerprint as array<int> of 0 and 1; null where the text wasn't read."""
    set_bits = F.transform(F.array(active_bits(graph, bits, radius)), lambda on: F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.array_contains(on, i).cast("int")))
    return F.when(graph["fate"] == "read", F.get(set_bits, 0))
