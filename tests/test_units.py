import pytest

from gridquill.functions.units import conversion, quantity_of
from gridquill.operators import units as U

KNOWN = [
    ("10^-19 J", "eV", 0.624151), ("kJ/mol", "eV", 0.0103643), ("sun", "mW cm^-2", 100), ("umol/(g h)", "umol g^-1 h^-1", 1), ("µmol g⁻¹ min⁻¹", "umol g^-1 h^-1", 60), ("nmol mg^-1 h^-1", "umol g^-1 h^-1", 1),
    ("g/100 g", "wt%", 1), ("mass fraction", "wt%", 100), ("wt. %", "wt%", 1), ("L/kg", "cm3/g", 1), ("Å", "nm", 0.1), ("m² kg⁻¹", "m2/g", 1e-3), ("ppmw", "wt%", 1e-4), ("10^-3 cm^3 g^-1", "cm3/g", 1e-3), ("µM", "mol/L", 1e-6), ("psi", "kPa", 6.894757),
]


@pytest.mark.parametrize(("unit", "common", "scale"), KNOWN)
def test_conversions(unit, common, scale):
    assert conversion(unit, common)[0] == pytest.approx(scale, rel=1e-5)


def test_temperatures_and_what_does_not_fit():
    assert conversion("degF", "degC") == (pytest.approx(5 / 9), pytest.approx(-32 * 5 / 9))
    assert conversion("K", "degC") == (1.0, -273.15) and conversion("ºC", "degC") == (1.0, 0.0)
    assert conversion("nm", "m2/g") is None and conversion("", "nm") is None and conversion("foo", "nm") is None and conversion("K", "kPa") is None


def test_headers():
    assert quantity_of("Evolution rate, umol h^-1 g^-1_CH4") == ("production_rate", "evolution rate", "umol h^-1 g^-1")
    assert quantity_of("r(umol g^-1 s^-1)")[::2] == ("production_rate", "umol g^-1 s^-1")
    assert quantity_of("T / deg C")[::2] == ("temperature", "deg C") and quantity_of("Pt loading")[0] == "metal_loading"
    assert quantity_of("Total pressure")[0] == "pressure" and quantity_of("Selectivity (%)") is None and quantity_of("Lattice parameter a (Å)") is None


CELL = "struct<kind:string,s:string,i:bigint,d:double>"


def relations(spark, tables, cells, mentions=()):
    t = spark.createDataFrame(tables, "table_no bigint, caption string, col_headers array<string>")
    c = spark.createDataFrame([(i, n, r, k, (kind, s, int(s) if kind == "i" else None, float(s) if kind == "f" else None), 0) for i, n, r, k, kind, s in cells], f"cell_id bigint, table_no bigint, row_no int, col_no int, cell {CELL}, value int")
    m = spark.createDataFrame(list(mentions), "mention_id bigint, table_no bigint, text string")
    u = spark.createDataFrame([("pore_volume", "cm3/g"), ("temperature", "degC"), ("pore_diameter", "nm")], "quantity string, common_unit string")
    return c, t, m, u


def test_where_units_stand(spark):
    tables = [(1, None, ["Sample", "V_p (mm3/g)", "T"]), (2, "Table 2. The pore size is given in pm.", ["Property", "A-1"]), (3, "x", ["Sample", "Pore size"]), (4, None, ["Sample", "PV", "pH"]), (5, "", None)]
    cells = [
        (1, 1, 0, 0, "s", "A"), (2, 1, 0, 1, "f", "12.5"), (3, 1, 0, 2, "s", "300 K"), (4, 1, 1, 1, "s", "0.2 cm3/g"), (5, 1, 1, 1, "s", "trace"), (6, 1, 1, 1, "m", "-"),
        (7, 2, 0, 0, "s", "Pore size"), (8, 2, 0, 1, "s", "~2,5 ± 0.1"), (9, 2, 1, 0, "s", "T (K)"), (10, 2, 1, 1, "i", "0"),
        (11, 3, 0, 0, "s", "A"), (12, 3, 0, 1, "i", "3"), (13, 4, 0, 0, "m", "-"), (14, 4, 0, 1, "s", "mL/g"), (15, 4, 1, 1, "s", "<1.5×10^2"), (16, 4, 1, 2, "i", "7"), (2, 1, 0, 1, "f", "12.5"), (17, 5, 0, 1, "i", "7"),
    ]
    got = {r.cell_id: (r.quantity, r.unit, r.value, r.common_value) for r in U.converted(*relations(spark, tables, cells, [(1, 3, "In Table 3 the pore size is expressed in Å. Next.")])).collect()}
    assert got[2] == ("pore_volume", "mm3/g", 12.5, pytest.approx(0.0125)) and got[3] == ("temperature", "K", 300.0, pytest.approx(26.85)) and got[4][1] == "cm3/g"
    assert got[8][:3] == ("pore_diameter", "pm", 2.5) and got[10] == ("temperature", "K", 0.0, pytest.approx(-273.15))
    assert got[12] == ("pore_diameter", "angstrom", 3.0, pytest.approx(0.3)) and got[15] == ("pore_volume", "mL/g", 150.0, 150.0)
    assert set(got) == {2, 3, 4, 8, 10, 12, 15}
    found = {r.cell_id for r in U.found(*relations(spark, tables, cells, [(1, 3, "In Table 3 the pore size is expressed in Å. Next.")])).collect()}
    assert found == {2, 3, 8, 10, 12}


def estimate(**known):
    return {"unit": "?", "shared": 40, "positive": 40, "ratio": None, "spread": 0.4, "scale": None, "offset": None, "middle": None, "wanted": None, "width": None} | known


def test_estimates_are_snapped_to_known_conversions():
    assert U.snapped(estimate(ratio=-1.04), "nm")[:2] == (0.1, 0.0) and U.snapped(estimate(ratio=2.9), "nm")[:2] == (1000.0, 0.0)
    assert U.snapped(estimate(ratio=1.75, spread=0.3), "umol g^-1 h^-1")[0] == 60.0 and U.snapped(estimate(ratio=0.8), "kPa")[0] == pytest.approx(6.894757, rel=1e-6)
    assert U.snapped(estimate(), "nm") is None and U.snapped(estimate(positive=0, ratio=1.0), "nm") is None


def test_the_notation_decides_what_the_estimate_leaves_open_but_not_against_the_values():
    assert U.snapped(estimate(unit="bar", ratio=2.0), "kPa")[0] == 100.0 and U.snapped(estimate(unit="atm", ratio=2.0), "kPa")[0] == 101.325
    assert U.snapped(estimate(unit="um", ratio=-3.0, shared=400, positive=400), "nm")[0] == 1e-3  # written so, but the values are picometres


def test_temperatures_need_scale_and_offset():
    same = {"wanted": 500.0, "width": 300.0}
    assert U.snapped(estimate(middle=773.0, scale=1.02, **same), "degC")[:2] == (1.0, -273.15)
    assert U.snapped(estimate(middle=501.0, scale=0.97, **same), "degC")[:2] == (1.0, 0.0)
    assert U.snapped(estimate(middle=930.0, scale=0.56, **same), "degC")[0] == pytest.approx(5 / 9)


def recorded(spark):
    """Forty samples whose pore diameters and temperatures are recorded in known and in made-up units."""
    pores = [("nm", 1.0), ("zorks", 1e-3), ("A", 10.0), ("Angs.", 10.0)]
    heat = [("degC", 1.0, 0.0), ("grd K", 1.0, 273.15), ("hot F", 1.8, 32.0)]
    rows = [("pore_diameter", u, f"s{i}", (2.0 + i % 17) * f * (1.1 if i % 5 else 0.8)) for u, f in pores for i in range(40)]
    rows += [("temperature", u, f"s{i}", (100.0 + 11 * i) * f + o) for u, f, o in heat for i in range(40)]
    rows += [("pore_diameter", "zorks", None, None), ("pore_diameter", "um", "s1", 0.0), ("pore_diameter", "furlong-ish", "s1", 0.0), ("pore_diameter", None, "s1", 3.0), ("pore_diameter", "alone", "other", 4.0)]
    return spark.createDataFrame(rows, "quantity string, unit string, entity string, value double")


def test_made_up_units_are_solved_by_the_entities_they_share(spark):
    common = {"pore_diameter": "nm", "temperature": "degC"}
    got = {(r.quantity, r.unit): (r.scale, r.offset, r.how) for r in U.graph(recorded(spark), common).collect()}
    assert got["pore_diameter", "zorks"] == (1000.0, 0.0, "estimated") and got["pore_diameter", "Angs."] == (0.1, 0.0, "estimated")
    assert got["temperature", "grd K"] == (1.0, -273.15, "estimated") and got["temperature", "hot F"][0] == pytest.approx(5 / 9)
    assert got["pore_diameter", "nm"][2] == "common" and got["pore_diameter", "alone"][2] == "population"
    assert got["pore_diameter", "um"] == (1000.0, 0.0, "read") and ("pore_diameter", "furlong-ish") not in got


def test_without_the_estimate_only_the_common_unit_is_known(spark):
    common = {"pore_diameter": "nm", "temperature": "degC"}
    off = {(r.quantity, r.unit) for r in U.graph(recorded(spark), common, estimated=False).collect()}
    assert off == {("pore_diameter", "nm"), ("temperature", "degC")}
    opaque = {(r.quantity, r.unit): r.scale for r in U.graph(recorded(spark), common, readable=False).collect()}
    assert opaque["pore_diameter", "A"] == 0.1 and opaque["pore_diameter", "Angs."] == 0.1


def test_without_the_common_unit_a_readable_one_starts(spark):
    few = recorded(spark).where("unit in ('A', 'zorks')")
    got = {r.unit: (r.scale, r.how) for r in U.graph(few, {"pore_diameter": "nm"}).collect()}
    assert got == {"A": (0.1, "read"), "zorks": (1000.0, "estimated")}


def test_empty(spark):
    c, t, m, u = relations(spark, [(1, "x", ["Sample", "V_p"])], [(1, 1, 0, 1, "i", "3")])
    assert U.found(c.limit(0), t, m, u).count() == 0 and U.found(c, t.limit(0), m, u).count() == 0 and U.found(c, t, m, u.limit(0)).count() == 0
    assert U.converted(c, t, m, u).first().common_value is None
