"""Units of measurement: their notation, dimensions and conversion, and the names of quantities."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

#: SI factor and dimensions (m, kg, s, mol, K) of each symbol; those in PREFIXED take prefixes.
SYMBOLS: dict[str, tuple[float, tuple[int, int, int, int, int]]] = {
    "m": (1.0, (1, 0, 0, 0, 0)),
    "g": (1e-3, (0, 1, 0, 0, 0)),
    "s": (1.0, (0, 0, 1, 0, 0)),
    "mol": (1.0, (0, 0, 0, 1, 0)),
    "L": (1e-3, (3, 0, 0, 0, 0)),
    "l": (1e-3, (3, 0, 0, 0, 0)),
    "J": (1.0, (2, 1, -2, 0, 0)),
    "eV": (1.602176634e-19, (2, 1, -2, 0, 0)),
    "Pa": (1.0, (-1, 1, -2, 0, 0)),
    "bar": (1e5, (-1, 1, -2, 0, 0)),
    "N": (1.0, (1, 1, -2, 0, 0)),
    "W": (1.0, (2, 1, -3, 0, 0)),
    "M": (1e3, (-3, 0, 0, 1, 0)),
    "K": (1.0, (0, 0, 0, 0, 1)),
    "atm": (101325.0, (-1, 1, -2, 0, 0)),
    "psi": (6894.757293, (-1, 1, -2, 0, 0)),
    "Torr": (133.322368, (-1, 1, -2, 0, 0)),
    "torr": (133.322368, (-1, 1, -2, 0, 0)),
    "mmHg": (133.322387, (-1, 1, -2, 0, 0)),
    "sun": (1e3, (0, 1, -3, 0, 0)),
    "suns": (1e3, (0, 1, -3, 0, 0)),
    "A": (1e-10, (1, 0, 0, 0, 0)),
    "angstrom": (1e-10, (1, 0, 0, 0, 0)),
    "angstroms": (1e-10, (1, 0, 0, 0, 0)),
    "micron": (1e-6, (1, 0, 0, 0, 0)),
    "microns": (1e-6, (1, 0, 0, 0, 0)),
    "cc": (1e-6, (3, 0, 0, 0, 0)),
    "sec": (1.0, (0, 0, 1, 0, 0)),
    "second": (1.0, (0, 0, 1, 0, 0)),
    "seconds": (1.0, (0, 0, 1, 0, 0)),
    "min": (60.0, (0, 0, 1, 0, 0)),
    "mins": (60.0, (0, 0, 1, 0, 0)),
    "minute": (60.0, (0, 0, 1, 0, 0)),
    "minutes": (60.0, (0, 0, 1, 0, 0)),
    "h": (3600.0, (0, 0, 1, 0, 0)),
    "hr": (3600.0, (0, 0, 1, 0, 0)),
    "hrs": (3600.0, (0, 0, 1, 0, 0)),
    "hour": (3600.0, (0, 0, 1, 0, 0)),
    "hours": (3600.0, (0, 0, 1, 0, 0)),
    "d": (86400.0, (0, 0, 1, 0, 0)),
    "day": (86400.0, (0, 0, 1, 0, 0)),
    "days": (86400.0, (0, 0, 1, 0, 0)),
    "wt%": (1e-2, (0, 0, 0, 0, 0)),
    "fraction": (1.0, (0, 0, 0, 0, 0)),
    "ppmw": (1e-6, (0, 0, 0, 0, 0)),
    "ppm": (1e-6, (0, 0, 0, 0, 0)),
}
PREFIXED = {"m", "g", "s", "mol", "L", "l", "J", "eV", "Pa", "bar", "N", "W", "M", "K"}
PREFIXES = {"k": 1e3, "c": 1e-2, "d": 1e-1, "m": 1e-3, "u": 1e-6, "n": 1e-9, "p": 1e-12, "M": 1e6, "G": 1e9, "h": 1e2}
AVOGADRO = 6.02214076e23
#: Kelvin = scale * degree + offset.
DEGREES = {"K": (1.0, 0.0), "degC": (1.0, 273.15), "degF": (5 / 9, 459.67 * 5 / 9)}
RAISED = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺", "0123456789-+")
#: Names under which each quantity is recorded, lower case.
NAMES: dict[str, tuple[str, ...]] = {
    "surface_area": ("bet specific surface area", "specific surface area", "bet surface area", "surface areas", "surface area", "bet area", "s_bet", "sbet", "a_bet", "ssa"),
    "pore_volume": ("total pore volume", "pore volumes", "pore volume", "pv", "v_p", "vp", "v_pore", "v_total"),
    "pore_diameter": ("mean pore diameter", "average pore diameter", "average pore width", "mean pore size", "average pore size", "pore diameter", "pore width", "pore size", "apd", "d_p", "d_pore"),
    "crystallite_size": ("crystallite size", "crystal size", "d_xrd", "mean crystallite size"),
    "film_thickness": ("film thickness", "layer thickness", "coating thickness"),
    "band_gap": ("optical band gap", "band gap energy", "band gap", "bandgap", "e_g", "eg"),
    "production_rate": ("production rate", "formation rate", "evolution rate", "yield rate", "r"),
    "temperature": ("calcination temperature", "reaction temperature", "temperature", "t_calc", "t"),
    "duration": ("irradiation time", "reaction time", "ageing time", "aging time", "calcination time", "time"),
    "irradiance": ("light intensity", "irradiance", "i_0"),
    "catalyst_mass": ("catalyst amount", "catalyst mass", "m_cat"),
    "metal_loading": ("metal loading", "metal content"),
    "pressure": ("total pressure", "co2 pressure", "partial pressure", "p_co2", "pressure", "p_total"),
    "concentration": ("precursor concentration", "naoh concentration", "concentration", "c_0"),
}
_BY_NAME = sorted(((n, q) for q, names in NAMES.items() for n in names), key=lambda x: -len(x[0]))
_ELEMENT = re.compile(r"[A-Z][a-z]? (?:loading|content)\b", re.I)
_SUBSTANCE = re.compile(r"[A-Za-z0-9]+ concentration\b", re.I)
#: What a label of a quantity starts with: cheap to test before ``quantity_of``.
STARTS = r"(?i)^[\s\u00a0*$]*(?:" + "|".join(re.escape(n) for n, _ in _BY_NAME) + r"|[A-Z][a-z]?[\s\u00a0]+(?:loading|content)|[A-Z0-9]+[\s\u00a0]+concentration)"
_TOKEN = re.compile(r"(wt%|[A-Za-z]+|\d+(?:\.\d+)?)(?:\^?\(?([+-]?\d+)\)?)?")


@lru_cache(maxsize=50_000)
def quantity_of(label: str) -> tuple[str, str, str] | None:
    """(quantity, its name, unit text) of a header, row label or name; None if it is no known quantity."""
    text = unicodedata.normalize("NFC", label).replace("\u00ad", "")
    text = re.sub(r"[\s  -​ 　]+", " ", text).strip().strip("*†‡§¶")
    text = re.sub(r"^\$|\$$", "", text)
    low = text.lower()
    found = None
    if (m := _ELEMENT.match(text)) is not None:
        found = "metal_loading", m.end()
    elif (m := _SUBSTANCE.match(text)) is not None:
        found = "concentration", m.end()
    for name, quantity in () if found else _BY_NAME:
        if low.startswith(name) and (len(low) == len(name) or not low[len(name)].isalnum()):
            found = quantity, len(name)
            break
    if not found:
        return None
    quantity, end = found
    rest = re.sub(r"^_[A-Za-z0-9]+", "", text[end:])
    rest = re.sub(r"_[A-Z][A-Za-z0-9]*$", "", rest)  # the product that a rate belongs to
    rest = re.sub(r"\^[a-z]$", "", rest.strip())
    rest = rest.strip(" ,;:/")
    if rest and re.match(r"in\s", rest):
        rest = rest[3:].strip()
    if len(rest) > 1 and rest[0] in "([{" and rest[-1] in ")]}":
        rest = rest[1:-1].strip()
    return quantity, low[:end], rest


def tidy(unit: str) -> str:
    """A unit in one notation: ASCII letters, carets, single spaces."""
    t = unicodedata.normalize("NFC", unit)
    t = re.sub(r"([⁰¹²³⁴-⁹⁻⁺]+)", lambda m: "^" + m[1].translate(RAISED), t)
    t = t.replace("µ", "u").replace("μ", "u").replace("−", "-").replace("–", "-").replace("Å", "angstrom").replace("Å", "angstrom").replace("º", "°")
    t = re.sub(r"(?:°|deg\.?|degrees?)\s*(C|F)\b|(?:degree )?(Celsius|Fahrenheit)", lambda m: "deg" + (m[1] or m[2][0]), t)
    t = re.sub(r"\b(?:wt|weight|mass|w)\s*\.?\s*%|%\s*\(?w/?w\)?", "wt%", t)
    t = re.sub(r"\b(?:mass|weight) fraction\b", "fraction", t)
    t = re.sub(r"[·⋅•×*\s  -​ 　]+", " ", t)
    return t.strip(" ,;:.")


@lru_cache(maxsize=50_000)
def si(unit: str) -> tuple[float, tuple[int, ...]] | None:
    """SI factor and dimensions of a unit; None if it can't be read."""
    t = tidy(unit)
    if not t or t.count("(") != t.count(")"):
        return None
    scale, dims = 1.0, [0, 0, 0, 0, 0]
    for k, part in enumerate(t.split("/")):
        sign = -1 if k else 1
        part = part.strip()
        if part[:1] == "(" and part[-1:] == ")":
            part = part[1:-1]
        at = 0
        if not part:
            return None
        for m in _TOKEN.finditer(part):
            if part[at : m.start()].strip():
                return None
            at = m.end()
            name, power = m[1], int(m[2] or 1) * sign
            if name[0].isdigit():
                scale *= float(name) ** power
                continue
            known = SYMBOLS.get(name)
            if known is None and name[0] in PREFIXES and name[1:] in PREFIXED:
                factor, d = SYMBOLS[name[1:]]
                known = factor * PREFIXES[name[0]], d
            if known is None:
                return None
            scale *= known[0] ** power
            dims = [a + b * power for a, b in zip(dims, known[1], strict=True)]
        if part[at:].strip():
            return None
    return scale, tuple(dims)


@lru_cache(maxsize=50_000)
def conversion(unit: str, common: str) -> tuple[float, float] | None:
    """(scale, offset) with value in ``common`` = scale * value + offset; None where the unit doesn't fit."""
    target = tidy(common)
    if target in DEGREES:
        got = DEGREES.get(tidy(unit))
        if got is None:
            return None
        scale, offset = DEGREES[target]
        return round(got[0] / scale, 12), round((got[1] - offset) / scale, 9)
    a, b = si(unit), si(common)
    if a is None or b is None:
        return None
    factor = a[0]
    if a[1] != b[1]:
        per_mole = tuple(x - y for x, y in zip(a[1], b[1], strict=True))
        if per_mole != (0, 0, 0, -1, 0) or b[1] != (2, 1, -2, 0, 0):
            return None
        factor /= AVOGADRO
    ratio = factor / b[0]
    nearest = float(f"{ratio:.9g}")
    return (1.0 if abs(nearest - 1) < 1e-4 else nearest), 0.0


@lru_cache(maxsize=1_000)
def known_conversions(common: str) -> tuple[tuple[float, float], ...]:
    """Every (scale, offset) by which values of some unit come to ``common``.

    Made by rule from the symbols: decimal multiples; for a rate or a duration also those of
    minutes, hours and days; for energies those of one joule and of one mole; and the named units
    of the same dimension.
    """
    target = tidy(common)
    if target in DEGREES:
        return tuple(sorted(c for d in DEGREES if (c := conversion(d, common)) is not None))
    got = si(target)
    if got is None:
        return ((1.0, 0.0),)
    scale, dims = got
    named = {s / scale for s, d in SYMBOLS.values() if d == dims}
    bases = {1.0}
    if dims[2] in (1, -1):  # a time, or something per time
        own = next((SYMBOLS[w][0] for w in re.findall(r"[A-Za-z]+", target) if w in SYMBOLS and SYMBOLS[w][1] == (0, 0, 1, 0, 0)), 1.0)
        bases |= {(t / own) ** dims[2] for t in (1.0, 60.0, 3600.0, 86400.0)}
    if dims == SYMBOLS["J"][1]:
        bases |= {1 / scale, 1 / AVOGADRO / scale}
    out = {float(f"{b * 10.0**k:.9g}") for b in bases for k in range(-9, 10)}
    # decimal multiples of a joule stand for each other: keep one of each value
    return tuple(sorted((x, 0.0) for x in out | {float(f"{x:.9g}") for x in named}))
