"""DuckDB forms of the column functions, for the SQL side of the queries."""

WS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NUMBER = r"[A-Za-z]?\d+(?:\.\d+)?|[IVXLC]+"
CAPTION = rf"^(?:\*\*)?(?:Table|Tab\.?)\s+({NUMBER})(?:\*\*)?\s*[:.\x{{2014}}\-]?\s+"
LABEL_ONLY = rf"^[\s#>*_]*(?:Tables?|Tab\.?|Figs?\.?|Figures?|Schemes?)\s+(?:{NUMBER})[\s*_]*[:.\x{{2014}}\-]?[\s*_]*$"


def replaced(x: str, pattern: str, to: str, flags: str = "g") -> str:
    return f"regexp_replace({x}, '{pattern}', '{to}', '{flags}')"


def collapsed(x: str) -> str:
    return f"trim({replaced(x, WS + '+', ' ')})"


def scientific(x: str) -> str:
    x = replaced(f"coalesce({x}, '')", rf"(?:\\mu|[µμ]){WS}*", "u")
    x = f"translate({x}, '₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎', '0123456789+-=()')"
    x = f"translate({replaced(x, '([⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻ⁿ]+)', chr(94) + chr(92) + '1')}, '⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻ⁿ', '0123456789+-n')"
    x = f"translate({x}, '−–—' || chr(160) || chr(8201) || chr(8239) || chr(197) || chr(8491) || chr(229) || chr(173), '---   AAa')"
    x = replaced(x, rf"([A-Za-z]){WS}*_{WS}*(\d+)", r"\1\2")
    x = replaced(x, r"([A-Za-z])_([A-Za-z])\b", r"\1\2")
    return collapsed(replaced(x, rf"{WS}*\^{WS}*", "^"))


def words(x: str) -> str:
    return rf"regexp_extract_all(lower({scientific(x)}), '[a-z0-9]+(?:[./^-][a-z0-9]+)*')"


def overlap(a: str, b: str) -> str:
    return f"coalesce(list_sum(list_transform(list_distinct({a}), lambda t: least(len(list_filter({a}, lambda x: x = t)), len(list_filter({b}, lambda x: x = t))))), 0)"


def precision(a: str, b: str) -> str:
    """Of predicted tokens ``b`` against reference tokens ``a``."""
    return f"(case when len({a}) = 0 and len({b}) = 0 then 1.0 when len({a}) = 0 or len({b}) = 0 then 0.0 else {overlap(a, b)}::double / len({b}) end)"


def recall(a: str, b: str) -> str:
    return f"(case when len({a}) = 0 and len({b}) = 0 then 1.0 when len({a}) = 0 or len({b}) = 0 then 0.0 else {overlap(a, b)}::double / len({a}) end)"


def harmonic(p: str, r: str) -> str:
    return f"(case when {p} + {r} = 0 then 0.0 else 2 * {p} * {r} / ({p} + {r}) end)"


def label_only(x: str) -> str:
    return f"regexp_matches({x}, '{LABEL_ONLY}', 'i')"


def caption_title(x: str) -> str:
    return f"(case when {label_only(x)} then '' else trim({replaced(x, CAPTION, '', 'i')}) end)"
