"""Text keys. They differ on purpose; each operator names the one it compares by.

Letters are replaced before lower-casing throughout: a dotted capital I becomes two code points otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Turkish letters and what they fold to.
TR_FROM, TR_TO = "çğıöşüÇĞİÖŞÜ", "cgiosuCGIOSU"
#: The same with circumflexes.
TR_WIDE_FROM, TR_WIDE_TO = TR_FROM + "âÂîÎûÛ", TR_TO + "aAiIuU"
#: Latin letters with marks, and their base letters.
MARKED_FROM = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿĞğİıŞş"
MARKED_TO = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyyGgIiSs"


def _c(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def safe_lower(text: Column | str) -> Column:
    return F.lower(F.translate(_c(text), "İ", "i"))


def ascii_key(text: Column | str) -> Column:
    """K1: Turkish letters folded, lower case, a-z and digits only."""
    return F.regexp_replace(F.lower(F.translate(_c(text), TR_WIDE_FROM, TR_WIDE_TO)), "[^a-z0-9]", "")


def line_key(text: Column | str) -> Column:
    """K2: folded, lower case, word characters and single spaces."""
    kept = F.regexp_replace(F.lower(F.translate(F.trim(_c(text)), TR_FROM, TR_TO)), r"[^\p{L}\p{N}_\s]", "")
    return F.regexp_replace(kept, r"\s+", " ")


def hit_key(text: Column | str) -> Column:
    """K3: trimmed, folded, lower case, a-z and digits only."""
    return F.regexp_replace(F.lower(F.translate(F.trim(_c(text)), TR_FROM, TR_TO)), "[^a-z0-9]", "")


def name_key(text: Column | str) -> Column:
    """K4: upper case without spaces, marks stripped."""
    return F.upper(F.translate(F.regexp_replace(F.trim(_c(text)), " ", ""), MARKED_FROM, MARKED_TO))


def alnum_key(text: Column | str) -> Column:
    """K5: lower case, letters and digits of any script."""
    return F.regexp_replace(safe_lower(text), r"[^\p{L}\p{N}]", "")


def word_key(text: Column | str) -> Column:
    """K6: marks stripped, camelCase split, lower case, other characters to single spaces."""
    folded = F.regexp_replace(F.translate(_c(text), MARKED_FROM, MARKED_TO), "([a-z])([A-Z])", "$1 $2")
    return F.trim(F.regexp_replace(F.lower(folded), "[^a-z0-9]+", " "))


def plain_key(text: Column | str) -> Column:
    """K7: lower case, a-z and digits only, nothing folded: marked letters vanish."""
    return F.regexp_replace(safe_lower(text), "[^a-z0-9]", "")


def phonetic_key(text: Column | str) -> Column:
    """K8: K4 with W as N, Q as G, and repeated letters once."""
    return F.regexp_replace(F.translate(name_key(text), "WQ", "NG"), r"(.)\1+", "$1")


def duck(kind: str, text: str) -> str:
    """The same keys as DuckDB SQL."""
    lower = f"lower(translate({text}, 'İ', 'i'))"
    marked = f"translate({text}, '{MARKED_FROM}', '{MARKED_TO}')"
    return {
        "ascii_key": f"regexp_replace(lower(translate({text}, '{TR_WIDE_FROM}', '{TR_WIDE_TO}')), '[^a-z0-9]', '', 'g')",
        "line_key": f"regexp_replace(regexp_replace(lower(translate(trim({text}), '{TR_FROM}', '{TR_TO}')), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g')",
        "hit_key": f"regexp_replace(lower(translate(trim({text}), '{TR_FROM}', '{TR_TO}')), '[^a-z0-9]', '', 'g')",
        "name_key": f"upper(translate(replace(trim({text}), ' ', ''), '{MARKED_FROM}', '{MARKED_TO}'))",
        "alnum_key": f"regexp_replace({lower}, '[^\\p{{L}}\\p{{N}}]', '', 'g')",
        "word_key": f"trim(regexp_replace(lower(regexp_replace({marked}, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+', ' ', 'g'))",
        "plain_key": f"regexp_replace({lower}, '[^a-z0-9]', '', 'g')",
        "safe_lower": lower,
    }[kind]
