"""LaTeX formulas to plain text.

Fractions nest, so they are rewritten from the inside until nothing changes; that is the one part built-in
functions cannot express.  Null stays null.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

# LaTeX names and the signs they stand for; longer names come first when they are applied.
SIGNS = {
    "\\times": "×", "\\div": "÷", "\\cdot": "·", "\\leq": "≤", "\\geq": "≥", "\\neq": "≠", "\\angle": "∠", "\\circ": "°", "\\pi": "π",
    "\\alpha": "α", "\\beta": "β", "\\theta": "θ", "\\Delta": "Δ", "\\triangle": "△", "\\infty": "∞", "\\pm": "±", "\\in": "∈", "\\cup": "∪", "\\cap": "∩",
}
_NAMES = re.compile("|".join(sorted((re.escape(k) + r"(?![A-Za-z])" for k in SIGNS), key=len, reverse=True)))
_FRACTION = re.compile(r"\\[dt]?frac\s*\{([^{}]*)\}\s*\{([^{}]*)\}")
_ROOT = re.compile(r"\\sqrt\s*\{([^{}]*)\}")
_STYLE = re.compile(r"\\(?:math[a-z]+|text|rm|bf|displaystyle|left|right)(?![A-Za-z])\s*")
_SCRIPT = re.compile(r"([_^])\{([^{}]*)\}")
_BRACES = re.compile(r"\{([^{}]*)\}")


def plain(formula: str | None) -> str | None:
    """One formula as plain text: ``\\frac{a}{b}`` to ``(a)/(b)``, scripts, signs and styles resolved."""
    if formula is None:
        return None
    t = _STYLE.sub("", formula.replace("$", ""))
    while True:
        u = _SCRIPT.sub(lambda m: m[1] + m[2] if len(m[2]) <= 1 else f"{m[1]}({m[2]})" if "\\" not in m[2] else m[0], t)
        u = _FRACTION.sub(lambda m: "/".join(x if re.fullmatch(r"\w+", x) else f"({x})" for x in (m[1], m[2])), u)
        u = _ROOT.sub(lambda m: f"√({m[1]})", u)
        if u == t:
            break
        t = u
    t = _NAMES.sub(lambda m: SIGNS[m[0]], t)
    while (u := _SCRIPT.sub(r"\1\2", t)) != t or (u := _BRACES.sub(r"\1", t)) != t:
        t = u
    return re.sub(r"\s+", " ", t.replace("^°", "°")).strip()


@arrow_udf(T.StringType())
def _plain(formulas: pa.Array) -> pa.Array:
    return pa.array([plain(x) for x in formulas.to_pylist()], pa.string())


def plain_formula(col: Column) -> Column:
    """Plain text of a formula column."""
    return _plain(col)


def without_styles(col: Column) -> Column:
    r"""``\mathrm`` and its like removed, with built-in functions only."""
    return F.regexp_replace(col, r"\\math[a-z]+ ?", "")
