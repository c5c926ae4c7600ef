"""Status texts and coded names as numbers: flags of treatment, receptor and event, levels of stage and grade."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortforge.functions.columns import col, numeric, tristate

#: What a status text says, as the data dictionaries fix it: field, precedence, how a phrase is
#: looked for (the whole text, its start, a part of it, or a leading code), phrases, and the value.
#: The first line of a field that fits decides; ``unless`` is a part that the text must not hold.
RULES = (
    ("treated", 1, "whole", "YES Y TRUE T 1 RECEIVED TREATED", None, 1),
    ("treated", 2, "whole", "NO N FALSE F 0 NOT_RECEIVED UNTREATED", None, 0),
    ("treated", 3, "part", "YES RECEIV", None, 1),
    ("treated", 4, "part", "TREAT", "NO", 1),
    ("treated", 5, "start", "NO", None, 0),
    ("receptor", 1, "whole", "+ 1 YES", None, 1),
    ("receptor", 2, "part", "POS", None, 1),
    ("receptor", 3, "whole", "- 0 NO", None, 0),
    ("receptor", 4, "part", "NEG", None, 0),
    ("event", 1, "code", "1", None, 1),
    ("event", 2, "part", "DECEASED DEAD DIED EVENT", None, 1),
    ("event", 3, "code", "0", None, 0),
    ("event", 4, "part", "LIVING ALIVE CENSORED", None, 0),
    ("event", 5, "whole", "TRUE YES", None, 1),
    ("event", 6, "whole", "FALSE NO", None, 0),
)
EVENT_TEXTS = ("1", "true", "yes", "event", "death", "dead", "failure")

#: How each kind of rule looks for a phrase: the regular expression around it.
_LOOK = {"whole": "^{}$", "start": "^{}", "part": "{}", "code": r"^{}(\D|$)"}


def status(c: str | Column, field: str) -> Column:
    """1, 0 or null: what the text says about ``field``, by the first of its rules that fits the trimmed text in upper case."""
    text = F.upper(F.trim(col(c).cast("string")))
    found = []
    for _, _, how, phrases, unless, value in sorted((r for r in RULES if r[0] == field), key=lambda r: r[1]):
        any_of = "|".join(_LOOK[how].format(re.escape(x.replace("_", " "))) for x in phrases.split())
        fits = text.rlike(any_of)
        found.append(F.when(fits & ~text.contains(unless) if unless else fits, value))
    return F.when(text != "", F.coalesce(*found))


def status_text(c: str | Column) -> Column:
    """1 for received, 0 for not received, else null; "not received" and the like hold "RECEIV" and count as received unless they are a whole text."""
    return status(c, "treated")


def receptor_text(c: str | Column) -> Column:
    """1 for positive, 0 for negative, else null."""
    return status(c, "receptor")


def event_text(c: str | Column) -> Column:
    """1 for an event, 0 for none, else null: a leading code 1 or 0, or a word."""
    return status(c, "event")


def event_flag(df: DataFrame, column: str, name: str = "event", least_share: float | None = None) -> DataFrame:
    """Adds an event flag; whether the column is read as numbers is decided for the whole column.

    Without ``least_share`` it is numeric if any value is, and a number above one half
    is an event; else texts decide and unknown ones are null.  With it, the column is
    numeric if that share of values is, a number above zero is an event, and anything
    else is none.
    """
    share = df.agg(F.avg(numeric(column).isNotNull().cast("double"))).scalar()
    x = numeric(column)
    if least_share is None:
        return df.withColumn(name, F.when(share > 0, F.when(x.isNotNull(), (x > 0.5).cast("int"))).otherwise(tristate(column)))
    text = F.lower(F.trim(col(column).cast("string"))).isin(*EVENT_TEXTS)
    return df.withColumn(name, F.coalesce(F.when(share >= least_share, x > 0).otherwise(text), F.lit(False)).cast("int"))


def normalise_name(name: str) -> str:
    """A column name in upper case with runs of other characters as one underscore."""
    return re.sub(r"[^A-Z0-9]+", "_", name.upper()).strip("_")


def _vocabulary() -> dict[str, dict[str, float]]:
    """Codes of the published staging manuals and their levels, by field: T0 to T4 with Tis, N0 to N3, M0 and M1, grades 1 to 4, stages 0 to IV; letters a to d name parts of a level."""
    parts = ("", "a", "b", "c", "d")
    spans = {"t": range(1, 5), "n": range(4), "m": range(2), "grade": range(1, 5)}
    codes = {field: {f"{field[0]}{level}{part}": float(level) for level in levels for part in parts} for field, levels in spans.items()}
    codes["t"] |= {"t0": 0.0, "tis": 0.0}
    codes["grade"] |= {f"grade{level}": float(level) for level in spans["grade"]}
    codes["stage"] = {f"stage{roman}{part}": float(level) for level, roman in enumerate(("0", "i", "ii", "iii", "iv")) for part in parts}
    return codes


LEVELS = _vocabulary()
#: Words in front of a bare level, which make up a code with it.
_HEADS = ("stage", "grade")
#: What says that a level is not known.
_UNKNOWN = {"t": {"tx"}, "n": {"nx"}, "m": {"mx"}, "grade": {"gx", "gradex"}, "stage": {"stagex", "stageis"}}


def level_of(name: str, kind: str) -> float | None:
    """The level (kind stage, t, n, m or grade) that the name of an indicator column stands for; null if unknown.

    The name is cut into tokens at anything but letters and digits; "stage" and "grade"
    take the token behind them.  The first token that is a code of the kind decides, and
    a token or words that say "unknown" before all.
    """
    tokens = re.findall(r"[a-z0-9]+", name.lower())
    codes = [a + b if a in _HEADS else a for a, b in zip(tokens, [*tokens[1:], ""])]
    if "unknown" in tokens or ("not", "reported") in set(zip(tokens, tokens[1:])) or _UNKNOWN[kind].intersection(codes):
        return None
    return next((LEVELS[kind][c] for c in codes if c in LEVELS[kind]), None)
