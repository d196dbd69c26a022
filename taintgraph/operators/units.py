"""Quantities recorded in different units, brought to one.

``potencies`` reads a potency from the type, unit, value, comment and reference columns of an activity table and gives
it in picomolar. Where no unit is written, ``fit_unit_mixture`` fits a mixture on the log scale whose components lie at
the known conversion factors; a record gets the unit with the highest posterior, and is flagged when that is unsure.

Defined cases: a null or unparsable type, unit or comment is no potency; a written unit that is unknown gives none;
values that are null, not finite or not above zero on a linear scale give none; repeated rows come out once; an empty
table gives an empty result; extra columns are never read.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taintgraph.functions.text import strip
from taintgraph.session import cut

#: fixed values: exponents of ten from an SI prefix
PREFIX_EXPONENT = {"": 0, "k": 3, "d": -1, "m": -3, "u": -6, "n": -9, "p": -12, "f": -15}
#: fixed values: spelled prefixes
SPELLED_PREFIX = {"milli": "m", "micro": "u", "nano": "n", "pico": "p", "femto": "f", "": ""}
#: fixed values: texts that stand for "no unit"
NO_UNIT = ["", "-", "--", "n/a", "na", "n.a.", "none", "null", "nan", "unknown", "unspecified", "not specified", "?", "."]
#: candidate units when none is written, as exponents of ten to molar
CANDIDATES = {"M": 0, "mM": -3, "uM": -6, "nM": -9, "pM": -12}

_NAME = r"(?:IC50|EC50|Ki|Kd)"
_TYPE = rf"(?i)^\s*(p|(?:[-−–]\s*)?log\s*(?:10|_10)?\s*)?[(\[]?\s*({_NAME})\s*[)\]]?\s*(.*)$"
_NUMBER = r"(?:\d[\d,]*(?:\.\d+)?|\.\d+)(?:\s*[x×*]\s*10\s*\^?\s*[-−+]?\d+|[eE][-−+]?\d+)?"
_UNIT_WORDS = (
    r"(?:[pnumfµμ]?M(?![A-Za-z0-9])|(?i:(?:pico|nano|micro|milli|femto)?molar)(?![A-Za-z])"
    r"|[pnumfµμ]?mol\s*(?:/\s*[lL]|[ .·]?\s*[lL]\^?[-−]1|/\s*dm\^?3|[ .·]?\s*dm\^?[-−]3)(?![A-Za-z0-9])"
    r"|[pnumkµμ]?g\s*(?:/\s*[mudµμ]?[lL]|[ .·]?\s*[mudµμ]?[lL]\^?[-−]1)(?![A-Za-z0-9]))"
)


#: codes of a written unit: an exponent of ten to molar, or MASS plus an exponent of ten to g/L, or one of the others
MASS, NONE, NEGLOG, LOG, LOGUNIT = 1000, 2000, 3000, 4000, 5000


def _unit_codes() -> dict[str, int]:
    """Unit texts in the normal form of :func:`unit_code`, built from the prefixes by rule."""
    out = {f"{p}{base}": e for p, e in PREFIX_EXPONENT.items() for base in ("M", "mol/L")}
    out |= {f"{p}g/{v}L": MASS + e - PREFIX_EXPONENT[v] for p, e in PREFIX_EXPONENT.items() for v in ("", "d", "m", "u")}
    return out


def _word_codes() -> dict[str, int]:
    out = {f"{w}molar": PREFIX_EXPONENT[p] for w, p in SPELLED_PREFIX.items()}
    out |= {re.sub(r"[\s.]", "", x): NONE for x in NO_UNIT} | {"logunits": LOGUNIT, "logunit": LOGUNIT}
    return out | {f"{s}log{t}{m}": c for s, c in (("-", NEGLOG), ("", LOG)) for t in ("", "10") for m in ("", "m", "molar", "mol/l")}


def _lookup(codes: dict[str, int]) -> Column:
    # a folded literal: a map of expressions would be turned into one long case expression
    return F.from_json(F.lit(json.dumps(codes)), "map<string,int>")


def unit_code(text: Column) -> Column:
    """A written unit as a code (see ``MASS`` and its neighbours); null for a unit that is not known."""
    u = F.translate(F.coalesce(strip(text), F.lit("")), "µμ−–", "uu--")
    u = F.regexp_replace(u, r"[\s.·*()\[\]^]+", "")
    u = F.regexp_replace(u, r"(mol|g)/?([mud]?)[lL](?:-1)?$", "$1/$2L")
    u = F.regexp_replace(u, r"mol/?dm-?3$", "mol/L")

    def look_up(x: Column) -> Column:
        power = F.regexp_extract(x, r"^(?:1x)?10'?([+-]?\d{1,2})(?:M|mol/L)$", 1).try_cast("int")
        return F.coalesce(_lookup(_unit_codes())[x], _lookup(_word_codes())[F.lower(x)], power)

    # within the lambda the normal form is a variable: it is made once, not once per use
    return F.transform(F.array(u), look_up)[0]


def _number(text: Column) -> Column:
    """A printed number: a comma before exactly three digits separates thousands, any other is a decimal comma."""
    x = F.regexp_replace(F.regexp_replace(text, "[−–]", "-"), r"\s*[x×*]\s*10\s*\^?\s*", "e")
    x = F.regexp_replace(x, r",(?=\d{3}(?!\d))", "")
    return F.regexp_replace(x, ",", ".").try_cast("double")


def comment_potency(comment: Column) -> Column:
    """The single value with unit that a comment gives as the potency: struct(value, unit), null when there is none.

    Either the whole comment is a number with a unit, or a potency name is followed by one. Ranges are none; several
    different values are none; percentages and concentrations named otherwise are not looked at."""
    not_range = r"(?!\s*(?:[-−–]|to\b|and\b|\.\.)\s*\d)"
    whole = rf"^\s*[<>=~≤≥≈]*\s*({_NUMBER})\s*({_UNIT_WORDS})\s*[.;]?\s*$"
    rel = r"\s*(?:value\s*)?(?:=|:|~|≈|<=?|>=?|≤|≥|of|is|was|at|approx\.?|approximately|about|ca\.?|\s)*\s*"
    named = rf"(?<![A-Za-z0-9])(?i:{_NAME})(?![A-Za-z0-9]){rel}({_NUMBER})\s*({_UNIT_WORDS}){not_range}"
    hits = F.array_distinct(
        F.zip_with(
            F.regexp_extract_all(comment, F.lit(named), 1),
            F.regexp_extract_all(comment, F.lit(named), 2),
            lambda v, u: F.struct(_number(v).alias("value"), u.alias("unit")),
        )
    )
    alone = F.struct(_number(F.regexp_extract(comment, whole, 1)).alias("value"), F.regexp_extract(comment, whole, 2).alias("unit"))
    return F.when(comment.rlike(whole), alone).when(F.size(hits) == 1, F.try_element_at(hits, F.lit(1)))


def fit_unit_mixture(distance: DataFrame, col: str, bin_width: float = 0.01, span: float = 20.0, rounds: int = 50) -> dict:
    """Fit components at 0, 3, 6, 9, 12 plus a uniform background to the log distance between value and reference.

    The data are first binned (at most ``2 * span / bin_width`` bins, whatever the table's size); only the bins come to
    the driver. Returns the weights, the common sigma, the background weight and the posterior of each bin."""
    shift = {u: -e for u, e in CANDIDATES.items()}
    rows = (
        distance.where(F.col(col).isNotNull() & (F.abs(F.col(col)) <= span))
        .groupBy(F.round(F.col(col) / bin_width).cast("int").alias("b"))
        .count()
        .collect()
    )
    w, back, sigma = {u: 0.9 / len(shift) for u in shift}, 0.1, 0.1
    data = [(r["b"] * bin_width, r["count"]) for r in rows]
    total = sum(n for _, n in data)

    def parts(x: float) -> tuple[dict[str, float], float]:
        dens = {u: w[u] * math.exp(-0.5 * ((x - s) / sigma) ** 2) / (sigma * math.sqrt(2 * math.pi)) for u, s in shift.items()}
        return dens, back / (2 * span)

    for _ in range(rounds if rows else 0):
        got, var, bg = dict.fromkeys(shift, 0.0), 0.0, 0.0
        for x, n in data:
            dens, b = parts(x)
            z = sum(dens.values()) + b
            bg += n * b / z
            for u, s in shift.items():
                p = n * dens[u] / z
                got[u] += p
                var += p * (x - s) ** 2
        hit = sum(got.values())
        w = {u: max(g / total, 1e-6) for u, g in got.items()}
        back = max(bg / total, 1e-4)
        sigma = max(math.sqrt(var / hit) if hit else sigma, bin_width)
    table = {}
    for r in rows:
        dens, b = parts(r["b"] * bin_width)
        u = max(dens, key=dens.get)
        table[r["b"]] = {"exponent": CANDIDATES[u], "posterior": dens[u] / (sum(dens.values()) + b)}
    return {"weights": w, "sigma": sigma, "background": back, "bin_width": bin_width, "table": table}


def assign_unit(distance: Column, fit: dict) -> Column:
    """struct(exponent, posterior) of the most likely unit by the fitted mixture; null without a distance in range.

    The posterior is looked up by bin, among the bins that occur."""
    table = F.from_json(F.lit(json.dumps(fit["table"])), "map<string,struct<exponent:int,posterior:double>>")
    return F.try_element_at(table, F.round(distance / fit["bin_width"]).cast("int").cast("string"))


def _finite_positive(c: Column) -> Column:
    return F.when((c > 0) & (c < F.lit(float("inf"))) & ~F.isnan(c), c)


def potencies(activities: DataFrame, sure: float = 0.9) -> DataFrame:
    """activity_id, value_m (molar), value_pm (rounded half up), origin (``value``/``log``/``comment``/``reference``/
    ``inferred``/``unsure``), unit_posterior, is_plain_nm. ``unsure`` rows keep a null value."""
    a = activities
    kind = F.lower(F.regexp_extract(strip(a["standard_type"]), _TYPE, 2))
    pre = F.lower(F.regexp_replace(F.regexp_extract(strip(a["standard_type"]), _TYPE, 1), r"\s", ""))
    rest = F.regexp_replace(F.regexp_extract(strip(a["standard_type"]), _TYPE, 3), r"^[\s_,;:(\[]+|[\s)\]]+$", "")
    t = a.select(
        "activity_id",
        a["standard_value"].cast("double").alias("v"),
        a["pchembl_value"].cast("double").alias("p"),
        _finite_positive(a["mol_weight"].cast("double")).alias("mw"),
        kind.alias("kind"),
        F.when(pre == "", 0).when(pre.rlike("^log"), 1).otherwise(-1).alias("log_sign"),
        unit_code(rest).alias("tu"),
        unit_code(a["standard_units"]).alias("su"),
        (strip(a["standard_units"]) == "nM").alias("nm"),
        F.when(a["standard_value"].isNull(), comment_potency(a["activity_comment"])).alias("c"),
    )
    # the texts are parsed once: the table is read for the fit and for the result
    t = cut(t, "activities").where("kind <> '' and tu is not null").withColumn("unit", F.when(F.col("tu") == NONE, F.col("su")).otherwise(F.col("tu")))
    t = t.withColumn(
        "sign",
        F.when(F.col("log_sign") != 0, F.col("log_sign")).when(F.col("unit") == NEGLOG, -1).when(F.col("unit") == LOG, 1).otherwise(0),
    )
    log_ok = F.col("unit").isin(NONE, LOG, NEGLOG, LOGUNIT, 0)
    unwritten = F.col("v").isNotNull() & (F.col("sign") == 0) & (F.col("unit") == NONE)
    t = t.withColumn("dist", F.when(unwritten, F.log10(_finite_positive(F.col("v"))) + F.col("p")))
    fit = fit_unit_mixture(t, "dist")
    t = t.withColumn("guess", assign_unit(F.col("dist"), fit)).withColumn("cu", unit_code(F.col("c.unit")))
    conc = lambda v, u: (
        F.when(F.abs(F.col(u)) < 500, _finite_positive(v) * F.pow(F.lit(10.0), F.col(u).cast("double")))
        .when(F.abs(F.col(u) - MASS) < 500, _finite_positive(v) * F.pow(F.lit(10.0), (F.col(u) - MASS).cast("double")) / F.col("mw"))
    )
    ten = lambda e: F.pow(F.lit(10.0), e)
    sure_guess = F.col("guess.posterior") >= sure
    from_value = (
        F.when((F.col("sign") != 0) & log_ok, ten(F.col("v") * F.col("sign")))
        .when(F.col("sign") != 0, F.lit(None))
        .when(F.col("unit") == NONE, F.when(sure_guess, F.col("v") * ten(F.col("guess.exponent").cast("double"))))
        .otherwise(conc(F.col("v"), "unit"))
    )
    from_comment = conc(F.col("c.value"), "cu")
    value = F.when(F.col("v").isNotNull(), from_value).otherwise(F.coalesce(from_comment, ten(-F.col("p"))))
    origin = (
        F.when(F.col("v").isNotNull() & (F.col("sign") != 0), "log")
        .when(unwritten, F.when(sure_guess, "inferred").otherwise("unsure"))
        .when(F.col("v").isNotNull(), "value")
        .when(from_comment.isNotNull(), "comment")
        .otherwise("reference")
    )
    pm = F.floor(_finite_positive(value * 1e12) * (1 + 1e-14) + 0.5)
    return t.select(
        "activity_id",
        value.alias("value_m"),
        pm.alias("value_pm"),
        origin.alias("origin"),
        F.when(unwritten, F.col("guess.posterior")).alias("unit_posterior"),
        (F.coalesce(F.col("nm"), F.lit(False)) & F.col("v").isNotNull() & (F.col("sign") == 0) & (F.col("tu") == NONE)).alias("is_plain_nm"),
    ).distinct()
