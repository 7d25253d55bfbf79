"""Quantities recorded in different units, brought to one unit per predicate.

The number comes from ``quantity.value`` or, when that is NULL, from ``quantity.verbatim``; the unit from
``unit_text``, ``verbatim``, ``context`` (``column_unit``, ``table_header``) or ``quote``: the first text in that order that is a unit
at all. Where no unit is stated anywhere, a log-scale mixture is fitted per predicate: one latent distribution of the canonical
value, with one component for each unit, offset by the unit's known conversion (zero points included). EM over stated and missing rows
together estimates the distribution and the weight of every unit. The posterior assigns the unit; assignments under ``CERTAIN``, and all
of a predicate of which no row states a unit, are flagged. Everything but the EM on bounded histograms runs in the JVM.

Defined results: NULL quantity, no number, a range, or a unit of another kind give status ``none`` and NULL
canonical columns. Exact replays of a claim collapse to one row; an empty table gives no rows; extra columns are
ignored. Very long quotes only pass through regular expressions anchored on short contexts.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlit.session import broadcast_counted, checkpoint

#: Posterior from which an inferred unit counts as certain.
CERTAIN = 0.9
#: Histogram resolution of the mixture, in bins per decade of the raw value.
BINS_PER_DECADE = 10

# Units by kind, as (spellings, factor to the kind's base unit).
LENGTH = [
    ("nm|nanometre|nanometres|nanometer|nanometers", 1e-9), ("um|micron|microns|micrometre|micrometer|micrometers", 1e-6),
    ("mm|millimetre|millimeter|millimeters", 1e-3), ("cm|centimetre|centimeter", 1e-2), ("m|metre|meter|metres|meters", 1.0),
    ("A|Å|angstrom|angstroms|ångström", 1e-10), ("km|kilometre|kilometer|kilometers|kilometres", 1e3),
    ("AU|au", 1.495978707e11), ("ly|lyr|light-year|light-years|light year|light years", 9.4607304725808e15),
    ("Mly|10^6 ly|million light-years|million light years", 9.4607304725808e21),
    ("pc|parsec|parsecs", 3.0856775814913673e16), ("kpc|Kpc|kiloparsec|kiloparsecs", 3.0856775814913673e19),
    ("Mpc|megaparsec|megaparsecs", 3.0856775814913673e22), ("Gpc|gigaparsec|gigaparsecs", 3.0856775814913673e25),
]
MASS = [
    ("ng|nanogram|nanograms", 1e-12), ("ug|mcg|microgram|micrograms", 1e-9), ("mg|mgs|milligram|milligrams", 1e-6),
    ("g|gm|gms|gram|grams", 1e-3), ("kg|kgs|kilogram|kilograms", 1.0), ("t|tonne|tonnes", 1e3),
    ("Msun|M_sun|Msol|solar mass|solar masses|$M_\\odot$|M_\\odot", 1.9884e30),
]
POWER = [
    ("erg/s|ergs/sec|ergs/s|erg s^-1|erg s-1", 1e-7), ("W|watt|watts", 1.0), ("kW|kilowatt|kilowatts", 1e3),
    ("Lsun|L_sun|Lsol|solar luminosity|solar luminosities|$L_\\odot$|L_\\odot", 3.828e26),
]
SPEED = [
    ("cm/s|cm s^-1|cm/sec", 1e-2), ("m/s|m s^-1|m/sec|m s-1|ms-1", 1.0), ("km/h|kph|km/hr|kmh", 1 / 3.6),
    ("km/s|km/sec|km s^-1|km s-1|kms-1|kms^-1", 1e3),
]
ANGLE = [
    ("mas|milliarcsec|milliarcsecond|milliarcseconds", 1e-3), ("arcsec|asec|arcsecs|arcsecond|arcseconds|″|\"|''", 1.0),
    ("arcmin|amin|arcmins|arcminute|arcminutes|′|'", 60.0), ("°|deg|degs|degree|degrees", 3600.0), ("rad|radian|radians", 648000 / math.pi),
]
TIME = [
    ("s|sec|second|seconds", 1.0), ("h|hr|hour|hours", 3600.0), ("d|day|days", 86400.0), ("a|yr|yrs|year|years", 3.15576e7),
    ("kyr|ka|thousand years", 3.15576e10), ("Myr|Ma|million years", 3.15576e13), ("Gyr|Ga|billion years", 3.15576e16),
]
FLUX_DENSITY = [
    ("uJy|microjansky", 1e-3), ("mJy|millijansky|millijanskys", 1.0), ("Jy|jansky|janskys", 1e3),
    ("W m^-2 Hz^-1|W m-2 Hz-1|W/m^2/Hz", 1e29),
]
PRESSURE = [
    ("Pa|pascal|pascals", 1.0), ("hPa|hectopascal|mbar|millibar", 100.0), ("kPa|kilopascal|kilopascals", 1e3), ("MPa|megapascal", 1e6),
    ("bar|bars", 1e5), ("atm|atmosphere|atmospheres", 101325.0), ("psi", 6894.757293168), ("mmHg|mm Hg|Torr|torr", 133.322368421),
]
FRACTION = [
    ("1|dimensionless|unity", 1.0), ("%|percent|per cent|wt%|pct", 1e-2), ("‰|per mille|permille|permil", 1e-3), ("ppm", 1e-6), ("ppb", 1e-9),
]
TEMPERATURE = [
    ("K|kelvin|kelvins", 1.0, 0.0), ("mK", 1e-3, 0.0), ("kK", 1e3, 0.0), ("°C|℃|deg C|celsius|degC", 1.0, 273.15),
    ("°F|℉|deg F|fahrenheit|degF", 5 / 9, 459.67 * 5 / 9),
]
KINDS = {
    "length": LENGTH, "mass": MASS, "power": POWER, "speed": SPEED, "angle": ANGLE, "time": TIME,
    "flux_density": FLUX_DENSITY, "pressure": PRESSURE, "fraction": FRACTION, "temperature": TEMPERATURE,
}

#: One number, with an exponent in any of the usual spellings.
NUMBER = r"[-+−]?\d[\d,]*(?:\.\d+)?(?:[eE][-+−]?\d+|\s*[x×·*]\s*10\s*\^?\s*[-+−⁻⁺]?[\d⁰¹²³⁴⁵⁶⁷⁸⁹]+)?"
MISSING_UNIT = ("", "n/a", "na", "none", "-", "—", "unknown", "?")


def unit_rows() -> list[tuple[str, str, str, float, float]]:
    """(kind, spelling, first spelling of the unit, factor, offset) of every known spelling."""
    out = []
    for kind, units in KINDS.items():
        for spelled, factor, *offset in units:
            names = spelled.split("|")
            out += [(kind, n, names[0], float(factor), float(offset[0] if offset else 0.0)) for n in names]
    return out


def fold_unit(c: Column) -> Column:
    """One spelling of a unit's characters: signs, superscripts, micro signs, sun signs, brackets, final stop."""
    c = F.translate(F.coalesce(c, F.lit("")), "−⁻⁺⁰¹²³⁴⁵⁶⁷⁸⁹µμÅ   ", "--+0123456789uuÅ   ")
    c = F.regexp_replace(c, "[⊙☉]", "sun")
    c = F.trim(F.regexp_replace(c, r"\s+", " "))
    c = F.trim(F.regexp_replace(c, r"^[\[(]\s*(.*?)\s*[\])]$", "$1"))
    return F.regexp_replace(c, r"(?<=[A-Za-z])\.$", "")


def fold_number(c: Column) -> Column:
    """A number's text as DOUBLE, or NULL: a comma before groups of three digits separates thousands, any other is decimal."""
    s = F.translate(c, "−⁻⁺⁰¹²³⁴⁵⁶⁷⁸⁹  ", "--+0123456789")
    s = F.regexp_replace(s, r"[x×·*]10\^?", "e")
    s = F.when(s.rlike(r"^[-+]?[1-9]\d{0,2}(,\d{3})+(?!\d)"), F.regexp_replace(s, ",", "")).otherwise(F.regexp_replace(s, ",", "."))
    return F.when(s.rlike(r"^[-+]?\d+(\.\d+)?([eE][-+]?\d+)?$"), s).cast("double")


def scale_of(note: Column) -> tuple[Column, Column]:
    """(factor, whether logarithmic) of a scale note; the factor is 1 for an empty note."""
    n = F.trim(F.lower(F.translate(F.coalesce(note, F.lit("")), "−⁻⁰¹²³⁴⁵⁶⁷⁸⁹", "--0123456789")))
    power = F.regexp_extract(n, r"10\s*\^?\s*([-+]?\d+)\s*$", 1)
    e_power = F.regexp_extract(n, r"^1e([-+]?\d+)$", 1)
    word = F.when(n.rlike("thousand"), 1e3).when(n.rlike("million"), 1e6).when(n.rlike("billion"), 1e9)
    factor = F.coalesce(
        word,
        F.when(e_power != "", F.pow(F.lit(10.0), e_power.cast("double"))),
        F.when((power != "") & ~n.rlike("^log"), F.pow(F.lit(10.0), power.cast("double"))),
        F.lit(1.0),
    )
    return factor, n.rlike("^(log|dex)")


def read_quantities(claims: DataFrame) -> DataFrame:
    """claim_id, predicate, the stored canonical columns, number ``x``, ``is_log``, ``is_range`` and unit texts in order of trust."""
    q, verb = F.col("quantity"), F.col("verb")
    base = claims.where((F.col("kind") == "measurement") & q.isNotNull()).select(
        "claim_id", "predicate", "canonical_value", "canonical_unit", F.coalesce(F.col("quote"), F.lit("")).alias("quote"), "context",
        F.trim(F.translate(F.coalesce(q["verbatim"], F.lit("")), "   ", "   ")).alias("verb"),
        q["value"].alias("value"), q["unit_text"].alias("unit_text"), q["scale_note"].alias("scale_note"),
        F.coalesce(q["uncertainty_kind"], F.lit("")).alias("uncertainty_kind"),
    )
    log_form = r"^\s*log(?:10)?\s*\(\s*(?:[^()/]*/)?\s*(.*?)\s*\)\s*=\s*(" + NUMBER + r")\s*$"
    hedge = r"^(?:about|approximately|approx\.?|roughly|around|ca\.?|circa|[~<>≤≥=≲≳≈])\s*"
    body = F.regexp_replace(F.regexp_replace(verb, hedge, ""), r"\s+in total$", "")
    factor, noted_log = scale_of(F.col("scale_note"))
    log_number = F.regexp_extract(verb, log_form, 2)
    tail = F.regexp_replace(body, "^" + NUMBER + r"\s*(?:\(?\s*±\s*" + NUMBER + r"\s*\)?)?\s*", "")
    plain = base.withColumns(
        {
            "is_range": (F.col("uncertainty_kind") == "range") | body.rlike("^" + NUMBER + r"\s*(?:–|—|to|\.\.)\s*" + NUMBER),
            "log_unit": F.when(log_number != "", F.regexp_extract(verb, log_form, 1)),
            "v_number": F.when(log_number != "", log_number).otherwise(F.regexp_extract(body, "^(" + NUMBER + ")", 1)),
            "v_unit": F.when(body.rlike(r"^[-+−]?\d"), F.trim(tail)),
            "million_ly": body.rlike(r"10\^6 ly$"),
            "factor": factor,
            "is_log": noted_log | (log_number != ""),
        }
    )
    # "65.510^6 ly": the unit begins with a number, so it is cut off the end first.
    glued = F.regexp_extract(F.regexp_replace(body, r"\s*10\^6 ly$", ""), "^(" + NUMBER + ")", 1)
    plain = plain.withColumn("v_number", F.when(F.col("million_ly"), glued).otherwise(F.col("v_number"))).withColumn(
        "v_unit", F.when(F.col("million_ly"), F.lit("10^6 ly")).otherwise(F.col("v_unit"))
    )
    x = F.coalesce(F.when(~F.isnan("value"), F.col("value")), fold_number(F.col("v_number")))
    quote_unit = F.coalesce(
        *[
            F.nullif(F.regexp_extract("quote", p, 1), F.lit(""))
            for p in (
                r"\[unit:\s*([^\]]+)\]", r"\(([^()]+);\s*see the header", r"[Aa]ll values are (?:given|quoted|listed) in (.+?)\.?\s*$",
                r"the unit is (.+?)\.?\s*$", r"(?:in units of|units?:)\s*([^\s,;.]+)",
            )
        ]
    )
    header = F.regexp_extract(F.try_element_at("context", F.lit("table_header")), r"\[([^\]]+)\]\s*$", 1)
    texts = F.array(
        F.col("unit_text"), F.col("log_unit"), F.col("v_unit"), F.try_element_at("context", F.lit("column_unit")), header, quote_unit
    )
    units = F.filter(F.transform(texts, fold_unit), lambda u: ~F.lower(u).isin(*MISSING_UNIT))
    return plain.select(
        "claim_id", "predicate", "canonical_value", "canonical_unit", "is_range", "is_log",
        F.when(~F.col("is_range"), F.when(F.col("is_log"), F.pow(F.lit(10.0), x)).otherwise(x * F.col("factor"))).alias("x"),
        units.alias("units"),
    )


def unit_table(measures: DataFrame) -> DataFrame:
    """predicate x spelling -> factor and offset into the predicate's canonical unit. Fixed size: spellings known here times measures."""
    spark = measures.sparkSession
    units = spark.createDataFrame(unit_rows(), "quantity_kind string, spelling string, unit string, f double, o double")
    canon = units.select("quantity_kind", F.col("spelling").alias("canonical"), F.col("f").alias("cf"), F.col("o").alias("co"))
    m = measures.select("predicate", "quantity_kind", F.col("canonical_unit").alias("target"), fold_unit(F.col("canonical_unit")).alias("canonical"))
    m = m.dropDuplicates(["predicate"]).join(F.broadcast(canon), ["quantity_kind", "canonical"])
    return m.join(F.broadcast(units), "quantity_kind").select(
        "predicate", "target", "spelling", "unit", (F.col("f") / F.col("cf")).alias("mul"), ((F.col("o") - F.col("co")) / F.col("cf")).alias("add")
    )


def fit_mixture(stated: list[tuple], missing: list[tuple], units: list[tuple], rounds: int = 200) -> list[tuple]:
    """EM on histograms of log10 values. stated: (predicate, unit, bin, n) of canonical values; missing: (predicate, bin, n) of raw ones;
    units: (predicate, unit, mul, add). Returns (predicate, unit, weight, mean, deviation, anchored) rows.

    Each predicate's canonical log10 value is a normal distribution. A stated row shows it directly; a row without a unit shows it through one
    of the units' conversions, with the unit's weight. Both kinds estimate mean, deviation and weights. Without stated rows it begins at the raw
    values taken in the canonical unit and is not ``anchored``. Bins bound the input whatever the row count.
    """
    out = []
    for p in sorted({u[0] for u in units}):
        own = sorted({(u[1], u[2], u[3]) for u in units if u[0] == p})
        xs, ns = (np.array([a[i] for a in [((b + 0.5) / BINS_PER_DECADE, n) for q, _, b, n in stated if q == p and b is not None]], float) for i in (0, 1))
        y, k = (np.array([a[i] for a in [((b + 0.5) / BINS_PER_DECADE, n) for q, b, n in missing if q == p and b is not None]], float) for i in (0, 1))
        if not len(xs) and not len(y):
            continue
        seen, weight = (xs, ns) if len(xs) else (y, k)
        order = np.argsort(seen)
        cut = np.interp([0.25, 0.5, 0.75], np.cumsum(weight[order]) / weight.sum(), seen[order])
        mu, sd = float(cut[1]), max(0.05, float(cut[2] - cut[0]) / 1.349)
        named = np.array([sum(n for q, u, _, n in stated if q == p and u == name) for name, _, _ in own], float)
        prior = (named + 1) / (named + 1).sum()
        w = prior
        # Canonical value of every bin under every unit, and how the conversion stretches the scale there.
        mul, add = (np.array([u[i] for u in own]) for i in (1, 2))
        raw = 10.0 ** y[:, None] * mul
        value = raw + add
        with np.errstate(divide="ignore", invalid="ignore"):
            z = np.where(value > 0, np.log10(np.maximum(value, 1e-300)), -1e3)
            stretch = np.where(value > 0, raw / np.maximum(value, 1e-300), 0.0)
        for _ in range(rounds if len(y) else 0):
            like = w * stretch * np.exp(-0.5 * np.minimum(((z - mu) / sd) ** 2, 1400)) + 1e-300
            post = like / like.sum(1, keepdims=True) * k[:, None]
            new = prior * 20 + post.sum(0)
            new /= new.sum()
            sure = np.where(z > -900, post, 0.0)
            total = ns.sum() + sure.sum()
            mean = ((xs * ns).sum() + (np.where(z > -900, z, 0.0) * sure).sum()) / total
            var = ((xs - mean) ** 2 * ns).sum() + (np.where(z > -900, (z - mean) ** 2, 0.0) * sure).sum()
            moved = max(np.abs(new - w).max(), abs(mean - mu))
            w, mu, sd = new, float(mean), max(0.05, float((var / total) ** 0.5))
            if moved < 1e-6:
                break
        out += [(p, name, float(a), mu, sd, bool(len(xs))) for (name, _, _), a in zip(own, w)]
    return out


def canonicalize(claims: DataFrame, measures: DataFrame) -> DataFrame:
    """One row per distinct measurement claim: canonical_unit, canonical_value, status (stated, inferred, uncertain, none), posterior,
    and the stored columns as ``stored_value`` and ``stored_unit``."""
    spark = claims.sparkSession
    table = unit_table(measures)
    # Replays collapse before anything is joined; the checkpoint keeps the parsed numbers, which three passes read.
    parsed = read_quantities(claims)
    read = checkpoint(parsed.groupBy("claim_id").agg(F.min(F.struct(*[c for c in parsed.columns if c != "claim_id"])).alias("r")).select("claim_id", "r.*"))
    # The first unit text that is a unit at all decides; a known unit of another kind means the claim states no unit of its kind.
    lookup = table.groupBy("predicate").agg(
        F.first("target").alias("target"),
        F.map_from_entries(F.collect_list(F.struct("spelling", F.struct("unit", "mul", "add")))).alias("known"),
    )
    joined = read.join(broadcast_counted(lookup), "predicate", "left")
    spellings = F.array(*[F.lit(x) for x in sorted({r[1] for r in unit_rows()})])
    first = F.coalesce(F.get(F.filter("units", lambda u: F.array_contains(spellings, u)), F.lit(0)), F.get(F.col("units"), F.lit(0)))
    hit = F.try_element_at("known", first)
    rows = joined.select(
        "claim_id", "predicate", "target", "x", F.col("canonical_value").alias("stored_value"), F.col("canonical_unit").alias("stored_unit"),
        (F.size("units") > 0).alias("has_unit"), hit.alias("u"),
    ).select("*", (F.col("x") * F.col("u.mul") + F.col("u.add")).alias("stated_value"))

    bin_of = lambda c: F.floor(F.log10(c) * BINS_PER_DECADE).cast("int")
    stated = rows.where((F.col("stated_value") > 0) & F.col("u").isNotNull())
    # Bounded by predicates x units x bins: the logarithm of a DOUBLE spans some 630 decades.
    s_rows = [tuple(r) for r in stated.groupBy("predicate", F.col("u.unit").alias("unit"), bin_of(F.col("stated_value")).alias("b")).count().collect()]
    m_rows = [tuple(r) for r in rows.where(~F.col("has_unit") & (F.col("x") > 0)).groupBy("predicate", bin_of(F.col("x")).alias("b")).count().collect()]
    u_rows = [tuple(r) for r in table.select("predicate", "unit", "mul", "add").distinct().collect()]
    fitted = fit_mixture(s_rows, m_rows, u_rows)
    factors = {(p, u): (mul, add) for p, u, mul, add in u_rows}
    model = spark.createDataFrame(
        [(p, [(u, w, mu, sd, sure, *factors[p, u]) for q, u, w, mu, sd, sure in fitted if q == p]) for p in sorted({f[0] for f in fitted})],
        "predicate string, parts array<struct<unit string, w double, mu double, sd double, sure boolean, mul double, add double>>",
    )

    def likelihood(c: Column) -> Column:
        raw = F.col("x") * c["mul"]
        value = raw + c["add"]
        distance = F.least(F.pow((F.log10(value) - c["mu"]) / c["sd"], F.lit(2.0)), F.lit(1400.0))
        return F.when(value > 0, c["w"] * raw / value * F.exp(-0.5 * distance)).otherwise(0.0)

    like = F.transform("parts", lambda c: F.struct(likelihood(c).alias("l"), c["mul"].alias("mul"), c["add"].alias("add"), c["sure"].alias("sure")))
    total = F.aggregate("like", F.lit(0.0), lambda a, c: a + c["l"])
    guess = rows.join(broadcast_counted(model), "predicate", "left").withColumn(
        "like", F.when(~F.col("has_unit") & (F.col("x") > 0), like)
    ).withColumn("best", F.array_max("like")).withColumn("posterior", F.when(total > 0, F.col("best.l") / total))
    inferred = F.col("posterior").isNotNull()
    value = F.coalesce("stated_value", F.when(inferred, F.col("x") * F.col("best.mul") + F.col("best.add")))
    status = (
        F.when(F.col("stated_value").isNotNull(), "stated").when(inferred & (F.col("posterior") >= CERTAIN) & F.col("best.sure"), "inferred")
        .when(inferred, "uncertain").otherwise("none")
    )
    return guess.select(
        "claim_id", "predicate", F.when(value.isNotNull(), F.col("target")).alias("canonical_unit"), value.alias("canonical_value"),
        status.alias("status"), F.when(F.col("stated_value").isNotNull(), F.lit(1.0)).otherwise(F.col("posterior")).alias("posterior"),
        "stored_value", "stored_unit",
    )


def inferred(canonical: DataFrame) -> DataFrame:
    """Claims that state a number and no unit, with the unit the mixture gives them and how sure it is."""
    return canonical.where(F.col("status").isin("inferred", "uncertain")).select("claim_id", "canonical_unit", "canonical_value", "posterior", "status")


def wrong_or_missing(canonical: DataFrame) -> DataFrame:
    """Stated claims whose stored canonical columns are NULL, name another unit, or are off by more than 1 %; value as C ``%.2e``."""
    off = F.abs(F.col("stored_value") - F.col("canonical_value")) > 0.01 * F.abs(F.col("canonical_value"))
    bad = F.col("stored_value").isNull() | F.isnan("stored_value") | F.col("stored_unit").isNull() | (F.col("stored_unit") != F.col("canonical_unit")) | off
    return canonical.where((F.col("status") == "stated") & bad).select(
        "claim_id", "canonical_unit", F.format_string("%.2e", F.col("canonical_value")).alias("canonical_value")
    )
