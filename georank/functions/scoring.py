"""Column builders of the evidence model: cleaning, scores, bands, reasons, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Evidence fields that count for a candidate, in weight order, and those that count against it.
POSITIVES = ("optical_anomaly", "sar_anomaly", "microrelief", "enclosure_shape", "linearity", "temporal_persistence", "historical_match", "contextual_fit")
NEGATIVES = ("modern_disturbance", "natural_confounder_risk")
EVIDENCE = (*POSITIVES, *NEGATIVES, "data_quality")
LANDSCAPES = ("steppe", "valley", "mountain", "forest")
SENSITIVITIES = ("normal", "restricted", "sensitive")

#: Fixed values: (field, least value, text) of the explanations in output order, and that of a low score.
REASONS = (
    ("microrelief", 0.7, "microrelief signal is strong"),
    ("enclosure_shape", 0.7, "regular enclosure-like geometry detected"),
    ("linearity", 0.7, "structured linear pattern detected"),
    ("temporal_persistence", 0.7, "signal persists across multiple observations"),
    ("historical_match", 0.7, "anomaly is supported by historical imagery"),
    ("contextual_fit", 0.7, "location fits plausible landscape context"),
    ("modern_disturbance", 0.6, "modern disturbance may be creating a false positive"),
    ("natural_confounder_risk", 0.6, "natural landform risk is high"),
)
LOW_SCORE = (0.35, "candidate kept for review only, not field action")
METRES_PER_DEGREE = 111_320.0


def clamp01(x: Column) -> Column:
    """x limited to [0, 1]; NaN gives 1, null stays null."""
    return F.when(x.isNull(), x).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


_DIGITS = "[0-9]+(?:_[0-9]+)*"
_NUMBER = f"^[+-]?(?:(?:{_DIGITS}\\.?(?:{_DIGITS})?|\\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?|(?i:inf|infinity|nan))$"


def evidence(raw: Column, default: float = 0.0, is_boolean: Column | None = None) -> Column:
    """A raw value as text to a number in [0, 1]; unparsable and null count as the default.

    Digits may be grouped by underscores; inf and nan are numbers. A JSON boolean (is_boolean) counts as 1 or 0; the text
    "true" is no number.
    """
    text = F.trim(raw.cast("string"))
    number = F.when(text.rlike(_NUMBER), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))
    if is_boolean is not None:
        number = F.when(is_boolean, F.when(text == "true", 1.0).otherwise(0.0)).otherwise(number)
    return clamp01(F.coalesce(number, F.lit(default)))


def normalize_landscape(x: Column) -> Column:
    return F.when(x.isin(*LANDSCAPES), x).otherwise("unknown")


def normalize_sensitivity(x: Column, strict: bool = False) -> Column:
    """Unknown levels count as normal; with strict as sensitive."""
    return F.when(x.isin(*SENSITIVITIES), x).otherwise("sensitive" if strict else "normal")


def weighted_score(weights: list[Column]) -> Column:
    """Weighted mean of the positive evidence; 0 where the weights sum to 0."""
    top, total = F.lit(0.0), F.lit(0.0)
    for name, w in zip(POSITIVES, weights):
        top = top + F.col(name) * w
        total = total + w
    return F.when(total == 0, F.lit(0.0)).otherwise(F.try_divide(top, total))


def penalty(strength: float) -> Column:
    return F.lit(strength) * (F.lit(0.6) * F.col("modern_disturbance") + F.lit(0.4) * F.col("natural_confounder_risk"))


def uncertainty(strength: float) -> Column:
    rough = F.when(F.col("landscape").isin("mountain", "forest", "unknown"), 0.15).otherwise(0.0)
    return F.lit(strength) * F.least(F.lit(1.0), (F.lit(1.0) - F.col("data_quality")) + F.lit(0.5) * F.col("natural_confounder_risk") + rough)


def confidence_band(score: Column) -> Column:
    return F.when(score >= 0.75, "high").when(score >= 0.5, "medium").when(score >= 0.25, "low").otherwise("very-low")


def band_color(band: Column) -> Column:
    """Map colour of a band."""
    return F.when(band == "high", "darkred").when(band == "medium", "orange").when(band == "low", "blue").otherwise("gray")


def reasons(score: Column, notes: Column) -> Column:
    """Explanations in fixed order, then the row's notes."""
    found = [F.when(F.col(name) >= least, text) for name, least, text in REASONS] + [F.when(score < LOW_SCORE[0], LOW_SCORE[1])]
    return F.concat(F.filter(F.array(*found), lambda x: x.isNotNull()), F.coalesce(notes, F.array().cast("array<string>")))


def shift(lat: Column, lon: Column, metres: float) -> Column:
    """The location moved by metres north and west. A fixed shift can be undone: it hides, it doesn't anonymize."""
    east = F.lit(METRES_PER_DEGREE) * F.greatest(F.cos(F.radians(lat)), F.lit(0.1))
    return F.struct((lat + F.lit(metres / METRES_PER_DEGREE)).alias("lat"), (lon - F.lit(metres) / east).alias("lon"))


def snap(lat: Column, lon: Column, metres: float) -> Column:
    """The centre of the location's cell on a grid of about ``metres``, which can't be undone."""
    step = metres / METRES_PER_DEGREE
    return F.struct(((F.floor(lat / step) + 0.5) * step).alias("lat"), ((F.floor(lon / step) + 0.5) * step).alias("lon"))


def locations(mode: str, lat: Column, lon: Column, restricted_m: float = 1000.0, public_m: float = 5000.0, redaction: str = "shift") -> tuple[Column, Column]:
    """(exact, public) for a permit mode; exact is null unless authorized."""
    exact = F.struct(lat.alias("lat"), lon.alias("lon"))
    if mode == "authorized":
        return exact, exact
    hide = {"shift": shift, "snap": snap}[redaction]
    return F.lit(None).cast("struct<lat:double,lon:double>"), hide(lat, lon, restricted_m if mode == "restricted" else public_m)


def context_fit(slope_median: Column, water: Column, risk: Column) -> Column:
    slope = clamp01(F.lit(1.0) - F.greatest(slope_median - 6.0, F.lit(0.0)) / 18.0)
    return clamp01(0.45 * slope + 0.35 * F.coalesce(water, F.lit(0.5)) + 0.20 * (1.0 - risk))


def natural_risk(ruggedness: Column, confounder: Column) -> Column:
    return F.coalesce(clamp01(0.5 * ruggedness + 0.5 * confounder), ruggedness)


def infer_landscape(forest: Column, slope_p90: Column, rugged: Column, water: Column, slope_median: Column) -> Column:
    return (
        F.when(forest >= 0.5, "forest").when((slope_p90 >= 18) | (rugged >= 0.65), "mountain")
        .when((water >= 0.6) & (slope_median <= 10), "valley").when(slope_median <= 8, "steppe").otherwise("unknown")
    )
