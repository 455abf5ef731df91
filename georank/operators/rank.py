"""Withhold, score, redact, explain and sort candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from georank.functions import scoring
from georank.operators.zones import outside_all
from georank.settings import Settings

MODES = ("public", "restricted", "authorized")


def weights_table(df: DataFrame, settings: Settings) -> DataFrame:
    """The landscape weights as a table of a few rows: landscape, w0 to w7."""
    rows = [F.struct(F.lit(k).alias("landscape"), *[F.lit(float(w)).alias(f"w{i}") for i, w in enumerate(ws)]) for k, ws in settings.weights.items()]
    return df.sparkSession.range(1).select(F.explode(F.array(*rows)).alias("w")).select("w.*")


def withhold(mode: str, in_zone: Column, settings: Settings) -> Column:
    """Whether a row is kept back: in a red zone that the mode has no access to, or sensitive without authorization."""
    g = settings.guardrails
    blocked = g.block_in_red_zones and (g.red_zone_access == "block" or g.red_zone_access == "authorized-only" and mode != "authorized")
    by_zone = in_zone if blocked else F.lit(False)
    by_level = F.coalesce(F.col("sensitivity") == "sensitive", F.lit(False)) if g.withhold_sensitive and mode != "authorized" else F.lit(False)
    return by_zone | by_level


def score(df: DataFrame, settings: Settings | None = None) -> DataFrame:
    """df with raw, penalty, uncertainty and adjusted (unrounded). Unknown landscapes take the steppe weights."""
    settings = settings or Settings()
    steppe = settings.weights["steppe"]  # a KeyError without it is intended
    joined = df.join(F.broadcast(weights_table(df, settings)), "landscape", "left")
    weights = [F.coalesce(F.col(f"w{i}"), F.lit(float(w))) for i, w in enumerate(steppe)]
    out = joined.withColumn("raw", scoring.weighted_score(weights)).drop(*[f"w{i}" for i in range(len(steppe))])
    out = out.withColumn("penalty", scoring.penalty(settings.scoring.penalty_strength))
    out = out.withColumn("uncertainty", scoring.uncertainty(settings.scoring.uncertainty_strength))
    return out.withColumn("adjusted", scoring.clamp01(F.col("raw") - F.col("penalty") - F.col("uncertainty")))


def drop_withheld(df: DataFrame, mode: str, zones: DataFrame | None, settings: Settings) -> DataFrame:
    """df without the rows that the guardrails keep back; zones is a table of boxes or polygons, matched by an anti join."""
    kept = df.where(~withhold(mode, F.lit(False), settings))
    blocked = settings.guardrails.block_in_red_zones and (
        settings.guardrails.red_zone_access == "block" or settings.guardrails.red_zone_access == "authorized-only" and mode != "authorized"
    )
    if zones is None or not blocked:
        return kept
    return outside_all(kept, zones)


def rank(df: DataFrame, mode: str = "public", zones: DataFrame | None = None, settings: Settings | None = None, redaction: str = "shift") -> DataFrame:
    """Ranked rows: withheld ones gone, scores to 4 places, band of the unrounded score, reasons, locations by mode."""
    if mode not in MODES:
        raise ValueError(f"unknown permit mode {mode!r}")
    settings = settings or Settings()
    out = score(drop_withheld(df, mode, zones, settings), settings)
    g = settings.guardrails
    exact, public = scoring.locations(mode, F.col("lat"), F.col("lon"), g.restricted_blur_m, g.public_blur_m, redaction)
    carried = [c for c in ("tags", "source_dates") if c in df.columns]
    return out.select(
        "seq", "candidate_id", F.round("raw", 4).alias("raw_score"), F.round("adjusted", 4).alias("adjusted_score"), scoring.confidence_band(F.col("adjusted")).alias("confidence"),
        scoring.reasons(F.col("adjusted"), F.col("notes") if "notes" in df.columns else F.array().cast("array<string>")).alias("reasons"),
        "landscape", "sensitivity", exact.alias("exact_location"), public.alias("public_location"), *carried,
    )


def ordered(ranked: DataFrame) -> DataFrame:
    """Highest rounded score first, ties in input order."""
    return ranked.orderBy(F.desc("adjusted_score"), "seq")


def top(ranked: DataFrame, k: int, min_score: float = 0.0) -> DataFrame:
    """The k best rows whose rounded score reaches min_score; planned as one top-k, not a full sort."""
    if k < 0:
        raise ValueError("k must not be negative")
    return ordered(ranked.where(F.col("adjusted_score") >= min_score)).limit(k)
