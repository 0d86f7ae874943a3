"""Bands, codes and labels as CASE expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels and weights that reports must show unchanged.
UNKNOWN = "Inconnu"
RAIN_LABELS = ("Temps Sec (0 mm)", "Pluie Léger (0-5 mm)", "Pluie Forte (>5 mm)")
TRAFFIC_LABELS = ("Trafic Fluide (Faible)", "Trafic Modéré", "Trafic Dense / Saturé")
SEVERITY_LABELS = {1: "Indemne", 2: "Tué", 3: "Blessé Hospitalisé", 4: "Blessé Léger"}
CLASS_LABELS = ("Grave / Décès", "Léger / Indemne", "Autre")
WEEKDAYS = {0: "Lundi", 1: "Mardi", 2: "Mercredi", 3: "Jeudi", 4: "Vendredi",
            5: "Samedi", 6: "Dimanche"}
MONTHS = {1: "Janvier", 2: "Février", 3: "Mars", 4: "Avril", 5: "Mai", 6: "Juin",
          7: "Juillet", 8: "Août", 9: "Septembre", 10: "Octobre", 11: "Novembre",
          12: "Décembre"}
SEASONS = ("Hiver", "Printemps", "Été", "Automne")
KILLED, HOSPITALISED, SLIGHT, UNHURT = 2, 3, 4, 1
WEIGHTS_YEARLY = {1: 0, 2: 3, 3: 2, 4: 1}
WEIGHTS_ZONES = {1: 0, 2: 4, 3: 2, 4: 1}


def coded(col: Column, table: Mapping, otherwise=None) -> Column:
    """Small code table as a CASE expression."""
    expr = None
    for code, label in table.items():
        expr = F.when(col == code, label) if expr is None else expr.when(col == code, label)
    return expr if otherwise is None else expr.otherwise(otherwise)


def rain_band(mm: Column) -> Column:
    dry, light, heavy = RAIN_LABELS
    return (F.when(mm == 0, dry).when((mm > 0) & (mm <= 5), light)
            .when(mm > 5, heavy).otherwise(UNKNOWN))


def banded(col: Column, low, high, labels: Sequence[str], low_closed: bool) -> Column:
    """Three bands split at low and high; NULL is unknown.

    `low_closed` puts values equal to `low` into the first band.
    """
    first = col <= low if low_closed else col < low
    return (F.when(col.isNull(), UNKNOWN).when(first, labels[0])
            .when(col <= high, labels[1]).otherwise(labels[2]))


def traffic_band(q: Column) -> Column:
    """Fixed bands: below 500, 500 to 1500, above 1500 vehicles per hour."""
    return banded(q, 500, 1500, TRAFFIC_LABELS, low_closed=False)


def severity_label(grav: Column) -> Column:
    return coded(grav, SEVERITY_LABELS, UNKNOWN)


def severity_class(grav: Column) -> Column:
    severe, light, other = CLASS_LABELS
    return F.when(grav.isin(2, 3), severe).when(grav.isin(1, 4), light).otherwise(other)


def is_severe(grav: Column) -> Column:
    return F.coalesce(grav.isin(KILLED, HOSPITALISED), F.lit(False))


def dark(lum: Column) -> Column:
    return F.when(lum.isin(2, 3, 4, 5), 1).otherwise(0)


def season(month: Column, names: Sequence[str] = SEASONS) -> Column:
    """Season name of a month; NULL month gives NULL."""
    return F.when(month.isNotNull(), F.element_at(
        F.array(*[F.lit(n) for n in names]),
        (F.floor((month % 12) / F.lit(3)) + 1).cast("int")))


def threshold_label(value: Column, steps: Sequence[tuple[float, str]], lowest: str) -> Column:
    """First label whose threshold the value reaches, scanning downwards."""
    expr = None
    for limit, label in steps:
        hit = value >= limit
        expr = F.when(hit, label) if expr is None else expr.when(hit, label)
    return F.when(value.isNotNull(), expr.otherwise(lowest))


# Thresholds of the ordinal labels.
CORRELATION_STEPS = ((0.7, "très forte"), (0.5, "forte"), (0.3, "modérée"), (0.15, "faible"))
PAIR_STEPS = ((0.5, "FORTE"), (0.3, "MOYENNE"))
VIF_STEPS = ((10.0, "PROBLEME"), (5.0, "ATTENTION"))


def imbalance_label(ratio: Column) -> Column:
    return (F.when(ratio < 0.2, "important").when(ratio < 0.4, "modéré")
            .when(ratio.isNotNull(), "équilibré"))


def stars(p: Column) -> Column:
    return (F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*")
            .when(p.isNotNull(), "ns"))
