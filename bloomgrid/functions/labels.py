"""Texts and classes shown for plants, stations, zones and months."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bloomgrid.functions.values import text_or_null

# Texts and thresholds that results must carry literally.
PHASE_LABELS = {
    "before": "Przed kwitnieniem",
    "blooming": "Kwitnie",
    "after": "Po kwitnieniu",
}
FRAME_LABELS = (
    "1. Przed kwitnieniem (Uśpienie)",
    "2. Kwitnienie",
    "3. Po kwitnieniu (Przekwitanie)",
)
ANNUAL_LABELS = ("Przed kwitnieniem", "W okresie kwitnienia", "Po kwitnieniu")
THRESHOLD_LABELS = ("Próg kwitnienia od", "Próg kwitnienia do")
MONTH_LABELS = (
    "Sty", "Lut", "Mar", "Kwi", "Maj", "Cze",
    "Lip", "Sie", "Wrz", "Paź", "Lis", "Gru",
)
NO_VALUE = "—"
DEFAULT_GDD_MIN = 100.0
DEFAULT_GDD_MAX = 200.0
DEFAULT_BASE_TEMP = 5.0


def _by_threshold(total: Column, low: Column, high: Column, texts: tuple[str, str, str]) -> Column:
    return F.when(total < low, texts[0]).when(total <= high, texts[1]).otherwise(texts[2])


def bloom_phase(total: Column, low: Column, high: Column) -> Column:
    """before / blooming / after; a missing total is `after`, as any failed comparison is."""
    return _by_threshold(total, low, high, ("before", "blooming", "after"))


def frame_label(total: Column, low: Column, high: Column) -> Column:
    """Long phase text of the animated map."""
    return _by_threshold(total, low, high, FRAME_LABELS)


def phase_label(phase: Column) -> Column:
    """Display text of a phase; an unknown phase is shown as it is."""
    texts = F.create_map(*[F.lit(part) for pair in PHASE_LABELS.items() for part in pair])
    return F.coalesce(F.try_element_at(texts, phase), phase)


def annual_status(gdd_max: Column, low: Column, high: Column) -> Column:
    return F.when(gdd_max.isNull(), NO_VALUE).otherwise(
        _by_threshold(gdd_max, low, high, ANNUAL_LABELS)
    )


def bloom_day_text(bloom_day: Column) -> Column:
    return F.when(bloom_day > 0, bloom_day.cast("string")).otherwise("-")


def month_label(month: Column) -> Column:
    """`01. Sty` … `12. Gru`."""
    names = F.array(*[F.lit(name) for name in MONTH_LABELS])
    return F.format_string("%02d. %s", month, F.element_at(names, month))


def station_label(name: Column, station_id: Column) -> Column:
    return F.coalesce(text_or_null(name), text_or_null(station_id), F.lit(NO_VALUE))


def two_part_label(first: Column, second: Column) -> Column:
    """`name (detail)`."""
    return F.format_string("%s (%s)", first, second)


def bloom_tooltip(plant_name: Column, start: Column, end: Column) -> Column:
    """`<plant>: od <start> do <end>`; NULL when any part is missing."""
    return F.concat(
        plant_name, F.lit(": od "), start.cast("string"), F.lit(" do "), end.cast("string")
    )


def no_bloom_tooltip(plant_name: Column) -> Column:
    return F.concat(plant_name, F.lit(": brak danych"))


def zone_tip(name: Column, station_id: Column, start: Column, end: Column, tip: Column) -> Column:
    """Zone text: the window when both dates are known, else the tooltip, else the name."""
    shown = F.coalesce(text_or_null(name), text_or_null(station_id), F.lit(""))
    window = F.concat(shown, F.lit(" · "), start.cast("string"), F.lit(" – "), end.cast("string"))
    return F.coalesce(
        F.when(start.isNotNull() & end.isNotNull(), window), text_or_null(tip), shown
    )


def zone_popup(start: Column, end: Column, tip: Column) -> Column:
    """Pop-up line: the window where a start date is known, else the tooltip or nothing."""
    window = F.concat(
        F.lit("Kwitnienie: "), start.cast("string"), F.lit(" – "),
        F.coalesce(end.cast("string"), F.lit("")),
    )
    return F.coalesce(window, tip, F.lit(""))


def zone_hover(name: Column, start: Column, end: Column) -> Column:
    """Vector-layer text: depends on the start date alone, a missing end prints as nothing."""
    window = F.concat(
        F.lit(" · "), start.cast("string"), F.lit(" – "), F.coalesce(end.cast("string"), F.lit(""))
    )
    return F.concat(name, F.coalesce(window, F.lit("")))
