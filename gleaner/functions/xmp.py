"""Edit settings in XMP text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Global settings that are read, and markers of local edits.
GLOBAL = ("Temperature", "IncrementalTemperature", "Tint", "IncrementalTint", "Exposure2012", "Contrast2012", "Highlights2012", "Shadows2012", "Whites2012", "Blacks2012", "Saturation", "Vibrance")
LOCAL = ("crs:MaskGroup", "crs:Masks", "crs:PaintBasedCorrections", "crs:PaintCorrection", "crs:CircularGradientBasedCorrections", "crs:GradientBasedCorrections", "crs:RetouchAreas", "crs:RetouchInfo", "crs:RedEyeInfo", "crs:DustSpots")


def setting(text: Column, name: str) -> Column:
    """A number from an attribute or an element of that name, else null."""
    pick = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    return F.coalesce(pick(rf'crs:{name}="([^"]*)"'), pick(rf"<crs:{name}>([^<]*)</crs:{name}>")).try_cast("double")


def scanned(text: Column) -> Column:
    """struct(status, values, local_tools): local tools count unless they are empty, self-closed tags."""
    known = F.contains(text, F.lit("crs:")) | F.contains(text, F.lit("<x:xmpmeta"))
    active = sum((F.when(F.contains(text, F.lit(m)) & ~F.regexp_like(text, F.lit(rf"{m}\s*/>")), 1).otherwise(0) for m in LOCAL), F.lit(0))
    values = F.map_filter(F.create_map(*[x for n in GLOBAL for x in (F.lit(n), setting(text, n))]), lambda k, v: v.isNotNull())
    ok = text.isNotNull() & known
    return F.struct(F.when(ok, "parsed").otherwise("unknown_schema").alias("status"), F.when(ok, values).alias("values"), F.when(ok, active).otherwise(0).alias("local_tools"))
