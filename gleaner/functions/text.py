"""Tag vocabulary, category cues and the route taxonomy."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directional tags with their measured axis and sign.
TAG_AXIS = {
    "warmer": ("temperature_delta_b", 1), "cooler": ("temperature_delta_b", -1), "tint_magenta": ("tint_delta_a", 1), "tint_green": ("tint_delta_a", -1),
    "brighter": ("mean_l_delta", 1), "darker": ("mean_l_delta", -1), "more_contrast": ("contrast_l_spread_delta", 1), "less_contrast": ("contrast_l_spread_delta", -1),
    "more_saturated": ("chroma_delta", 1), "muted": ("chroma_delta", -1), "lifted_blacks": ("black_point_l_delta", 1), "crushed_blacks": ("black_point_l_delta", -1),
    "lifted_shadows": ("shadow_l_delta", 1), "brighter_highlights": ("highlight_l_delta", 1), "softer_highlights": ("highlight_l_delta", -1),
    "warmer_shadows": ("split_tone_shadow_b", 1), "cooler_shadows": ("split_tone_shadow_b", -1), "warmer_highlights": ("split_tone_highlight_b", 1), "cooler_highlights": ("split_tone_highlight_b", -1),
}
# Retired tags and what they are called now.
ALIASES = {"more_magenta": "tint_magenta", "more_green": "tint_green", "higher_contrast": "more_contrast", "softer_contrast": "less_contrast", "desaturated": "muted"}
# Style tags.
STYLES = ("matte", "faded", "filmic", "cinematic", "teal-orange", "sepia", "bleach bypass", "natural")
# Axes whose smallest perceptible change is 1.0 (of all others it is 1.5).
CHROMA_AXES = ("chroma_delta", "highlight_chroma_delta", "shadow_chroma_delta", "split_tone_shadow_b", "split_tone_highlight_b", "split_tone_shadow_a", "split_tone_highlight_a")
# Categories that a single global transform cannot do, that it cannot represent, and that are too vague.
OUT_OF_SCOPE = ("local_region_edit", "semantic_object_recolor", "content_removal", "content_replacement", "content_generation", "selective_preservation", "reference_style_transfer", "relighting", "texture_detail", "geometry", "inpainting")
OUT_OF_GAMUT = ("infrared_false_color", "pure_primary_cast", "hue_rotation")
CLARIFY = ("underspecified_intent",)
MIXED_PREFIX = "mixed_partial_supported_plus_"
# Words that show a category in a request.
CUES = {
    "local_region_edit": ("only", "just the", "background", "foreground", "the sky", "left", "right", "top ", "bottom", "corner", "region", "area", "behind", "in the back", "blur the back"),
    "semantic_object_recolor": ("recolor", "shirt", "car", "dress", "hair", "eyes", "wall", "jacket", "sky blue", "make the", "turn the", "change the", "to red", "to blue", "to green", "to purple", "to pink"),
    "content_removal": ("remove", "erase", "delete", "get rid of", "take out", "without the"),
    "content_replacement": ("replace", "swap", "instead of", "turn ... into", " into a", "change the sky to"),
    "content_generation": ("add", "insert", "put a", "generate", "create", "rain", "clouds", "birds", "moon", "stars", "snow", "fog"),
    "selective_preservation": ("leave", "keep", "but leave", "except", "everything else", "rest of", "only the", "while keeping", "unchanged", "the same"),
    "reference_style_transfer": ("reference", "this image", "copy the colors", "match the style", "like the attached", "from the other", "same look as"),
    "relighting": ("relight", "light", "lighting", "sunset", "shadow", "sunlight", "from the left", "from the right", "golden hour", "backlit"),
    "texture_detail": ("sharpen", "blur", "denoise", "deblur", "smooth", "clean up", "detail", "grain", "soften the", "skin"),
    "geometry": ("crop", "straighten", "rotate", "perspective", "warp", "stretch", "flip", "resize", "tilt", "align"),
    "inpainting": ("fill in", "inpaint", "missing", "patch", "reconstruct", "restore the", "damaged", "torn"),
    "infrared_false_color": ("infrared", "false color", "false-color", "ir look", "ir photo", "thermal", "heat map", "heatmap", "aerochrome"),
    "pure_primary_cast": ("pure red", "pure green", "pure blue", "pure primary", "all red", "all green", "all blue", "everything red", "everything green", "everything blue", "entirely red", "entirely blue", "solid red", "monochrome red"),
    "hue_rotation": ("rotate", "hue rotation", "hue-rotate", "rotate the hues", "rotate every hue", "shift all hues", "shift every hue", "180 degrees", "180 degree", "hue wheel", "opposite colors", "invert the colors", "invert the hues", "complementary colors"),
    "underspecified_intent": ("make it better", "make it look better", "fix the colors", "fix the color", "fix it", "improve it", "improve the", "make it nicer", "make it look nicer", "make it look good", "make it pretty", "do something", "make it pop", "enhance it", "clean it up"),
}
# Word stems that name a supported direction, so a request is not vague.
DIRECTION_STEMS = ("warm", "cool", "bright", "dark", "contrast", "mut", "fad", "matte", "cinema", "saturat", "desaturat", "vibrant", "vivid", "tint", "sepia")

_W = r"[\p{L}\p{N}_]"


def phrase_pattern(cues) -> str:
    """Any cue as whole words; boundaries are spelled out, so that any engine reads them alike."""
    return rf"(^|[^\p{{L}}\p{{N}}_])({'|'.join(re.escape(c.strip()).replace(chr(92) + ' ', ' ') for c in cues)})([^\p{{L}}\p{{N}}_]|$)"


def stem_pattern(stem: str) -> str:
    return rf"(^|[^\p{{L}}\p{{N}}_]){re.escape(stem)}"


def has_phrase(text: Column, cues) -> Column:
    return F.regexp_like(F.lower(text), F.lit(phrase_pattern(cues)))


def has_stem(text: Column, stem: str) -> Column:
    return F.regexp_like(F.lower(text), F.lit(stem_pattern(stem)))


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def canonical_tag(tag: Column) -> Column:
    return F.coalesce(F.element_at(_map(ALIASES), tag), tag)


def normal_tags(tags: Column) -> Column:
    """Known tags in canonical spelling, first occurrence kept."""
    spelled = _map({re.sub(r"[\s_-]+", " ", t): t for t in (*TAG_AXIS, *STYLES)} | {re.sub(r"[\s_-]+", " ", a): t for a, t in ALIASES.items()})
    named = F.transform(tags, lambda t: F.element_at(spelled, F.regexp_replace(F.trim(F.lower(t)), r"[\s_-]+", " ")))
    return F.array_distinct(F.filter(named, lambda t: t.isNotNull()))


def refuse_kind(category: Column) -> Column:
    return F.when(category.isin(*OUT_OF_GAMUT), "out_of_gamut").when(category.isin(*OUT_OF_SCOPE) | F.startswith(category, F.lit(MIXED_PREFIX)), "out_of_scope")


def route(category: Column) -> Column:
    return F.when(category.isin(*CLARIFY), "clarify").when(refuse_kind(category).isNotNull(), "refuse")


def prompt_issue(text: Column, category: Column) -> Column:
    """The first thing wrong with a request written for a category, or null."""
    named = F.coalesce(*[F.when(has_stem(text, s), F.lit(s)) for s in DIRECTION_STEMS])
    missing = F.lit(False)
    for name, cues in CUES.items():
        if name not in CLARIFY:
            missing = F.when(category == name, ~has_phrase(text, cues)).otherwise(missing)
    return (
        F.when(text.isNull() | (F.length(F.trim(text)) < 8), "empty_or_too_short")
        .when(category.isin(*CLARIFY) & named.isNotNull(), F.concat(F.lit("names_supported_direction:"), named))
        .when(missing, F.concat(F.lit("no_category_cue:"), category))
    )


def caption_issue(text: Column) -> Column:
    size = F.length(F.trim(text))
    return F.when(text.isNull() | (size < 6), "too_short").when(size > 400, "too_long")


def magnitude_bucket(value: Column) -> Column:
    size = F.abs(value)
    return F.when(size < 1.5, "slight").when(size < 3, "moderate").when(size < 6, "strong").otherwise("extreme")
