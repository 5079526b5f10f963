"""The attribute spec grammar: `route=grade | warmer=+2.4 brighter=+1.0 | conf=0.90`."""

from __future__ import annotations

import re
from collections.abc import Callable
from decimal import ROUND_HALF_EVEN, Decimal

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .let import let
from .text import magnitude_bucket

# Bipolar fields with the tags of their two directions.
BIPOLAR = {
    "temperature_delta_b": ("warmer", "cooler"), "tint_delta_a": ("tint_magenta", "tint_green"), "mean_l_delta": ("brighter", "darker"), "contrast_l_spread_delta": ("more_contrast", "less_contrast"),
    "chroma_delta": ("more_saturated", "muted"), "black_point_l_delta": ("lifted_blacks", "crushed_blacks"), "highlight_l_delta": ("brighter_highlights", "softer_highlights"), "shadow_l_delta": ("lifted_shadows", "crushed_shadows"),
}
# Unipolar keys, and hue keys with the field that gates them.
UNIPOLAR = {"matte": "matte_strength", "split_strength": "split_tone_strength"}
HUES = {"global_hue": ("global_hue_deg", "global_hue_magnitude"), "shadow_hue": ("shadow_hue_deg", "split_tone_strength"), "highlight_hue": ("highlight_hue_deg", "split_tone_strength")}
# Hue sectors and the order of keys in a spec.
SECTORS = ("red", "orange", "yellow", "green", "cyan", "blue", "magenta")
ORDER = ("warmer", "cooler", "tint_magenta", "tint_green", "brighter", "darker", "more_contrast", "less_contrast", "more_saturated", "muted", "lifted_blacks", "crushed_blacks", "lifted_shadows", "crushed_shadows", "brighter_highlights", "softer_highlights", "matte", "split_strength", "global_hue", "shadow_hue", "highlight_hue", *(f"sat_{s}" for s in SECTORS))
#: a key's field and sign (0: as written)
TAGS = {up: (name, 1.0) for name, (up, _) in BIPOLAR.items()} | {down: (name, -1.0) for name, (_, down) in BIPOLAR.items()} | {k: (v, 0.0) for k, v in UNIPOLAR.items()} | {k: (v[0], 0.0) for k, v in HUES.items()} | {f"sat_{s}": (f"sat_{s}", 0.0) for s in SECTORS}
MAGNITUDE, HUE_GATE, SATURATION = 0.5, 1.0, 1.0  # smallest values that are written


def signed(value: Column) -> Column:
    """+1.2 or -0.5: one decimal, half to even, the sign always written."""
    tenth = F.abs(F.bround(value, 1))
    # A rounded double below 1e7 prints with its one decimal as it is, at a fraction of a formatter's cost.  Rounding is the
    # costly step, so what decides is asked of the value: -0.05 rounds to 0.0, all below it to less.
    return F.concat(F.when(value < -0.05, "-").otherwise("+"), F.when(F.abs(value) < 9e6, tenth.cast("string")).otherwise(F.format_string("%.1f", tenth)))


def _parts(fields: dict[str, Column], bucketed: bool) -> dict[str, Column]:
    zero = lambda name: F.coalesce(fields.get(name, F.lit(None)).cast("double"), F.lit(0.0))
    shown = lambda v: magnitude_bucket(F.bround(v, 1)) if bucketed else signed(F.abs(v))
    out = {}
    for name, (up, down) in BIPOLAR.items():
        v = zero(name)
        out[up] = F.when(v >= MAGNITUDE, F.concat(F.lit(f"{up}="), shown(v)))
        out[down] = F.when(v <= -MAGNITUDE, F.concat(F.lit(f"{down}="), shown(v)))
    for key, name in UNIPOLAR.items():
        out[key] = F.when(zero(name) >= MAGNITUDE, F.concat(F.lit(f"{key}="), shown(zero(name))))
    for key, (name, gate) in HUES.items():
        out[key] = F.when(zero(gate) >= HUE_GATE, F.concat(F.lit(f"{key}="), F.bround(zero(name), 0).cast("long").cast("string")))
    for sector in SECTORS:
        v = zero(f"sat_{sector}")
        sign = F.when(v >= 0, "+").otherwise("-")
        out[f"sat_{sector}"] = F.when(F.abs(v) >= SATURATION, F.concat(F.lit(f"sat_{sector}="), F.concat(sign, magnitude_bucket(F.bround(v, 1))) if bucketed else signed(v)))
    return out


def serialize(fields: dict[str, Column], bucketed: bool = False) -> Column:
    """A grade spec of measured fields (sector saturations as sat_<sector>)."""
    parts = _parts(fields, bucketed)
    return F.concat(F.lit("route=grade | "), F.concat_ws(" ", *[parts[k] for k in ORDER]))


def refusal(reason: Column) -> Column:
    return F.concat(F.lit("route=refuse | refuse="), F.coalesce(reason, F.lit("out_of_scope")))


def parsed(text: Column) -> dict[str, Column]:
    """route, refuse, conf and axes (field -> signed value; sectors as sat_<sector>) of a spec's first line, nulls if malformed.

    An axis that is written twice, be it as its two directions, has its last value.
    """
    first = F.trim(F.get(F.split(F.trim(text), "\n"), F.lit(0)))
    ok = F.startswith(first, F.lit("route="))
    segments = F.transform(F.split(first, r"\|"), lambda s: F.trim(s))
    named = lambda key: F.get(F.filter(segments, lambda s: F.startswith(s, F.lit(f"{key}="))), F.lit(0))
    after = lambda s: F.trim(F.substring_index(s, "=", -1))
    other = lambda s: ~(F.startswith(s, F.lit("route=")) | F.startswith(s, F.lit("conf=")) | F.startswith(s, F.lit("refuse=")))
    # what isn't key=number has no known key or no value below, so it needs no pattern of its own
    pairs = F.flatten(F.transform(F.filter(segments, other), lambda s: F.split(F.translate(s, "\t\x0b\f\r", "    "), " ")))
    table = F.create_map(*[x for k, (name, sign) in TAGS.items() for x in (F.lit(k), F.struct(F.lit(name).alias("field"), F.lit(sign).alias("sign")))])
    known = F.filter(F.transform(pairs, lambda t: F.struct(F.element_at(table, F.substring_index(t, "=", 1)).alias("to"), F.substring_index(t, "=", -1).try_cast("double").alias("value"))), lambda x: x["to"].isNotNull() & x["value"].isNotNull())
    entries = F.transform(known, lambda x: F.struct(x["to"]["field"].alias("key"), F.bround(F.when(x["to"]["sign"] == 0, x["value"]).otherwise(x["to"]["sign"] * F.abs(x["value"])), 1).alias("value")))
    return {
        "route": F.when(ok, after(named("route"))), "refuse": F.when(ok, after(named("refuse"))), "conf": F.when(ok, after(named("conf")).try_cast("double")),
        "axes": F.when(ok, let(entries, lambda all_: F.map_from_entries(F.filter(all_, lambda e, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda x: x["key"] == e["key"]))))),
    }


def directions(axes: Column) -> Column:
    """The axes that have a sign: all but hue angles."""
    return F.map_filter(axes, lambda k, v: ~F.endswith(k, F.lit("_hue_deg")))


def share(claims: Column, other: Column, how: str, tol: float = 1.0) -> Column:
    """Share of one spec's claims that the other bears out (1 if it claims nothing).

    sign: same sign; bucket: same sign and magnitude bucket; value: same sign and within max(tol, a quarter).
    """
    mine = F.map_entries(claims)

    def agrees(e: Column) -> Column:
        return let(F.coalesce(F.element_at(other, e["key"]), F.lit(0.0)), lambda theirs: judged(e, theirs))

    def judged(e: Column, theirs: Column) -> Column:
        same = (theirs != 0) & ((e["value"] > 0) == (theirs > 0))
        if how == "bucket":
            return same & (magnitude_bucket(e["value"]) == magnitude_bucket(theirs))
        if how == "value":
            sign_ok = (e["value"] * theirs > 0) | (F.abs(e["value"]) < F.when(F.startswith(e["key"], F.lit("sat_")), SATURATION).otherwise(MAGNITUDE))
            return sign_ok & (F.abs(e["value"] - theirs) <= F.greatest(F.lit(tol), 0.25 * F.abs(e["value"])))
        return same

    return let(mine, lambda m: F.when(F.size(m) == 0, 1.0).otherwise(F.size(F.filter(m, agrees)) / F.size(m)))


def f1(p: Column, r: Column) -> Column:
    return let(F.struct(p.alias("p"), r.alias("r")), lambda x: F.when(x["p"] + x["r"] == 0, 0.0).otherwise(2 * x["p"] * x["r"] / (x["p"] + x["r"])))


_DECIMAL, _HEX = re.compile(r"([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)[fFdD]?"), re.compile(r"([+-]?0[xX](?:[0-9a-fA-F]+\.?|[0-9a-fA-F]*\.[0-9a-fA-F]+)[pP][+-]?[0-9]+)[fFdD]?")
_NAMED = re.compile(r"[+-]?(?:NaN|Infinity)|[+-]?(?:(?i:inf|infinity))|(?i:nan)")
_BLANKS, _TRIMMED = str.maketrans("\t\x0b\f\r", "    "), "".join(map(chr, range(33)))


def _number(text: str) -> float | None:
    """What Spark's try_cast to double gives."""
    text = text.strip(_TRIMMED)
    if found := _DECIMAL.fullmatch(text):
        return float(found[1])
    if found := _HEX.fullmatch(text):
        try:
            return float.fromhex(found[1])
        except OverflowError:
            return float("-inf" if found[1][0] == "-" else "inf")
    return float(text) if _NAMED.fullmatch(text) else None


def _tenth(value: float) -> float:
    """Half to even at one decimal, on the shortest decimal form; no negative zero."""
    return float(Decimal(repr(value)).quantize(Decimal("0.1"), ROUND_HALF_EVEN)) + 0.0 if abs(value) < 1e15 else value


def read_axes(text: str | None) -> dict[str, float] | None:
    """The axes of `parsed`, of one text."""
    first = "" if text is None else text.strip(" ").split("\n", 1)[0].strip(" ")
    if not first.startswith("route="):
        return None
    out: dict[str, float] = {}
    for segment in first.split("|"):
        segment = segment.strip(" ")
        if segment.startswith(("route=", "conf=", "refuse=")):
            continue
        for pair in segment.translate(_BLANKS).split(" "):
            to = TAGS.get(pair.split("=", 1)[0])
            value = None if to is None else _number(pair.rsplit("=", 1)[-1])
            if value is not None:
                out[to[0]] = _tenth(to[1] * abs(value) if to[1] else value)
    return out


def _more(x: float, y: float) -> bool:
    """x > y as Spark orders doubles: NaN is above all and equals itself."""
    return y == y and (x != x or x > y)


def _size(value: float) -> int:
    return next((i for i, most in enumerate((1.5, 3, 6)) if abs(value) < most), 3)


def read_share(claims: dict[str, float] | None, other: dict[str, float] | None, how: str, tol: float = 1.0) -> float | None:
    """`share` of axes that have been read."""
    if not claims:
        return None if claims is None else 1.0
    agreed = 0
    for key, mine in claims.items():
        theirs = (other or {}).get(key, 0.0)
        if how == "value":
            quarter = 0.25 * abs(mine)
            small = abs(mine) < (SATURATION if key.startswith("sat_") else MAGNITUDE)
            agreed += (small or _more(mine * theirs, 0.0)) and not _more(abs(mine - theirs), quarter if _more(quarter, tol) else tol)
        else:
            agreed += theirs != 0 and _more(mine, 0.0) == _more(theirs, 0.0) and (how == "sign" or _size(mine) == _size(theirs))
    return agreed / len(claims)


def _scores(p_text: str | None, r_text: str | None) -> dict[str, float | None]:
    p, r = ({k: v for k, v in a.items() if not k.endswith("_hue_deg")} if (a := read_axes(t)) is not None else None for t in (p_text, r_text))
    out: dict[str, float | None] = {}
    for how in ("sign", "bucket", "value"):
        x, y = read_share(p, r, how), read_share(r, p, how)
        out[how] = None if x is None or y is None else 2 * x * y / (x + y) if x + y else 0.0
    return out


def _borne_out(text: str | None, other: str | None) -> float | None:
    return read_share(read_axes(text), read_axes(other), "value")


def _by_text(work: Callable[..., object], kind: str, arrow: pa.DataType, texts: list[Column]) -> Column:
    """work(texts of a row), done once for each distinct row of an Arrow batch."""

    def run(*columns: pa.Array) -> pa.Array:
        place: dict[tuple, int] = {}
        at = [place.setdefault(row, len(place)) for row in zip(*(c.to_pylist() for c in columns))]
        return pa.array([work(*row) for row in place], arrow).take(pa.array(at, pa.int32()))

    # Arrow hands over as many arrays as there are texts; the signature must say so
    fixed = (lambda a: run(a)) if len(texts) == 1 else (lambda a, b: run(a, b))
    return F.arrow_udf(fixed, kind)(*texts)


def axes(text: Column) -> Column:
    """The axes of `parsed`, as a map, by an Arrow function: the grammar costs far less there than in lambdas."""
    work = lambda t: None if (a := read_axes(t)) is None else list(a.items())
    return _by_text(work, "map<string,double>", pa.map_(pa.string(), pa.float64()), [text])


def compared(p: Column, r: Column) -> Column:
    """F1 of the axes of two texts that have a sign, with agreement by sign, bucket and value (`f1` of `share`)."""
    fields = ("sign", "bucket", "value")
    return _by_text(_scores, "struct<" + ",".join(f"{f}:double" for f in fields) + ">", pa.struct([(f, pa.float64()) for f in fields]), [p, r])


def borne_out(text: Column, other: Column) -> Column:
    """Share of the axes of a text that the other's bear out in sign and size (`share` by value)."""
    return _by_text(_borne_out, "double", pa.float64(), [text, other])


def shuffled(text: Column, key: Column, seed: int) -> Column:
    """The axis tokens in the order of a digest of (seed, key, token); other segments stay."""
    first = F.substring_index(text, " | ", 1)
    after = F.substring(text, F.length(first) + 4, F.length(text))
    tokens = F.substring_index(after, " | ", 1)
    salt = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(key.cast("string"), F.lit(":")), F.lit("")))
    # a digest is 32 characters, so that digest and token are one text, ordered as the pair is
    ranked = F.sort_array(F.transform(F.split(tokens, " "), lambda t: F.concat(F.md5(F.concat(salt, t)), t)))
    order = F.array_join(F.transform(ranked, lambda s: F.substring(s, 33, 1 << 30)), " ")
    return F.when(F.contains(tokens, F.lit("=")), F.concat(first, F.lit(" | "), order, F.substring(after, F.length(tokens) + 1, F.length(text)))).otherwise(text)


def jittered(axes: Column, key: Column, seed: int, width: float = 0.3) -> Column:
    """Magnitudes moved by up to `width`, by a digest, keeping sign and the smallest written size; hues stay."""

    def move(name: Column, v: Column) -> Column:
        u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), name)), 1, 8), 16, 10).cast("double") / float(1 << 32)
        least = F.when(F.startswith(name, F.lit("sat_")), SATURATION).otherwise(MAGNITUDE)
        moved = v + (2 * u - 1) * width
        return F.when(F.endswith(name, F.lit("_hue_deg")), v).otherwise(F.bround(F.when(v > 0, F.greatest(moved, least)).when(v < 0, F.least(moved, -least)).otherwise(moved), 1))

    return F.transform_values(axes, move)
