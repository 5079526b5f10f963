"""Strict parsing of code outputs and projection onto the grammar, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.let import let

BEGIN, END, REFUSE, CODES, LARGEST = "<lut_bos>", "<lut_eos>", "<unsupported>", 64, 255
_CODE = "^<lut_[0-9]{3}>$"
_GOOD = "^<lut_(?:[01][0-9]{2}|2[0-4][0-9]|25[0-5])>$"  # a code up to LARGEST


def _is_code(t: Column) -> Column:
    return F.regexp_like(t, F.lit(_GOOD))


def parse_output(text: Column) -> Column:
    """struct(kind, codes, errors): lut_tokens, unsupported or invalid, with the reasons in order."""
    none = F.lit([]).cast("array<int>")

    def wrong(x: Column) -> Column:
        fault = F.when(x.isin(BEGIN, END), F.concat(F.lit("stray_control_token:"), x)).when(~F.regexp_like(x, F.lit(_CODE)), F.concat(F.lit("unknown_token:"), x))
        return fault.otherwise(F.concat(F.lit("code_out_of_range:"), x))

    def framed(t: Column, inner: Column, good: Column) -> Column:
        bad = F.transform(F.filter(inner, lambda x: ~_is_code(x)), wrong)
        count = F.when((F.size(good) != CODES) | (F.size(inner) != CODES), F.array(F.concat(F.lit("token_count_"), F.size(good).cast("string"), F.lit(f"_not_{CODES}")))).otherwise(F.lit([]).cast("array<string>"))
        codes = F.transform(good, lambda x: F.substring(x, 6, 3).cast("int"))
        return let(F.concat(bad, count), lambda errors: F.struct(F.when(F.size(errors) == 0, "lut_tokens").otherwise("invalid").alias("kind"), codes.alias("codes"), errors.alias("errors")))

    def invalid(*errors: Column) -> Column:
        return F.struct(F.lit("invalid").alias("kind"), none.alias("codes"), F.array_compact(F.array(*errors)).alias("errors"))

    def tokens(t: Column) -> Column:
        first, last = F.get(t, F.lit(0)), F.try_element_at(t, F.lit(-1))
        inner = F.slice(t, 2, F.greatest(F.size(t) - 2, F.lit(0)))
        whole = let(inner, lambda i: let(F.filter(i, _is_code), lambda good: framed(t, i, good)))
        return (
            F.when(F.array_contains(t, REFUSE), invalid(F.lit("mixed_unsupported_and_tokens")))
            .when((first != BEGIN) | (last != END), invalid(F.when(first != BEGIN, "missing_bos"), F.when(last != END, "missing_eos")))
            .otherwise(whole)
        )

    def trimmed(s: Column) -> Column:
        refusal = F.struct(F.lit("unsupported").alias("kind"), none.alias("codes"), F.lit([]).cast("array<string>").alias("errors"))
        return F.when(s.isNull(), invalid(F.lit("null_output"))).when(s == REFUSE, refusal).when(s == "", invalid(F.lit("empty_output"))).otherwise(let(F.split(s, r"\s+"), tokens))

    return let(F.regexp_replace(text, r"^\s+|\s+$", ""), trimmed)


def format_codes(codes: Column) -> Column:
    return F.concat(F.lit(f"{BEGIN} "), F.array_join(F.transform(codes, lambda c: F.concat(F.lit("<lut_"), F.lpad(c.cast("string"), 3, "0"), F.lit(">"))), " "), F.lit(f" {END}"))


def project_codes(text: Column) -> Column:
    """The refusal, or the frame around the first CODES codes, padded with code 0; a code's token is written as it was read."""

    def projected(t: Column) -> Column:
        codes = F.slice(F.concat(F.filter(t, _is_code), F.array_repeat(F.lit("<lut_000>"), CODES)), 1, CODES)
        return F.when(F.get(t, F.lit(0)) == REFUSE, REFUSE).otherwise(F.concat(F.lit(f"{BEGIN} "), F.array_join(codes, " "), F.lit(f" {END}")))

    return let(F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+"), projected)


def valid_sequence(text: Column) -> Column:
    """Whether the grammar's state machine accepts the tokens: a fold over (state, codes so far)."""
    t = F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+")
    start = F.struct(F.lit("start").alias("at"), F.lit(0).alias("n"))

    def step(s: Column, x: Column) -> Column:
        n = s["n"] + 1
        at = (
            F.when((s["at"] == "start") & (x == BEGIN), "codes").when((s["at"] == "start") & (x == REFUSE), "done").when((s["at"] == "codes") & _is_code(x), F.when(n == CODES, "end").otherwise("codes"))
            .when((s["at"] == "end") & (x == END), "done").otherwise("failed")
        )
        return F.struct(at.alias("at"), F.when(s["at"] == "codes", n).otherwise(s["n"]).alias("n"))

    return F.aggregate(t, start, step)["at"] == "done"
