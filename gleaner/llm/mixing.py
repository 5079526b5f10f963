"""Mixing sources to target weights: rake token weights to source, language and topic marginals, then sample.

Documents are summed to cells (source, language, topic).  Iterative proportional fitting scales the cells' token
weights, one margin after another, until every margin has its target share.  A cell's factor is its fitted over its
actual weight.  It is used in two ways, and expected tokens have the target shares in both:

* `probability` is the factor over the largest factor; `kept` is drawn with it.  No document is taken twice, so a rare
  cell that needs much thins out all others.
* `weight` is the factor scaled to `volume` times all tokens, the expected number of copies; `copies` is its whole
  part plus a draw for the rest.  Rare cells are repeated, and the sample grows with the corpus.

The draw is a hash of the key: the same document always falls the same way.

Targets are tempered shares: a value's share of the tokens to the power `temper`, made to sum to 1.  Powers under 1
lift small sources and lower large ones.  `goals` gives other targets for a margin, as a table (value, target).
`margins` reports what shares were asked for, had and reached.

Topics are shapes of text that can be told without a model: table, brief, article and longform.

Defined results: null margins count as the value `(none)`; documents without tokens weigh nothing and are kept with
their cell's probability (1 if the whole cell weighs nothing); values without a given target get none of the sample,
targets of values without tokens are shared out among the others; a null key is drawn as the text `null`; repeated
rows fall alike; nothing is ranked, so there are no ties to break; texts of any length are read whole, inside the
JVM; extra columns are carried through.

DataFrame functions only.  The cells are as many as there are combinations of values, not documents; they stay a
table, and every step's factors are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .carry import carried, restored
from .store import discard, saved

MARGINS = ("source", "lang", "topic")
SWEEPS = 6
VOLUME = 0.7  #: expected tokens of the copies over all tokens
PARTS = 8
TEMPER = {"source": 0.7, "lang": 0.8, "topic": 0.9}
WORD = r"[^ \t\n\x0B\f\r]+"


def topic_of(text: Column, tokens: Column) -> Column:
    bars = F.length(text) - F.length(F.translate(text, "|", ""))
    return (
        F.when(tokens == 0, "(none)").when(bars * 4 > tokens, "table").when(tokens < 100, "brief").when(tokens < 1000, "article").otherwise("longform")
    )


def targets(cells: DataFrame, margin: str, temper: float) -> DataFrame:
    sums = cells.groupBy(margin).agg(F.sum("tokens").alias("t")).where("t > 0").select(margin, F.pow(F.col("t").cast("double"), F.lit(temper)).alias("p"))
    return sums.join(F.broadcast(sums.agg(F.sum("p").alias("all"))), how="cross").select(margin, (F.col("p") / F.col("all")).alias("target"))


def rake(cells: DataFrame, goals: dict[str, DataFrame], sweeps: int = SWEEPS) -> DataFrame:
    """cells (margins, tokens) -> (margins, factor): one factor per cell, the product of its margins' factors.

    A fitted weight is always the cell's tokens times one factor for each of its values, so a step keeps only such
    factors (a row per value): a margin's new factors are its targets over its sums under the other margins' factors.
    """
    factors = {m: goal.select(m, F.lit(1.0).alias(f"f_{m}")) for m, goal in goals.items()}
    for _ in range(sweeps):
        for margin, goal in goals.items():
            others = [m for m in goals if m != margin]
            scaled = cells
            for m in others:
                scaled = scaled.join(factors[m], m)
            sums = scaled.groupBy(margin).agg(F.sum(F.col("tokens") * F.col(f"f_{others[0]}") * F.col(f"f_{others[1]}")).alias("have"))
            step = sums.join(goal, margin).select(margin, (F.col("target") / F.col("have")).alias(f"f_{margin}"))
            step = saved(step.coalesce(PARTS), "factors")  # a row per value: few tasks write them
            discard(factors[margin])
            factors[margin] = step
    out = cells
    for m, f in factors.items():
        out = out.join(f, m)
    return out.select(*goals, (F.col("f_source") * F.col("f_lang") * F.col("f_topic")).alias("factor"))


def given(cells: DataFrame, margin: str, goal: DataFrame) -> DataFrame:
    """Targets from a table (value, target), for the values that have tokens, made to sum to 1."""
    there = goal.select(F.col(goal.columns[0]).cast("string").alias(margin), F.col(goal.columns[1]).cast("double").alias("t")).where(f"{margin} IS NOT NULL AND t > 0")
    there = there.join(cells.select(margin).distinct(), margin, "left_semi")
    return there.join(F.broadcast(there.agg(F.sum("t").alias("all"))), how="cross").select(margin, (F.col("t") / F.col("all")).alias("target"))


def mix(
    df: DataFrame, key: str = "doc_id", text: str = "text", sweeps: int = SWEEPS, temper: dict[str, float] = TEMPER, seed: int = 17,
    volume: float = VOLUME, goals: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """df with _source, _lang, _topic, _tokens, probability, kept, weight and copies (which replace columns of these names)."""
    named = carried(df, key=key, text=text, source="source", lang="lang")
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(none)"))
    named = named.withColumn("tokens", F.regexp_count(body, F.lit(WORD)).cast("long")).withColumns({"topic": topic_of(body, F.col("tokens")), "source": none("source"), "lang": none("lang")}).drop("text")
    cells = saved(named.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")).where("tokens > 0"), "cells")
    targeted = {m: saved(given(cells, m, goals[m]) if goals and m in goals else targets(cells, m, temper[m]), "goal") for m in MARGINS}
    factor = saved(rake(cells, targeted, sweeps), "fitted")
    # Two numbers: the largest factor and all tokens.
    whole = factor.agg(F.max("factor").alias("most")).join(F.broadcast(cells.agg((F.sum("tokens") * F.lit(float(volume))).alias("scale"))), how="cross")
    odds = saved(factor.join(F.broadcast(whole), how="cross").select(*MARGINS, (F.col("factor") / F.col("most")).alias("odds"), (F.col("factor") * F.col("scale")).alias("weight")), "odds")
    draw = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("key").cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)
    lacking = F.when(F.col("tokens") > 0, 0.0).otherwise(1.0)
    out = named.join(odds, list(MARGINS), "left").withColumns({"probability": F.coalesce("odds", lacking), "weight": F.coalesce("weight", lacking)})
    copies = F.floor("weight") + (draw < F.col("weight") - F.floor("weight")).cast("long")
    return out.select(*restored(df, {"_source": F.col("source"), "_lang": F.col("lang"), "_topic": F.col("topic"), "_tokens": F.col("tokens"), "probability": F.col("probability"), "kept": draw < F.col("probability"), "weight": F.col("weight"), "copies": copies}))


def margins(mixed: DataFrame, temper: dict[str, float] = TEMPER) -> DataFrame:
    """(margin, value, had, target, by_probability, by_weight, kept, copied): shares of tokens in a result of `mix`.

    Both expected shares should be the target's; `kept` and `copied` are the drawn ones.
    """
    t = F.col("_tokens")
    cells = mixed.groupBy(*[F.col(f"_{m}").alias(m) for m in MARGINS]).agg(
        F.sum(t).alias("had"), F.sum(t * F.col("probability")).alias("by_probability"), F.sum(t * F.col("weight")).alias("by_weight"), F.sum(F.when(F.col("kept"), t)).alias("kept"), F.sum(t * F.col("copies")).alias("copied")
    )
    each = cells.select(F.explode(F.array(*[F.struct(F.lit(m).alias("margin"), F.col(m).alias("value"), F.lit(temper[m]).alias("power")) for m in MARGINS])).alias("m"), *cells.columns[len(MARGINS) :])
    shares = ("had", "by_probability", "by_weight", "kept", "copied")
    sums = each.groupBy("m.margin", "m.value", "m.power").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in shares]).withColumn("target", F.when(F.col("had") > 0, F.pow("had", "power")).otherwise(0.0))
    alls = sums.groupBy("margin").agg(*[F.nullif(F.sum(c), F.lit(0.0)).alias(f"all_{c}") for c in (*shares, "target")])
    return sums.join(F.broadcast(alls), "margin").select("margin", "value", *[(F.col(c) / F.col(f"all_{c}")).alias(c) for c in ("had", "target", *shares[1:])])


def sql(sweeps: int = SWEEPS, temper: dict[str, float] = TEMPER, seed: int = 17, volume: float = VOLUME) -> str:
    word = r"[^ \t\n\x0B\f\r]+"
    parts = [
        f"""d AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
          len(regexp_extract_all(coalesce(text, ''), '{word}')) AS tokens, coalesce(text, '') AS text FROM documents)""",
        """t AS (SELECT doc_id, source, lang, tokens, CASE WHEN tokens = 0 THEN '(none)' WHEN (length(text) - length(replace(text, '|', ''))) * 4 > tokens THEN 'table'
          WHEN tokens < 100 THEN 'brief' WHEN tokens < 1000 THEN 'article' ELSE 'longform' END AS topic FROM d)""",
        "c AS (SELECT source, lang, topic, sum(tokens) AS tokens FROM t GROUP BY ALL HAVING sum(tokens) > 0)",
        *(f"p_{m} AS (SELECT {m}, sum(tokens)::DOUBLE ** {temper[m]} AS p FROM c GROUP BY {m}), g_{m} AS (SELECT {m}, p / sum(p) OVER () AS target FROM p_{m})" for m in MARGINS),
        "w0 AS (SELECT *, tokens / (SELECT sum(tokens) FROM c) AS weight FROM c)",
    ]
    n = 0
    for _ in range(sweeps):
        for m in MARGINS:
            parts.append(f"w{n + 1} AS MATERIALIZED (SELECT w.source, w.lang, w.topic, w.tokens, w.weight * g.target / sum(w.weight) OVER (PARTITION BY w.{m}) AS weight FROM w{n} w JOIN g_{m} g USING ({m}))")
            n += 1
    parts.append(f"f AS (SELECT source, lang, topic, tokens, weight / tokens AS factor FROM w{n})")
    parts.append(f"m AS (SELECT max(factor) AS most, sum(tokens) * {volume}::DOUBLE AS scale FROM f)")
    parts.append("o AS (SELECT source, lang, topic, factor / most AS odds, factor * scale AS weight FROM f, m)")
    draw = f"('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':{seed}'), 1, 12))::BIGINT::DOUBLE / {float(1 << 48)}"
    parts.append(f"r AS (SELECT doc_id, source, lang, topic, tokens, coalesce(odds, 1.0) AS p, coalesce(weight, 1.0) AS w, {draw} AS u FROM t LEFT JOIN o USING (source, lang, topic))")
    return "WITH " + ",\n".join(parts) + "\nSELECT doc_id, source, lang, topic, tokens, round(p, 9) AS probability, u < p AS kept, round(w, 9) AS weight, (floor(w) + (u < w - floor(w))::INTEGER)::BIGINT AS copies FROM r"
