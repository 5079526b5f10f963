"""Text rules over conversations and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import query
from ..sources.tables import table

_CATEGORIES = list(T.CUES)
#: a turn stands in for a generated request; its position picks the category it was written for
_CATEGORY_SQL = f"({_CATEGORIES})[((conv_id * 7 + turn) % {len(_CATEGORIES)})::INTEGER + 1]"


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _requests(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return rows.withColumn("category", F.element_at(F.lit(_CATEGORIES), ((F.col("conv_id") * 7 + F.col("turn")) % len(_CATEGORIES) + 1).cast("int")))


_TAGS = ["Warmer", "more_magenta", " Teal Orange ", "lifted-blacks", "desaturated", "unknown", "Bleach_Bypass", "warmer"]


@query(
    f"""WITH t AS (SELECT p_partkey, ({[t for t in _TAGS]})[p_partkey % 8 + 1] AS a, ({[t for t in _TAGS]})[(p_partkey // 8) % 8 + 1] AS b FROM part),
    k AS (SELECT * FROM (VALUES {", ".join(f"({_quote(__import__('re').sub('[ _-]+', ' ', s))}, {_quote(t)})" for s, t in [*((x, x) for x in (*T.TAG_AXIS, *T.STYLES)), *T.ALIASES.items()])}) v(spelled, tag)),
    n AS (SELECT p_partkey, x.tag AS a, y.tag AS b FROM t LEFT JOIN k x ON x.spelled = regexp_replace(trim(lower(t.a)), '[\\s_-]+', ' ', 'g') LEFT JOIN k y ON y.spelled = regexp_replace(trim(lower(t.b)), '[\\s_-]+', ' ', 'g'))
    SELECT p_partkey, concat_ws('|', a, CASE WHEN b IS DISTINCT FROM a THEN b END) AS tags FROM n"""
)
def tag_canonicalize(spark, sf_dir):
    pick = lambda i: F.element_at(F.lit(_TAGS), (i % 8 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array(pick(F.col("p_partkey")), pick(F.floor(F.col("p_partkey") / 8))).alias("raw"))
    return rows.select("p_partkey", F.array_join(T.normal_tags(F.col("raw")), "|").alias("tags"))


@query(
    "WITH " + "c(category, pattern) AS (VALUES " + ", ".join(f"({_quote(k)}, {_quote(T.phrase_pattern(v))})" for k, v in T.CUES.items()) + ") SELECT conv_id, turn, category FROM conversations JOIN c ON regexp_matches(lower(text), pattern)"
)
def cue_categories(spark, sf_dir):
    """Every category that a turn shows a cue of."""
    found = F.array_compact(F.array(*[F.when(T.has_phrase(F.col("text"), cues), F.lit(name)) for name, cues in T.CUES.items()]))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(found).alias("category"))


_ISSUE_SQL = (
    "CASE WHEN text IS NULL OR length(trim(text)) < 8 THEN 'empty_or_too_short' WHEN category = 'underspecified_intent' THEN (CASE "
    + " ".join(f"WHEN regexp_matches(lower(text), {_quote(T.stem_pattern(s))}) THEN 'names_supported_direction:{s}'" for s in T.DIRECTION_STEMS)
    + " END) "
    + " ".join(f"WHEN category = '{k}' AND NOT regexp_matches(lower(text), {_quote(T.phrase_pattern(v))}) THEN 'no_category_cue:{k}'" for k, v in T.CUES.items() if k not in T.CLARIFY)
    + " END"
)


@query(f"WITH r AS (SELECT conv_id, turn, text, {_CATEGORY_SQL} AS category FROM conversations) SELECT conv_id, turn, category, {_ISSUE_SQL} AS issue FROM r")
def prompt_validation(spark, sf_dir):
    return _requests(spark, sf_dir).select("conv_id", "turn", "category", T.prompt_issue(F.col("text"), F.col("category")).alias("issue"))


_KIND_SQL = f"CASE WHEN category IN {T.OUT_OF_GAMUT} THEN 'out_of_gamut' WHEN category IN {T.OUT_OF_SCOPE} OR starts_with(category, '{T.MIXED_PREFIX}') THEN 'out_of_scope' END"


@query(
    f"""WITH r AS (SELECT conv_id, turn, CASE WHEN role = 'user' AND turn % 2 = 0 THEN '{T.MIXED_PREFIX}' || {_CATEGORY_SQL} ELSE {_CATEGORY_SQL} END AS category FROM conversations)
    SELECT conv_id, turn, category, {_KIND_SQL} AS refuse_kind, CASE WHEN category = 'underspecified_intent' THEN 'clarify' WHEN {_KIND_SQL} IS NOT NULL THEN 'refuse' END AS route FROM r"""
)
def taxonomy_route(spark, sf_dir):
    rows = _requests(spark, sf_dir)
    mixed = F.when((F.col("role") == "user") & (F.col("turn") % 2 == 0), F.concat(F.lit(T.MIXED_PREFIX), F.col("category"))).otherwise(F.col("category"))
    return rows.withColumn("category", mixed).select("conv_id", "turn", "category", T.refuse_kind(F.col("category")).alias("refuse_kind"), T.route(F.col("category")).alias("route"))


@query("SELECT issue, count(*) AS n FROM (SELECT CASE WHEN text IS NULL OR length(trim(text)) < 6 THEN 'too_short' WHEN length(trim(text)) > 400 THEN 'too_long' ELSE 'ok' END AS issue FROM documents) GROUP BY issue")
def caption_validity(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.coalesce(T.caption_issue(F.col("text")), F.lit("ok")).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


_VAGUE = {"the": "warmer", "with": "brighter", "of": "muted", "and": "more_contrast"}


@query(
    f"""WITH l(word, suggestion, ord) AS (VALUES {", ".join(f"('{w}', '{s}', {i})" for i, (w, s) in enumerate(_VAGUE.items()))}),
    h AS (SELECT conv_id, turn, suggestion, row_number() OVER (PARTITION BY conv_id, turn ORDER BY ord) AS k FROM conversations JOIN l ON regexp_matches(lower(text), '(^|[^a-z])' || word || '([^a-z]|$)'))
    SELECT conv_id, turn, string_agg(suggestion, '|' ORDER BY k) AS suggestions FROM h WHERE k <= 3 GROUP BY ALL"""
)
def vague_suggest(spark, sf_dir):
    """Up to three suggestions for vague words, in lexicon order."""
    hits = F.array_compact(F.array(*[F.when(F.regexp_like(F.lower("text"), F.lit(rf"(^|[^a-z]){w}([^a-z]|$)")), F.lit(s)) for w, s in _VAGUE.items()]))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.slice(hits, 1, 3).alias("s")).where("size(s) > 0").select("conv_id", "turn", F.array_join("s", "|").alias("suggestions"))


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn, text) AS preview FROM conversations GROUP BY conv_id")
def message_preview(spark, sf_dir):
    """A conversation's turns flattened to one text."""
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", F.struct("turn", "text", "role").alias("m"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("m")).select("conv_id", F.array_join(F.transform("m", lambda m: F.concat(m["role"], F.lit(": "), m["text"])), "\n").alias("preview"))


@query(
    """SELECT doc_id, CASE WHEN regexp_matches(lower(text), '(^|[^a-z])(remove|replace|add|crop)([^a-z]|$)') THEN 'out_of_scope' WHEN regexp_matches(lower(text), '(^|[^a-z])(infrared|thermal)([^a-z]|$)') THEN 'out_of_gamut'
    WHEN length(text) < 60 THEN 'clarify' ELSE 'grade' END AS route FROM documents WHERE text IS NOT NULL"""
)
def keyword_router(spark, sf_dir):
    text = F.lower("text")
    word = lambda w: F.regexp_like(text, F.lit(rf"(^|[^a-z])({w})([^a-z]|$)"))
    found = F.when(word("remove|replace|add|crop"), "out_of_scope").when(word("infrared|thermal"), "out_of_gamut").when(F.length("text") < 60, "clarify").otherwise("grade")
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", found.alias("route"))


@query("SELECT item_id, coalesce(nullif(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')), ''), 'untitled') AS stem FROM benchmark")
def safe_stems(spark, sf_dir):
    stem = F.regexp_replace(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return table(spark, sf_dir, "benchmark").select("item_id", F.coalesce(F.nullif(F.trim(stem), F.lit("")), F.lit("untitled")).alias("stem"))
