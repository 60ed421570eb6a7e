"""Line-first quality rules, in DataFrame operations only.

Every line with a word is judged by itself: a line fails as boilerplate, as
navigation, as shouting or symbols, or for want of punctuation.  Failing lines
are removed and a document that loses too much of its text is rejected, as is
one that fails the base rules on its words.

Defined results: a null text has no words and is rejected like an empty one;
rows that repeat are judged once each; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW_WORDS = 5
LEAST_WORDS = 10
#: Percent of words in repeated windows from which a document fails.
MOST_REPEATED = 20
SYMBOLS = "#*$%&|<>"
#: Share of the text (characters of lines with words) that may be removed.
MOST_LOST = 0.5
#: Words (blanks plus one) from which a line has to end in punctuation.
PROSE_WORDS = 6
BLANK = r"[\x20\x09-\x0D]"
WORDED = r"[^\x20\x09-\x0D]"
ENDS = tuple(".!?:;…\"'”»)]")
#: Characters between the entries of a navigation line.
SEPARATORS = "|•·→›"
#: Fixed phrases of boilerplate lines, lower case: English, German, Spanish, French.
BOILERPLATE = (
    "all rights reserved",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "enable javascript",
    "sign up for",
    "subscribe to our",
    "click here",
    "lorem ipsum",
    "skip to content",
    "alle rechte vorbehalten",
    "datenschutzerklärung",
    "nutzungsbedingungen",
    "cookie-richtlinie",
    "hier klicken",
    "newsletter abonnieren",
    "javascript aktivieren",
    "zum inhalt springen",
    "todos los derechos reservados",
    "política de privacidad",
    "condiciones de uso",
    "política de cookies",
    "haga clic aquí",
    "suscríbete a",
    "saltar al contenido",
    "tous droits réservés",
    "politique de confidentialité",
    "mentions légales",
    "politique de cookies",
    "cliquez ici",
    "abonnez-vous",
    "aller au contenu",
)
BOILERPLATE_WORDS = 30


def _any_of(text: Column, phrases: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | F.contains(text, F.lit(p))
    return found


def _without(text: Column, *parts: str) -> Column:
    for p in parts:
        text = F.replace(text, F.lit(p), F.lit(""))
    return text


def repeated_words(words: Column, window: int = WINDOW_WORDS) -> Column:
    """How many words lie in windows that occur twice or more.

    Hashes of windows tell most texts to have no repeat at all; where two are
    equal the windows themselves are sorted and compared.
    """
    n = F.size(words)
    places = F.sequence(F.lit(0), n - window)
    hashes = F.transform(places, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(window)]))
    pairs = F.array_sort(
        F.transform(
            places,
            lambda i: F.struct(
                F.array_join(F.slice(words, i + 1, window), " ").alias("w"), i.alias("i")
            ),
        )
    )

    def same(sorted_pairs: Column) -> Column:
        found = F.filter(
            sorted_pairs,
            lambda x, i: F.coalesce(F.get(sorted_pairs, i - 1)["w"] == x["w"], F.lit(False))
            | F.coalesce(F.get(sorted_pairs, i + 1)["w"] == x["w"], F.lit(False)),
        )
        return F.array_sort(F.transform(found, lambda x: x["i"]))

    # A lambda over a one-item array names the sorted pairs, so they are made once.
    repeats = F.get(F.transform(F.array(pairs), same), F.lit(0))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        repeats,
        start,
        lambda s, i: F.struct(
            (i + window).alias("end"), (s["n"] + i + window - F.greatest(s["end"], i)).alias("n")
        ),
        lambda s: s["n"],
    )
    counted = F.get(
        F.transform(
            F.array(hashes),
            lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered).otherwise(
                F.lit(0).cast("long")
            ),
        ),
        F.lit(0),
    )
    return F.when(n > window, counted).otherwise(F.lit(0).cast("long"))


def line_fails(line: Column, boilerplate: Column, bangs: Column, symbols: Column, separators: Column) -> Column:
    """Whether a line with a word is to be removed.

    The flags say what the whole text has, so most lines are asked only how they end.
    """
    n = F.length(line) - F.length(_without(line, " ")) + 1
    bars = F.length(line) - F.length(F.translate(line, SEPARATORS, ""))
    signs = F.length(line) - F.length(F.translate(line, SYMBOLS, ""))
    loud = F.length(line) - F.length(F.replace(line, F.lit("!!"), F.lit("!")))
    return (
        (~F.substring(F.rtrim(line), -1, 1).isin(*ENDS) & (n >= PROSE_WORDS))
        | (separators & (bars > 0) & (bars * 4 >= n))
        | (symbols & (signs > 1) & (signs * 2 >= n))
        | (bangs & (loud >= 3) & (loud * 4 >= n))
        | (boilerplate & (n <= BOILERPLATE_WORDS) & _any_of(F.lower(line), BOILERPLATE))
    )


def judged(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the base counts and verdict, lost_share, clean_text and kept; no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", text.alias("t")).select(
        "doc_id",
        "t",
        F.array_remove(F.split("t", BLANK + "+"), "").alias("words"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(WORDED)).alias("lines"),
        _any_of(F.lower("t"), BOILERPLATE).alias("boilerplate"),
        F.contains("t", F.lit("!!")).alias("bangs"),
        F.col("t").rlike("[#*$%&|<>]").alias("symbols"),
        F.col("t").rlike(f"[{SEPARATORS}]").alias("separators"),
    )
    base = split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(_without(F.col("t"), *" \t\n\x0b\f\r")).cast("long").alias("word_chars"),
        F.when(
            F.col("symbols"), F.length("t") - F.length(F.regexp_replace("t", "[#*$%&|<>]+", ""))
        )
        .otherwise(0)
        .cast("long")
        .alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.aggregate("lines", F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("chars"),
        F.filter(
            "lines",
            lambda x: ~line_fails(x, *map(F.col, ("boilerplate", "bangs", "symbols", "separators"))),
        ).alias("good"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    )
    kept_chars = F.aggregate("good", F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    return (
        base.withColumn("base_failed", failed)
        .withColumn("lost_chars", F.col("chars") - kept_chars)
        .select(
            "doc_id",
            "n_words",
            "word_chars",
            "n_symbols",
            "n_dup_lines",
            "n_repeat_words",
            "base_failed",
            (~F.col("base_failed") & (F.col("lost_chars") <= MOST_LOST * F.col("chars"))).alias(
                "kept"
            ),
            "lost_chars",
            F.array_join("good", "\n").alias("clean_text"),
        )
    )


_W, _B = WORDED, BLANK
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '{_W}+') AS ws,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{_W}')) AS nb
  FROM d
), g AS (
  SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM w WHERE len(ws) >= 5)
), r AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1
), v AS (
  SELECT rid, sum(least(5, coalesce(nxt - i, 5))) AS n
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM r) GROUP BY rid
), l AS (
  SELECT rid, line, length(line) AS size, length(line) - length(replace(line, ' ', '')) + 1 AS n,
         length(line) - length(replace(line, '!!', '!')) AS bangs,
         length(line) - length(regexp_replace(line, '[{SEPARATORS}]', '', 'g')) AS bars,
         length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS signs
  FROM (SELECT rid, unnest(nb) AS line FROM w)
), k AS (
  SELECT rid, sum(size) AS chars, sum(CASE WHEN
      (regexp_matches(lower(line), '{"|".join(BOILERPLATE)}') AND n <= {BOILERPLATE_WORDS})
      OR (bars * 4 >= n AND bars > 0)
      OR (bangs >= 3 AND bangs * 4 >= n) OR (signs * 2 >= n AND signs > 1)
      OR (n >= {PROSE_WORDS} AND NOT contains('.!?:;…"''”»)]', right(rtrim(line), 1)))
    THEN size ELSE 0 END) AS lost
  FROM l GROUP BY rid
), b AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '{_B}+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(nb) - len(list_distinct(nb)))::BIGINT AS n_dup_lines,
         coalesce(v.n, 0)::BIGINT AS n_repeat_words, coalesce(k.lost, 0)::BIGINT AS lost_chars,
         coalesce(k.chars, 0) AS chars
  FROM w LEFT JOIN v USING (rid) LEFT JOIN k USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AS base_failed,
       (n_words >= {LEAST_WORDS} AND 100 * n_repeat_words <= {MOST_REPEATED} * n_words
        AND lost_chars <= {MOST_LOST} * chars) AS kept,
       lost_chars
FROM b
"""
