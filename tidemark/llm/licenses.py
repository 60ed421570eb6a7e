"""License scanning, in DataFrame operations only.

Base phrases are found wherever their words stand consecutively.  Beyond that
an exact set-similarity join finds every text block that contains a license
template: tokens are ordered from the globally rarest on; a block can meet a
template's threshold only if it has a token of the template's prefix (prefix
filter), enough tokens (length filter) and, from the places of the token in
both orders, enough tokens left (positional filter).  Candidates are verified
by their intersection.

A block is a line for short notices and a paragraph (what stands between blank
lines) for license bodies.  A block that meets a template gives its label if it
has the template's telling tokens too, and no other template in the block has
all of those and more (the lesser general public license is no general public
license; version 3 is no other version).  Of a text's labels one that names a
family (lgpl) gives way to its members (lgpl-2.1).

Templates are a short list in code, so their side of the join is broadcast.

Defined results: a null text is empty: no words, no places, score 0; rows that
repeat are scanned once each; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ALNUM_WORD_RE, cut

#: Base phrases (words, lower case) and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: The wording of license notices and bodies: label, telling tokens, kind of block, words.
TEMPLATES = (
    ("apache-2.0", "apache 2", "line", "licensed under the apache license version 2.0"),
    ("mit", "mit", "line", "released under the mit license"),
    ("mit", "mit", "line", "licensed under the mit license"),
    ("bsd", "bsd", "line", "released under the bsd license"),
    ("bsd", "bsd", "line", "licensed under the bsd license"),
    ("bsd-2-clause", "bsd 2 clause", "line", "licensed under the bsd 2 clause license"),
    ("bsd-3-clause", "bsd 3 clause", "line", "licensed under the bsd 3 clause license"),
    ("isc", "isc", "line", "licensed under the isc license"),
    ("gpl", "gpl", "line", "released under the gpl license"),
    ("gpl-2.0", "gpl 2", "line", "licensed under the gpl version 2"),
    ("gpl-3.0", "gpl 3", "line", "licensed under the gpl version 3"),
    ("gpl", "gnu general", "line", "licensed under the gnu general public license"),
    ("gpl-2.0", "gnu general 2", "line", "licensed under the gnu general public license version 2"),
    ("gpl-3.0", "gnu general 3", "line", "licensed under the gnu general public license version 3"),
    ("lgpl", "gnu general lesser", "line", "licensed under the gnu lesser general public license"),
    ("lgpl-2.1", "gnu general lesser 2", "line", "licensed under the gnu lesser general public license version 2.1"),
    ("lgpl-3.0", "gnu general lesser 3", "line", "licensed under the gnu lesser general public license version 3"),
    ("agpl-3.0", "gnu general affero 3", "line", "licensed under the gnu affero general public license version 3"),
    ("mpl-2.0", "mozilla 2", "line", "subject to the terms of the mozilla public license version 2.0"),
    ("cc-by-nc", "cc nc", "line", "licensed under cc by nc 4.0"),
    ("cc-by-sa", "cc sa", "line", "licensed under cc by sa 4.0"),
    ("cc-by-nd", "cc nd", "line", "licensed under cc by nd 4.0"),
    ("cc-by-nc-sa", "cc nc sa", "line", "licensed under cc by nc sa 4.0"),
    ("cc-by-nc-nd", "cc nc nd", "line", "licensed under cc by nc nd 4.0"),
    ("cc-by-nc", "commons noncommercial", "line", "creative commons attribution noncommercial license"),
    ("cc-by-sa", "commons sharealike", "line", "creative commons attribution sharealike license"),
    ("cc0", "cc0", "line", "released into the public domain under cc0"),
    ("copyright", "copyright rights reserved", "line", "copyright all rights reserved"),
    (
        "mit", "permission granted charge sublicense merge", "paragraph",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files to deal in the software without restriction including without limitation the rights to "
        "use copy modify merge publish distribute sublicense and or sell copies of the software",
    ),
    (
        "isc", "permission fee granted distribute", "paragraph",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "bsd", "redistribution binary forms permitted", "paragraph",
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
    ),
    (
        "apache-2.0", "apache 2 compliance", "paragraph",
        "licensed under the apache license version 2.0 you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at http www apache org licenses license 2.0",
    ),
    (
        "gpl-2.0", "gnu general redistribute 2", "paragraph",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation either version 2 of the license or at your option "
        "any later version",
    ),
    (
        "gpl-3.0", "gnu general redistribute 3", "paragraph",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation either version 3 of the license or at your option "
        "any later version",
    ),
    (
        "lgpl-2.1", "gnu general lesser redistribute 2", "paragraph",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser "
        "general public license as published by the free software foundation either version 2.1 of the license or at "
        "your option any later version",
    ),
    (
        "mpl-2.0", "mozilla source form 2", "paragraph",
        "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not "
        "distributed with this file you can obtain one at",
    ),
)
#: What ends a block of each kind.
BREAKS = {"line": r"\n", "paragraph": r"\n[ \t\r]*\n"}
CONTAINMENT = 0.8
#: The Kelvin sign and I with a dot, whose lower case begins with an ASCII letter.
NOT_ASCII = "\N{KELVIN SIGN}\N{LATIN CAPITAL LETTER I WITH DOT ABOVE}"
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def tokens(text: str) -> list[str]:
    return sorted(set(re.findall(ALNUM_WORD_RE, text.lower())))


@dataclass(frozen=True)
class Template:
    """One wording: what a block needs of it, and the templates that tell more than it does."""

    label: str
    kind: str
    tokens: list[str]
    need: int
    telling: list[str]
    above: list[int]


def template_rows(templates: tuple[tuple, ...], containment: float) -> list[Template]:
    telling = [(kind, set(tokens(t))) for _, t, kind, _ in templates]
    return [
        Template(
            label,
            kind,
            tokens(words),
            math.ceil(containment * len(tokens(words)) - 1e-9),
            tokens(told),
            [i for i, (k, more) in enumerate(telling) if k == kind and more > set(tokens(told))],
        )
        for label, told, kind, words in templates
    ]


def _lower(text: Column) -> Column:
    """Lower case in which no character becomes a letter a-z but A-Z: two others would."""
    for c in NOT_ASCII:
        text = F.replace(text, F.lit(c), F.lit("\N{REPLACEMENT CHARACTER}"))
    return F.lower(text)


def _words_in(framed: Column) -> Column:
    return F.floor((F.length(framed) - F.length(F.replace(framed, F.lit(" "), F.lit("")))) / 2)


def _frame(phrase: str) -> str:
    return "".join(f" {w} " for w in phrase.split())


def _places(words: Column, n_words: Column, phrase: str) -> Column:
    """Struct of the number of places of a phrase and its first and last start, null if none."""
    frame = _frame(phrase)
    count = (F.length(words) - F.length(F.replace(words, F.lit(frame), F.lit("")))) / len(frame)
    before = _words_in(F.substring_index(words, frame, 1))
    after = _words_in(F.substring_index(words, frame, -1))
    return F.when(
        F.contains(words, F.lit(frame)),
        F.struct(
            F.floor(count).cast("long").alias("n"),
            before.cast("long").alias("first"),
            (n_words - after - len(phrase.split())).cast("long").alias("last"),
        ),
    )


def scanned(docs: DataFrame, phrases: dict[str, str], templates: list[Template]) -> DataFrame:
    """One narrow row per document: the base columns, its template tokens and those of its blocks.

    Only texts whose tokens could meet a template as a whole are split into
    blocks, and blocks with fewer tokens than any template needs are left out.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    known = F.array(*[F.lit(w) for w in sorted({w for t in templates for w in t.tokens})])
    places = [F.col(f"p{i}") for i in range(len(phrases))]
    framed = (
        docs.select("doc_id", _lower(text).alias("t"))
        .withColumn("gapped", F.trim(F.regexp_replace("t", _GAPS, "  ")))
        .select(
            "doc_id",
            "t",
            # Each word has a blank of its own on both sides.
            F.when(F.col("gapped") == "", "")
            .otherwise(F.concat(F.lit(" "), "gapped", F.lit(" ")))
            .alias("words"),
            F.array_intersect(F.split("gapped", "  "), known).alias("has"),
        )
        .withColumn("n_words", _words_in(F.col("words")).cast("long"))
    )

    def blocks(kind: str) -> Column:
        """Template tokens of each block of a kind; none where no template can be met."""
        own = [t for t in templates if t.kind == kind]
        least = min((t.need for t in own), default=0)
        maybe = F.lit(False)
        for t in own:
            overlap = F.size(F.array_intersect("has", F.array(*[F.lit(w) for w in t.tokens])))
            maybe = maybe | (overlap >= t.need)
        found = F.transform(F.split("t", BREAKS[kind]), lambda x: F.array_intersect(F.split(x, _GAPS), known))
        return F.when((F.size("has") >= least) & maybe, F.filter(found, lambda x: F.size(x) >= least)).otherwise(
            F.array().cast("array<array<string>>")
        )

    found = framed.select(
        "doc_id",
        "n_words",
        "has",
        *[
            _places(F.col("words"), F.col("n_words"), p).alias(f"p{i}")
            for i, p in enumerate(phrases)
        ],
        *[blocks(kind).alias(kind) for kind in BREAKS],
    )
    none = F.lit(None).cast("long")
    labels = [F.when(c.isNotNull(), F.lit(x)) for c, x in zip(places, phrases.values(), strict=True)]
    return found.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        "n_words",
        sum((F.coalesce(c["n"], F.lit(0)) for c in places), F.lit(0).cast("long")).alias("n_base"),
        F.least(none, *[c["first"] for c in places]).alias("first_word"),
        F.greatest(none, *[c["last"] for c in places]).alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("base_found"),
        "has",
        *BREAKS,
    )


def template_matches(rows: DataFrame, templates: list[Template]) -> DataFrame:
    """(row, kind, block, template, told, containment): every block that meets a template, by the filtered join.

    rows has row, has (the template tokens of each text) and those of its blocks of each kind.
    told: whether the block has the template's telling tokens.
    """
    spark = rows.sparkSession
    blocks = reduce(
        DataFrame.unionByName,
        [
            rows.where(F.size(kind) > 0).select("row", F.lit(kind).alias("kind"), F.posexplode(kind).alias("block", "has"))
            for kind in BREAKS
        ],
    )
    counted = rows.select(F.explode("has").alias("token")).groupBy("token").count()
    # One row for each template token at most comes back.
    often = {r["token"]: r["count"] for r in counted.collect()}
    vocabulary = sorted({w for t in templates for w in t.tokens}, key=lambda w: (often.get(w, 0), w))
    rank = {w: i for i, w in enumerate(vocabulary)}
    ranks = F.create_map(*[F.lit(x) for w, i in rank.items() for x in (w, i)])
    prefixes = [
        (i, t.kind, sorted(rank[w] for w in t.tokens), [rank[w] for w in t.telling], t.need, place, token)
        for i, t in enumerate(templates)
        for place, token in enumerate(sorted(rank[w] for w in t.tokens)[: len(t.tokens) - t.need + 1])
    ]
    prefix = spark.createDataFrame(
        prefixes,
        "template int, kind string, wants array<int>, telling array<int>, need int, place int, token int",
    )
    ordered = blocks.select(
        "row",
        "kind",
        "block",
        F.array_sort(F.transform("has", lambda w: F.element_at(ranks, w))).alias("has"),
    )
    probes = ordered.select("row", "kind", "block", "has", F.posexplode("has").alias("at", "token"))
    left = F.least(F.size("wants") - F.col("place"), F.size("has") - F.col("at"))
    candidates = probes.join(F.broadcast(prefix), ["kind", "token"]).where(
        (F.size("has") >= F.col("need")) & (left >= F.col("need"))
    )
    overlap = F.size(F.array_intersect("has", "wants"))
    return (
        candidates.withColumn("overlap", overlap)
        .where("overlap >= need")
        .groupBy("row", "kind", "block", "template")
        .agg(
            F.max(F.col("overlap") / F.size("wants")).alias("containment"),
            F.max(F.size(F.array_except("telling", "has")) == 0).alias("told"),
        )
    )


def labelled(matches: DataFrame, templates: list[Template]) -> DataFrame:
    """(row, found, best, n_matches): the labels of each row, from the most telling templates of each block."""
    above = F.array(*[F.array(*map(F.lit, t.above)).cast("array<int>") for t in templates])
    label = F.array(*[F.lit(t.label) for t in templates])
    told = F.when(F.col("told"), F.col("template"))
    by_block = matches.groupBy("row", "kind", "block").agg(
        F.count("*").alias("n"),
        F.collect_set(told).alias("ids"),  # a set of templates, so no longer than their list
        F.collect_list(F.when(F.col("told"), F.struct("template", "containment"))).alias("met"),
    )
    kept = F.filter(
        "met", lambda m: ~F.arrays_overlap(F.element_at(above, m["template"] + 1), F.col("ids"))
    )
    return (
        by_block.select("row", "n", kept.alias("met"))
        .select(
            "row",
            "n",
            F.transform("met", lambda m: F.element_at(label, m["template"] + 1)).alias("labels"),
            F.array_max(F.transform("met", lambda m: m["containment"])).alias("best"),
        )
        .groupBy("row")
        .agg(
            F.array_distinct(F.flatten(F.collect_set("labels"))).alias("found"),
            F.max("best").alias("best"),
            F.sum("n").alias("n_matches"),
        )
    )


def license_scan(
    docs: DataFrame,
    phrases: dict[str, str] = PHRASES,
    templates: tuple[tuple, ...] = TEMPLATES,
    containment: float = CONTAINMENT,
) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_matches.

    n_matches counts the pairs of a block and a template that it meets, whether they give a label or not.
    """
    wanted = template_rows(templates, containment)
    rows = cut(scanned(docs, phrases, wanted))
    found = labelled(template_matches(rows, wanted), wanted)
    family = F.filter("found", lambda x: ~F.exists("found", lambda y: F.startswith(y, F.concat(x, F.lit("-")))))
    labels = F.array_union("base_found", F.coalesce(family, F.array().cast("array<string>")))
    return rows.join(found, "row", "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_found", ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.greatest(
            F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)
        ).alias("score"),
        F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"),
    )


def oracle() -> str:
    """DuckDB SQL for license_scan with the default phrases and templates."""
    values = ", ".join(
        f"({i}, '{t.label}', '{t.kind}', {t.tokens!r}, {t.need}, {t.telling!r})"
        for i, t in enumerate(template_rows(TEMPLATES, CONTAINMENT))
    )
    phrases = ", ".join(
        f"({p.split()!r}, {len(p.split())}, '{label}')" for p, label in PHRASES.items()
    )
    low = "coalesce(text, '')"
    for c in NOT_ASCII:
        low = f"replace({low}, '{c}', '\N{REPLACEMENT CHARACTER}')"
    blocks = " UNION ALL ".join(
        f"SELECT rid, '{kind}' AS kind, unnest(string_split_regex(t, '{at}')) AS part, generate_subscripts(string_split_regex(t, '{at}'), 1) AS block FROM d"
        for kind, at in BREAKS.items()
    )
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lower({low}) AS t FROM documents
), w AS (
  SELECT rid, doc_id, regexp_extract_all(t, '{ALNUM_WORD_RE}') AS ws FROM d
), p(words, k, label) AS (VALUES {phrases}
), s AS (
  SELECT rid, label, i - 1 AS pos
  FROM (SELECT rid, ws, unnest(generate_series(1, len(ws))) AS i FROM w), p
  WHERE ws[i] = words[1] AND ws[i:i + k - 1] = words
), b AS (
  SELECT rid, count(*) AS n, min(pos) AS first, max(pos) AS last,
         list(DISTINCT label) AS labels
  FROM s GROUP BY rid
), x(id, label, kind, words, need, telling) AS (VALUES {values}
), l AS (
  SELECT rid, kind, block, list_distinct(regexp_extract_all(part, '{ALNUM_WORD_RE}')) AS ws FROM ({blocks})
), m AS (
  SELECT rid, l.kind, block, id, label, telling, len(list_intersect(ws, words)) / len(words) AS share,
         len(list_intersect(ws, telling)) = len(telling) AS told
  FROM l JOIN x ON l.kind = x.kind WHERE len(ws) >= need AND len(list_intersect(ws, words)) >= need
), t AS (
  SELECT * FROM m WHERE told AND NOT EXISTS (
    SELECT 1 FROM m AS o WHERE o.told AND o.rid = m.rid AND o.kind = m.kind AND o.block = m.block
      AND len(o.telling) > len(m.telling) AND len(list_intersect(o.telling, m.telling)) = len(m.telling))
), a AS (
  SELECT rid, list(DISTINCT label) AS labels, max(share) AS best FROM t GROUP BY rid
), f AS (
  SELECT rid, best, list_filter(labels, lambda x: NOT list_bool_or(list_transform(labels, lambda y: starts_with(y, x || '-')))) AS labels
  FROM a
), c AS (
  SELECT rid, count(*) AS n FROM m GROUP BY rid
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base,
       b.first::BIGINT AS first_word, b.last::BIGINT AS last_word,
       array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ',') AS labels,
       greatest(coalesce(f.best, 0), CASE WHEN coalesce(b.n, 0) > 0 THEN 1 ELSE 0 END)::DOUBLE AS score,
       coalesce(c.n, 0)::BIGINT AS n_matches
FROM w LEFT JOIN b USING (rid) LEFT JOIN f USING (rid) LEFT JOIN c USING (rid)
"""
