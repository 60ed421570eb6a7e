"""URL filtering by rules and a path-template tree, in DataFrame operations only.

Rules of host and path prefix decide first, the longest that fits.  The other
URLs are judged by a tree of path templates for each host, which counts all
pages, also those that a rule fits.  Level by level, as deep as paths go, a
segment becomes a wildcard where it varies too much under its branch (numbers
and hashes always do), and a fixed segment is merged into the wildcard where
its rate of bad pages differs from its siblings' by no more than chance.  A
template is rejected if enough labelled pages fall under it and its purity,
smoothed towards its host's and the overall rate, is high.

Pages are counted by host, path shape and number before anything is joined, and
a join whose key many rows share (a host with a third of all pages, the page
number 1) deals that key out over several tasks.

Defined results: a null URL or one without '://' has an empty host and path,
fits no rule and is allowed; rows that repeat are judged once each; without
labels every URL that fits no rule is allowed; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, joined_evenly

#: The base rules (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: A branch with so many children, and so many for each page, has variable segments.
LEAST_CHILDREN = 12
VARIABLE_SHARE = 0.5
#: Standard errors by which a branch must differ from its siblings to stay apart.
APART = 2.58
#: Pages that the prior rates weigh like, labelled pages a verdict needs, and the purity to reject.
SMOOTHING = 5.0
LEAST_LABELLED = 5
PURITY = 0.6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_VARIABLE = r"^([0-9]+|[0-9a-fA-F-]{16,})(\.[A-Za-z0-9]+)?$"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host and path as text) and its verdict; null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _counted(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, raw, n, n_labelled, n_bad): a page is labelled as the document whose number ends its path."""
    number = F.expr("try_cast(regexp_extract(path, '([0-9]{1,18})[^0-9]*$', 1) AS bigint)")
    shapes = cut(pages.groupBy("host", "raw", number.alias("number")).agg(F.count("*").alias("n")))
    known = (
        labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)")
        .groupBy(F.col("doc_id").alias("number"))
        .agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
        .where("bad IS NOT NULL")
    )
    often = shapes.where("number IS NOT NULL").groupBy("number").agg(F.count("*").alias("shapes"))
    told = cut(known.join(often, "number"))  # only labels that a page has
    labelled = joined_evenly(
        shapes.where("number IS NOT NULL"), told, ["number"], "shapes", F.struct("host", "raw")
    ).select("host", "raw", F.lit(0).cast("long").alias("n"), F.col("n").alias("n_labelled"), (F.col("n") * F.col("bad")).alias("n_bad"))
    none = F.lit(0).cast("long")
    counts = shapes.select("host", "raw", "n", none.alias("n_labelled"), none.alias("n_bad")).unionByName(labelled)
    return counts.groupBy("host", "raw").agg(*[F.sum(c).alias(c) for c in ("n", "n_labelled", "n_bad")])


def _level(tree: DataFrame, total: int) -> DataFrame:
    """Settles the next segment of every branch: kept, or '*'.  A path without one stays as it is.

    Where no segment of a branch could be told from its siblings, now or further down, the rest of its
    paths is settled at once: a path has it to itself, its labelled pages are all good or all bad, or
    they are so few that even a perfect split would be no more than chance.
    """
    branch = ["host", "t"]
    told = tree.withColumn("seg", F.coalesce(F.get("parts", F.lit(0)), F.lit("")))
    child = cut(
        told.groupBy(*branch, "seg").agg(
            F.sum("n").alias("c_n"), F.sum("n_labelled").alias("c_l"), F.sum("n_bad").alias("c_b"), F.count("*").alias("paths")
        )
    )
    parent = child.groupBy(*branch).agg(
        F.count("*").alias("children"),
        F.sum("c_n").alias("p_n"),
        F.sum("c_l").alias("p_l"),
        F.sum("c_b").alias("p_b"),
        F.sum("paths").alias("all_paths"),
    )
    others = F.col("p_l") - F.col("c_l")
    rate = F.try_divide("p_b", "p_l")
    apart = F.abs(
        F.try_divide("c_b", "c_l") - F.try_divide(F.col("p_b") - F.col("c_b"), others)
    ) > APART * F.sqrt(rate * (1 - rate) * (F.try_divide(F.lit(1.0), F.col("c_l")) + F.try_divide(F.lit(1.0), others)))
    variable = (F.col("children") >= LEAST_CHILDREN) & (
        F.col("children") > VARIABLE_SHARE * F.col("p_n")
    )
    settled = (
        F.when(F.col("seg") == "", "")
        .when((F.col("seg") == "*") | variable, "*")
        .when(F.coalesce(apart, F.lit(False)), F.col("seg"))
        .otherwise("*")
    )
    known = joined_evenly(child, parent.withColumn("kids", F.col("children")), branch, "kids", F.col("seg"), total)
    at_once = (
        (F.col("all_paths") == 1) | (F.col("p_l") <= APART**2) | (F.col("p_b") == 0) | (F.col("p_b") == F.col("p_l"))
    )
    said = known.select(*branch, "seg", settled.alias("new"), at_once.alias("at_once"), "paths")
    rest = F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0)))
    whole = F.concat("t", F.array_join(F.transform("parts", lambda _: F.lit("/*")), ""))
    return joined_evenly(told, said, [*branch, "seg"], "paths", F.col("raw"), total).select(
        "host",
        "raw",
        F.when(F.col("at_once"), whole)
        .otherwise(F.concat("t", F.when(F.col("new") == "", "").otherwise(F.concat(F.lit("/"), "new"))))
        .alias("t"),
        F.when(F.col("at_once"), F.lit(None)).when(F.col("seg") != "", rest).alias("parts"),
        "n",
        "n_labelled",
        "n_bad",
    )


def templates(counts: DataFrame) -> DataFrame:
    """(host, raw, template, n, n_labelled, n_bad, purity, reject) of every raw path.

    counts has host, raw (the path with '*' for numbers and hashes), n, n_labelled and n_bad.
    The loop goes as deep as good and bad labelled pages stand together under one branch.
    """
    columns = ["host", "raw", "t", "n", "n_labelled", "n_bad"]
    level = cut(
        counts.select(
            "host",
            "raw",
            F.lit("").alias("t"),
            F.filter(F.split("raw", "/"), lambda x: x != "").alias("parts"),
            "n",
            "n_labelled",
            "n_bad",
        )
    )
    paths = level.count()
    settled = level.where("parts IS NULL").select(columns)
    while not level.isEmpty():
        level = cut(_level(level, paths))  # else each level would read those before it several times
        settled = settled.unionByName(level.where("parts IS NULL").select(columns))
        level = level.where("parts IS NOT NULL")
    total = settled.agg(F.sum("n_bad").alias("b"), F.sum("n_labelled").alias("l")).first()
    overall = (total["b"] or 0) / max(1, total["l"] or 0)

    def smoothed(bad: str, labelled: str, prior: Column) -> Column:
        return (F.col(bad) + SMOOTHING * prior) / (F.col(labelled) + SMOOTHING)

    per_template = cut(
        settled.groupBy("host", F.col("t").alias("template")).agg(
            F.sum("n_bad").alias("b"), F.sum("n_labelled").alias("l"), F.count("*").alias("paths")
        )
    )
    hosts = (
        per_template.groupBy("host")
        .agg(F.sum("b").alias("h_b"), F.sum("l").alias("h_l"), F.count("*").alias("templates"))
        .select("host", smoothed("h_b", "h_l", F.lit(overall)).alias("prior"), "templates")
    )
    judged = (
        joined_evenly(per_template, hosts, ["host"], "templates", F.col("template"), paths)
        .withColumn("purity", smoothed("b", "l", F.col("prior")))
        .withColumn("reject", (F.col("l") >= LEAST_LABELLED) & (F.col("purity") >= PURITY))
    )
    rows = settled.select("host", "raw", F.col("t").alias("template"), "n")
    return joined_evenly(rows, judged, ["host", "template"], "paths", F.col("raw"), paths).select(
        "host", "raw", "template", "n", F.col("l").alias("n_labelled"), F.col("b").alias("n_bad"), "purity", "reject"
    )


def judged_urls(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, template and purity (null where a rule fits)."""
    host, path = split_url(F.col("url"))
    base = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    raw = F.array_join(
        F.transform(
            F.filter(F.split("path", "/"), lambda x: x != ""),
            lambda x: F.when(x.rlike(_VARIABLE), "*").otherwise(x),
        ),
        "/",
    )
    ruled = base.withColumns({"rule": rule, "said": said, "raw": raw})
    hosted = ruled.where("host <> ''")
    found = cut(templates(_counted(hosted.select("host", "raw", "path"), labels)).select("host", "raw", "template", "purity", "reject", "n"))
    # Rows in the order of the table's files: the same in every run, and different for rows that repeat.
    placed = hosted.withColumn("_at", F.monotonically_increasing_id())
    columns = ["page_id", "host", "path", "rule", "said"]
    free = F.col("rule").isNull()
    joined = (
        joined_evenly(placed, found, ["host", "raw"], "n", F.col("_at"))
        .select(
            *columns,
            F.when(free, F.col("reject")).alias("reject"),
            F.when(free, F.col("template")).alias("template"),
            F.when(free, F.col("purity")).alias("purity"),
        )
        .unionByName(ruled.where("host = ''").select(columns), allowMissingColumns=True)
    )
    return joined.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("said", F.when(F.col("reject"), "block").otherwise("allow")).alias("verdict"),
        "template",
        F.round("purity", 6).alias("purity"),
    )


def oracle() -> str:
    """DuckDB SQL for judged_urls with the default rules."""
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [
        f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in ordered
    ]
    rule = " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, ordered, strict=True))
    said = " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(fits, ordered, strict=True))

    return rf"""
WITH RECURSIVE u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), v AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r AS (
  SELECT *, CASE {rule} END AS rule, CASE {said} END AS said,
         array_to_string(list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''),
           lambda x: CASE WHEN regexp_matches(x, '{_VARIABLE}') THEN '*' ELSE x END), '/') AS raw
  FROM v
), k AS (
  SELECT doc_id AS number, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1
    WHEN quality IS NOT NULL AND toxic IS NOT NULL THEN 0 END) AS bad
  FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY 1
), e AS (
  SELECT host, raw, count(*) AS n, count(bad) AS l, coalesce(sum(bad), 0)::BIGINT AS b
  FROM (SELECT *, try_cast(regexp_extract(path, '([0-9]{{1,18}})[^0-9]*$', 1) AS BIGINT) AS number FROM r WHERE host <> '')
  LEFT JOIN k USING (number) GROUP BY host, raw
), v0(host, raw, t, parts, n, l, b) AS (
  SELECT host, raw, '', list_filter(string_split(raw, '/'), lambda x: x <> ''), n, l, b FROM e
  UNION ALL
  SELECT host, raw, t || CASE WHEN seg = '' THEN '' WHEN seg <> '*' AND NOT (kids >= {LEAST_CHILDREN} AND kids > {VARIABLE_SHARE} * pn)
      AND coalesce(abs(cb / nullif(cl, 0) - (pb - cb) / nullif(pl - cl, 0)) > {APART} * sqrt(
        (pb / nullif(pl, 0)) * (1 - pb / nullif(pl, 0)) * (1.0 / nullif(cl, 0) + 1.0 / nullif(pl - cl, 0))), false)
    THEN '/' || seg ELSE '/*' END, CASE WHEN seg <> '' THEN parts[2:] END, n, l, b
  FROM (SELECT *, count(DISTINCT seg) OVER (PARTITION BY host, t) AS kids, sum(n) OVER (PARTITION BY host, t) AS pn,
          sum(l) OVER (PARTITION BY host, t) AS pl, sum(b) OVER (PARTITION BY host, t) AS pb,
          sum(l) OVER (PARTITION BY host, t, seg) AS cl, sum(b) OVER (PARTITION BY host, t, seg) AS cb
        FROM (SELECT *, coalesce(parts[1], '') AS seg FROM v0 WHERE parts IS NOT NULL))
), z0 AS (SELECT * FROM v0 WHERE parts IS NULL
), o AS (
  SELECT coalesce(sum(b), 0) / greatest(1, coalesce(sum(l), 0)) AS overall FROM z0
), h AS (
  SELECT host, (sum(b) + {SMOOTHING} * any_value(overall)) / (sum(l) + {SMOOTHING}) AS prior
  FROM z0, o GROUP BY host
), j AS (
  SELECT host, t, sum(l) AS n_l, (sum(b) + {SMOOTHING} * any_value(prior)) / (sum(l) + {SMOOTHING}) AS purity
  FROM z0 JOIN h USING (host) GROUP BY host, t
), z AS (
  SELECT host, raw, t AS template, purity, n_l >= {LEAST_LABELLED} AND purity >= {PURITY} AS reject
  FROM z0 JOIN j USING (host, t)
)
SELECT page_id, r.host, path, rule,
       coalesce(said, CASE WHEN reject THEN 'block' ELSE 'allow' END) AS verdict,
       template, round(purity, 6) AS purity
FROM r LEFT JOIN z ON r.host = z.host AND r.raw = z.raw AND rule IS NULL
"""
