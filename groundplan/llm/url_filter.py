"""URL filters: suffix rules, and path-template trees where no rule fits; built-in functions only.

A rule is a host suffix with a path prefix, ``allow`` or ``block``; of the rules that fit
a URL the longest decides. The others are judged by a tree of path templates per host:

* A URL's path is cut at ``/`` into segments, each first reduced to its shape: digits
  become ``#``, hexadecimal strings of 8 and more with digits and letters ``%``;
  everything else is kept.
* Going down the tree, a branch becomes a wildcard ``*`` if it is variable (less than
  ``SUPPORT`` pages of its host below it) or statistically like its siblings: its share
  of labelled bad pages does not differ from that of all its siblings together by more
  than ``Z`` standard errors. Branches that differ are kept apart. Every level is one
  aggregation by (host, template so far, segment) and one by (host, template so far).
  A path below whose template there is no other path is finished with its segments as
  they are, so there are as many levels as different paths of a host have in common, not
  as many as the deepest path has.
* A template's badness is its labelled bad share, smoothed by ``PRIOR`` pages of its
  host's share, which in turn is smoothed by the overall share, a quarter if nothing is
  labelled. At ``REJECT`` or more the template's pages are blocked; so none are without a label.

Labels come as (url, bad) pairs; here a page is bad if the document that its URL's last
number names is labelled of quality 0. Only aggregates are joined back, by keys that are
aggregated map-side first; the size of a broadcast side is left to Spark.

A null URL or one without ``://`` has an empty host and path, which no rule fits; it is
judged as part of the empty host. Repeated rows are judged alike and count as often as
they come. Other columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundplan.llm.common import table, written

#: Fixed rules: (verdict, host suffix, path prefix).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
SUPPORT = 4
Z = 1.96
PRIOR = 8
REJECT = 0.5


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, suffix, prefix in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(prefix)
        rule, verdict = F.when(fits, suffix + prefix).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def shape(segment: Column) -> Column:
    hexed = segment.rlike(r"^[0-9A-Fa-f]{8,}$") & segment.rlike(r"[0-9]") & segment.rlike(r"[A-Fa-f]")
    return F.when(hexed, "%").otherwise(F.regexp_replace(segment, r"[0-9]+", "#"))


def segments(path: Column) -> Column:
    """The shapes of all segments of a path."""
    return F.transform(F.split(F.substr(path, F.lit(2)), "/"), shape)


def grown(tree: DataFrame, depth: int) -> DataFrame:
    """``tree`` (host, shapes, n, seen, bad, template), whose templates are ``depth`` segments long, with one more, and whether it is ``done``."""
    here = tree.withColumn("segment", F.get("shapes", F.lit(depth)))
    sums = [F.sum("n").alias("n"), F.sum("seen").alias("seen"), F.sum("bad").alias("bad")]
    branches = here.groupBy("host", "template", "segment").agg(*sums, F.count("*").alias("leaves"))
    pooled = branches.groupBy("host", "template").agg(F.sum("seen").alias("all_seen"), F.sum("bad").alias("all_bad"), F.count("*").alias("siblings"), F.sum("leaves").alias("all_leaves"))
    rest_seen, rest_bad = F.col("all_seen") - F.col("seen"), F.col("all_bad") - F.col("bad")
    mean = (F.col("all_bad") + 1) / (F.col("all_seen") + 2)
    error = F.sqrt(mean * (1 - mean) * (1 / F.greatest("seen", F.lit(1)) + 1 / F.greatest(rest_seen, F.lit(1))))
    apart = F.abs(F.col("bad") / F.greatest("seen", F.lit(1)) - rest_bad / F.greatest(rest_seen, F.lit(1))) > Z * error
    kept = (F.col("siblings") == 1) | ((F.col("n") >= SUPPORT) & (F.col("seen") > 0) & (rest_seen > 0) & apart)
    named = branches.join(pooled, ["host", "template"]).select(F.col("host").alias("h"), F.col("template").alias("t"), F.col("segment").alias("s"), F.when(kept, F.col("segment")).otherwise("*").alias("name"), (F.col("all_leaves") == 1).alias("alone"))
    joined = here.join(named, (F.col("host") == F.col("h")) & (F.col("template") == F.col("t")) & F.col("segment").eqNullSafe(F.col("s")))
    rest = F.slice("shapes", F.lit(depth + 1), F.size("shapes"))
    tail = F.when(F.col("segment").isNull(), "").when(F.col("alone"), F.concat(F.lit("/"), F.array_join(rest, "/"))).otherwise(F.concat(F.lit("/"), "name"))
    return joined.select("host", "shapes", "n", "seen", "bad", F.concat("template", tail).alias("template"), (F.col("segment").isNull() | F.col("alone")).alias("done"))


def templates(pages: DataFrame) -> DataFrame:
    """Per (host, shapes): its ``template`` and smoothed ``badness``. ``pages``: host, shapes, bad (null if not labelled)."""
    leaves = pages.groupBy("host", "shapes").agg(F.count("*").alias("n"), F.count("bad").alias("seen"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    level = written(leaves.select("*", F.lit("").alias("template"), F.lit(False).alias("done")), "templates")  # each level reads it three times
    finished, depth = level.where("done"), 0
    while not level.where("not done").isEmpty():
        level = written(grown(level.where("not done").drop("done"), depth), "templates")
        finished, depth = finished.unionByName(level.where("done")), depth + 1
    tree = finished.drop("done")
    by_template = tree.groupBy("host", "template").agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad"))
    by_host = by_template.groupBy("host").agg(F.sum("seen").alias("host_seen"), F.sum("bad").alias("host_bad"))
    overall = by_host.agg(F.sum("host_seen").alias("seen"), F.sum("host_bad").alias("bad")).first()  # two numbers
    share = ((overall.bad or 0.0) + 1) / ((overall.seen or 0.0) + 4)
    host_share = (F.col("host_bad") + PRIOR * F.lit(share)) / (F.col("host_seen") + PRIOR)
    scored = by_template.join(by_host, "host").select("host", "template", ((F.col("bad") + PRIOR * host_share) / (F.col("seen") + PRIOR)).alias("badness"))
    return tree.select("host", "shapes", "template").join(scored, ["host", "template"])


def judge(pages: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES) -> DataFrame:
    """Per row: id, host, path, rule, verdict, template and badness. ``labelled``: (key, bad) by the URL's last number."""
    url = F.col(url_col)
    parsed = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    key = F.expr("try_cast(regexp_extract(path, '(\\\\d+)[^/0-9]*/?$', 1) AS bigint)")
    work = parsed.select(id_col, "host", "path", rule.alias("rule"), verdict.alias("by_rule"), key.alias("key"), segments(F.col("path")).alias("shapes"))
    # pages without a number match nothing, and are dealt out by their id so as not to meet in one task
    place = F.coalesce("key", F.xxhash64(id_col))
    joined = work.join(labelled.select(F.col("key").alias("label_key"), "bad"), (place == F.col("label_key")) & F.col("key").isNotNull(), "left")
    scored = templates(joined.select("host", "shapes", "bad")).select(F.col("host").alias("h"), F.col("shapes").alias("s"), "template", "badness")
    judged = work.join(scored, (F.col("host") == F.col("h")) & F.col("shapes").eqNullSafe(F.col("s")), "left")
    return judged.select(id_col, "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("badness") >= REJECT, "block").otherwise("allow")).alias("verdict"), "template", F.round("badness", 6).alias("badness"))


def labels_of(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(key, bad), one row per labelled id; of several labels the worst counts."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    return known.groupBy(F.col(id_col).alias("key")).agg(F.max((F.col(label_col) == 0).cast("int")).alias("bad"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), labels_of(table(spark, sf_dir, "labels")))


def _oracle() -> str:
    """The same tree in SQL: a step of the recursion for each level, down to the deepest path, without the shortcut for lone paths."""
    shaped = "CASE WHEN regexp_matches(x, '^[0-9A-Fa-f]{8,}$') AND regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Fa-f]') THEN '%' ELSE regexp_replace(x, '[0-9]+', '#', 'g') END"
    rules = sorted(RULES, key=lambda r: -len(r[1]) - len(r[2]))
    fits = lambda suffix, prefix: f"(host = '{suffix}' OR ends_with(host, '.{suffix}')) AND starts_with(path, '{prefix}')"
    rule = "CASE " + " ".join(f"WHEN {fits(s, p)} THEN '{s}{p}'" for _, s, p in rules) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(s, p)} THEN '{k}'" for k, s, p in rules) + " END"
    mean = "((all_bad + 1.0) / (all_seen + 2))"
    rest = "greatest(all_seen - b_seen, 1)"
    error = f"sqrt({mean} * (1 - {mean}) * (1.0 / greatest(b_seen, 1) + 1.0 / {rest}))"
    apart = f"abs(b_bad * 1.0 / greatest(b_seen, 1) - (all_bad - b_bad) * 1.0 / {rest}) > {Z} * {error}"
    kept = f"siblings = 1 OR (b_n >= {SUPPORT} AND b_seen > 0 AND all_seen - b_seen > 0 AND {apart})"
    return f"""WITH RECURSIVE labelled AS (SELECT doc_id AS key, max(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
parsed AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*(/[^?#]*)', 1), '') AS path FROM pages),
work AS (SELECT page_id, host, path, {rule} AS rule, {verdict} AS by_rule, TRY_CAST(regexp_extract(path, '([0-9]+)[^/0-9]*/?$', 1) AS BIGINT) AS key, list_transform(string_split(substr(path, 2), '/'), lambda x: {shaped}) AS shapes FROM parsed),
leaves AS (SELECT host, shapes, CAST(count(*) AS DOUBLE) AS n, CAST(count(bad) AS DOUBLE) AS seen, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS bad FROM work LEFT JOIN labelled ON work.key = labelled.key GROUP BY host, shapes),
deepest AS (SELECT max(len(shapes)) AS m FROM leaves),
tree AS (SELECT host, shapes, n, seen, bad, '' AS template, 0 AS d FROM leaves
 UNION ALL
 SELECT host, shapes, n, seen, bad, concat(template, CASE WHEN segment IS NULL THEN '' WHEN {kept} THEN concat('/', segment) ELSE '/*' END), d + 1
 FROM (SELECT *, sum(CASE WHEN nth = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY host, template) AS siblings FROM
  (SELECT *, sum(n) OVER (PARTITION BY host, template, segment) AS b_n, sum(seen) OVER (PARTITION BY host, template, segment) AS b_seen, sum(bad) OVER (PARTITION BY host, template, segment) AS b_bad,
    row_number() OVER (PARTITION BY host, template, segment ORDER BY shapes) AS nth, sum(seen) OVER (PARTITION BY host, template) AS all_seen, sum(bad) OVER (PARTITION BY host, template) AS all_bad
   FROM (SELECT tree.*, shapes[d + 1] AS segment FROM tree, deepest WHERE d < m) a) b) c),
last AS (SELECT tree.* FROM tree, deepest WHERE d = m),
bt AS (SELECT host, template, CAST(sum(seen) AS DOUBLE) AS seen, CAST(sum(bad) AS DOUBLE) AS bad FROM last GROUP BY 1, 2),
bh AS (SELECT host, sum(seen) AS host_seen, sum(bad) AS host_bad FROM bt GROUP BY 1),
al AS (SELECT (sum(host_bad) + 1) / (sum(host_seen) + 4) AS share FROM bh),
sc AS (SELECT bt.host, template, (bad + {PRIOR} * ((host_bad + {PRIOR} * share) / (host_seen + {PRIOR}))) / (seen + {PRIOR}) AS badness FROM bt JOIN bh ON bt.host = bh.host CROSS JOIN al)
SELECT w.page_id, w.host, w.path, w.rule, coalesce(w.by_rule, CASE WHEN sc.badness >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, t.template, round(sc.badness, 6) AS badness
FROM work w LEFT JOIN last t ON w.host = t.host AND w.shapes = t.shapes LEFT JOIN sc ON sc.host = t.host AND sc.template = t.template"""


ORACLE_SQL = _oracle()
