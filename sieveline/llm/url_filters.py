"""URL filters: explicit host and path rules, then a path-template tree learned from the labelled urls.

The tree: each path segment is first generalised by its shape (numbers, hexadecimal names, dates, file
extensions), which leaves per host a small tree of templates. Level by level, the children of a node that look
like their siblings - whose share of bad labels is within ``Z`` standard errors of all siblings' share, or
that have no labels - are merged into one ``*`` branch; a child that differs keeps its name, among however many. A template is rejected if its labelled purity, smoothed towards
its parent's, reaches ``REJECT``. The parents' purities come from the rules' own verdicts, or from a label column.

Everything is summed over distinct (host, shape path) before any shuffle by node, so that a host with a third of
all urls is a few rows; the pages meet their template in an equi-join that adaptive execution can split.

Without a label column the labels are the verdicts of the rules, so that the tree carries those over to what the rules
don't name; with few rules it rejects little.

Defined results: a null url or one without ``://`` has empty host and path, which is a template of its own; a url is
read whole, to its last segment; a tie of labels is no evidence, and between rules of one length the later by name is
asked first; repeated rows are judged each by itself; other columns pass through, whatever their names - they travel as
one struct - and an input column that bears the name of an added one is replaced; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import ascii_lower, packed, written

#: (rule, verdict); the host is what stands before the first slash.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
#: Standard errors by which a branch may differ from its siblings and still be merged.
Z = 2.0
#: Weight, in urls, of the parent's purity.
WEIGHT = 4.0
REJECT = 0.75


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path as the rules see them."""
    u = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(u, "(?s)^.*?://([^/?#]*)", 1)), F.regexp_extract(u, "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fits(rule: str, host: Column, path: Column) -> Column:
    name, _, rest = rule.partition("/")
    return ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)


def matched(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest is asked first
        rule = F.when(fits(text, host, path), F.lit(text)).otherwise(rule)
        verdict = F.when(fits(text, host, path), F.lit(said)).otherwise(verdict)
    return rule, verdict


def shaped(path: Column) -> Column:
    """All segments, with variable parts generalised."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    one = lambda s: (
        F.when(s.rlike("^[0-9]+$"), "{n}")
        .when(s.rlike("^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), "{date}")
        .when(s.rlike("^[0-9a-fA-F]{8,}$|^[0-9a-fA-F]{8}-[0-9a-fA-F-]{27}$"), "{hex}")
        .when(s.rlike("^[0-9]+\\.[A-Za-z0-9]{1,5}$"), F.concat(F.lit("{n}."), F.substring_index(s, ".", -1)))
        .when(s.rlike("[0-9]"), F.regexp_replace(s, "[0-9]+", "{d}"))
        .otherwise(s)
    )
    return F.transform(parts, one)


def templates(urls: DataFrame) -> DataFrame:
    """From rows (host, shape, bad, good): host, shape, template, bad_share of every distinct shape path."""
    tree = written(urls.groupBy("host", "shape").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"), F.sum("good").alias("good")))
    whole = tree.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("b"), F.coalesce(F.sum("good"), F.lit(0)).alias("g")).first()
    # A host without labels isn't rejected for what others do.
    base = min(0.5, (whole["b"] + 1.0) / (whole["b"] + whole["g"] + 2.0))
    # The host is the root of its tree.
    root = tree.groupBy("host").agg(F.sum("bad").alias("b"), F.sum("good").alias("g"))
    root = root.select("host", ((F.col("b") + WEIGHT * base) / (F.col("b") + F.col("g") + WEIGHT)).alias("p"))
    tree = written(tree.join(root, "host").withColumn("template", F.lit("")))
    for d in count():  # until no path has a further segment
        seg = F.get("shape", F.lit(d))
        if tree.where(seg.isNotNull()).isEmpty():
            break
        child = tree.where(seg.isNotNull()).groupBy("host", "template", seg.alias("seg")).agg(F.sum("bad").alias("b"), F.sum("good").alias("g"), F.first("p").alias("p"))
        node = child.groupBy("host", "template").agg(F.sum("b").alias("nb"), F.sum("g").alias("ng"), F.count("*").alias("kinds"))
        both = child.join(node, ["host", "template"])
        share = (F.col("nb") + 1.0) / (F.col("nb") + F.col("ng") + 2.0)
        labelled = F.col("b") + F.col("g")
        off = F.abs(F.col("b") - labelled * share) / F.sqrt(F.greatest(labelled, F.lit(1)) * share * (1 - share))
        wild = (F.col("kinds") > 1) & ((labelled == 0) | (off <= Z))
        both = both.withColumn("name", F.when(wild, F.lit("*")).otherwise(F.col("seg")))
        branch = both.groupBy("host", "template", "name").agg(
            ((F.sum("b") + WEIGHT * F.first("p")) / (F.sum("b") + F.sum("g") + WEIGHT)).alias("np")
        )
        step = both.select("host", "template", "seg", "name").join(branch, ["host", "template", "name"])
        tree = written(
            tree.withColumn("seg", seg).join(step, ["host", "template", "seg"], "left")
            .select("host", "shape", "n", "bad", "good", F.coalesce("np", "p").alias("p"),
                    F.when(F.col("name").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "name")).alias("template"))
        )
    return tree.select("host", "shape", "template", F.col("p").alias("bad_share"))


def judge(pages: DataFrame, rules=RULES, url: str = "url", label: str | None = None) -> DataFrame:
    """The pages with host, path, rule, template, bad_share and verdict; ``label``: a column, 1 for bad and 0 for good."""
    own = [F.col(f"_row.`{c}`") for c in pages.columns if c.lower() not in ("host", "path", "rule", "template", "bad_share", "verdict")]
    host, path = split_url(F.col(f"`{url}`"))
    a = packed(pages, host=host, path=path)
    rule, said = matched(F.col("host"), F.col("path"), rules)
    a = a.select("_row", "host", "path", rule.alias("rule"), said.alias("_said"), shaped(F.col("path")).alias("shape"))
    bad = F.col(f"_row.`{label}`") if label else F.when(F.col("_said") == "block", 1).when(F.col("_said") == "allow", 0)
    learned = templates(a.select("host", "shape", (bad == 1).cast("long").alias("bad"), (bad == 0).cast("long").alias("good")).na.fill(0, ["bad", "good"]))
    verdict = F.coalesce("_said", F.when(F.col("bad_share") >= REJECT, "block").otherwise("allow"))
    return a.join(learned, ["host", "shape"], "left").select(*own, "host", "path", "rule", "template", "bad_share", verdict.alias("verdict"))
