"""Link filters: rules first, then token combinations mined by FP-growth from the links the rules judge."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE_ROWS = 50_000  # index rows that are broadcast; beyond, the index is joined by token
VERDICT = "verdict:"


def split_link(links: DataFrame) -> DataFrame:
    """Adds host (A-Z lower-cased) and path of ``url``; both empty for null or without ``://``."""
    url = F.coalesce(F.col("url"), F.lit(""))
    return links.withColumns({
        "host": F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER),
        "path": F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1),
    })


def rule_of(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, say in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name = F.when(fits, F.lit(host + path)).otherwise(name)
        verdict = F.when(fits, F.lit(say)).otherwise(verdict)
    return name, verdict


def link_tokens() -> Column:
    """Distinct tokens: labels of the host, path segments with digits as 0, scheme, query names."""
    url = F.coalesce(F.col("url"), F.lit(""))
    labels = F.transform(F.split("host", r"\."), lambda x: F.concat(F.lit("host:"), x))
    ends = F.array(F.concat(F.lit("top:"), F.element_at(F.split("host", r"\."), -1)))
    segments = F.transform(F.split("path", "/"), lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, "[0-9]+", "0")))
    names = F.transform(F.split(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "&"), lambda x: F.concat(F.lit("query:"), F.split(x, "=")[0]))
    scheme = F.array(F.concat(F.lit("scheme:"), F.regexp_extract(url, r"(?s)^(.*?)://", 1)))
    every = F.concat(labels, ends, segments, names, scheme)
    return F.array_sort(F.array_distinct(F.filter(every, lambda x: ~x.endswith(":"))))


def mine_rules(judged: DataFrame, support: float, confidence: float, words: int, least_links: int) -> DataFrame | None:
    """(antecedent, verdict, confidence, support) over judged(tokens, verdict); None with too few links.

    Only associations from at most ``words`` link tokens to a verdict are kept. A rule is
    pruned if one token of its antecedent, or all but one, gives the same verdict with no
    less confidence.
    """
    total = judged.count()
    if total < least_links:
        return None
    support = max(support, least_links / total)
    # tokens under the support are in no frequent combination and those of nearly all links tell nothing: at most (tokens a link) / support are left
    common = judged.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n").between(support * total, 0.98 * total))
    held = sorted(r.token for r in common.collect())
    if not held:
        return None
    items = judged.select(F.concat(F.filter("tokens", lambda x: x.isin(held)), F.array(F.concat(F.lit(VERDICT), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    found = model.associationRules.where(F.col("consequent")[0].startswith(VERDICT)).where(~F.exists("antecedent", lambda x: x.startswith(VERDICT)) & (F.size("antecedent") <= words))
    rules = written(found.select(
        F.array_sort("antecedent").alias("antecedent"), F.expr(f"substr(consequent[0], {len(VERDICT) + 1})").alias("verdict"), "confidence", "support",
    ), "rules")
    ones, rest = F.transform("antecedent", lambda x: F.array(x)), F.transform("antecedent", lambda x: F.array_except("antecedent", F.array(x)))
    parts = rules.select("antecedent", "verdict", "confidence", F.explode(F.concat(ones, rest)).alias("part")).where(F.size("part") < F.size("antecedent"))
    surer = rules.select(F.col("antecedent").alias("part"), "verdict", F.col("confidence").alias("sure"))
    needless = parts.join(surer, ["part", "verdict"]).where("sure >= confidence").select("antecedent", "verdict")
    out = written(rules.join(needless, ["antecedent", "verdict"], "left_anti"), "mined")
    discard(rules)
    return out


def judge_links(links: DataFrame, rules: list[tuple[str, str, str]], support: float = 0.005, confidence: float = 0.8, words: int = 3,
                least_links: int = 20, default: str = "allow") -> DataFrame:
    """A verdict for each outgoing link of a page: its rule's, else that of mined token combinations.

    links(link_id, url). ``rules`` are (host, path, verdict): a rule fits its host and all
    subdomains, if the link's path starts with the rule's; the longest wins. Links that a
    rule judges are the labels: FP-growth mines their token combinations, and rules of
    enough support (a share, and ``least_links`` links) and confidence judge the others. Of several that match, the surest
    wins, then the better supported, the longer, the first by name. Without a match:
    ``default``.

    Returns per link row: link_id, url, host, path, rule (like ``net/``, else null), verdict,
    matched (the mined combination, comma-joined, else null), confidence (1.0 for a rule,
    else the mined rule's or null).

    Null url or one without ``://``: empty host and path, no rule and no token, ``default``.
    Repeated rows give repeated rows; no labelled link means no mined rule; an empty
    table gives an empty one. Other columns are ignored.
    """
    name, say = rule_of(rules)
    given = split_link(links.select("link_id", "url")).withColumns({"rule": name, "said": say}).withColumn("tokens", link_tokens())
    labelled = given.where("said IS NOT NULL").select("tokens", F.col("said").alias("verdict"))
    mined = mine_rules(labelled, support, confidence, words, least_links)
    if mined is None:
        return given.select("link_id", "url", "host", "path", "rule", F.coalesce("said", F.lit(default)).alias("verdict"),
                            F.lit(None).cast("string").alias("matched"), F.when(F.col("rule").isNotNull(), 1.0).alias("confidence"))
    index = mined.select(F.col("antecedent")[0].alias("token"), "antecedent", F.col("verdict").alias("mined"), "confidence", "support")
    few = mined.count() <= RULE_ROWS
    rows = given.withColumn("row_no", F.monotonically_increasing_id())
    asked = rows.where("said IS NULL").select("row_no", "link_id", "url", "host", "path", "tokens", F.explode_outer("tokens").alias("token"))
    hits = asked.join(F.broadcast(index) if few else index, "token", "left")
    fits = F.col("antecedent").isNotNull() & (F.size(F.array_except("antecedent", "tokens")) == 0)
    best = F.max(F.when(fits, F.struct("confidence", "support", F.size("antecedent").alias("size"), F.array_join("antecedent", ",").alias("matched"), "mined")))
    open_ = hits.groupBy("row_no", "link_id", "url", "host", "path").agg(best.alias("best")).select(
        "link_id", "url", "host", "path", F.lit(None).cast("string").alias("rule"), F.coalesce("best.mined", F.lit(default)).alias("verdict"),
        F.col("best.matched").alias("matched"), F.col("best.confidence").alias("confidence"),
    )
    ruled = rows.where("said IS NOT NULL").select(
        "link_id", "url", "host", "path", "rule", F.col("said").alias("verdict"), F.lit(None).cast("string").alias("matched"), F.lit(1.0).alias("confidence"),
    )
    return ruled.unionByName(open_)
