"""Links between pages and files: extraction, classes, closure, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.operators.versions import reach
from spanframe.functions import text as tx
from spanframe.plans import findings as fd

# Fixed patterns of the recognised reference forms.
ATTRIBUTES = r"""(?i)\s(src|href|poster|data|srcset)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
TAG = r"(?s)<[a-zA-Z][^>]*>"
SCRIPT = r"(?is)<script[^>]*>(.*?)</script>"
STYLE = r"(?is)<style[^>]*>(.*?)</style>"
CSS = r"""(?i)url\(\s*['"]?([^'")\s]+)['"]?\s*\)|@import\s+['"]([^'"\n]+)['"]"""
JS_STATIC = r"""\b(?:import|export)\s+(?:[^;\n]*?\s+from\s+)?['"]([^'"\n]+)['"]"""

JS_CALL = r"""\b(?:fetch|import)\s*\(\s*([^)]*)\)|\bnew\s+URL\s*\(\s*([^,)]*)"""
LITERAL = r"""^['"]([^'"\n]+)['"](?:\s*,|\s*$)"""


def _found(text, pattern, groups):
    out = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in range(1, groups + 1)]
    return F.filter(F.flatten(F.array(*out)), lambda x: x != "")


def _calls(scripts):
    """The argument texts of loading calls; both groups of the pattern in one list, an empty argument too."""

    def of(script):
        first, second = (F.regexp_extract_all(script, F.lit(JS_CALL), F.lit(g)) for g in (1, 2))
        return F.zip_with(first, second, lambda a, b: tx.strip(F.when(a != "", a).otherwise(b)))

    return F.flatten(F.transform(scripts, of))


def dynamic_links(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """GR1 findings: loading calls whose target is computed, so that a reader has to look at them."""
    scripts = F.regexp_extract_all(html, F.lit(SCRIPT), F.lit(1))
    targets = F.transform(_calls(scripts), lambda e: tx.strip(F.split(e, ",", 2)[0]))
    rows = pages.select(F.col(id_col), F.explode(F.array_distinct(F.filter(targets, lambda t: ~t.rlike(LITERAL)))).alias("expression"))
    return fd.finding(rows, "DYNAMIC_RESOURCE_NEEDS_REVIEW", F.lit(True), F.col(id_col).cast("string"), work=id_col, evidence=F.col("expression"))


def extract_links(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """GR1: distinct references of each page: attributes, srcset, CSS, static imports, and the
    literal arguments of ``fetch()``, ``import()`` and ``new URL()``.

    References that start with ``#`` or ``data:`` are dropped, and everything inside
    script and style bodies counts only through their own patterns.
    """
    scripts, styles = F.regexp_extract_all(html, F.lit(SCRIPT), F.lit(1)), F.regexp_extract_all(html, F.lit(STYLE), F.lit(1))
    tags = F.array_join(F.regexp_extract_all(F.regexp_replace(F.regexp_replace(html, r"(?is)(<script[^>]*>).*?</script>", "$1"), r"(?is)(<style[^>]*>).*?</style>", "$1"), F.lit(TAG), F.lit(0)), "\n")
    names = F.transform(F.regexp_extract_all(tags, F.lit(ATTRIBUTES), F.lit(1)), lambda x: F.lower(x))
    raw = F.regexp_extract_all(tags, F.lit(ATTRIBUTES), F.lit(2))
    vals = F.transform(raw, lambda v: F.regexp_replace(v, r"""^["']|["']$""", ""))
    pairs = F.zip_with(names, vals, lambda n, v: F.struct(n.alias("n"), v.alias("v")))
    plain = F.transform(F.filter(pairs, lambda p: p["n"] != "srcset"), lambda p: p["v"])
    sets = F.flatten(F.transform(F.filter(pairs, lambda p: p["n"] == "srcset"), lambda p: F.transform(F.split(p["v"], ","), lambda s: F.regexp_extract(tx.strip(s), r"^\S+", 0))))
    css = F.flatten(F.transform(styles, lambda s: _found(s, CSS, 2)))
    js = F.flatten(F.transform(scripts, lambda s: _found(s, JS_STATIC, 1)))
    calls = F.filter(F.transform(_calls(scripts), lambda e: F.regexp_extract(e, LITERAL, 1)), lambda x: x != "")
    kinds = [("attribute", plain), ("srcset", sets), ("css", css), ("import", js), ("call", calls)]

    def tagged(kind, refs):
        return F.transform(refs, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("ref")))

    all_ = F.flatten(F.array(*[tagged(k, c) for k, c in kinds]))
    rows = pages.select(F.col(id_col), F.explode(F.array_distinct(all_)).alias("x")).select(id_col, "x.kind", "x.ref")
    return rows.where((F.col("ref") != "") & ~F.startswith("ref", F.lit("#")) & ~F.startswith("ref", F.lit("data:")))


def is_remote(ref):
    return ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^//")


def classify_links(links: DataFrame, declared: DataFrame, id_col: str = "page_id") -> tuple[DataFrame, DataFrame]:
    """GR2: observed references with their declared decision, and findings.

    ``declared``: page id, ref, decision (bundle, external, forbidden), reason.
    """
    seen = links.select(id_col, "ref").distinct().withColumn("__s", F.lit(True))
    j = seen.join(declared.select(id_col, "ref", "decision", "reason"), [id_col, "ref"], "full")
    known = F.col("decision").isin("bundle", "external", "forbidden")
    bad = fd.checks(
        j,
        [
            ("RESOURCE_EDGE_SET_MISMATCH", F.col("__s").isNull() | F.col("decision").isNull()), ("RESOURCE_DECISION_REQUIRED", F.col("decision").isNotNull() & ~known),
            ("RESOURCE_REASON_REQUIRED", known & (F.col("decision") != "bundle") & (tx.strip(F.coalesce("reason", F.lit(""))) == "")),
            ("REMOTE_RESOURCE_MUST_BE_EXTERNAL", is_remote(F.col("ref")) & (F.col("decision") != "external")),
        ],
        work=id_col, entity="ref",
    )
    cls = F.when(is_remote(F.col("ref")), "remote").otherwise("local")
    return j.where("__s").select(id_col, "ref", cls.alias("class"), "decision"), bad


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """GR3: pages reachable from the seeds, with their distance."""
    return reach(edges, seeds, [])


def check_refs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """GR4: unknown targets, self references and repeated edges."""
    one = F.lit("graph")
    e = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    lost = e.join(nodes.select(F.col("id").alias("dst")).distinct(), "dst", "left_anti")
    name = F.concat_ws(">", "src", "dst")
    return fd.union([
        fd.finding(lost, "UNKNOWN_TARGET", F.lit(True), name, work=one), fd.finding(e, "SELF_REFERENCE", F.col("src") == F.col("dst"), name, work=one), fd.finding(e, "DUPLICATE_REFERENCE", F.col("n") > 1, name, work=one),
    ])
