"""URL filters: rules on host and path, with block decisions carried over to aliases.

Pages that redirect to each other or name each other as canonical are one resource under several addresses.
A blocked address blocks every alias that no rule judges; a page with an allow rule of its own stays allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quirefold.llm.common import LOWER, UPPER, keeps_columns
from quirefold.llm.components import components
from quirefold.session import stage

Rule = tuple[str, str, str]  # verdict, host, path

_COMMENTS = r"(?s)<!--.*?(?:-->|$)"
_TAGS = r"(?is)<(?:link|meta)\b[^>]*>"
# Any of the words of `rel` may be the one, quoted or not.
_CANONICAL = (
    r"(?is)[\s\"'/]rel\s*=\s*(?:\"(?:[^\">]*\s)?canonical(?:\s[^\">]*)?\"|'(?:[^'>]*\s)?canonical(?:\s[^'>]*)?'|canonical[\s/>])"
)
_REFRESH = r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b"
_HREF = r"(?is)[\s\"'/]href\s*=\s*[\"']?([^\"'\s>]+)"
_TARGET = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty without `://`."""
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def without_dots(path: Column) -> Column:
    """A path as it is requested: `.` and `..` resolved, the empty path is `/`."""
    steps = F.slice(F.split(path, "/", -1), 2, F.size(F.split(path, "/", -1)))

    def step(kept: Column, part: Column) -> Column:
        up = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(part == ".", kept).when(part == "..", up).otherwise(F.concat(kept, F.array(part)))

    # A last step `.` or `..` names a folder: a slash is left at the end.
    ended = F.when(path.rlike(r"/\.\.?$"), F.concat(steps, F.array(F.lit("")))).otherwise(steps)
    kept = F.aggregate(ended, F.array().cast("array<string>"), step)
    return F.when(path == "", "/").when(path.contains("/."), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def address_of(url: Column) -> Column:
    """What names the resource: host, path and query, without scheme, fragment and dot segments; null without a host."""
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*(\?[^#]*)?", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), without_dots(path_of(url)), query))


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """(rule, verdict) of the longest rule for the host or a parent domain whose path starts the path.

    Among rules of one length `allow` comes first. Null if none fits.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r))
    table = F.array(*[
        F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in ordered
    ])
    fits = F.filter(
        table,
        lambda r: ((host == r["host"]) | host.endswith(F.concat(F.lit("."), r["host"]))) & path.startswith(r["path"]),
    )
    best = F.get(fits, F.lit(0))
    return F.when(
        best.isNotNull(),
        F.struct(F.concat(best["host"], best["path"]).alias("rule"), best["verdict"].alias("verdict")),
    )


def alias_links(pages: DataFrame) -> DataFrame:
    """(a, b): the address of a page and of its canonical link or refresh target (null if it has no host).

    Links in comments do not count; any word of `rel` may say `canonical`; targets are resolved against the page.
    """
    url = F.col("url")
    found = pages.where(host_of(url) != "").select(
        address_of(url).alias("a"), host_of(url).alias("host"), path_of(url).alias("path"),
        F.explode(F.regexp_extract_all(F.regexp_replace("html", _COMMENTS, ""), F.lit(_TAGS), 0)).alias("tag"),
    )
    target = F.when(F.col("tag").rlike(_CANONICAL), F.regexp_extract("tag", _HREF, 1)).when(
        F.col("tag").rlike(_REFRESH), F.regexp_extract("tag", _TARGET, 1)
    )
    found = found.select("a", "host", "path", F.replace(target, F.lit("&amp;"), F.lit("&")).alias("to"))
    to, folder = F.col("to"), F.regexp_extract("path", r"(?s)^(.*/)?", 1)
    full = (
        F.when(to.contains("://"), to)
        .when(to.startswith("//"), F.concat(F.lit("http:"), to))
        .when(to.startswith("/"), F.concat(F.lit("http://"), "host", to))
        .when(to.rlike("^[?#]"), F.concat(F.lit("http://"), "host", "path", to))
        .otherwise(F.concat(F.lit("http://"), "host", F.when(folder == "", "/").otherwise(folder), to))
    )
    # Distinct before the address is taken apart again: one copy of each link, and two small expressions.
    # Nulls stay for the reader to drop, since a filter here would be pushed down with both expressions in it.
    found = found.where(F.length("to") > 0).select("a", full.alias("full")).distinct()
    return found.select("a", address_of(F.col("full")).alias("b"))


@keeps_columns
def judge_urls(pages: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """`pages` with host, path, rule and verdict (`allow` or `block`).

    The page's own rule decides. Without one, the page is blocked if an address in its component of alias
    links falls under a block rule (the address need not be a page of the table), else it gets `default`.
    Null or malformed urls have an empty host and path, no rule and the default verdict; null html has no
    links. Repeated rows are judged alike, very long urls and pages are read whole, an empty table gives no rows. Columns named like a result are replaced.
    """
    links = stage(alias_links(pages).distinct(), "alias-links")
    member = components(links, "a", "b", "_qcomp")
    node = F.concat(F.lit("x://"), "node")
    judged = member.withColumn("_qrule", fitting_rule(host_of(node), path_of(node), rules))
    hit = judged.where(F.col("_qrule.verdict") == "block").select("_qcomp").distinct()
    spread = stage(member.join(hit, "_qcomp", "left_semi").select(F.col("node").alias("_qnode")), "blocked-aliases")
    own = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url")), "_qnode": address_of(F.col("url"))})
    rows = rows.withColumn("_qrule", own).join(spread.withColumn("_qhit", F.lit(True)), "_qnode", "left")
    verdict = F.coalesce("_qrule.verdict", F.when(F.col("_qhit"), F.lit("block")), F.lit(default))
    return rows.withColumns({"rule": F.col("_qrule.rule"), "verdict": verdict}).drop("_qnode", "_qrule", "_qhit")
