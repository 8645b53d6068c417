"""URL filters in DataFrame functions: rules, and a list of canonical URLs behind a blocked Bloom filter.

A URL's verdict is that of the longest rule that fits, or else that of the
list: block if its canonical form is listed, allow if not. A blocked Bloom
filter of the list (one block of 256 bits a URL, two bits in each of its four
words) passes all listed URLs and about one in a thousand others to an exact
hash join, which removes the false positives; the rest never joins.

The filter's blocks and the list are broadcast only if they have at most
``BROADCAST_BYTES`` bytes; larger ones are joined by a shuffle.

Defined results: a null URL, or one without ``://``, has an empty host and
path, fits no rule, is on no list and is allowed; repeated rows are judged
each; repeated or null entries of the list count once or not at all; of two
rules equal in length the alphabetically first wins; a URL may have any length; without pages there are no rows, with an empty list nothing is on it; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import cut, small

#: So many rules become one conditional expression; more are joined by domain.
MOST_RULES = 1000
BLOCK_BITS, BITS_A_URL = 256, 16

# Query parameters that name no other page.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without trailing slashes, query without tracking parameters; null without ``://``."""
    query = F.array_join(F.filter(F.split(F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1), "&"), lambda p: ~p.rlike(TRACKING) & (p != "")), "&")
    body = F.concat(F.regexp_replace(host(url), r"^www\.", ""), F.rtrim(path(url), F.lit("/")))
    return F.when(F.contains(url, F.lit("://")), F.concat(body, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _fits(rule: str, own_host: Column, own_path: Column) -> Column:
    domain, slash, rest = rule.partition("/")
    return ((own_host == domain) | own_host.endswith("." + domain)) & own_path.startswith(slash + rest)


def rule_of(rules: list[tuple[str, str]], own_host: Column, own_path: Column) -> tuple[Column, Column]:
    """The longest fitting rule of ``(verdict, rule)`` pairs and its verdict, else nulls."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1]), reverse=True):
        fits = _fits(rule, own_host, own_path)
        found, verdict = F.when(fits, F.lit(rule)).otherwise(found), F.when(fits, F.lit(kind)).otherwise(verdict)
    return found, verdict


def _by_domain(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``pages`` (``host, path``) with ``rule`` and ``__verdict`` for any number of rules.

    Each distinct host is looked up under its own name and all domains above it; what is found, the rules of these domains,
    is joined back to the host's pages.
    """
    listed = pages.sparkSession.createDataFrame([(*r.partition("/")[::2], r, k) for k, r in sorted(set(rules))], "domain string, rest string, rule string, kind string")
    by = listed.groupBy("domain").agg(F.collect_list(F.struct((-F.length("rule")).alias("size"), "rule", F.concat(F.lit("/"), "rest").alias("prefix"), "kind")).alias("rules"))
    labels = F.split("host", r"\.", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = pages.select("host").distinct().select("host", F.explode(above).alias("domain"))
    found = each.join(small(cut(by, "rules")), "domain").groupBy(F.col("host").alias("__host")).agg(F.flatten(F.collect_list("rules")).alias("__rules"))
    out = pages.join(small(cut(found, "hosts")), F.col("host") == F.col("__host"), "left")
    best = F.array_min(F.filter("__rules", lambda r: F.startswith(F.col("path"), r["prefix"])))
    return out.withColumns({"rule": best["rule"], "__verdict": best["kind"]}).drop("__host", "__rules")


def _block(key: Column, blocks: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 20).bitwiseAND(F.lit(blocks - 1).cast("long"))


def _masks(key: Column) -> list[Column]:
    """The four words of a URL's 256-bit pattern."""
    h = F.xxhash64(key, F.lit(17))
    bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * n).bitwiseAND(F.lit(63).cast("long")).cast("int"))
    return [bit(2 * i).bitwiseOR(bit(2 * i + 1)) for i in range(4)]


def bloom(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """``__block, __w0 .. __w3``: the filter's blocks that hold anything."""
    masks = [m.alias(f"__m{i}") for i, m in enumerate(_masks(F.col(key)))]
    return listed.select(_block(F.col(key), blocks).alias("__block"), *masks).groupBy("__block").agg(*(F.bit_or(f"__m{i}").alias(f"__w{i}") for i in range(4)))


def judge(pages: DataFrame, rules: list[tuple[str, str]], listed: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of each page; ``listed`` has canonical URLs in its column ``url``."""
    listed = cut(listed.select(F.col("url").alias("__listed")).filter("__listed IS NOT NULL").distinct(), "listed")
    blocks = 1
    while blocks * BLOCK_BITS < BITS_A_URL * listed.count():
        blocks *= 2
    url = F.col("url")
    own = pages.select("page_id", host(url).alias("host"), path(url).alias("path"), canonical(url).alias("__key"))
    if len(rules) > MOST_RULES:
        own = _by_domain(own, rules)
    else:
        rule, verdict = rule_of(rules, F.col("host"), F.col("path"))
        own = own.withColumns({"rule": rule, "__verdict": verdict})
    # URLs without a canonical form, and those that a rule decides, have no place in the filter
    open_ = F.col("__verdict").isNull() & F.col("__key").isNotNull()
    columns = ["page_id", "host", "path", "rule"]
    decided = own.filter(~open_).select(*columns, F.coalesce("__verdict", F.lit("allow")).alias("verdict"))
    filter_ = cut(bloom(listed, "__listed", blocks), "bloom")
    probed = own.filter(open_).withColumn("__at", _block(F.col("__key"), blocks)).join(small(filter_), F.col("__at") == F.col("__block"), "left")
    passes = F.col("__block").isNotNull()
    for i, m in enumerate(_masks(F.col("__key"))):
        passes = passes & (F.col(f"__w{i}").bitwiseAND(m) == m)
    probed = probed.withColumn("__ask", F.coalesce(passes, F.lit(False)))
    missed = probed.filter(~F.col("__ask")).select(*columns, F.lit("allow").alias("verdict"))
    asked = probed.filter("__ask").join(small(listed.hint("shuffle_hash")), F.col("__key") == F.col("__listed"), "left")
    return decided.unionByName(missed).unionByName(asked.select(*columns, F.when(F.col("__listed").isNotNull(), "block").otherwise("allow").alias("verdict")))


def refetched(pages: DataFrame) -> DataFrame:
    """Canonical URLs that more than one page was fetched from: a list that grows with the crawl."""
    return pages.select(canonical(F.col("url")).alias("url")).filter("url IS NOT NULL").groupBy("url").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("url")
