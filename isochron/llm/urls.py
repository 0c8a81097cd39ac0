"""URL filter: a blocked Bloom filter of listed keys passes possible hits to an exact hash join that removes false ones.

Two kinds of entries are listed. A rule (host, path, verdict) fits its host and all subdomains where the path starts with
the rule's; of several the longest wins. A canonical URL fits the URLs that have the same canonical form: no scheme, `www.`,
default port, fragment or tracking parameters, host in lower case, parameters sorted, no slash at the end. A URL asks for its
canonical form and for each (labels, path length) that some rule has; each such key goes to one block of the filter, 512 bits in
eight words of which a key sets one bit each. The filter has 16 bits a key, at most MAX_BLOCKS blocks, so what is broadcast is
bounded; of a longer list more keys pass it, and the join, whose plan is the same, removes them.

Each different URL is looked up once, so copies of one cost no more; a rule that most URLs meet is a hot key of the join, whose
rows of URLs adaptive execution splits. Defined results: a null URL or one without `://` has empty host and path and fits no
rule and no listed URL; it is allowed, as is all that nothing fits. Rules without host or path are left out; of rules with the
same host and path, and of a URL listed twice, `block` counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isochron.llm.common import LOWER, UPPER, cut

#: Blocks of 512 bits; 8 MB at most are broadcast, enough for 4 million keys at 16 bits.
MAX_BLOCKS = 131_072
WORDS, KEYS_A_BLOCK = 8, 32
#: Parameters that name how a reader came, not what is read.
TRACKING = r"^(utm_.*|ref|gclid|fbclid|mc_[ce]id)(=.*)?$"
#: The rules of the query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Words of hosts whose pages' canonical URLs the query lists.
LISTED_WORDS = r"(^|[.-])(spam|pills|casino|viagra|warez|phish|malware)([.-]|$)"


def host(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?` or `#`, A-Z in lower case; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to `?` or `#`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """The canonical form; null for null and for what has no `://`."""
    bare = F.regexp_replace(F.regexp_replace(host(url), r"^.*@", ""), r"(:(80|443))?$", "")
    name = F.regexp_replace(F.regexp_replace(bare, r"\.$", ""), r"^www\.", "")
    place = F.regexp_replace(path(url), r"/+$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.when(F.instr(url, "://") > 0, F.concat(name, F.when(place == "", "/").otherwise(place), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept))))


def entries(rules: DataFrame, listed: DataFrame) -> DataFrame:
    """(key, verdict, labels, length): one row per key; of canonical URLs labels is null.

    rules: host, path, verdict; listed: url (canonical), verdict.
    """
    named = rules.filter("host is not null and path is not null")
    prefixes = named.select(F.concat("host", "path").alias("key"), "verdict", F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("length"))
    # A canonical URL's key cannot be a rule's: hosts do not begin with a blank.
    wholes = listed.filter("url is not null").select(F.concat(F.lit(" "), "url").alias("key"), "verdict", F.lit(None).cast("int").alias("labels"), F.lit(None).cast("int").alias("length"))
    return prefixes.unionByName(wholes).groupBy("key", "labels", "length").agg(F.max("verdict").alias("verdict"))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bit(word: int) -> str:
    """SQL of the bit of a word that a key sets: six bits of a second hash."""
    return f"cast(shiftright(xxhash64(13, key), {6 * word}) & 63 as int)"


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w7): the blocks that hold a key; the others are empty."""
    marked = keys.select(_block(F.col("key"), blocks).alias("block"), *(F.expr(f"shiftleft(1L, {_bit(k)})").alias(f"w{k}") for k in range(WORDS)))
    return marked.groupBy("block").agg(*(F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)))


def possible(asked: DataFrame, listed: DataFrame) -> DataFrame:
    """The rows of `asked` whose key the filter of `listed`'s keys passes: all that are listed and few others."""
    n = listed.count()
    blocks = max(1, min(MAX_BLOCKS, -(-n // KEYS_A_BLOCK)))
    hits = " and ".join(f"shiftright(w{k}, {_bit(k)}) & 1 = 1" for k in range(WORDS))
    passed = asked.withColumn("block", _block(F.col("key"), blocks)).join(F.broadcast(bloom(listed, blocks)), "block")
    return passed.filter(hits).select(*asked.columns)


def lookup(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """(url, rule, rule_verdict, url_verdict) of each different URL that something fits; listed: as `entries` gives it."""
    listed = cut(listed)
    shapes = listed.filter("labels is not null").agg(F.collect_set(F.struct("labels", "length")).alias("shapes"))
    different = urls.select("url").filter("url is not null and instr(url, '://') > 0").distinct()
    parts = different.select("url", F.split(host(F.col("url")), r"\.").alias("names"), path(F.col("url")).alias("place"), canonical(F.col("url")).alias("whole")).crossJoin(F.broadcast(shapes))
    fits = "filter(shapes, s -> s.labels <= size(names) and s.length <= length(place))"
    keys = f"transform({fits}, s -> concat(array_join(slice(names, size(names) - s.labels + 1, s.labels), '.'), substring(place, 1, s.length)))"
    asked = parts.select("url", F.explode(F.expr(f"concat({keys}, array(concat(' ', whole)))")).alias("key"))
    found = possible(asked, listed).join(listed, "key")
    longest = F.struct(F.length("key").alias("size"), F.expr("length(key) - length").alias("host"), "key", "verdict")
    best = found.groupBy("url").agg(F.max(F.when(F.col("labels").isNotNull(), longest)).alias("rule"), F.max(F.when(F.col("labels").isNull(), F.col("verdict"))).alias("url_verdict"))
    return best.select("url", F.col("rule.key").alias("rule"), F.col("rule.verdict").alias("rule_verdict"), "url_verdict")


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, url: str = "url") -> DataFrame:
    """Adds url_host, url_path, url_rule, url_listed (its canonical form is listed) and url_verdict to each row.

    The rule's verdict counts; without one that of the canonical URL; else it is allowed.
    """
    if clash := {"url_host", "url_path", "url_rule", "url_listed", "url_verdict", "url_asked"} & {c.lower() for c in pages.columns}:
        raise ValueError(f"columns that the filter would overwrite: {sorted(clash)}")
    found = lookup(pages.select(F.col(url).alias("url")), entries(rules, listed)).select(F.col("url").alias("url_asked"), F.col("rule").alias("url_rule"), "rule_verdict", F.col("url_verdict").alias("found_verdict"))
    joined = pages.join(found, pages[url] == found["url_asked"], "left")
    verdict = F.coalesce("rule_verdict", "found_verdict", F.lit("allow"))
    return joined.select(*(pages[c] for c in pages.columns), host(pages[url]).alias("url_host"), path(pages[url]).alias("url_path"), "url_rule", F.col("found_verdict").isNotNull().alias("url_listed"), verdict.alias("url_verdict"))


def report(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Every page's verdict by the rules and by the list of canonical URLs of pages whose host has a listed word."""
    spark = pages.sparkSession
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    listed = pages.filter(host(F.col("url")).rlike(LISTED_WORDS)).select(canonical(F.col("url")).alias("url"), F.lit("block").alias("verdict")).distinct()
    judged = judge(pages.select("page_id", "url"), table, listed)
    return judged.select("page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), F.col("url_rule").alias("rule"), F.col("url_verdict").alias("verdict"), F.col("url_listed").alias("listed"))
