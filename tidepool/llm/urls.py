"""URL filter: host and path rules, and pattern rules indexed by their rarest token.

``judge_urls`` gives every url the verdict of the longest host and path rule
that fits it, else that of the pattern rules:

1. Every rule stands in one table under one key that any url it fits must
   hold: a host and path rule under its host and the folder of its path, a
   pattern rule under the rarest of its literal tokens, as counted over all
   urls by Spark. A pattern without a sure token stands under the empty
   token, which every url has, so that it is tried on all of them.
2. A url's keys (host suffixes with path folders, as deep as any rule goes,
   and distinct tokens) meet the rules' keys in one equi-join. Only the rules
   fetched this way are tried: a prefix test, or the pattern's regular
   expression.
3. What fits is reduced to one row per url (partial sums in the map tasks) and
   joined back. Spark chooses the joins by the size of the written rule table;
   no size is assumed.

The pattern language: ``*`` is any text, ``^`` one character that is no
letter, digit or ``%``, or the url's end; a leading ``||`` is the start of a
label of the host, a leading or closing ``|`` the url's start or end; all
else is literal. A pattern between slashes is a regular expression. Patterns
are matched on the url with A-Z lower-cased. A literal token (a longest run
of letters, digits and ``%``) is sure to be a whole token of the url where
both its neighbours in the pattern are known to be neither of these nor ``*``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The host and path rules of the registered query, as (verdict, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

#: Pattern rules for web text: hosts named for adult sites, gambling, sold medicine, loans and
#: link farms; addresses of adverts, trackers and pages without prose. ``allow`` is an exception.
PATTERNS = [
    *[("block", f"||{word}^") for word in ("adult", "betting", "bingo", "casino", "casinos", "escort", "escorts", "gambling", "jackpot", "poker", "porn", "porno", "roulette", "sex", "slots", "viagra", "cialis", "xxx")],
    *[("block", f"||{name}^") for name in ("buy-followers", "cheap-meds", "cheap-pills", "cheap-viagra", "essay-writing", "free-casino", "free-porn", "link-farm", "online-casino", "payday-loan", "payday-loans", "replica-watches", "spam-farm")],
    *[("block", f"||{name}.") for name in ("ads", "adserver", "tracker", "tracking", "doubleclick")],
    *[("block", f"/{path}^") for path in ("wp-login.php", "cgi-bin", "checkout", "add-to-cart", "unsubscribe")],
    *[("block", f".{kind}|") for kind in ("exe", "zip", "iso", "apk", "dmg", "css", "js")],
    ("block", "/[?&](?:sessionid|phpsessid|jsessionid)=[0-9a-z]{16,}/"),
    ("allow", "||sex-education^"),
    ("allow", "||responsible-gambling^"),
]

_TOKEN = "[a-z0-9%]+"
_EDGE = "[^a-z0-9%]"


def lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return lower(F.regexp_extract(_rest(url), r"\A([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """Text behind the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """Host and path rules (verdict, host, path) as a table."""
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def pattern_table(spark: SparkSession, patterns=PATTERNS) -> DataFrame:
    """Pattern rules (verdict, pattern) as a table."""
    return spark.createDataFrame(list(patterns), "verdict string, pattern string")


def _regex(pattern: Column) -> Column:
    """The regular expression of a pattern."""
    p = F.regexp_replace(pattern, r"([\\.+?{}()\[\]$])", r"\\$1")
    p = F.regexp_replace(p, r"\|\z", "__end__")
    p = F.regexp_replace(p, r"\A\|\|", "__label__")
    p = F.regexp_replace(p, r"\A\|", "__start__")
    p = F.replace(p, F.lit("|"), F.lit(r"\|"))
    p = F.replace(p, F.lit("*"), F.lit(".*"))
    p = F.replace(p, F.lit("^"), F.lit(f"(?:{_EDGE}|\\z)"))
    p = F.replace(p, F.lit("__end__"), F.lit(r"\z"))
    p = F.replace(p, F.lit("__label__"), F.lit(r"\A[^:/?#]*://(?:[^/?#]*\.)?"))
    p = F.concat(F.lit("(?s)"), F.replace(p, F.lit("__start__"), F.lit(r"\A")))
    return F.when(_is_regex(pattern), F.concat(F.lit("(?s)"), F.expr("substring(pattern, 2, length(pattern) - 2)"))).otherwise(p)


def _is_regex(pattern: Column) -> Column:
    return pattern.rlike(r"(?s)\A/.+/\z")


def _sure_tokens(pattern: Column) -> Column:
    """Literal tokens that are whole tokens of any url the pattern fits."""
    inside = f"(?<=[^a-z0-9%*])({_TOKEN})(?=[^a-z0-9%*])"
    return F.when(_is_regex(pattern), F.array().cast("array<string>")).otherwise(F.regexp_extract_all(pattern, F.lit(inside), 1))


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a url, and the empty token."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(lower(url), F.lit(f"({_TOKEN})"), 1)))


def index_patterns(patterns: DataFrame, urls: DataFrame) -> DataFrame:
    """Pattern rules with the key they are found by: (key, verdict, pattern, regex).

    ``key`` is the sure token that fewest urls hold (ties: the longest, then the
    first in byte order), the empty token where there is none. Counts cover
    all rows of ``urls``; repeated rules are one rule.
    """
    rules = patterns.select("verdict", lower(F.col("pattern")).alias("_low"), "pattern").where(F.col("pattern").isNotNull() & F.col("verdict").isin("allow", "block")).distinct()
    # a regular expression keeps its letters, as classes such as \S have a meaning
    rules = rules.select("verdict", F.when(_is_regex(F.col("pattern")), F.col("pattern")).otherwise(F.col("_low")).alias("pattern")).distinct()
    # written, so that Spark knows its size where it joins the tokens of all urls with it
    tokens = cut(rules.select("verdict", "pattern", F.explode_outer(_sure_tokens(F.col("pattern"))).alias("key")), "url-rule-tokens")
    known = tokens.where(F.col("key").isNotNull()).select("key").distinct()
    counts = urls.select(F.explode(url_tokens(F.col("url"))).alias("key")).join(known, "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    by = F.struct(F.coalesce("_n", F.lit(0)), -F.length("key"), "key")
    keyed = tokens.join(counts, "key", "left").groupBy("verdict", "pattern").agg(F.min_by("key", F.when(F.col("key").isNotNull(), by)).alias("key"))
    return keyed.select(F.coalesce("key", F.lit("")).alias("key"), "verdict", "pattern", _regex(F.col("pattern")).alias("regex"))


def _folder(path: Column) -> Column:
    """A path up to its last slash."""
    return F.regexp_extract(path, r"\A((?s:.*/)?)", 1)


def _host_keys(host: Column, path: Column, labels: int, folders: int) -> Column:
    """Keys that the host and path rules which may fit stand under: every suffix of the
    host of at most ``labels`` labels, with every folder of the path of depth at most ``folders``."""
    n_labels = F.least(F.length(host) - F.length(F.replace(host, F.lit("."))) + 1, F.lit(labels))
    n_folders = F.least(F.length(path) - F.length(F.replace(path, F.lit("/"))), F.lit(folders))

    def keys(k):
        suffix = F.call_function("substring_index", host, F.lit("."), -k)

        def at(d):
            folder = F.when(d > 0, F.concat(F.call_function("substring_index", path, F.lit("/"), d), F.lit("/"))).otherwise("")
            return F.concat(suffix, F.lit(" "), folder)

        return F.transform(F.sequence(F.lit(0), n_folders), at)

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n_labels), keys)))


def index_rules(rules: DataFrame) -> DataFrame:
    """Host and path rules with their key: (key, verdict, host, path, rule). A rule without
    a host is none; a null path is the empty one; of two rules for one place, block holds."""
    host, path = lower(F.col("host")), F.coalesce("path", F.lit(""))
    have = rules.where(F.col("verdict").isin("allow", "block") & (F.coalesce("host", F.lit("")) != "")).select(host.alias("host"), path.alias("path"), "verdict")
    have = have.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    return have.select(F.concat("host", F.lit(" "), _folder(F.col("path"))).alias("key"), "verdict", "host", "path", F.concat("host", "path").alias("rule"))


def _found(urls: DataFrame, rules: DataFrame, patterns: DataFrame) -> DataFrame:
    """The urls (not null) that some rule fits: (url, _rule struct of n, r, v; _pattern struct of v, p)."""
    places, index = index_rules(rules), index_patterns(patterns, urls)
    null = F.lit(None).cast("string")
    table = cut(places.select("key", "verdict", "path", "rule", null.alias("pattern"), null.alias("regex")).unionByName(
        index.select(F.concat(F.lit("#"), "key").alias("key"), "verdict", null.alias("path"), null.alias("rule"), "pattern", "regex")), "url-rules")
    depth = places.agg(F.max(F.length("host") - F.length(F.replace("host", F.lit(".")))).alias("labels"), F.max(F.length("path") - F.length(F.replace("path", F.lit("/")))).alias("folders")).first()
    labels, folders = (depth["labels"] or 0) + 1, depth["folders"] or 0
    url = F.col("url")
    host, path = host_of(url), path_of(url)
    by_place = F.when(host != "", _host_keys(host, path, labels, folders)).otherwise(F.array().cast("array<string>"))
    keys = F.concat(by_place, F.transform(url_tokens(url), lambda t: F.concat(F.lit("#"), t)))
    asked = urls.where(url.isNotNull()).select("url", path.alias("_path"), F.explode(keys).alias("key"))
    fits = F.when(F.col("rule").isNotNull(), F.startswith("_path", "path")).otherwise(F.regexp_like(lower(url), F.col("regex")))
    fitting = asked.join(table, "key").where(fits)
    by_pattern = F.when(F.col("pattern").isNotNull(), F.struct(F.col("verdict").alias("v"), F.col("pattern").alias("p")))
    by_rule = F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), F.col("rule").alias("r"), F.col("verdict").alias("v")))
    return fitting.groupBy("url").agg(F.max(by_rule).alias("_rule"), F.min(by_pattern).alias("_pattern"))


def judge_urls(pages: DataFrame, rules: DataFrame, patterns: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): (page_id, host, path, rule, verdict, pattern).

    ``rule`` is the longest host and path rule that fits: its host is the url's
    or a parent domain of it, and the url's path starts with its path. Without
    one, ``pattern`` is the pattern rule that decides: an ``allow`` pattern
    before a ``block`` one, then the first in byte order; a url that nothing
    fits is allowed. A null url, or one without ``://``, has an empty host and
    path and no rule; patterns are tried on the latter's whole text. Repeated
    rows are judged each, an empty table gives no rows, other columns are not
    read. Urls of any length are worked on whole.
    """
    urls = pages.select("page_id", "url")
    out = urls.join(_found(urls, rules, patterns), "url", "left")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    return out.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), F.col("_rule.r").alias("rule"),
                      F.coalesce("_rule.v", "_pattern.v", F.lit("allow")).alias("verdict"), F.when(F.col("_rule").isNull(), F.col("_pattern.p")).alias("pattern"))


def filter_urls(pages: DataFrame, rules: DataFrame, patterns: DataFrame) -> DataFrame:
    """The rows of ``pages``, all their columns, whose ``url`` is allowed (see
    :func:`judge_urls`): blocked urls go by an anti join; rows with a null url stay."""
    urls = pages.select("url")
    blocked = _found(urls, rules, patterns).where(F.coalesce("_rule.v", "_pattern.v") == "block").select("url")
    return pages.join(blocked, "url", "left_anti").select(*[F.col(f"`{c}`") for c in pages.columns])
