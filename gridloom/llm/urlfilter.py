"""URL allow and block rules by a sort-merge range join.

A rule's canonical host key is its host's labels in reverse order, each ended by a dot, so the hosts that it covers are the
keys that start with it: an interval from the key itself to the key followed by a byte that no text holds.  Paths that
start with a rule's path are an interval likewise.  Intervals of prefixes are nested or apart.  A sweep goes over the
starts and ends of the intervals and the urls' keys in sorted order and keeps a stack of the rules that are open: a start
pushes, an end pops, and a url finds those that cover it on the stack.  The first sweep is over hosts, and gives each url
the rule hosts that cover it; the second, over the paths under each of these, gives it the longest rule: the stack's top.

The sweeps are window functions: the running sum of starts and ends is the stack's height, and place d of the stack
holds the last rule that was pushed to height d.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import UPPER, ascii_lower, fresh, stored

#: Urls that one task sweeps; more under one key are salted, and the key's rules repeated for each salt.
SWEEP_ROWS = 20_000
_PUSH, _URL, _POP = 0, 1, 2


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_table(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(host, path, verdict) of (verdict, ``host/path``) pairs."""
    rows = [(r.partition("/")[0].translate(str.maketrans(UPPER, UPPER.lower())), "/" + r.partition("/")[2], v) for v, r in rules]
    return spark.createDataFrame(rows, "host string, path string, verdict string")


def _labels(host: Column | str) -> Column:
    return F.reverse(F.split(host, r"\."))


def _host_key(host: Column | str) -> Column:
    return F.concat(F.array_join(_labels(host), "."), F.lit("."))


def _events(rules: DataFrame, by: Sequence[str]) -> DataFrame:
    """The starts and ends of the rules' intervals, by, at, kind, rule: of columns by, key and rule."""
    start = F.encode("key", "UTF-8")
    pushes = rules.select(*by, start.alias("at"), F.lit(_PUSH).alias("kind"), "rule")
    pops = rules.select(*by, F.concat(start, F.lit(b"\xff")).alias("at"), F.lit(_POP).alias("kind"), F.lit(None).cast(rules.schema["rule"].dataType).alias("rule"))
    return pushes.union(pops)


def _height(by: Sequence[str]) -> tuple[Column, object]:
    """(height of the stack after an event, the sweep's window)."""
    sweep = Window.partitionBy(*by).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(F.when(F.col("kind") == _PUSH, 1).when(F.col("kind") == _POP, -1).otherwise(0)).over(sweep), sweep


def _swept(urls: DataFrame, rules: DataFrame, by: Sequence[str], rows: int) -> DataFrame:
    """``urls`` (columns by, key and others) with ``stack``: the open rules (columns by, key, rule), outermost first.

    Those without a rule under their by are left out.
    """
    deepest = _events(rules, by).withColumn("height", _height(by)[0]).agg(F.max("height")).first()[0] or 0
    own = rules.groupBy(*by).agg(F.count("*").alias("rules"))
    # salts are so many that rules repeated for them are no more than the urls
    salts = urls.groupBy(*by).agg(F.count("*").alias("urls")).join(own, list(by)).select(*by, F.ceil(F.col("urls") / F.greatest(F.col("rules"), F.lit(rows))).cast("int").alias("salts"))
    salts = stored(salts, "salts")
    others = [c for c in urls.columns if c not in (*by, "key")]
    looks = urls.join(salts, list(by)).select(*by, F.pmod(F.xxhash64("key", *others), F.col("salts")).cast("int").alias("salt"), F.encode("key", "UTF-8").alias("at"), F.lit(_URL).alias("kind"), *others)
    salted = [*by, "salt"]
    every = rules.join(salts, list(by)).select(*by, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "key", "rule")
    height, sweep = _height(salted)
    rows_ = _events(every, salted).unionByName(looks, allowMissingColumns=True).withColumn("height", height)
    places = [F.last(F.when((F.col("kind") == _PUSH) & (F.col("height") == d), F.col("rule")), ignorenulls=True).over(sweep) for d in range(1, deepest + 1)]
    stack = F.slice(F.array(*places), 1, F.col("height").cast("int"))
    return rows_.select(*by, "kind", *others, "height", stack.alias("stack")).filter((F.col("kind") == _URL) & (F.col("height") > 0)).select(*by, *others, "stack")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", sweep_rows: int = SWEEP_ROWS) -> DataFrame:
    """``pages`` with host, path, rule and verdict (columns of these names are replaced).

    rules: host (lower-case), path (starts with ``/``), verdict.  A rule covers its host and all subdomains where the
    url's path starts with its own; the longest covering rule wins (ties: the longer host), ``default`` where there
    is none.  A url that is null or has no ``://`` has empty host and path; a very long one is compared as far as the
    longest rule goes.  Of equal rules with two verdicts the larger word (``block``) counts; rules with a null don't.
    Repeated pages are each judged; no rules or pages are defined and give defaults or no rows; other columns pass through.

    Only distinct (host, path as far as the longest rule) pairs are swept, so repeats of a url cost nothing.
    """
    rest = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    cut, best_of = fresh(pages.columns, "cut", "best")
    one = rules.dropna().groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block before allow
    one = stored(one, "rules")
    longest = one.agg(F.max(F.length("path"))).first()[0]
    judged = pages.select(*rest, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if longest is None:
        return judged.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    short = F.left(F.col("path"), F.lit(longest))

    hosts = one.select("host").distinct().select(F.get(_labels("host"), F.lit(0)).alias("top"), _host_key("host").alias("key"), F.col("host").alias("rule"))
    urls = judged.select("host", short.alias("cut")).distinct().select(F.get(_labels("host"), F.lit(0)).alias("top"), _host_key("host").alias("key"), "host", "cut")
    under = _swept(urls, hosts, ["top"], sweep_rows).select("host", F.col("cut").alias("key"), F.explode("stack").alias("under"))
    under = stored(under, "covered-hosts")

    whole = F.struct(F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"), F.concat("host", "path").alias("rule"), F.col("verdict"))
    paths = one.select(F.col("host").alias("under"), F.col("path").alias("key"), whole.alias("rule"))
    found = _swept(under.withColumn("cut", F.col("key")), paths, ["under"], sweep_rows).select("host", "cut", F.element_at("stack", -1).alias("top"))
    best = found.groupBy("host", F.col("cut").alias(cut)).agg(F.max("top").alias(best_of))
    met = judged.withColumn(cut, short).join(best, ["host", cut], "left")
    return met.select(*rest, "host", "path", F.col(best_of)["rule"].alias("rule"), F.coalesce(F.col(best_of)["verdict"], F.lit(default)).alias("verdict"))
