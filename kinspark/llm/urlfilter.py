"""URL filter: host-suffix and path-prefix expressions joined with rules on short hash prefixes.

A URL's expressions are every suffix of its host at a label's start with every prefix of its path that a rule
may have.  Rules are known by the SHA-256 digest of "host + path"; the join is on the digest's first 32 bits,
and the whole digest decides.  Of a URL's rules the longest wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspark.llm.common import stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z in lower case; empty for null or without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _prefix(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def expressions(urls: DataFrame, odd_lengths: list[int] | None, longest_host: int, longest_path: int) -> DataFrame:
    """One row per row and expression of ``urls`` (host, path): host, path, digest, prefix.

    Path prefixes end at each slash; rules whose path ends otherwise add their lengths (None: all lengths).  No rule has a
    host or a path of more than ``longest_host`` or ``longest_path`` characters, so longer suffixes and prefixes can't be
    one's and are not made: a URL of a million labels or slashes has no more expressions than these lengths allow.
    """
    whole = F.length("host") <= longest_host
    cut = F.split(F.when(whole, F.col("host")).otherwise(F.substring("host", -(longest_host + 1), longest_host + 1)), r"\.")
    labels = F.when(whole, cut).otherwise(F.slice(cut, 2, F.size(cut)))  # the first label of a cut host is not whole
    suffixes = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    start = F.substring("path", 1, longest_path)
    parts = F.split(start, "/")
    slashes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.when(i < F.size(parts), "/").otherwise("")))
    lengths = F.sequence(F.lit(0), F.length(start)) if odd_lengths is None else F.array(F.lit(0), *[F.lit(n) for n in odd_lengths])
    odd = F.transform(F.filter(lengths, lambda n: n <= F.length(start)), lambda n: F.substring(start, F.lit(1), n))
    prefixes = F.array_distinct(F.concat(slashes, odd))
    rows = urls.select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes")).select("host", "path", "suffix", F.explode("prefixes").alias("start"))
    rows = rows.select("host", "path", F.sha2(F.concat("suffix", F.lit("\n"), "start"), 256).alias("digest"))
    return rows.withColumn("prefix", _prefix(F.col("digest")))


def filter_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", broadcast_rules: int = 200_000, most_broadcast: int = 32 << 20, most_lengths: int = 64
) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict.

    ``rules`` has host, path, verdict.  A rule fits its host and all subdomains, if the URL's path starts with
    the rule's.  The longest rule (of its host and path together) wins, then the longest host; of equal rules block
    beats allow.  Without a rule that fits, the verdict is ``default`` and rule is null.  A null URL or one without
    :// has an empty host and path; no rule has an empty host.  Null ids and repeated rows have their rows.
    Hosts and paths of any length are judged, but only their parts up to the longest rule's length become expressions.
    Rules are counted first: up to ``broadcast_rules`` they are broadcast and expressions are judged where pages lie; more
    are shuffled by the hash prefix, as are the expressions of each distinct host and path.  Only hosts and paths that a rule
    fits go on, each once, and their verdicts are broadcast back up to ``most_broadcast`` bytes (summed first).  Pages without
    a host meet nothing.  Rules whose paths end within a segment in more than ``most_lengths`` lengths try every length.
    """
    known = (
        rules.select(F.translate("host", _UPPER, _LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), "verdict")
        .where("r_host <> ''")
        .groupBy("r_host", "r_path")
        .agg(F.max("verdict").alias("r_verdict"))
        .withColumn("r_digest", F.sha2(F.concat("r_host", F.lit("\n"), "r_path"), 256))
        .withColumn("r_prefix", _prefix(F.col("r_digest")))
        .withColumn("rule", F.concat("r_host", "r_path"))
    )
    odd = [r[0] for r in known.where("r_path <> '' and r_path not like '%/'").select(F.length("r_path").alias("n")).distinct().orderBy("n").limit(most_lengths + 1).collect()]
    odd = odd if len(odd) <= most_lengths else None
    n = known.agg(F.count("*").alias("rules"), F.max(F.length("r_host")).alias("host"), F.max(F.length("r_path")).alias("path")).first()
    small, longest = n.rules <= broadcast_rules, (n.host or 0, n.path or 0)
    own = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    some, bare = own.where("host <> ''"), own.where("host = ''")
    best = F.max(F.struct(F.length("rule").alias("a"), F.length("r_host").alias("b"), "rule", "r_verdict")).alias("best")
    urls = some.select("host", "path") if small else some.select("host", "path").distinct()
    fitting = expressions(urls, odd, *longest).join(F.broadcast(known) if small else known, (F.col("prefix") == F.col("r_prefix")) & (F.col("digest") == F.col("r_digest")))
    judged = stored(fitting.groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.r_verdict"), "judged")
    size = judged.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + F.octet_length("rule") + 64), F.lit(0))).first()[0]
    few = F.broadcast if size <= most_broadcast else (lambda x: x)
    out = some.join(few(judged), ["host", "path"], "left").unionByName(bare.select("*", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("r_verdict")))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("r_verdict", F.lit(default)).alias("verdict"))


def rules_frame(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A frame of (verdict, host, path) triples."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")
