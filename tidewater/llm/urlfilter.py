"""URL filters: a blocked Bloom filter over listed canonical URLs, then an exact hash join. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (host, path, verdict); fixed values of the production list.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Bits of the filter per listed URL, and the most 64-bit blocks it may have (512 KB); beyond, it passes more and the join still decides.
BITS, MOST_BLOCKS = 16, 1 << 16
PROBES = 4


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def _mask(key: Column) -> Column:
    """The bits of a key in its 64-bit block, from a second hash."""
    h = F.xxhash64(F.lit("bits"), key)
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
    out = bit(0)
    for i in range(1, PROBES):
        out = out.bitwiseOR(bit(i))
    return out


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    names = ["rule_host", "rule_path", "rule_verdict"]
    columns = F.arrays_zip(*[F.lit([r[i] for r in rules]).alias(n) for i, n in enumerate(names)])
    return spark.range(1).select(F.inline(columns).alias(*names))


def bloom(rules: DataFrame) -> list[int]:
    """The filter's blocks, at most MOST_BLOCKS longs; a list of any length fits."""
    n = rules.count()
    blocks = max(1, min(MOST_BLOCKS, -(-n * BITS // 64)))
    key = F.concat("rule_host", "rule_path")
    held = rules.groupBy(_block(key, blocks).alias("block")).agg(F.bit_or(_mask(key)).alias("bits")).collect()
    out = [0] * blocks
    for r in held:
        out[r["block"]] = r["bits"]
    return out


def judge_urls(pages: DataFrame, rules: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row.

    A rule (host, path, verdict) fits its host and all subdomains where the url's path starts with the rule's;
    the longest wins. Candidates are the suffixes of the host at a dot that have no more labels than the longest listed host, with every prefix of the path that
    has a listed length; so the work is linear in the length of a url. Those the Bloom filter passes meet the rules in an exact hash join; rows without one are never
    shuffled. Unlisted, null and malformed urls get the default verdict and a null rule; repeated
    rows are judged each, a null id stays null, an empty table or list is fine; other columns are not read.
    """
    spark = pages.sparkSession
    rules = (rules_table(spark) if rules is None else rules).groupBy("rule_host", "rule_path").agg(F.min("rule_verdict").alias("rule_verdict"))
    lengths = [r[0] for r in rules.select(F.length("rule_path")).distinct().collect()]  # distinct lengths of paths: as many as the longest path has characters
    most = rules.agg(F.max(F.size(F.split("rule_host", r"\.", -1)))).first()[0] or 0  # labels of the longest listed host
    words = bloom(rules)
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    labels = F.split("host", r"\.", -1)
    suffixes = F.filter(F.array(*[F.when(F.size(labels) >= i, F.array_join(F.slice(labels, -i, i), ".")) for i in range(1, most + 1)]).cast("array<string>"), lambda h: h.isNotNull())
    fits = F.filter(F.lit(lengths) if lengths else F.expr("cast(array() as array<int>)"), lambda n: n <= F.length("path"))
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(fits, lambda n: F.struct(h.alias("h"), F.col("path").substr(F.lit(1), n).alias("p")))))

    def passes(x: Column) -> Column:
        key = F.concat(x["h"], x["p"])
        return F.element_at(F.lit(words), _block(key, len(words)) + 1).bitwiseAND(_mask(key)) == _mask(key)

    rows = rows.withColumn("hits", F.filter(pairs, passes))
    fixed = [F.col("page_id"), F.col("host"), F.col("path")]
    missed = rows.where(F.size("hits") == 0).select(*fixed, F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    exact = (
        rows.where(F.size("hits") > 0)
        .withColumn("row", F.monotonically_increasing_id())
        .select("row", *fixed, F.explode("hits").alias("hit"))
        .join(rules, (F.col("hit.h") == F.col("rule_host")) & (F.col("hit.p") == F.col("rule_path")), "left")
    )
    order = F.struct(F.length("hit.h") + F.length("hit.p"), F.length("hit.h"), F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict")
    won = exact.groupBy("row").agg(*(F.first(c).alias(c) for c in ("page_id", "host", "path")), F.max(F.when(F.col("rule_host").isNotNull(), order)).alias("won"))
    return missed.unionAll(won.select(*fixed, F.col("won.rule").alias("rule"), F.coalesce("won.rule_verdict", F.lit(default)).alias("verdict")))
