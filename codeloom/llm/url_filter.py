"""URL rules by a cascade of Bloom filters: exact membership in the key universe of the corpus, without joins."""

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.scratch import Scratch

PAGE_WORDS = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and where ``://`` is missing."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


@dataclass
class Level:
    bits: int
    hashes: int
    filter: bytes

    def has(self, key: Column, salt: int) -> Column:
        """Whether all bits of a key are set; the filter is in the expression once and the first bit that is not set ends it."""

        def is_set(i: Column) -> Column:
            at = F.pmod(F.xxhash64(F.lit(salt), i, key), F.lit(self.bits).cast("long"))
            byte = F.conv(F.hex(F.substring(F.lit(bytearray(self.filter)), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
            return F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1

        return F.forall(F.array(*[F.lit(i) for i in range(self.hashes)]), is_set)


@dataclass
class Cascade:
    """Level 1 holds the listed keys, level 2 the keys of the universe that level 1 takes by mistake, and so on."""

    levels: list[Level] = field(default_factory=list)

    def has(self, key: Column) -> Column:
        """Exact for every key of the universe: the first level that lacks the key decides."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for n in range(len(self.levels), 0, -1):
            answer = F.when(self.levels[n - 1].has(key, n), answer).otherwise(F.lit(n % 2 == 0))
        return answer


def _bits(n: int, rate: float) -> int:
    return max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2 / 64) * 64)


def _level(keys: DataFrame, n: int, rate: float, salt: int, most_bytes: int) -> Level:
    bits = _bits(n, rate)
    if bits // 8 > most_bytes:
        raise ValueError(f"a filter of {bits // 8} bytes is needed and {most_bytes} are allowed")
    hashes = max(1, round(-math.log2(rate)))
    at = F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(salt), F.lit(i), F.col("key")), F.lit(bits).cast("long")) for i in range(hashes)]))
    # Words of 64 bits, whose hex digits are the filter's bytes in order, become pages: a filter of 64 MB reaches the driver in 2,048 rows.
    shift = F.expr("56 - 8 * (at % 64 div 8) + at % 8").cast("int")
    words = keys.select(at.alias("at")).groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), shift)).alias("set"))
    every = keys.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("set"))
    pages = words.unionByName(every).groupBy("word").agg(F.bit_or("set").alias("set")).groupBy(F.expr(f"word div {PAGE_WORDS}").alias("page")).agg(
        F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word", "set"))), lambda w: F.lpad(F.hex(w["set"]), 16, "0")), "")).alias("bytes")
    )
    return Level(bits, hashes, b"".join(bytes(r["bytes"]) for r in sorted(pages.collect(), key=lambda r: r["page"])))


def _first_rate(n: int, others: int) -> float:
    return min(0.5, max(1e-9, math.sqrt(0.5) * n / max(others, 1)))


def build_cascade(keys: DataFrame, most_bytes: int = 64 << 20) -> Cascade:
    """A cascade for ``keys`` (key, listed): distinct keys of the complete universe and whether each is listed.

    The first rate is chosen so that as many mistakes as listed keys are expected; all further levels halve.
    The whole cascade then takes a number of bits in proportion to the listed keys and the logarithm of the universe; a
    filter over ``most_bytes`` is refused (``filter_urls`` deals the keys over several cascades then).  No listed key gives an empty cascade, which has no key.
    """
    out = Cascade()
    include, exclude = keys.filter("listed"), keys.filter("not listed")
    n, others = include.count(), exclude.count()
    rate = _first_rate(n, others)
    while n:
        salt = len(out.levels) + 1
        level = _level(include, n, rate, salt, most_bytes)
        out.levels.append(level)
        include, exclude, rate = exclude.filter(level.has(F.col("key"), salt)), include, 0.5
        n = include.count()
    return out


def candidate_keys(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """Keys that a rule for this url could have: host suffixes of up to ``labels`` labels with path starts."""
    names = F.split(host, "\\.")
    suffixes = F.when(host == "", F.array(F.lit(""))).otherwise(
        F.transform(
            F.sequence(F.lit(1), F.least(F.size(names), F.lit(labels))),
            lambda k: F.array_join(F.slice(names, -k, k), "."),
        )
    )
    starts = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: F.length(path) >= n), lambda n: F.substring(path, F.lit(1), n))
    return F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.concat(s, p)))))


def _longest(found: Column) -> Column:
    """Of (key, allow) the longest key, of equally long ones the first by code point."""
    k = "key"
    order = lambda a, b: (
        F.when(F.length(a[k]) != F.length(b[k]), F.length(b[k]) - F.length(a[k])).when(a[k] < b[k], -1).when(a[k] > b[k], 1).otherwise(0)
    )
    return F.get(F.array_sort(found, order), F.lit(0))


def filter_urls(
    pages: DataFrame, rules: dict[str, str] | DataFrame, default: str = "allow", scratch: Scratch | None = None, most_bytes: int = 64 << 20,
) -> DataFrame:
    """Adds host, path, rule and verdict to each row of ``pages`` by its ``url``.

    ``rules`` maps ``host`` + ``path start`` to ``allow`` or ``block``, or is a table (rule, verdict) of any size; rules that are null, or
    whose verdict is neither, are left out, and a rule with both verdicts allows.  A rule fits its host and the hosts below it if the url's
    path starts with the rule's; the longest wins, of equally long ones the first by code point.  An unlisted url gets ``default``.
    A first cascade tells which of a url's candidate keys are listed, a second one which listed keys allow.  Their universe
    is every candidate key of every url, so both are exact for this table.  A filter travels inside the expression and takes
    ``most_bytes`` at most: keys that need more are dealt by their digest to as many cascades as it takes, and the rows
    are read once for each.  The number of different lengths of the rules' paths has to be small, as each is tried.
    Null urls have empty host and path and match no rule with a host; rows and other columns stay as they are (columns named like the
    results are replaced); an empty table stays empty.
    """
    spark = pages.sparkSession
    scratch = scratch or Scratch(spark, "urls")
    if isinstance(rules, dict):
        rules = spark.createDataFrame(list(rules.items()), "rule string, verdict string")
    own = rules.filter("rule is not null and verdict in ('allow', 'block')").groupBy(F.col("rule").alias("key")).agg(F.max(F.col("verdict") == "allow").alias("allow"))
    own = scratch.cut(own, "rules")
    name = F.substring_index("key", "/", 1)
    shape = own.agg(
        F.max(F.length(name) - F.length(F.replace(name, F.lit("."), F.lit("")))).alias("dots"), F.collect_set(F.length("key") - F.length(name)).alias("lengths")
    ).first()
    labels, lengths = (shape["dots"] or 0) + 1, sorted(shape["lengths"])
    host, path = url_parts(F.col("url"))
    rows = pages.withColumns({"host": host, "path": path})
    candidates = candidate_keys(F.col("host"), F.col("path"), labels, lengths) if lengths else F.array().cast("array<string>")

    universe = rows.select(F.explode(candidates).alias("key"), F.lit(False).alias("listed"), F.lit(False).alias("allow"))
    keys = universe.unionByName(own.select("key", F.lit(True).alias("listed"), "allow")).groupBy("key").agg(F.max("listed").alias("listed"), F.max("allow").alias("allow"))
    keys = scratch.cut(keys, "keys")
    n = keys.agg(F.count_if("listed").alias("n"), F.count_if(~F.col("listed")).alias("others")).first()
    # The first filter is the largest but for chance; an eighth of the room is left for keys that are dealt unevenly.
    parts = math.ceil(_bits(n["n"], _first_rate(n["n"], n["others"])) / 8 / most_bytes * 8 / 7) if n["n"] else 0
    found = "_found"
    while found in [c.lower() for c in rows.columns]:
        found += "_"
    rows = rows.withColumn(found, F.array().cast("array<struct<key:string,allow:boolean>>"))
    before = None
    for part in range(parts):
        here = lambda k: F.pmod(F.xxhash64(F.lit("part"), k), F.lit(parts)) == part  # noqa: B023, E731
        mine = keys.filter(here(F.col("key")))
        member = build_cascade(mine, most_bytes)
        allows = build_cascade(mine.filter("listed").select("key", F.col("allow").alias("listed")), most_bytes)
        hits = F.filter(candidates, lambda k: here(k) & member.has(k))  # noqa: B023
        rows = rows.withColumn(found, F.concat(found, F.transform(hits, lambda k: F.struct(k.alias("key"), allows.has(k).alias("allow")))))  # noqa: B023
        if part < parts - 1:
            rows = scratch.cut(rows, "rows")
            if before is not None:
                scratch.drop(before)
            before = rows
    scratch.drop(keys, own)
    rows = rows.withColumn(found, _longest(F.col(found)))
    verdict = F.when(F.col(found).isNull(), default).otherwise(F.when(F.col(found)["allow"], "allow").otherwise("block"))
    return rows.withColumns({"rule": F.col(found)["key"], "verdict": verdict}).drop(found)
