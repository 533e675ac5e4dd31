"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

Every url is written as a few canonical expressions: its host and each parent domain, with its path and each directory above
it. A listed entry covers a url if it is one of these expressions. The filter is a table of blocks of eight 32-bit words, as
many as the list needs; an expression is a possible hit if its block has its bit in each word. Possible hits go to an exact
join with the list, so false positives of the filter never reach the result.

Each pair of host and path is looked up once, however many rows have it. The filter and the list are broadcast only below a
checked size. Beyond, each expression is looked up once too, however many urls lie below it, and what is found goes back to
urls and rows by joins on salted keys.

Rules of host and path judge first, the longest that fits; the list judges the urls that no rule fits.

Defined results: a null url, or one without "://", has an empty host and path, fits no rule or entry and is allowed; urls of any
length are judged whole; repeated rows each get a result; null or empty entries of the list are ignored; with an empty list every
url without a rule is allowed. The columns that are added take the place of columns of the same names; others are carried along.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

# The contract's rules (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
# The default list's domains, each listed whole ("/" covers all below it).
LISTED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED = tuple(f"{name}.example.{top}/" for name in LISTED_NAMES for top in ("com", "net", "org"))
#: Bits of the filter for each listed entry, and the largest filter that is broadcast (bytes of its words).
BITS_PER_ENTRY, BROADCAST_BYTES = 16, 64 << 20
WORDS = 8
#: Bytes that are reckoned for a listed url where its broadcast is considered.
URL_BYTES = 512
#: Parts that the rows of one key are dealt in where a join is by shuffle.
SALTS = 32

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def with_host_and_path(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host and path as the contract has them. (?s) lets the end be the end of a text with line breaks."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return pages.withColumn("host", lower_ascii(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0))).withColumn("path", F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1))


def fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)


def with_rule(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule and rule_verdict of the longest rule that fits (both null: none)."""
    host, path = F.col("host"), F.col("path")
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    first = lambda value: F.coalesce(*(F.when(fits(host, path, r[1], r[2]), F.lit(value(r))) for r in longest))
    return pages.withColumn("rule", first(lambda r: r[1] + r[2])).withColumn("rule_verdict", first(lambda r: r[0]))


def canonical_path(path: Column) -> Column:
    """Without .html and repeated or last slashes; the root is "/"."""
    p = F.regexp_replace(F.regexp_replace(path, r"/{2,}", "/"), r"\.html?$|/$", "")
    return F.when(p == "", "/").otherwise(p)


def host_levels(host: Column) -> Column:
    """Array of the host and each parent domain of two labels at least; empty without a host."""
    bare = F.regexp_replace(host, r":\d+$|\.$", "")
    labels = F.split(bare, r"\.")
    levels = F.size(labels)
    hosts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), levels - 2)), lambda i: F.array_join(F.slice(labels, i + 1, levels - i), "."))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(hosts)


def path_levels(path: Column) -> Column:
    """Array of the canonical path and each directory above it."""
    clean = canonical_path(path)
    parts = F.split(clean, "/")
    above = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)),
        lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")),
    )
    return F.array_distinct(F.concat(F.array(clean), above))


def expressions(urls: DataFrame) -> DataFrame:
    """urls(host, path) -> (host, path, entry), the canonical expressions of each; a url's pairs of levels are never held at once."""
    hosts = urls.select("host", "path", F.explode(host_levels(F.col("host"))).alias("h"))
    return hosts.select("host", "path", "h", F.explode(path_levels(F.col("path"))).alias("p")).select("host", "path", F.concat("h", "p").alias("entry"))


def canonical_entry(url: Column) -> Column:
    """A listed url, with or without a scheme, as an expression. A path that ends in "/" covers all below it."""
    bare = F.regexp_replace(F.regexp_replace(url, r"(?s)^.*?://", ""), r"(?s)[?#].*$", "")
    host = F.regexp_replace(lower_ascii(F.regexp_extract(bare, r"^[^/]*", 0)), r":\d+$|\.$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"(?s)^[^/]*(.*)$", 1), r"/{2,}", "/")
    return F.concat(host, F.when(path.rlike("/$"), path).otherwise(canonical_path(path)))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks).cast("long"))


def _masks(key: Column) -> list[Column]:
    """One bit in each of the block's words, from a second hash."""
    second = F.xxhash64(F.lit("bits"), key)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned(second, 8 * i), F.lit(32)).cast("int")) for i in range(WORDS)]


def bloom_blocks(entries: DataFrame, blocks: int) -> DataFrame:
    """entries(entry) -> (block, w0, ..., w7). Bits meet in a partial aggregation before the shuffle."""
    bits = entries.select(_block(F.col("entry"), blocks).alias("block"), *(m.alias(f"w{i}") for i, m in enumerate(_masks(F.col("entry")))))
    return bits.groupBy("block").agg(*(F.expr(f"bit_or(w{i})").alias(f"w{i}") for i in range(WORDS)))


def _salted(rows: DataFrame, found: DataFrame, keys: list[str], how: str) -> DataFrame:
    """rows joined with found, which has each key once: found is there in all parts that the rows of a key are dealt in, by a
    hash of their columns."""
    hashed = [f.name for f in rows.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(*hashed), F.lit(SALTS)).cast("int"))
    copies = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, [*keys, "salt"], how).drop("salt")


def listed_urls(urls: DataFrame, entries: DataFrame, bits_per_entry: int, broadcast_bytes: int) -> DataFrame:
    """Of urls(host, path), each once, those below one of entries(entry)."""
    blocks = max(1, -(-entries.count() * bits_per_entry // (32 * WORDS)))
    filter_table = bloom_blocks(entries, blocks)
    small = blocks * (WORDS + 1) * 8 <= broadcast_bytes
    tried = expressions(urls)
    lookups = tried if small else tried.select("entry").distinct()
    possible = lookups.withColumn("block", _block(F.col("entry"), blocks)).join(F.broadcast(filter_table) if small else filter_table, "block")
    possible = possible.filter(reduce(lambda a, b: a & b, (F.col(f"w{i}").bitwiseAND(m) != 0 for i, m in enumerate(_masks(F.col("entry"))))))
    exact = possible.join(F.broadcast(entries) if small else entries, "entry")
    found = exact if small else _salted(tried, exact.select("entry"), ["entry"], "inner")
    return found.select("host", "path").distinct()


def listed_hits(pages: DataFrame, listed: DataFrame, bits_per_entry: int = BITS_PER_ENTRY, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """pages with host and path -> pages with a boolean listed. listed has one string column, the urls or hosts."""
    entries = listed.select(canonical_entry(F.col(listed.columns[0])).alias("entry")).filter("entry is not null and entry <> '' and entry not like '/%'").distinct()
    if entries.isEmpty():
        return pages.withColumn("listed", F.lit(False))
    found = materialize(listed_urls(pages.select("host", "path").distinct(), entries, bits_per_entry, broadcast_bytes), "listed-urls")
    # Other columns wait under names of their own, so that none clashes with those of the joins.
    names = {c: f"_c{i}" for i, c in enumerate(pages.columns) if c not in ("host", "path", "listed")}
    rows = pages.select("host", "path", *(F.col(c).alias(n) for c, n in names.items()))
    found = found.withColumn("listed", F.lit(True))
    if found.limit(broadcast_bytes // URL_BYTES + 1).count() <= broadcast_bytes // URL_BYTES:
        hit = rows.join(F.broadcast(found), ["host", "path"], "left")
    else:
        hit = _salted(rows, found, ["host", "path"], "left")
    back = {n: c for c, n in names.items()}
    columns = [c for c in pages.columns if c != "listed"]
    return hit.select(*(F.col(names.get(c, c)).alias(back.get(c, c)) for c in columns), F.coalesce("listed", F.lit(False)).alias("listed"))


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, url_col: str = "url") -> DataFrame:
    """pages with host, path, rule, listed and verdict added."""
    judged = listed_hits(with_rule(with_host_and_path(pages, url_col), rules), listed)
    by_list = F.when(F.col("listed"), "block").otherwise("allow")
    return judged.withColumn("verdict", F.coalesce("rule_verdict", by_list)).drop("rule_verdict")


def op2_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = spark.createDataFrame([(x,) for x in LISTED], "url string")
    return judge(pages, listed).select("page_id", "host", "path", "rule", "verdict")


def op2_oracle() -> str:
    longest = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fit = lambda r: f"(host = '{r[1]}' or host like '%.{r[1]}') and starts_with(path, '{r[2]}')"
    listed = " or ".join(f"bare = '{h}' or bare like '%.{h}'" for h in (x.rstrip("/") for x in LISTED))
    return f"""
with cut as (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
parts as (select page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') as host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
ruled as (select *, regexp_replace(host, ':[0-9]+$|\\.$', '') as bare,
  case {" ".join(f"when {fit(r)} then '{r[1] + r[2]}'" for r in longest)} end as rule,
  case {" ".join(f"when {fit(r)} then '{r[0]}'" for r in longest)} end as said from parts)
select page_id, host, path, rule, coalesce(said, case when {listed} then 'block' else 'allow' end) as verdict from ruled
"""
