"""URL filter: allow and block rules by host and path, then a weighted vocabulary counted by an automaton."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDLIKE = frozenset(LOWER + "0123456789")

# Terms and weights. One strict term rejects; soft terms only together.
STRICT = dict.fromkeys("adult casino escort hentai porn porno poker roulette viagra warez xxx".split(), 1.0)
SOFT = dict.fromkeys(
    "ads bet bets bonus cheap cialis clicks crack dating farm free hot jackpot keygen loan loans lottery nude pills pill "
    "promo replica sale sex sexy slots spam torrent track win winner".split(),
    0.5,
)
SOFT_NEEDED = 2

# Fixed values: (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


@dataclass(frozen=True)
class Vocabulary:
    strict: tuple[tuple[str, float], ...]
    soft: tuple[tuple[str, float], ...]
    soft_needed: int = SOFT_NEEDED

    @classmethod
    def of(cls, strict: Mapping[str, float], soft: Mapping[str, float], soft_needed: int = SOFT_NEEDED) -> Vocabulary:
        return cls(tuple(strict.items()), tuple(soft.items()), soft_needed)


DEFAULT = Vocabulary.of(STRICT, SOFT)


@functools.cache
def _automaton(words: Vocabulary) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, terms in (("soft", words.soft), ("strict", words.strict)):
        for term, weight in terms:
            out.add_word(term, (kind, term, weight))
    out.make_automaton()
    return out


def hits(url: str | None, words: Vocabulary = DEFAULT) -> tuple[int, int, int, float]:
    """Strict terms, soft terms, distinct soft terms and the weight of the distinct terms in a URL.

    A term counts where neither an ASCII letter nor a digit touches it, A-Z being lower-cased.
    """
    if not url:
        return 0, 0, 0, 0.0
    low = url.translate(_LOWERED)
    strict = soft = 0
    seen: dict[str, tuple[str, float]] = {}
    for end, (kind, term, weight) in _automaton(words).iter(low):
        at = end - len(term)
        if (at >= 0 and low[at] in WORDLIKE) or (end + 1 < len(low) and low[end + 1] in WORDLIKE):
            continue
        strict, soft = strict + (kind == "strict"), soft + (kind == "soft")
        seen[term] = (kind, weight)
    return strict, soft, sum(k == "soft" for k, _ in seen.values()), float(sum(w for _, w in seen.values()))


_LOWERED = str.maketrans(UPPER, LOWER)


def _fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)


def judge(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES, words: Vocabulary = DEFAULT,
) -> DataFrame:
    """Id, ``host``, ``path``, ``rule``, ``verdict`` and the term counts of every row; row-wise, without an exchange.

    The longest rule (host and path together) that fits decides; without one, a URL is blocked for one strict term or
    ``soft_needed`` distinct soft terms. A null URL or one without ``://`` has empty host and path; null URLs are
    allowed. Rows that repeat are judged each; other columns are not read.
    """
    part = lambda k: F.coalesce(F.regexp_extract("_url", r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    named = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")).select(
        "_id", "_url", F.translate(part(1), UPPER, LOWER).alias("host"), part(2).alias("path")
    )

    @F.pandas_udf("strict long, soft long, distinct_soft long, weight double")
    def counted(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for some in urls:
            yield pd.DataFrame([hits(u, words) for u in some], columns=["strict", "soft", "distinct_soft", "weight"])

    rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = _fits(F.col("host"), F.col("path"), host, path)
        rule, said = F.when(fits, host + path).otherwise(rule), F.when(fits, verdict).otherwise(said)
    method = F.when((F.col("_h.strict") > 0) | (F.col("_h.distinct_soft") >= words.soft_needed), "block").otherwise("allow")
    return named.withColumns({"_h": counted("_url"), "rule": rule}).select(
        F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce(said, method).alias("verdict"),
        F.col("_h.strict").alias("strict_hits"), F.col("_h.soft").alias("soft_hits"),
        F.col("_h.distinct_soft").alias("distinct_soft_hits"), F.col("_h.weight").alias("weight"),
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every URL of ``pages``."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def sql(words: Vocabulary = DEFAULT, rules: Sequence[tuple[str, str, str]] = RULES) -> str:
    """The same by regular expressions, for DuckDB."""
    listed = ", ".join(
        f"('{term}', {kind}, {weight})" for kind, terms in ((1, words.strict), (0, words.soft)) for term, weight in terms
    )
    fitting = ", ".join(f"('{verdict}', '{host}', '{path}')" for verdict, host, path in rules)
    return rf"""
WITH terms(term, strict, weight) AS (VALUES {listed}),
rules(verdict, rule_host, rule_path) AS (VALUES {fitting}),
p AS (
    SELECT page_id, coalesce(translate(url, '{UPPER}', '{LOWER}'), '') AS low,
           coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
    FROM pages
), h AS (
    SELECT page_id, host, path, terms.*,
           len(regexp_extract_all(regexp_replace(low, '([^a-z0-9])', '\1\1', 'g'), '(^|[^a-z0-9])' || term || '($|[^a-z0-9])')) AS n
    FROM p CROSS JOIN terms
), c AS (
    SELECT page_id, host, path, sum(n * strict)::BIGINT AS strict_hits, sum(n * (1 - strict))::BIGINT AS soft_hits,
           count(*) FILTER (n > 0 AND strict = 0) AS distinct_soft_hits,
           coalesce(sum(weight) FILTER (n > 0), 0)::DOUBLE AS weight
    FROM h GROUP BY ALL
), r AS (
    SELECT page_id, arg_max(rule_host || rule_path, len(rule_host || rule_path)) AS rule,
           arg_max(verdict, len(rule_host || rule_path)) AS said
    FROM p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY page_id
)
SELECT c.page_id, host, path, rule,
       coalesce(said, CASE WHEN strict_hits > 0 OR distinct_soft_hits >= {words.soft_needed} THEN 'block' ELSE 'allow' END) AS verdict,
       strict_hits, soft_hits, distinct_soft_hits, weight
FROM c LEFT JOIN r USING (page_id)
"""
