"""URL filter: host/path rules first, then a weighted URL vocabulary.

A rule ``(host, path)`` fits its host and all subdomains if the url's path starts with the rule's
path; the longest fitting rule decides (host and path together; of equal ones that with the longer
host, then a blocking one).  Where none fits, an Aho-Corasick automaton counts strict and soft terms in
the whole lower-cased url.  A term counts only at boundaries (no ASCII letter or digit next to it).
One strict term, or two distinct soft terms or more whose weights reach the threshold, block the url;
a single soft term never does, whatever its weight.

The vocabulary is a parameter (``Vocabulary``) and can be read from a table of terms.

Scale: one pass over the rows, nothing is shuffled; rules and vocabulary are parameters of a checked
size.  Host, path and rules are native expressions; the automaton is built once a task and runs on
Arrow batches, only for urls that no rule decides, in time linear in the url's length.

Defined cases: a null url, or one without ``://``, has empty host and path and no rule; null and empty
urls have no terms and are allowed; very long urls are read whole; repeated rows are judged alike;
extra columns are kept, but for those named like the result's, which are replaced; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Fixed vocabulary: terms that block alone, and soft ones with their weights.
STRICT = tuple(sorted("""
    casino cheap-pills free-money malware porn spam-farm warez xxx
    botnet camgirls carding counterfeit crackz darkmarket escorts exploit-kit fake-id hentai hardcore-sex
    keygen keylogger nsfw nude nudes onlinecasino phishing pharma-discount pornstar ransomware rat-builder
    replica-watches serialz sexcam shemale stolen-cards torrentz trojan viagra-online webcam-girls xrated
""".split()))  # fmt: skip
SOFT = {
    **dict.fromkeys("""
        adult ads affiliate auction banner bargain best-price bet bets betting bonus buy-now cash cheap click clickbait clickhere
        coupon coupons credit crypto dating deal deals debt discount download doubler earn escort farm fast-cash flirt
        forex free freebie gambling gift giveaway hookup hot hyip income invest jackpot join-now keno lender loan loans lottery
        lucky mlm mortgage naked offer offers payday pharma pharmacy pills poker popup prize promo promotion pyramid
        rebate referral replica rich roulette sale sexy singles slots spam spin stream-free surveys sweepstakes tabs
        ticker toolbar traffic unlimited unlock vip viral voucher wager weightloss win winner
    """.split(), 1),
    **dict.fromkeys("blackjack cialis crackme hacked levitra lolita steroids viagra xanax".split(), 2),
}
SOFT_LIMIT, SOFT_TERMS = 2, 2


@dataclass(frozen=True)
class Vocabulary:
    """Strict terms, weighted soft ones, and what blocks a url."""

    strict: tuple[str, ...] = STRICT
    soft: dict[str, int] = field(default_factory=lambda: dict(SOFT))
    limit: int = SOFT_LIMIT
    distinct: int = SOFT_TERMS

    @staticmethod
    def read(table: DataFrame, limit: int = SOFT_LIMIT, most: int = 200_000) -> Vocabulary:
        """From ``term, weight`` (null for strict), at most ``most`` rows; a term named twice has its
        strictest entry."""
        rows = table.where("term is not null and term <> ''").groupBy(F.lower("term").alias("term"))
        rows = rows.agg(F.max(F.col("weight").isNull()).alias("strict"), F.max("weight").alias("weight")).limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"a vocabulary has at most {most} terms")
        return Vocabulary(tuple(sorted(r["term"] for r in rows if r["strict"])), {r["term"]: int(r["weight"]) for r in rows if not r["strict"]}, limit)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    return ((host == rule[0]) | host.endswith("." + rule[0])) & path.startswith(rule[1])


def boundary_hits(automaton: ahocorasick.Automaton, url: str) -> set[str]:
    """Distinct terms in ``url`` (lower-cased) with no ASCII letter or digit beside them."""
    solid = lambda c: c.isascii() and c.isalnum()
    found = set()
    for end, term in automaton.iter(url):
        start = end - len(term) + 1
        if (start == 0 or not solid(url[start - 1])) and (end + 1 == len(url) or not solid(url[end + 1])):
            found.add(term)
    return found


def build_automaton(terms) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for t in terms:
        a.add_word(t, t)
    if len(a):
        a.make_automaton()
    return a


def judge(pages: DataFrame, rules=RULES, vocabulary: Vocabulary | None = None, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, strict_hits, soft_hits, soft_weight and verdict."""
    words = vocabulary or Vocabulary()

    @F.pandas_udf("struct<strict_hits int, soft_hits int, soft_weight int>")
    def terms(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton, hard = build_automaton([*words.strict, *words.soft]), set(words.strict)
        for urls in parts:
            hits = [boundary_hits(automaton, u.lower()) if u and len(automaton) else set() for u in urls]
            yield pd.DataFrame({"strict_hits": [len(h & hard) for h in hits], "soft_hits": [len(h - hard) for h in hits], "soft_weight": [sum(words.soft[t] for t in h - hard) for h in hits]})

    host, path = F.col("host"), F.col("path")
    rule = verdict = None
    for r in _by_length(rules):
        rule = F.when(_fits(host, path, r), r[0] + r[1]) if rule is None else rule.when(_fits(host, path, r), r[0] + r[1])
        verdict = F.when(_fits(host, path, r), r[2]) if verdict is None else verdict.when(_fits(host, path, r), r[2])
    judged = pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    judged = judged.withColumn("rule", rule if rule is not None else F.lit(None).cast("string"))
    judged = judged.withColumn("__hf_t", terms(F.when(F.col("rule").isNull(), F.col(url))))
    judged = judged.withColumns({c: F.col(f"__hf_t.{c}") for c in ("strict_hits", "soft_hits", "soft_weight")}).drop("__hf_t")
    method = F.when((F.col("strict_hits") > 0) | ((F.col("soft_hits") >= words.distinct) & (F.col("soft_weight") >= words.limit)), "block").otherwise("allow")
    return judged.withColumn("verdict", F.coalesce(verdict, method) if verdict is not None else method)


def _by_length(rules):
    return sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[2] != "block"))


def op8_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits", "soft_weight")


def _sql() -> str:
    u = "lower(coalesce(url, ''))"
    esc = lambda t: t.replace("-", "\\-")
    has = lambda t: f"CAST(regexp_matches({u}, '(^|[^a-z0-9]){esc(t)}($|[^a-z0-9])') AS INTEGER)"
    strict = " + ".join(has(t) for t in STRICT)
    count = " + ".join(has(t) for t in SOFT)
    soft = " + ".join(f"{w} * {has(t)}" for t, w in SOFT.items())
    fits = lambda r: f"(host = '{r[0]}' OR ends_with(host, '.{r[0]}')) AND starts_with(path, '{r[1]}')"
    order = _by_length(RULES)
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r[0]}{r[1]}'" for r in order) + " END"
    verdict = "CASE " + " ".join(f"WHEN rule = '{r[0]}{r[1]}' THEN '{r[2]}'" for r in order) + f" WHEN strict_hits > 0 OR (soft_hits >= {SOFT_TERMS} AND soft_weight >= {SOFT_LIMIT}) THEN 'block' ELSE 'allow' END"
    return f"""
WITH p AS (SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, {rule} AS rule FROM p),
t AS (SELECT page_id, host, path, rule, CASE WHEN rule IS NULL THEN {strict} ELSE 0 END AS strict_hits, CASE WHEN rule IS NULL THEN {count} ELSE 0 END AS soft_hits, CASE WHEN rule IS NULL THEN {soft} ELSE 0 END AS soft_weight FROM r)
SELECT page_id, host, path, rule, CAST(strict_hits AS INTEGER) AS strict_hits, CAST(soft_hits AS INTEGER) AS soft_hits, CAST(soft_weight AS INTEGER) AS soft_weight, {verdict} AS verdict FROM t
"""


SQL = _sql()
