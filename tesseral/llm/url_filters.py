"""URL verdicts from an indexed rule set, in SQL expressions only.

Two rule layers.  *Host rules* name a host suffix and a path prefix; the longest that fits wins.
*Pattern rules* are regular expressions over the lower-cased host and path; the first that matches decides.
Each is filed under its rarest literal token, the tokens of a URL fetch the rules filed under them, and
only those rules run their expression.  The tokens that any match must hold are read off the expression itself,
so the index loses no match; a rule without such a token runs on every URL.

An index is a constant array of slots by token hash: a lookup is one array access, whatever the number of rules.
It is part of the plan, so rule sets are bounded by ``MAX_RULES``.
"""
from __future__ import annotations

import json
import re
from collections import Counter
from dataclasses import dataclass
from re import _constants as sre, _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[a-z0-9]+"
TOKEN_CHARS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
#: Rules of each layer at most: they are sent with the plan (some 100 bytes each).
MAX_RULES = 50_000


@dataclass(frozen=True)
class HostRule:
    """``verdict`` for ``host`` and all its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """A regular expression over the lower-cased host + path."""

    verdict: str
    pattern: str


HOST_RULES = (
    HostRule("allow", "com", "/"),
    HostRule("block", "example.com", "/en/"),
    HostRule("allow", "www.example.com", "/en/"),
    HostRule("block", "net", "/es/"),
    HostRule("block", "net", "/fr/"),
)
#: Words that block a URL where they stand alone.
SPAM_WORDS = "casino poker roulette blackjack jackpot slots betting bookmaker lottery viagra cialis levitra xanax tramadol payday xxx porno hentai camgirls escorts warez keygen torrentz clickbank".split()
#: Offers that block a URL, as any of these words before any of those.
OFFERS = "cheap discount generic buy order free online bulk instant easy".split()
GOODS = "pills meds drugs pharmacy steroids loans credit mortgage watches replica followers likes backlinks essays diplomas ringtones downloads software visas insurance".split()
PATTERN_RULES = (
    *(PatternRule("block", f"(^|[^a-z0-9]){w}([^a-z0-9]|$)") for w in SPAM_WORDS),
    *(PatternRule("block", f"(^|[^a-z0-9]){a}[._-]{b}([^a-z0-9]|$)") for a in OFFERS for b in GOODS),
    PatternRule("block", r"(^|[./_-])(free[._-]?)?porn([./_-]|$)"),
    PatternRule("block", r"(^|[./_-])(link|spam|splog)[._-]?farms?([./_-]|$)"),
    PatternRule("block", r"/wp-(login|signup|cron)\.php$"),
    PatternRule("block", r"/cgi-bin/.*\.cgi$"),
    PatternRule("block", r"/xmlrpc\.php$"),
    PatternRule("block", r"/phpmyadmin(/|$)"),
    PatternRule("block", r"/(login|logout|signin|signup|register)/?$"),
    PatternRule("block", r"^(ads?|adserver|banners?|track(er|ing)?|pixel)[0-9]*\."),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host ends at ``/``, ``?`` or ``#`` and has A-Z lower-cased; no ``://`` or null: empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(low, F.lit("")), F.coalesce(path, F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host and every parent domain: ``a.b.c`` -> [a.b.c, b.c, c]."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def _apart(item) -> bool:
    """Whether what ``item`` matches begins and ends with a character outside a token, or is an end of the text."""
    kind, value = item
    if kind is sre.LITERAL:
        return chr(value) not in TOKEN_CHARS
    if kind is sre.AT:
        return value in (sre.AT_BEGINNING, sre.AT_BEGINNING_STRING, sre.AT_END, sre.AT_END_STRING)
    if kind is sre.IN:
        negated = value[0][0] is sre.NEGATE
        plain = [(v, v) if k is sre.LITERAL else v for k, v in value if k in (sre.LITERAL, sre.RANGE)]
        holds = [any(lo <= ord(c) <= hi for lo, hi in plain) for c in TOKEN_CHARS]
        return all(holds) if negated else len(plain) == len(value) and not any(holds)
    if kind is sre.SUBPATTERN:
        return len(value[-1]) == 1 and _apart(value[-1][0])
    if kind is sre.BRANCH:
        return all(len(branch) == 1 and _apart(branch[0]) for branch in value[1])
    return False


def literals(pattern: str) -> frozenset[str]:
    """Tokens that every URL with a match holds whole: runs of token characters of the top-level
    sequence (groups that must occur are opened) with something on both sides that ends a token."""
    found, run, open_left = set(), "", False

    def close(bounded: bool) -> None:
        nonlocal run
        if run and open_left and bounded:
            found.add(run)
        run = ""

    def walk(items) -> None:
        nonlocal run, open_left
        for item in items:
            kind, value = item
            if kind is sre.LITERAL and chr(value) in TOKEN_CHARS:
                run += chr(value)
            elif kind is sre.SUBPATTERN and not _apart(item) and not value[1] and not value[2]:
                walk(value[-1])
            else:
                apart = _apart(item)
                close(apart)
                open_left = apart

    walk(parser.parse(pattern))
    close(False)
    return frozenset(found)


def index_patterns(rules: tuple[PatternRule, ...]) -> tuple[dict[str, list[int]], list[int]]:
    """Rarest literal (fewest rules hold it; ties: longest, then alphabetical) -> rule numbers; rules without literals."""
    held = [literals(r.pattern) for r in rules]
    count = Counter(t for ts in held for t in ts)
    index: dict[str, list[int]] = {}
    for i, ts in enumerate(held):
        if ts:
            index.setdefault(min(ts, key=lambda t: (count[t], -len(t), t)), []).append(i)
    return index, [i for i, ts in enumerate(held) if not ts]


def _slot(token: str, slots: int) -> int:
    """crc32 as Spark has it, so that driver and executors agree."""
    from zlib import crc32

    return crc32(token.encode()) % slots


def _lookup(index: dict[str, list[dict]], fields: str):
    """A function from a token column to the array of entries filed under it."""
    slots = max(1, 2 * len(index))
    table: list[list[dict]] = [[] for _ in range(slots)]
    for token, entries in index.items():
        table[_slot(token, slots)] += [{"token": token} | e for e in entries]
    known = F.from_json(F.lit(json.dumps(table)), f"array<array<struct<token:string,{fields}>>>")
    return lambda t: F.filter(F.element_at(known, (F.pmod(F.crc32(t.cast("binary")), F.lit(slots)) + 1).cast("int")), lambda e: e["token"] == t)


def _host_rule(host: Column, path: Column, rules: tuple[HostRule, ...]) -> Column:
    """Struct of the longest fitting rule (host length, then path length), null without one."""
    if not rules:
        return F.lit(None).cast("struct<size:int,name:string,verdict:string>")
    by_host: dict[str, list[dict]] = {}
    for r in rules:
        by_host.setdefault(r.host, []).append({"size": len(r.host) + len(r.path), "name": r.name, "verdict": r.verdict, "path": r.path})
    find = _lookup(by_host, "size:int,name:string,verdict:string,path:string")
    fetched = F.flatten(F.transform(host_suffixes(host), find))
    fit = F.filter(fetched, lambda r: F.startswith(path, r["path"]))
    return F.array_max(F.transform(fit, lambda r: F.struct(r["size"], r["name"], r["verdict"])))


def _pattern_verdict(target: Column, rules: tuple[PatternRule, ...]) -> Column:
    """Verdict of the first (lowest-numbered) pattern that matches, null without one."""
    if not rules:
        return F.lit(None).cast("string")
    index, rest = index_patterns(rules)
    entry = lambda i: {"id": i, "verdict": rules[i].verdict, "pattern": rules[i].pattern}
    find = _lookup({t: [entry(i) for i in ids] for t, ids in index.items()}, "id:int,verdict:string,pattern:string")
    tokens = F.array_distinct(F.regexp_extract_all(target, F.lit(f"({TOKEN})"), 1))
    fetched = F.flatten(F.transform(tokens, find))
    indexed = F.transform(F.filter(fetched, lambda r: F.rlike(target, r["pattern"])), lambda r: F.struct(r["id"].alias("id"), r["verdict"].alias("verdict")))
    always = [F.when(F.rlike(target, F.lit(rules[i].pattern)), F.struct(F.lit(i).alias("id"), F.lit(rules[i].verdict).alias("verdict"))) for i in rest]
    best = F.array_min(indexed)
    return (F.least(best, *always) if always else best)["verdict"]


def judge_urls(pages: DataFrame, host_rules=HOST_RULES, pattern_rules=PATTERN_RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``.

    Only page_id and url are read, so other columns may have any name.  A null url, or one without
    ``://``, has empty host and path and gets ``default`` unless a pattern says otherwise (none can
    match the empty text).  Repeated rows are judged one by one; an empty table gives no rows.
    Very long URLs are judged whole; of pattern rules that match, the first in the list decides, and host
    rules of one length cannot both fit.  One narrow projection: no shuffle, no Python, so a host with a third of
    all rows is as good as any.
    """
    if max(len(host_rules), len(pattern_rules)) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules of one layer")
    host, path = url_parts(F.col("url"))
    base = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"))
    cut = base.select("page_id", host.alias("host"), path.alias("path"))
    low = F.lower(F.concat(F.col("host"), F.col("path")))
    found = cut.select("page_id", "host", "path", _host_rule(F.col("host"), F.col("path"), tuple(host_rules)).alias("r"), low.alias("low"))
    verdict = F.coalesce(F.col("r.verdict"), _pattern_verdict(F.col("low"), tuple(pattern_rules)), F.lit(default))
    return found.select("page_id", "host", "path", F.col("r.name").alias("rule"), verdict.alias("verdict"))


_QUOTED = ",\n    ".join("({}, '{}', '{}')".format(i, r.verdict, r.pattern.replace("'", "''")) for i, r in enumerate(PATTERN_RULES))
ORACLE_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN url IS NOT NULL AND instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM cut
), rules(verdict, rh, rp) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), best AS (
  SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
  FROM parts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  GROUP BY page_id
), patterns(id, verdict, pattern) AS (
  VALUES {_QUOTED}
), matched AS (
  SELECT page_id, arg_min(patterns.verdict, id) AS verdict
  FROM parts JOIN patterns ON regexp_matches(lower(host || path), pattern)
  WHERE page_id NOT IN (SELECT page_id FROM best)
  GROUP BY page_id
)
SELECT p.page_id, host, path, b.rule AS rule, coalesce(b.verdict, m.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN best b USING (page_id) LEFT JOIN matched m USING (page_id)
"""
