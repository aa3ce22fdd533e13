"""Operator 5, URL filters: rules indexed by their rarest literal token.

Every rule, a host-and-path rule or a pattern rule, is a regular expression with literal tokens, runs of
[a-z0-9] with other characters or ends on both sides.  Counted over all URLs, the rarest of a rule's
tokens is its key; a URL's tokens fetch the rules of those keys, and only these run.  Rules without such
a token always run.  Among host-and-path rules that fit, the longest wins (then the longer host, then
the text); it gives the verdict.  Else the verdict is ``block`` if a pattern rule fits, else ``allow``.

Defined results: a null URL or one without ``://`` has an empty host and path, no rule and the method's
verdict; repeated rows each give a row; extra columns are ignored; an empty table gives an empty result.
Rules travel in slices of bounded size, each a pass over the rows without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_RULES = 100_000
TOKEN = re.compile(r"[a-z0-9]+")
A_Z = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@dataclass(frozen=True)
class Rule:
    """``where``: what the pattern is searched in: ``place`` (host and path) or ``url`` (A-Z lower-cased)."""

    text: str
    verdict: str
    pattern: str
    where: str


def host_rule(verdict: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(text, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}", "place")


def pattern_rule(pattern: str) -> Rule:
    return Rule(pattern, "block", pattern, "url")


HOST_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
PATTERN_RULES = (
    r"://(?:[^/?#]*\.)?(?:porn|xxx|sex|adult)[^/?#]*\.",
    r"[/.-]casino(?:[/.-]|$)",
    r"/(?:wp-)?login(?:[./?#]|$)",
    r"/cart/(?:add|checkout)\b",
    r"[?&]affiliate_id=\d+",
    r"\.(?:exe|zip|rar|apk)(?:[?#]|$)",
    r"[?&]phpsessid=[0-9a-f]{8,}",
)
DEFAULT_RULES = (*(host_rule(*r) for r in HOST_RULES), *map(pattern_rule, PATTERN_RULES))


def _apart(op, value) -> bool:
    """Whether an item matches one character other than [a-z0-9], or an end of the text or of a word."""
    if op is C.LITERAL:
        return not TOKEN.fullmatch(chr(value))
    if op is C.AT:
        return value in (C.AT_BOUNDARY, C.AT_BEGINNING, C.AT_BEGINNING_STRING, C.AT_END, C.AT_END_STRING)
    if op is C.IN:
        return all(o is C.LITERAL and not TOKEN.fullmatch(chr(v)) for o, v in value)
    if op is C.SUBPATTERN:
        return len(value[3]) == 1 and _apart(*value[3][0])
    return op is C.BRANCH and all(len(x) == 1 and _apart(*x[0]) for x in value[1])


def _lead(op, value) -> bool:
    """Whether an item is an optional group that ends in a character other than [a-z0-9]."""
    if op is not C.MAX_REPEAT or value[0]:
        return False
    inner = list(value[2])
    if len(inner) == 1 and inner[0][0] is C.SUBPATTERN:
        inner = list(inner[0][1][3])
    return _apart(*inner[-1])


def literal_tokens(pattern: str) -> set[str]:
    """Tokens that any match holds whole, from the top level of the parsed pattern."""
    run = []  # literal characters, a space for what sets tokens apart, a null where anything may stand
    for op, value in _parser.parse(pattern):
        if op is C.LITERAL:
            run.append(chr(value))
        elif _apart(op, value):
            run.append(" ")
        elif not (_lead(op, value) and run and not TOKEN.fullmatch(run[-1])):  # such a group leaves the next token set apart
            run.append("\0")
    text = "\0" + "".join(run) + "\0"
    return {m[0] for m in TOKEN.finditer(text) if "\0" not in (text[m.start() - 1], text[m.end()])}


def compiled(pattern: str) -> re.Pattern[str]:
    """The pattern with digits, words and their borders of ASCII, and ``$`` for the very end of the text, also after a newline."""
    ends = re.sub(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\$", lambda m: r"\Z" if m[0] == "$" else m[0], pattern, flags=re.S)
    return re.compile(ends, re.ASCII)


class RuleIndex:
    def __init__(self, rules: list[Rule], counts: dict[str, int]):
        self.always, self.by_token = [], defaultdict(list)
        for rule in rules:
            entry = (rule, compiled(rule.pattern))
            tokens = literal_tokens(rule.pattern)
            if tokens:
                self.by_token[min(tokens, key=lambda t: (counts.get(t, 0), t))].append(entry)
            else:
                self.always.append(entry)

    def judge(self, host: str, path: str, url: str) -> tuple[str | None, str]:
        """(rule, verdict)."""
        low = url.translate(A_Z)
        place = host + path
        fitting = [r for r, p in self.always if p.search(place if r.where == "place" else low)]
        for token in set(TOKEN.findall(low)):
            fitting += [r for r, p in self.by_token.get(token, ()) if p.search(place if r.where == "place" else low)]
        placed = [r for r in fitting if r.where == "place"]
        if placed:
            best = max(placed, key=rank)
            return best.text, best.verdict
        return None, "block" if fitting else "allow"


def rank(rule: Rule) -> tuple:
    return len(rule.text), rule.text.find("/"), rule.text


def _count(tokens: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for url in batch.column(0).to_pylist():
                counts.update(tokens.intersection(TOKEN.findall((url or "").translate(A_Z))))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["token", "n"])

    return run


def _judge(index: RuleIndex, by_text: dict[str, Rule]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rules, verdicts = [], []
            cols = [batch.column(c).to_pylist() for c in ("host", "path", "url", "rule", "verdict")]
            for host, path, url, old, verdict in zip(*cols, strict=True):
                rule, new = index.judge(host, path, url or "")
                if old is not None and (rule is None or rank(by_text[old]) > rank(by_text[rule])):
                    rule, new = old, verdict
                elif rule is None and verdict == "block":
                    new = "block"
                rules.append(rule)
                verdicts.append(new)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], names=batch.schema.names)

    return run


def url_verdicts(spark: SparkSession, pages: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES, slice_rules: int = SLICE_RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages`` (page_id, url)."""
    rest = F.expr("CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END")
    parts = pages.select("page_id", "url", F.coalesce(rest, F.lit("")).alias("_rest")).select(
        "page_id",
        F.translate(F.regexp_extract("_rest", r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"),
        F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1).alias("path"),
        "url",
        F.lit(None).cast("string").alias("rule"),
        F.lit("allow").alias("verdict"),
    )
    kind = pages.schema["page_id"].dataType.simpleString()
    by_text = {r.text: r for r in rules if r.where == "place"}
    for at in range(0, len(rules), slice_rules):
        part = list(rules[at : at + slice_rules])
        tokens = frozenset(t for r in part for t in literal_tokens(r.pattern))
        counted = pages.select("url").mapInArrow(_count(tokens), "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
        counts = {r.token: r.n for r in counted.collect()}  # no more rows than the slice's rules have tokens
        parts = parts.mapInArrow(_judge(RuleIndex(part, counts), by_text), f"page_id {kind}, host string, path string, url string, rule string, verdict string")
    return parts.select("page_id", "host", "path", "rule", "verdict")


def _sql_rules() -> str:
    cases = []
    for verdict, text in sorted(HOST_RULES, key=lambda r: rank(host_rule(*r)), reverse=True):
        host, slash, path = text.partition("/")
        cases.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash}{path}') THEN '{text}'")
    return "CASE " + " ".join(cases) + " END"


_VERDICTS = " ".join(f"WHEN rule = '{text}' THEN '{verdict}'" for verdict, text in HOST_RULES)
_PATTERNS = " OR ".join(f"regexp_matches(low, '{p}')" for p in PATTERN_RULES)
ORACLE_SQL = f"""
WITH r AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
  translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM r),
j AS (SELECT *, {_sql_rules()} AS rule FROM p)
SELECT page_id, host, path, rule, CASE {_VERDICTS} WHEN {_PATTERNS} THEN 'block' ELSE 'allow' END AS verdict FROM j
"""
