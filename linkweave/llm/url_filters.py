"""URL filters: host and path rules, and regular expressions behind a token index.

A pattern rule is filed under the rarest of its literal tokens: runs of
[a-z0-9] that every match must contain whole. A URL's own tokens then fetch the
few rules that could match, and only those run. Rules without such a token are
few by design, and run on every URL. Tables and compiled patterns are made once
in a worker; lists of over `BLOCK` rules are judged in blocks.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterable
from dataclasses import dataclass
from re import _constants as K
from re import _parser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name, quoted

#: Rules that are sent to tasks at once.
BLOCK = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_FOLD = str.maketrans(UPPER, LOWER)

#: Pattern rules of the default filter; they run on URLs with A-Z in lower case.
PATTERNS = (
    r"\bcasino\b",
    r"\bpoker\b",
    r"\bfree-bets\b",
    r"\bbetting\b",
    r"\bcheap-pills\b",
    r"\bviagra\b",
    r"\badult-[a-z0-9]",
    r"\bporn\b",
    r"\bxxx\b",
    r"\bspam-farm\b",
    r"\bads-track\b",
    r"\bdoubleclick\b",
    r"[?&](?:sessionid|phpsessid)=",
)


@dataclass(frozen=True)
class HostRule:
    verdict: str  # allow or block
    host: str
    path: str

    def __str__(self) -> str:
        return self.host + self.path


def parse_rule(text: str) -> HostRule:
    """'block com/en/' and the like."""
    verdict, _, rest = text.partition(" ")
    host, slash, path = rest.partition("/")
    if verdict not in ("allow", "block") or not host:
        raise ValueError(f"not a rule: {text!r}")
    return HostRule(verdict, host.translate(_FOLD), slash + path)


def read_rules(lines: Iterable[str]) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(host rules, patterns) of a rule list: a rule a line, 'allow host/path',
    'block host/path' or 'pattern regular-expression'. Blank lines and those that
    begin with '#' say nothing."""
    hosts, patterns = [], []
    for n, line in enumerate(lines, 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        kind, _, rest = line.partition(" ")
        try:
            if kind == "pattern":
                re.compile(rest.strip(), re.ASCII)
                patterns.append(rest.strip())
            else:
                hosts.append(f"{kind} {rest.strip()}")
                parse_rule(hosts[-1])
        except (ValueError, re.error) as e:
            raise ValueError(f"line {n}: {e}") from e
    return tuple(hosts), tuple(patterns)


def _closed(item) -> bool:
    """Whether a pattern item never leaves an [a-z0-9] next to a literal run."""
    op, arg = item
    if op is K.AT:
        return arg in (K.AT_BOUNDARY, K.AT_BEGINNING, K.AT_BEGINNING_STRING, K.AT_END_STRING)
    if op is K.LITERAL:
        return chr(arg) not in _ALNUM
    if op is K.IN:
        return all(o is K.LITERAL and chr(a) not in _ALNUM for o, a in arg)
    return False


def literal_tokens(pattern: str) -> list[str]:
    """Tokens that stand whole in every text the pattern matches. Only top-level
    items count: what is optional or an alternative promises nothing."""
    items, out, i = list(_parser.parse(pattern, re.ASCII)), [], 0
    while i < len(items):
        j = i
        while j < len(items) and items[j][0] is K.LITERAL and chr(items[j][1]) in _ALNUM:
            j += 1
        if j > i and i and j < len(items) and _closed(items[i - 1]) and _closed(items[j]):
            out.append("".join(chr(x[1]) for x in items[i:j]))
        i = max(j, i + 1)
    return out


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.split(F.translate(url, UPPER, LOWER), "[^a-z0-9]+"))


def token_counts(urls: DataFrame, url: str, tokens: set[str]) -> dict[str, int]:
    """In how many URLs each of the rules' tokens stands, over all URLs. Comes to
    the driver with one row per token of the rules at most."""
    if not tokens:
        return {}
    wanted = urls.sparkSession.createDataFrame([(t,) for t in sorted(tokens)], "token string")
    rows = urls.select(F.explode(url_tokens(quoted(url))).alias("token"))
    return {t: n for t, n in rows.join(F.broadcast(wanted), "token").groupBy("token").count().collect()}


class Index:
    """token -> its rules, and the rules without a token."""

    def __init__(self, patterns, counts: dict[str, int]):
        self.by_token: dict[str, list[int]] = {}
        self.always: list[int] = []
        self.patterns = list(patterns)
        for i, p in enumerate(self.patterns):
            tokens = literal_tokens(p)
            if tokens:
                self.by_token.setdefault(min(tokens, key=lambda t: (counts.get(t, 0), -len(t), t)), []).append(i)
            else:
                self.always.append(i)

    def matcher(self, ran: list[int] | None = None):
        """Function of a URL to the first rule, in the order given, that matches.
        Patterns are compiled when first fetched. ran: takes the number of each that runs."""
        compiled: dict[int, re.Pattern] = {}

        def matches(i: int, low: str) -> bool:
            if i not in compiled:
                compiled[i] = re.compile(self.patterns[i], re.ASCII)
            if ran is not None:
                ran.append(i)
            return compiled[i].search(low) is not None

        def first(url: str) -> str | None:
            low = url.translate(_FOLD)
            found = {i for t in set(re.split("[^a-z0-9]+", low)) for i in self.by_token.get(t, ())}
            return next((self.patterns[i] for i in sorted(found.union(self.always)) if matches(i, low)), None)

        return first


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z in lower case) and path; both empty for null and without '://'."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(_FOLD), re.match(r"[^?#]*", rest[len(host) :])[0]


def host_matcher(rules: list[HostRule]):
    by_host: dict[str, list[HostRule]] = {}
    for r in rules:
        by_host.setdefault(r.host, []).append(r)

    def longest(host: str, path: str) -> HostRule | None:
        fits, at = [], host
        while at:
            fits += [r for r in by_host.get(at, ()) if path.startswith(r.path)]
            at = at.partition(".")[2]
        return max(fits, key=lambda r: (len(str(r)), str(r)), default=None)

    return longest


_made: dict[bytes, tuple] = {}


def _matchers(key: bytes, data: bytes) -> tuple:
    """What a worker needs to judge with one block of rules; made once."""
    if key not in _made:
        if len(_made) >= 8:
            _made.clear()
        hosts, index = pickle.loads(data)
        _made[key] = (host_matcher(hosts), index.matcher())
    return _made[key]


def filter_urls(urls: DataFrame, url: str = "url", rules: tuple[str, ...] = (), patterns: tuple[str, ...] = PATTERNS, into: str = "judged", block: int = BLOCK) -> DataFrame:
    """urls with the struct `into`: host, path, rule, pattern, verdict.

    The longest host rule that fits decides (`rule`; of equally long ones the last in
    code-point order); else the first pattern that matches blocks (`pattern`); else the
    verdict is allow. Null URLs and those without '://' have an empty host and path, fit
    no host rule, and null ones match no pattern; URLs are read whole. No shuffle of
    rows; a column named `into` is replaced, all others stay, whatever their names, and
    so do repeated rows. Empty table: no rows."""
    hosts = [parse_rule(r) for r in rules]
    counts = token_counts(urls, url, {t for p in patterns for t in literal_tokens(p)})
    blocks = [(hosts[i : i + block], Index(patterns[i : i + block], counts)) for i in range(0, max(len(hosts), len(patterns), 1), block)]

    def judged(part: tuple) -> Column:
        data = urls.sparkSession.sparkContext.broadcast(pickle.dumps(part))
        key = hashlib.sha256(data.value).digest()

        @F.arrow_udf("struct<host:string,path:string,rule:string,pattern:string,verdict:string>")
        def judge(column: pa.Array) -> pa.Array:
            longest, first = _matchers(key, data.value)
            out = []
            for u in column.to_pylist():
                host, path = split_url(u)
                r = longest(host, path)
                p = None if r or u is None else first(u)
                out.append((host, path, r and str(r), p, r.verdict if r else "block" if p else "allow"))
            names = ["host", "path", "rule", "pattern", "verdict"]
            return pa.StructArray.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in range(5)], names)

        return judge(quoted(url))

    if len(blocks) == 1:
        return urls.withColumn(into, judged(blocks[0]))
    found = [free_name(urls, f"judged{i}") for i in range(len(blocks))]
    x = urls.withColumns({n: judged(b) for n, b in zip(found, blocks, strict=True)})
    rule = F.greatest(*(F.when(F.col(f"{n}.rule").isNotNull(), F.struct(F.length(F.col(f"{n}.rule")).alias("n"), F.col(f"{n}.rule").alias("rule"), F.col(f"{n}.verdict").alias("verdict"))) for n in found))
    pattern = F.when(rule["rule"].isNull(), F.coalesce(*(F.col(f"{n}.pattern") for n in found)))
    verdict = F.coalesce(rule["verdict"], F.when(pattern.isNotNull(), "block").otherwise("allow"))
    first = F.col(found[0])
    return x.withColumn(into, F.struct(first["host"].alias("host"), first["path"].alias("path"), rule["rule"].alias("rule"), pattern.alias("pattern"), verdict.alias("verdict"))).drop(*found)
