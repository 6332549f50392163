"""URL filtering by pattern rules that are found through their rarest token.

A rule is a pattern in which ``*`` stands for any characters, ``^`` for one
character other than a letter or digit (or the end), ``||`` at the front for
the start of a host label, ``|`` for the start of the URL; ``@@`` in front makes it
an exception.  A rule's literal tokens are its runs of letters and digits with
a boundary on both sides, so they are whole tokens of every URL it fits.  Each
rule is indexed by the one of them that is rarest among the URLs.  A URL's
tokens fetch the rules indexed by them, and only those run as regular
expressions.  Host rules (host suffix and path prefix) go the same way.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import salted_join, stage

#: Topics that blocked hosts and paths name.
BLOCK_PATTERNS = [
    "^adult^", "^porn^", "^xxx^", "^sex^", "^escort^", "^casino^", "^poker^", "^bets^", "^betting^",
    "^pills^", "^viagra^", "^pharma^cheap^", "^spam^", "^phishing^", "^malware^", "^warez^", "^torrent^",
    "^ads^", "^adserver^", "^doubleclick^", "^popunder^", "^click^farm^", "^free^money^", "^payday^loan^",
]
#: Places that name such topics for a good reason.
EXCEPT_PATTERNS = ["@@||edu^", "@@||gov^", "@@^sex^education^", "@@^health^"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: An index of at most this many rules is a literal of the plan; a larger one is joined by token.
LITERAL_RULES = 500


@dataclass(frozen=True)
class Rule:
    """One rule: what it says, the regular expression that decides, and its literal tokens."""

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    host_rule: bool = False


def pattern_rule(pattern: str) -> Rule:
    """A rule over lower-cased URLs."""
    body, verdict = (pattern[2:], "allow") if pattern.startswith("@@") else (pattern, "block")
    literal = body.lower()
    regex, rest = "", literal
    if literal.startswith("||"):
        regex, rest = r"^[^:/?#]*://(?:[^/?#]*\.)?", literal[2:]
    elif literal.startswith("|"):
        regex, rest = "^", literal[1:]
    for c in rest:
        regex += ".*" if c == "*" else r"(?:[^a-z0-9]|^|$)" if c == "^" else re.escape(c)
    anchored = literal.replace("||", "^").replace("|", "^")
    tokens = tuple(re.findall(r"(?<=[^a-z0-9*])([a-z0-9]+)(?=[^a-z0-9*])", anchored))
    return Rule(pattern, verdict, regex, tokens)


def patterns_of(lines: list[str]) -> tuple[list[str], list[str]]:
    """The patterns of a rule list in the common text form, and the lines that none of ours can stand for.

    Comments (``!``, ``#``, ``[...]``) and empty lines are passed over.  A line of a hosts
    file (an address and a name) becomes a pattern of the name.  Rules that
    hide elements, regular expressions, and rules with options (after ``$``) other than
    ``important`` and ``all`` are given back, as they ask for more than the URL.
    """
    patterns, others = [], []
    for line in (x.strip() for x in lines):
        if not line or line[0] in "![" or re.match(r"#(\s|$)", line):
            continue
        hosts = re.fullmatch(r"(?:\d+\.\d+\.\d+\.\d+|::1?)\s+([^\s#]+)\s*(?:#.*)?", line)
        body, _, options = line.partition("$")
        if hosts:
            patterns.append(f"||{hosts[1].lower()}^")
        elif re.search(r"#[@?$%]*#", line) or re.fullmatch(r"(@@)?/.*/", body) or set(filter(None, options.split(","))) - {"important", "all"} or not body.removeprefix("@@").strip("*|"):
            others.append(line)
        else:
            patterns.append(body)
    return patterns, others


def host_rule(name: str, verdict: str) -> Rule:
    """``host/path``: the host and its subdomains, if the path starts with the rule's.

    The regular expression runs over host and path, parted by a line feed.
    Only tokens that the rule delimits on both sides are literal: those of
    the host, and those of the path before its last separator.
    """
    host, slash, path = name.partition("/")
    path = slash + path
    tokens = [t for t in re.split(r"[^a-z0-9]+", host.lower()) if t]
    tokens += [m[1] for m in re.finditer(r"(?<=[^a-z0-9])([a-z0-9]+)(?=[^a-z0-9])", path.lower())]
    regex = r"^(?:[^\n]*\.)?" + re.escape(host.lower()) + r"\n" + re.escape(path)
    return Rule(name, verdict, regex, tuple(tokens), True)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without one."""
    at = F.instr(url, "://")
    rest = F.expr("substring(url, instr(url, '://') + 3)")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(F.when(at > 0, host), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end; empty without ``://``."""
    rest = F.expr("substring(url, instr(url, '://') + 3)")
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def url_tokens() -> Column:
    """Distinct runs of a-z and 0-9 in the lower-cased ``url`` column."""
    lowered = F.translate(F.coalesce("url", F.lit("")), UPPER, LOWER)
    return F.array_distinct(F.regexp_extract_all(lowered, F.lit("([a-z0-9]+)"), F.lit(1)))


def filter_urls(
    pages: DataFrame,
    host_rules: list[tuple[str, str]],
    *,
    patterns: list[str] | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """Judge every URL: ``id, url, host, path, rule, verdict, pattern``.

    ``rule`` is the longest host rule that fits (of equally long ones the
    last by name) and decides; without one, a URL is blocked if a blocking
    pattern and no exception fits, and ``pattern`` tells the first by name.

    Defined cases: a null URL, or one without ``://``, has empty host and path
    and fits no host rule; a null one also fits no pattern.  Repeated rows are
    judged alike, each once.  An empty table gives no rows; other columns are
    not read.

    Scale: one pass counts the rules' own tokens among the URLs (a table no
    larger than the rules), one pass judges each URL where it is read, without
    a shuffle.  An index of over ``LITERAL_RULES`` rules is joined by token.
    """
    rules = [host_rule(*r) for r in host_rules] + [pattern_rule(p) for p in (BLOCK_PATTERNS + EXCEPT_PATTERNS if patterns is None else patterns)]
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    index = rule_index(rules, token_counts(urls, {t for r in rules for t in r.tokens}))
    known = urls.withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url")))
    found = candidates_by_literal(known, index) if len(rules) <= LITERAL_RULES else candidates_by_join(known, index)

    lowered = F.translate(F.col("url"), UPPER, LOWER)
    both = F.concat("host", F.lit("\n"), "path")
    placed = F.instr(F.col("url"), "://") > 0
    fits = F.filter("candidates", lambda r: F.when(r["host_rule"], placed & F.regexp_like(both, r["regex"])).otherwise(F.regexp_like(lowered, r["regex"])))
    hits = found.withColumn("hits", fits)
    best = F.array_max(F.transform(F.filter("hits", lambda r: r["host_rule"]), lambda r: F.struct(
        F.length(r["name"]).alias("n"), r["name"].alias("name"), r["verdict"].alias("verdict"))))
    excepted = F.exists("hits", lambda r: ~r["host_rule"] & (r["verdict"] == "allow"))
    pattern = F.array_min(F.transform(F.filter("hits", lambda r: ~r["host_rule"] & (r["verdict"] == "block")), lambda r: r["name"]))
    judged = hits.withColumn("best", best).withColumn("pattern", pattern).withColumn("excepted", excepted)
    own = F.when(F.col("pattern").isNotNull() & ~F.coalesce("excepted", F.lit(False)), "block").otherwise("allow")
    return judged.select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), "host", "path",
        F.col("best.name").alias("rule"), F.coalesce("best.verdict", own).alias("verdict"), "pattern")


RULE = "struct<name:string,verdict:string,regex:string,host_rule:boolean>"


def candidates_by_literal(known: DataFrame, index: dict[str, list[Rule]]) -> DataFrame:
    """``known`` with the rules that its tokens fetch, looked up in a map of the plan."""
    def rules(held: list[Rule]) -> Column:
        return F.array(*[F.struct(
            F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.regex).alias("regex"), F.lit(r.host_rule).alias("host_rule"),
        ) for r in held])

    none = F.array().cast(f"array<{RULE}>")
    by_token = [c for token, held in index.items() if token for c in (F.lit(token), rules(held))]
    table = F.create_map(*by_token) if by_token else F.create_map().cast(f"map<string,array<{RULE}>>")
    # only tokens that fetch something are looked up
    keys = F.array(*[F.lit(t) for t in index if t]) if by_token else F.array().cast("array<string>")
    fetched = F.flatten(F.transform(F.array_intersect(url_tokens(), keys), lambda t: F.coalesce(F.try_element_at(table, t), none)))
    # rules without a literal token are candidates everywhere
    return known.withColumn("candidates", F.concat(fetched, rules(index[""]) if "" in index else none))


def candidates_by_join(known: DataFrame, index: dict[str, list[Rule]]) -> DataFrame:
    """The same for an index too large for a plan: URLs' tokens meet it by shuffle."""
    spark = known.sparkSession
    table = spark.createDataFrame(
        [(token, r.name, r.verdict, r.regex, r.host_rule) for token, held in index.items() for r in held],
        "token string, name string, verdict string, regex string, host_rule boolean")
    known = stage(known.withColumn("row", F.monotonically_increasing_id()), name="urls")
    rows = known.select("row", F.explode(F.array_append(url_tokens(), F.lit(""))).alias("token"))
    fetched = salted_join(rows, table.groupBy("token").agg(F.collect_list(F.struct("name", "verdict", "regex", "host_rule")).alias("held")), "token", ["row"], how="inner")
    per = fetched.groupBy("row").agg(F.flatten(F.collect_list("held")).alias("candidates"))
    return known.join(per, "row", "left").withColumn("candidates", F.coalesce("candidates", F.array().cast(f"array<{RULE}>"))).drop("row")


def token_counts(urls: DataFrame, wanted: set[str]) -> dict[str, int]:
    """How many URLs hold each of the rules' own tokens."""
    if len(wanted) > LITERAL_RULES:
        # a table no larger than the rules
        told = urls.sparkSession.createDataFrame([(t,) for t in sorted(wanted)], "token string")
        counted = urls.select(F.explode(url_tokens()).alias("token")).join(told, "token", "left_semi").groupBy("token").count()
        return {r["token"]: r["count"] for r in counted.collect()}
    only = F.array(*[F.lit(t) for t in sorted(wanted)]) if wanted else F.array().cast("array<string>")
    rows = urls.select(F.explode(F.array_intersect(url_tokens(), only)).alias("token")).groupBy("token").count().collect()
    return {r["token"]: r["count"] for r in rows}


def rule_index(rules: list[Rule], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """Rules by their rarest literal token; those without one under the empty token."""
    index: dict[str, list[Rule]] = {}
    for r in rules:
        index.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=""), []).append(r)
    return index
