"""URL filters: rules indexed by their rarest literal token.

A rule names a host and a path, or carries a regular expression over host and path; lists
in the published syntax of ad filters (`||host^`, `@@`, `*`, `^`, `|`, `/expression/`) can
be read.  Every rule is filed under one of its literal tokens, the one that the fewest rules
have: a run of ASCII letters and digits that stands whole in every URL that fits, or, where
a rule has none (as most expressions), a fragment of such a run, of FRAGMENTS letters.
A URL's own tokens and fragments fetch candidate rules from that index, and only the
candidates' expressions run.  Rules without either are candidates for every URL.

Read filters match whatever the case of A-Z, unless they say match-case.  Of options, those
are applied that speak of pages and of the filter itself (OWN_OPTIONS, important, badfilter);
filters with others, for page elements, or with an expression that is none, are no rules of
URLs; read_list counts them by reason.

Up to MAX_RULES rules the index travels with the tasks and no row moves.  Longer lists are
an index table: URL tokens are joined to it by a shuffle (those that many URLs have, where
they are), and rules without a token are tried in portions.  The results are the same.

Defined cases: a null URL or one without `://` has an empty host and path and no rule;
repeated URLs are judged each alone; of rules that fit, the longest host and path wins,
then for read filters important ones, then allow over block, then the first in the list; an
empty table gives an empty result.  Only A-Z are lower-cased.
"""

from __future__ import annotations

import re
import re._constants as ops
import re._parser as parser
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.shared import table, written
from glossa.llm.skew import join_skewed

#: Rules that travel with every task (about 1 kB each); longer lists are joined.
MAX_RULES = 200_000

LIST_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: What the method blocks where no listed rule fits: expressions over lower-case host and path.
PATTERNS = (
    r"(^|[./_-])(ads?|adserver|doubleclick|banners?)[./_-]",
    r"[./_-]tracking[./_-]",
    r"(^|[./_-])(casino|poker|viagra|porn|xxx)([./_-]|$)",
    r"/(login|signup|signin|cart|checkout)(/|$)",
    r"/wp-(admin|json)/",
)

OUT = "page_id long, host string, path string, rule string, verdict string"


#: Letters of the fragments under which rules without a whole token are filed: the longest that a rule's literals hold.
FRAGMENTS = (6, 4, 3)
#: Options of read filters that a page's own URL satisfies.
OWN_OPTIONS = {"document", "doc", "all", "popup", "~third-party", "1p", "first-party", "~3p"}


@dataclass(frozen=True)
class Rule:
    verdict: str
    pattern: str
    #: Each set of tokens and fragments: a URL that fits has one of every set.
    needs: tuple[tuple[str, ...], ...]
    length: int
    name: str | None
    #: Is it matched with the URL as it is (else lower-cased)?
    exact: bool = False


def words_of(x: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", x)


def fragments_of(run: str) -> list[str]:
    """What a rule with this literal can be filed under; a tilde tells fragments from tokens."""
    size = next((n for n in FRAGMENTS if n <= len(run)), 0)
    return ["~" + run[i : i + size] for i in range(len(run) - size + 1)] if size else []


def keys_of(lowered: str) -> set[str]:
    """All tokens and fragments of a URL."""
    words = set(words_of(lowered))
    return words | {"~" + w[i : i + n] for w in words for n in FRAGMENTS for i in range(len(w) - n + 1)}


def literals(pattern: str) -> list[tuple[str, ...]]:
    """Runs of letters and digits, lower-cased, that stand in whatever fits the expression: of each tuple one."""

    def walk(items) -> list[tuple[str, ...]]:
        out: list[tuple[str, ...]] = []
        run = ""
        for op, value in [*items, (None, None)]:
            if op is ops.LITERAL and chr(value).isascii() and chr(value).isalnum():
                run += chr(value).lower()
                continue
            if run:
                out.append((run,))
            run = ""
            if op is ops.SUBPATTERN:
                out += walk(value[3])
            elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT) and value[0] > 0:
                out += walk(value[2])
            elif op is ops.ATOMIC_GROUP:
                out += walk(value)
            elif op is ops.BRANCH:
                # of each alternative the set whose shortest run is longest
                best = [max(walk(x), key=lambda need: min(map(len, need)), default=None) for x in value[1]]
                if all(best):
                    out.append(tuple(dict.fromkeys(r for need in best for r in need)))
        return out

    return walk(parser.parse(pattern))


def filed(needs: list[tuple[str, ...]]) -> tuple[tuple[str, ...], ...]:
    """Literals that may stand amid longer words, as fragments."""
    out: list[tuple[str, ...]] = []
    for need in needs:
        found = [fragments_of(r) for r in need]
        if len(need) == 1:
            out += [(f,) for f in found[0]]
        elif all(found):
            out.append(tuple(dict.fromkeys(f[0] for f in found)))
    return tuple(out)


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits the host and its subdomains if the path begins with the rule's."""
    whole = words_of(host) + [w for w in re.findall(r"(?<=/)[a-z0-9]+(?=/)", path)]
    return Rule(verdict, rf"(?:[^/]*\.)?{re.escape(host)}(?={re.escape(path)})", tuple((w,) for w in whole), len(host + path), host + path, True)


def pattern_rule(verdict: str, pattern: str) -> Rule:
    """A search over lower-case host and path; its tokens are the alternatives of its first group of words."""
    group = next((g for g in re.findall(r"\(([^()]*)\)", pattern) if re.fullmatch(r"[a-z0-9?|]+", g)), None)
    plain = words_of(re.sub(r"\[[^\]]*\]|\([^()]*\)", " ", pattern))
    needs = [(w,) for w in plain] if plain else []
    if group:
        needs.append(tuple(dict.fromkeys(v for w in group.split("|") for v in ((w[:-2], w[:-2] + w[-2]) if w.endswith("?") else (w,)))))
    return Rule(verdict, f"(?s:.*?)(?:{pattern})", tuple(needs), 0, None)


class NoRule(ValueError):
    """Why a line is no rule of URLs."""


def _parted(body: str) -> tuple[str, list[str]]:
    """A filter's body and its options."""
    m = re.fullmatch(r"(/.+/)(?:\$(.+))?", body) or re.fullmatch(r"(.*?)(?:\$([^$/]*))?", body)
    return m[1], [x.strip().lower() for x in (m[2] or "").split(",") if x.strip()]


def _parsed(line: str) -> Rule:
    """A rule from a line in the syntax of ad filters, options but for badfilter applied."""
    line = line.strip()
    if not line or line.startswith(("!", "[")):
        raise NoRule("comment")
    if re.search(r"#[@?$]?#", line):
        raise NoRule("element")
    verdict, body = ("allow", line[2:]) if line.startswith("@@") else ("block", line)
    body, options = _parted(body)
    if set(options) - OWN_OPTIONS - {"match-case", "important"}:
        raise NoRule("options")
    first = 2 if "important" in options else 1 if verdict == "allow" else 0  # exceptions win
    exact = "match-case" in options
    if len(body) > 2 and body[0] == body[-1] == "/":
        try:
            needs = filed(literals(body[1:-1]))
            pattern = f"(?s:.*?)(?{'a' if exact else 'ai'}:{body[1:-1]})"
            re.compile(pattern)
        except (re.error, RecursionError, OverflowError) as e:
            raise NoRule("expression") from e
        return Rule(verdict, pattern, needs, first, None, exact)
    lowered = body.translate(_LOWER)
    body = body if exact else lowered
    start, body = ("||", body[2:]) if body.startswith("||") else ("|", body[1:]) if body.startswith("|") else ("", body)
    if start == "|":
        body = re.sub(r"^[a-zA-Z]*://", "", body)  # what is judged has no scheme
    body, end = (body[:-1], r"\Z") if body.endswith("|") else (body, "")
    expression = "".join({"*": "(?s:.*)", "^": r"(?:[^a-zA-Z0-9_.%-]|\Z)"}.get(c, re.escape(c)) for c in body)
    before = {"||": r"(?:[^/]*\.)?", "|": "", "": "(?s:.*?)"}[start]
    whole, amid = [], []
    for m in re.finditer(r"[a-zA-Z0-9]+", body):
        stands = (m.start() > 0 and body[m.start() - 1] != "*" or m.start() == 0 and start) and (m.end() < len(body) and body[m.end()] != "*" or m.end() == len(body) and end)
        (whole if stands else amid).append((m[0].translate(_LOWER),))
    return Rule(verdict, before + expression + end, tuple(whole) or filed(amid), first, None, exact)


def read_filter(line: str) -> Rule | None:
    """A rule from a line in the syntax of ad filters; None for what is no rule of URLs."""
    try:
        return _parsed(line)
    except NoRule:
        return None


def read_list(lines: list[str]) -> tuple[list[Rule], Counter]:
    """The rules of a list, and how many of its lines are none, by reason: comment, element, options, expression, badfilter (with what it takes back)."""
    key = lambda line: (_parted(line)[0], *sorted(set(_parted(line)[1]) - {"badfilter"}))
    bad = {key(line.strip()) for line in lines if "badfilter" in _parted(line.strip())[1]}
    rules, reasons = [], Counter()
    for line in lines:
        if bad and key(line.strip()) in bad:
            reasons["badfilter"] += 1
            continue
        try:
            rules.append(_parsed(line))
        except NoRule as why:
            reasons[str(why)] += 1
    return rules, reasons


def read_filters(lines: list[str]) -> list[Rule]:
    return read_list(lines)[0]


class RuleIndex:
    """Rules by their rarest tokens; an expression is compiled when it is first tried."""

    def __init__(self, rules: list[Rule]):
        self.rules, self.compiled = rules, {}
        counts = Counter(w for r in rules for need in r.needs for w in need)
        self.by_token, self.always = defaultdict(list), []
        for i, r in enumerate(rules):
            if r.needs:
                for w in min(r.needs, key=lambda need: sum(counts[w] for w in need)):
                    self.by_token[w].append(i)
            else:
                self.always.append(i)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"compiled": {}}

    def candidates(self, lowered: str) -> list[int]:
        found = set(self.always)
        for w in keys_of(lowered):
            found.update(self.by_token.get(w, ()))
        return sorted(found)

    def fits(self, i: int, whole: str, lowered: str) -> bool:
        if i not in self.compiled:
            self.compiled[i] = re.compile(self.rules[i].pattern)
        return self.compiled[i].match(whole if self.rules[i].exact else lowered) is not None

    def judge(self, host: str, path: str) -> Rule | None:
        whole = host + path
        lowered = whole.translate(_LOWER)
        fitting = [self.rules[i] for i in self.candidates(lowered) if self.fits(i, whole, lowered)]
        return max(fitting, key=lambda r: r.length, default=None)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path, both empty without a `://`."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    return host.translate(_LOWER), path


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def default_rules() -> list[Rule]:
    return [host_rule(*r) for r in LIST_RULES] + [pattern_rule("block", p) for p in PATTERNS]


def _joined(pages: DataFrame, index: RuleIndex, most: int) -> DataFrame:
    """filter_urls for a list of more than `most` rules: the index is a table."""
    spark, entries = pages.sparkSession, sorted({(w, i) for w, own in index.by_token.items() for i in own})
    sizes = {len(w) - 1 for w in index.by_token if w[0] == "~"}  # fragments of other sizes fetch nothing
    portions = [[(i, index.rules[i]) for i in index.always[at : at + most]] for at in range(0, len(index.always), most)]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [split_url(u) for u in batch.column("url").to_pylist()]
            words = [sorted(k for k in keys_of((h + p).translate(_LOWER)) if k[0] != "~" or len(k) - 1 in sizes) for h, p in rows]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array([h for h, _ in rows], pa.string()), pa.array([p for _, p in rows], pa.string()), pa.array(words, pa.list_(pa.string()))], ["page_id", "host", "path", "words"])

    def tried(rules_of):
        """no and best, the rule that fits best, of each row for which one fits."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    whole = row["host"] + row["path"]
                    fit = [(r["length"], -r["number"], r["verdict"], r["name"]) for r in rules_of(row) if re.match(r["pattern"], whole if r["exact"] else whole.translate(_LOWER))]
                    if fit:
                        length, number, verdict, name = max(fit, key=lambda f: f[:2])
                        out.append({"no": row["no"], "length": length, "number": number, "verdict": verdict, "name": name})
                yield pa.RecordBatch.from_pylist(out, pa.schema([("no", pa.int64()), ("length", pa.int64()), ("number", pa.int64()), ("verdict", pa.string()), ("name", pa.string())]))

        return run

    fields, found = "number long, verdict string, pattern string, length long, name string, exact boolean", "no long, length long, number long, verdict string, name string"
    fielded = lambda i, r: {"number": i, "verdict": r.verdict, "pattern": r.pattern, "length": r.length, "name": r.name, "exact": r.exact}
    rows = pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url").mapInArrow(split, "page_id long, host string, path string, words array<string>")
    rows = written(rows.withColumn("no", F.monotonically_increasing_id()), "urls")
    table_ = spark.createDataFrame([(w, *fielded(i, index.rules[i]).values()) for w, i in entries], f"word string, {fields}")
    table_ = written(table_.groupBy("word").agg(F.collect_list(F.struct("number", "verdict", "pattern", "length", "name", "exact")).alias("rules")), "rules")
    words = written(rows.select("no", F.explode("words").alias("word")), "words")
    met = join_skewed(words, table_, ["word"]).drop("word").join(rows.select("no", "host", "path"), "no")
    fits = met.mapInArrow(tried(lambda row: row["rules"]), found)
    for portion in portions:
        own = [fielded(i, r) for i, r in portion]
        fits = fits.unionByName(rows.select("no", "host", "path").mapInArrow(tried(lambda row, own=own: own), found))
    best = fits.groupBy("no").agg(F.max(F.struct("length", "number", "verdict", "name")).alias("b"))
    return rows.join(best, "no", "left").select("page_id", "host", "path", F.col("b.name").alias("rule"), F.coalesce("b.verdict", F.lit("allow")).alias("verdict"))


def filter_urls(pages: DataFrame, rules: list[Rule] | None = None, most: int = MAX_RULES) -> DataFrame:
    """page_id, host, path, the listed rule that fits (else null) and the verdict (allow where nothing fits)."""
    index = RuleIndex(default_rules() if rules is None else rules)
    if len(index.rules) > most:
        return _joined(pages, index, most)

    held = pages.sparkSession.sparkContext.broadcast(index)  # `most` rules

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in batches:
            split = [split_url(u) for u in batch.column("url").to_pylist()]
            judged = [index.judge(*s) for s in split]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), *(pa.array(x, pa.string()) for x in ([h for h, _ in split], [p for _, p in split], [r and r.name for r in judged], [r.verdict if r else "allow" for r in judged]))],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url").mapInArrow(run, OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


SQL = rf"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR suffix(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM s
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN {" OR ".join(f"regexp_matches(translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{p}')" for p in PATTERNS)} THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
