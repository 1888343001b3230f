"""Secret scan with a trigram inverted index, in DataFrame operations only.

From every rule's regex a Boolean trigram query is derived: the ways to spell the regex's mandatory literals, each a
conjunction of trigrams, united by OR. The inverted index holds (trigram, doc_id) postings for the trigrams that
some query asks for; a query is answered by intersecting postings, and only the documents that answer it are
verified with the regex. A rule without a mandatory trigram (a bare run of hex digits) scans every text.

Postings, intersection (a bit mask per document, rule and conjunction, partially aggregated) and verification are
built-in functions; match positions come from the lengths of the pieces between matches, in code points. The
candidates are a narrow written table, joined to the texts by doc_id: broadcast only if the planner finds the table
small enough, else both sides are shuffled by doc_id.

Null text: empty. Null doc_id: such rows share one entry of the index, which can only add candidates. Rows that
repeat a doc_id are verified each by themselves. Empty table: no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripstar.llm.base import written

_GAP = "\0"
#: Spellings of a regex beyond which an element counts as a gap; trigrams asked for by one conjunction (any part of
#: a conjunction is a sound query, and trigrams with marks in them are rarer than those of letters or blanks).
MAX_SPELLINGS, MAX_TRIGRAMS = 64, 6


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a regex (Java syntax), and the least length of one of its groups (0: the whole match)."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


# The base rules of the contract, then rules for token formats with published prefixes.
BASE = (
    Rule("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
MORE = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)


def spellings(regex: str) -> set[str]:
    """Lower-cased spellings of a regex's literals, with a gap where anything may stand."""
    from re import _constants as c
    from re import _parser as parser

    def one(op, arg) -> set[str]:
        if op is c.LITERAL:
            return {chr(arg).lower()}
        if op is c.IN:
            chars: set[str] = set()
            for kind, value in arg:
                if kind is c.LITERAL:
                    chars.add(chr(value).lower())
                elif kind is c.RANGE and value[1] - value[0] < 8:
                    chars |= {chr(x).lower() for x in range(value[0], value[1] + 1)}
                else:
                    return {_GAP}
            return chars if len(chars) <= 8 else {_GAP}
        if op is c.BRANCH:
            return set().union(*(whole(x) for x in arg[1]))
        if op is c.SUBPATTERN:
            return whole(arg[-1])
        if op in (c.MAX_REPEAT, c.MIN_REPEAT):
            least, most, sub = arg
            inner = whole(sub)
            if most == 1:
                return inner | ({""} if least == 0 else set())
            return {_GAP} if least == 0 else {x + _GAP for x in inner}
        return {""} if op in (c.AT, c.ASSERT, c.ASSERT_NOT) else {_GAP}

    def whole(sequence) -> set[str]:
        out = {""}
        for op, arg in sequence:
            more = one(op, arg)
            if len(out) * len(more) > MAX_SPELLINGS:
                more = {_GAP}
            out = {a + b for a, b in product(out, more)}
        return out

    return whole(parser.parse(regex))


def trigram_query(regex: str) -> list[frozenset[str]] | None:
    """The conjunctions of trigrams of which a match needs one, or None where there is no mandatory trigram."""
    clauses = {frozenset(p[i:i + 3] for p in s.split(_GAP) for i in range(len(p) - 2)) for s in spellings(regex)}
    if frozenset() in clauses:
        return None
    rare = lambda t: (" " in t, t.isalpha(), t)
    least = {frozenset(sorted(c, key=rare)[:MAX_TRIGRAMS]) for c in clauses if not any(d < c for d in clauses)}
    return sorted(least, key=sorted)


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index over these trigrams: trigram, doc_id (texts compared in lower case)."""
    low = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("_low"))
    found = F.array_compact(F.array(*[F.when(F.contains(F.col("_low"), F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select("doc_id", F.explode(found).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """doc_id, rules: the kinds whose trigram query the document answers."""
    spark = docs.sparkSession
    asked = [(r.kind, k, t, 1 << i, (1 << len(clause)) - 1)
             for r in rules for k, clause in enumerate(trigram_query(r.regex) or [])
             for i, t in enumerate(sorted(clause))]
    asked_table = spark.createDataFrame(asked, "kind string, clause int, trigram string, bit long, all long")
    index = postings(docs, sorted({a[2] for a in asked}))
    return (index.join(F.broadcast(asked_table), "trigram")      # a few rows a rule
            .groupBy("doc_id", "kind", "clause", "all").agg(F.bit_or("bit").alias("bits"))
            .filter("bits = all").groupBy("doc_id").agg(F.collect_set("kind").alias("kinds")))


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """Array of (start, number of the kind, end) of the matches that are long enough."""
    match = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    size = F.transform(match, F.length)
    good = (F.transform(F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)), F.length)
            if rule.group else size)
    gap = F.transform(F.split(text, rule.regex, -1), F.length)
    rows = F.arrays_zip(size.alias("size"), good.alias("good"), F.slice(gap, 1, F.greatest(F.size(match), F.lit(0))).alias("gap"))

    def width(x: Column) -> Column:
        return (x["gap"] + x["size"]).cast("long")

    def ends(items: Column, first: Column, width) -> Column:
        """Running sums of the items' widths, from ``first`` on."""
        begin = F.struct(first.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(items, begin, lambda acc, x: F.struct(
            (acc["at"] + width(x)).alias("at"),
            F.concat(acc["out"], F.array(acc["at"] + width(x))).alias("out")))["out"]

    def spans(rows: Column) -> Column:
        # Blocks of the square root of n matches: a running sum copies what it has gathered at every step, so sums
        # are gathered over a block and over the blocks' totals, never over all matches of a text.
        step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(rows)))).cast("int")
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(rows)), step)
        blocks = F.transform(starts, lambda i: F.slice(rows, i, step))
        sized = F.transform(blocks, lambda b: F.struct(
            b.alias("rows"), F.aggregate(b, F.lit(0).cast("long"), lambda n, x: n + width(x)).alias("width")))
        return bound(sized, lambda s: F.flatten(F.transform(
            F.arrays_zip(s["rows"].alias("rows"), s["width"].alias("width"),
                         ends(s, F.lit(0).cast("long"), lambda x: x["width"]).alias("end")),
            lambda b: F.filter(F.zip_with(b["rows"], ends(b["rows"], b["end"] - b["width"], width), lambda x, e: F.when(
                x["good"] >= rule.least, F.struct((e - x["size"]).alias("s"), F.lit(number).alias("k"), e.alias("e")))),
                lambda x: x.isNotNull()))))

    return bound(rows, spans)


def bound(value: Column, body) -> Column:
    """body(value), the value computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """docs(doc_id, text) → doc_id, found array<struct<s, k, e>> sorted by start and kind number (code points, end
    exclusive); k indexes ``rules``."""
    may = written(candidates(docs, rules), "secret-candidates")
    may = may.select(F.col("doc_id").alias("_id"), "kinds")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    rows = rows.join(may, rows["doc_id"].eqNullSafe(may["_id"]), "left")
    none = F.array().cast("array<struct<s:bigint,k:int,e:bigint>>")
    found = []
    for i, rule in enumerate(rules):
        indexed = trigram_query(rule.regex) is not None
        worth = F.array_contains("kinds", rule.kind) if indexed else F.rlike(F.col("_text"), F.lit(rule.regex))
        found.append(F.when(worth, _spans(F.col("_text"), rule, i)).otherwise(none))
    return rows.select("doc_id", F.array_sort(F.concat(*found)).alias("found"))


def joined(found: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end of the spans, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(
        ":", F.element_at(kinds, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def oracle_sql() -> str:
    """DuckDB SQL for the query (case variants spelt out, since its case folding is not ASCII's)."""
    def fold(word: str) -> str:
        return "".join(f"[{ch}{ch.upper()}]" if ch.isalpha() else ch for ch in word)

    words = "|".join(fold(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    patterns = [f"({words})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"]
    patterns += [r.regex for r in (*BASE[1:], *MORE)]
    rules = [*BASE, *MORE]
    values = ", ".join(f"({i}, '{r.kind}', '{p}', {r.least})" for i, (r, p) in enumerate(zip(rules, patterns)))
    union = " UNION ALL ".join(
        f"SELECT row, doc_id, {i} AS k, regexp_extract_all(text, '{p}', 0) AS m, "
        f"regexp_extract_all(text, '{p}', {r.group}) AS g, string_split_regex(text, '{p}') AS gaps FROM d"
        for i, (r, p) in enumerate(zip(rules, patterns)))
    return f"""
WITH rules(k, kind, regex, least) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
hits AS ({union}),
each AS (SELECT row, k, unnest(m) AS m, unnest(g) AS g, unnest(gaps[1:len(m)]) AS gap,
         unnest(range(1, len(m) + 1)) AS i FROM hits WHERE len(m) > 0),
placed AS (SELECT row, k, g, sum(length(gap) + length(m)) OVER (PARTITION BY row, k ORDER BY i) AS e, length(m) AS n
           FROM each),
spans AS (SELECT row, k, (e - n)::BIGINT AS s, e::BIGINT AS e FROM placed JOIN rules USING (k) WHERE length(g) >= least),
done AS (SELECT row, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access,
    count(*) FILTER (k = 2) AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM spans JOIN rules USING (k) GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
    coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN done USING (row)
"""
