"""Secret scans by a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived:
an OR of ANDs of trigrams that any match must contain, case folded.  The index
posts every document under each trigram that some rule asks for; the postings
of a clause are intersected, and only the documents left are verified with the
rule itself.  Rules without mandatory trigrams are run over all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoscan.llm.common import ascii_lower, stored, table


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``regex`` whose ``group`` has ``least`` code points or more."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1
    base: bool = False


KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
RULES = (
    Rule("assign", f"({'|'.join(map(_either_case, KEYWORDS))})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, True),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", "[0-9a-f]+", 0, 24, True),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("forge", "gh[opsu]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]+", 0, 20),
)
MAX_STRINGS = 64


class Unreadable(ValueError):
    """The expression uses syntax whose mandatory strings aren't worked out."""


def _bounded(strings: set[str] | None) -> set[str] | None:
    return strings if strings is not None and len(strings) <= MAX_STRINGS else None


def _joined(items: Iterable[set[str] | None]) -> set[str] | None:
    out = {""}
    for more in items:
        if more is None or len(out) * len(more) > MAX_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def _escaped(regex: str, at: int) -> tuple[set[str] | None, int]:
    """What the escape at ``at`` can match, and the place after it."""
    c = regex[at + 1]
    if c == "x":
        return {chr(int(regex[at + 2 : at + 4], 16)).lower()}, at + 4
    if c in "bBAzZ":
        return {""}, at + 2
    if c in "dDwWsS":
        return None, at + 2
    if c.isalnum():
        return ({{"n": "\n", "t": "\t", "r": "\r"}[c]}, at + 2) if c in "ntr" else _fail(regex)
    return {c}, at + 2


def _fail(regex: str):
    raise Unreadable(regex)


def _class(regex: str, at: int) -> tuple[set[str] | None, int]:
    """What the bracketed class at ``at`` can match, and the place after it."""
    out, i, known = set(), at + 1, regex[at + 1] != "^"
    while regex[i] != "]" or i == at + 1:
        own, i = _escaped(regex, i) if regex[i] == "\\" else ({regex[i].lower()}, i + 1)
        if regex[i] == "-" and regex[i + 1] != "]":
            known = known and own is not None and regex[i + 1] != "\\"
            own = {chr(x).lower() for x in range(ord(min(own)), ord(regex[i + 1].lower()) + 1)} if known else own
            i += 2
        known = known and own is not None
        out |= own or set()
    return (_bounded(out) if known else None), i + 1


def _items(regex: str, at: int = 0) -> tuple[list[list[set[str] | None]], int]:
    """The alternatives from ``at`` to the closing bracket or the end: for each item all strings, lower-cased, that it can match, or None if there are many."""
    branches: list[list[set[str] | None]] = [[]]
    while at < len(regex) and regex[at] != ")":
        c = regex[at]
        if c == "|":
            branches.append([])
            at += 1
            continue
        if c == "(":
            if regex[at + 1] == "?" and regex[at + 2] != ":":
                raise Unreadable(regex)
            inner, at = _items(regex, at + (3 if regex[at + 1] == "?" else 1))
            sets = [_joined(x) for x in inner]
            own, at = (None if None in sets else _bounded(set().union(*sets))), at + 1
        elif c == "[":
            own, at = _class(regex, at)
        elif c == "\\":
            own, at = _escaped(regex, at)
        else:
            own, at = None if c == "." else {""} if c in "^$" else {c.lower()}, at + 1
        if times := re.match(r"[?*+]|\{(\d+)(,?)(\d*)\}", regex[at:]):
            low, high = (int(times[1]), int(times[3] or times[1]) if times[3] or not times[2] else None) if times[1] else {"?": (0, 1), "*": (0, None), "+": (1, None)}[times[0]]
            few = own is not None and high is not None and high <= 8 and len(own) ** high <= MAX_STRINGS
            own = _bounded({"".join(x) for n in range(low, high + 1) for x in product(own, repeat=n)}) if few else None
            at += len(times[0])
            at += regex[at : at + 1] in ("?", "+") and bool(regex[at : at + 1])
        branches[-1].append(own)
    return branches, at


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def trigram_query(regex: str) -> list[frozenset[str]] | None:
    """Clauses of which any match satisfies one: all its trigrams occur in the lower-cased text.

    The expression's longest runs of items with few possible strings give the
    clauses; the run whose shortest string is longest is taken.  None if no run
    forces a trigram, or if the expression can't be read here.
    """
    try:
        branches, _ = _items(regex)
    except Unreadable:
        return None
    runs: list[set[str]] = [{""}]
    for own in branches[0] if len(branches) == 1 else [None if None in (sets := [_joined(b) for b in branches]) else _bounded(set().union(*sets))]:
        if own is not None and len(runs[-1]) * len(own) <= MAX_STRINGS:
            runs[-1] = {a + b for a in runs[-1] for b in own}
        else:
            runs.append(own or {""})
    best = max(runs, key=lambda r: min(map(len, r)))
    if min(map(len, best)) < 3:
        return None
    clauses = {trigrams(s) for s in best}
    return sorted((c for c in clauses if not any(d < c for d in clauses)), key=sorted)  # a clause that asks for more than another adds nothing


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key of the text, so that rows that share a doc_id are told apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_key"))


def trigram_index(keyed: DataFrame, wanted: list[str]) -> DataFrame:
    """trigram, doc_id, text_key: a posting per document and wanted trigram that its lower-cased text holds."""
    low = keyed.select("doc_id", "text_key", ascii_lower(F.col("text")).alias("low"))
    found = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in wanted]))
    return low.select(F.explode(found).alias("trigram"), "doc_id", "text_key")


def candidates(index: DataFrame, queries: dict[int, list[frozenset[str]]]) -> DataFrame:
    """doc_id, text_key, rules: the rules (by number) whose query the document satisfies."""
    spark = index.sparkSession
    terms = [(rule, n, t, len(clause)) for rule, clauses in queries.items() for n, clause in enumerate(clauses) for t in sorted(clause)]
    asked = spark.createDataFrame(terms, "rule int, clause int, trigram string, need int")  # as long as the rules
    met = index.join(F.broadcast(asked), "trigram").groupBy("doc_id", "text_key", "rule", "clause", "need").agg(F.collect_set("trigram").alias("held")).where(F.size("held") == F.col("need"))
    return met.groupBy("doc_id", "text_key").agg(F.collect_set("rule").alias("rules"))


def rule_spans(text: Column, rule: Rule, number: int) -> Column:
    """The matches of a rule as structs (start, kind, end), in code points, end exclusive.

    What lies between the matches gives their places.  Matches are numbered in
    blocks of about the root of their number, each from the sum of the lengths
    before it, so that a text of very many matches takes about linear time.
    """
    regex = F.lit(rule.regex)
    long = lambda c: F.coalesce(F.char_length(c), F.lit(0))
    zipped = F.arrays_zip(F.split(text, rule.regex).alias("gap"), F.regexp_extract_all(text, regex, F.lit(0)).alias("match"), F.regexp_extract_all(text, regex, F.lit(rule.group)).alias("part"))
    lengths = F.transform(zipped, lambda x: F.struct(long(x["gap"]).alias("gap"), long(x["match"]).alias("match"), (long(x["part"]) >= rule.least).alias("passes")))
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + x["match"]
        span = F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["passes"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    def numbered(all_lengths: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(all_lengths))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_lengths) - 1) / size).cast("int")), lambda i: F.slice(all_lengths, i * size + 1, size))
        summed = F.transform(blocks, lambda b: F.struct(b.alias("block"), F.aggregate(b, F.lit(0), lambda n, x: n + x["gap"] + x["match"]).alias("length")))
        return F.flatten(F.transform(F.array(summed), placed))

    def placed(blocks: Column) -> Column:
        before = lambda i: F.aggregate(F.slice(blocks, F.lit(1), i), F.lit(0), lambda n, b: n + b["length"])
        return F.flatten(F.transform(blocks, lambda b, i: F.aggregate(b["block"], F.struct(before(i).alias("at"), none.alias("spans")), step, lambda s: s["spans"])))

    # each array is bound to a name once, in a list of one
    return F.flatten(F.transform(F.array(lengths), numbered))


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, spans array<struct<start, kind, end>> for every row; kind is the rule's number.

    Spans are leftmost and non-overlapping per rule, in code points of the
    whole text, sorted by start and then by rule.  Null and empty texts have
    none.  Rows that repeat a doc_id are scanned each for itself; extra columns
    are ignored.
    """
    queries = {n: q for n, r in enumerate(rules) if (q := trigram_query(r.regex)) is not None}
    keyed = _keyed(docs)
    wanted = sorted({t for clauses in queries.values() for c in clauses for t in c})
    texts = keyed.withColumn("rules", F.array().cast("array<int>"))
    if queries:
        index = stored(trigram_index(keyed, wanted), "secret-index")
        held = stored(candidates(index, queries), "secret-candidates").withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
        texts = keyed.join(held, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    text = F.col("text")
    found = []
    for n, r in enumerate(rules):
        # in a rule without trigrams a run of the least length is looked for first
        passes = F.array_contains("rules", n) if n in queries else text.rlike(r.regex.removesuffix("+") + f"{{{r.least}}}" if r.regex.endswith("]+") and not r.group else r.regex)
        found.append(F.when(passes, rule_spans(text, r, n)).otherwise(none))
    return texts.select("doc_id", F.sort_array(F.concat(*found)).alias("spans"))


def _listed(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    count = lambda n: F.size(F.filter("spans", lambda s: s["kind"] == n)).cast("long")
    bases = [n for n, r in enumerate(RULES) if r.base]
    return found.select(
        "doc_id", *[count(n).alias(f"n_{RULES[n].kind}") for n in bases],
        F.sha2(_listed(F.filter("spans", lambda s: s["kind"].isin(bases)), RULES), 256).alias("base_sha256"), _listed(F.col("spans"), RULES).alias("spans"),
    )


def _rule_sql(n: int, r: Rule) -> str:
    regex = r.regex.replace("'", "''")
    return f"""SELECT doc_id, {n} AS kind, '{r.kind}' AS name,
    list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hit[1:i-1], lambda x: length(x))), 0) AS start, length(hit[i]) AS len
  FROM (SELECT doc_id, hit, part, regexp_split_to_array(text, '{regex}') AS gap, unnest(range(1, len(hit) + 1)) AS i
        FROM (SELECT doc_id, text, regexp_extract_all(text, '{regex}', 0) AS hit, regexp_extract_all(text, '{regex}', {r.group}) AS part FROM d))
  WHERE length(part[i]) >= {r.least}"""


OP8_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL ".join(_rule_sql(n, r) for n, r in enumerate(RULES))}),
t AS (SELECT *, name || ':' || start::BIGINT || ':' || (start + len)::BIGINT AS span FROM s)
SELECT d.doc_id, {", ".join(f"count(*) FILTER (WHERE kind = {n}) AS n_{r.kind}" for n, r in enumerate(RULES) if r.base)},
       sha256(coalesce(string_agg(span, ',' ORDER BY start, kind) FILTER (WHERE kind < 3), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY start, kind), '') AS spans
FROM d LEFT JOIN t ON d.doc_id = t.doc_id GROUP BY d.doc_id
"""
