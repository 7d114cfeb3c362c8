"""Operator 11 [native]: secrets in texts, found through a trigram inverted index.

Every rule is a regular expression. From its syntax tree a Boolean query of trigrams is derived
(``trigram_query``): an OR of alternatives, each an AND of trigrams without which the expression
cannot match. Texts are indexed by the trigrams that the rules' queries name: a posting list for
each trigram and shard of texts. The lists of an alternative are intersected shard by shard, and
only the texts that remain are matched against the rule. A rule whose query demands nothing, such
as a run of hex digits, is matched against every text.

The index is made of lower-case texts, so a query can only let too many texts through, never too
few; what is reported always comes from the expression itself. Texts are indexed by a hash of
their whole content: copies have one entry, and two texts that share a hash are both looked at.

All of it is DataFrame functions. Posting lists are split into shards of ``SHARD_TEXTS`` texts, so
a trigram that stands in every text is no long list. Candidates go back to the texts as a
broadcast up to a counted bound and by a shuffle join beyond it.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import few, materialize

#: A disjunction of sets of trigrams; the empty set demands nothing.
Query = list[frozenset[str]]
EVERYTHING: Query = [frozenset()]
#: Strings followed through an expression, members of a character class that are spelled out, and
#: alternatives of a query. Beyond them a query demands less, so more texts are verified.
MOST_STRINGS, MOST_MEMBERS, MOST_ALTERNATIVES = 64, 8, 64
SHARD_TEXTS = 2048
#: Matches whose offsets are summed at a time.
FOLD = 128


@dataclass(frozen=True)
class Rule:
    """``group`` of a match has ``least`` characters or more, else the match is dropped. Java's syntax, which is also Python's here."""

    kind: str
    pattern: str
    either_case: bool = False
    group: int = 0
    least: int = 1

    @property
    def java(self) -> str:
        return ("(?i)" if self.either_case else "") + self.pattern


#: The rules that every scan has, then further well-known token formats. Fixed values.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]+", least=24),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment_key", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("url_login", r"[a-z]{3,10}://[A-Za-z0-9._-]+:[A-Za-z0-9._-]{3,}@"),
)
RULES = BASE_RULES + MORE_RULES


# --- queries from expressions ------------------------------------------------------------------


def _absorbed(query: Iterable[frozenset[str]]) -> Query:
    """Without the alternatives that a weaker one covers."""
    out: Query = []
    for x in sorted(set(query), key=lambda x: (len(x), sorted(x))):
        if not any(y <= x for y in out):
            out.append(x)
    return out


def _both(a: Query, b: Query) -> Query:
    out = _absorbed(x | y for x in a for y in b)
    return out if len(out) <= MOST_ALTERNATIVES else a


def _of_strings(strings: set[str]) -> Query:
    return _absorbed(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _members(items) -> set[str] | None:
    """The lower-case members of a character class, if they are few."""
    out: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            out.add(chr(arg).lower())
        elif op is sre.RANGE and arg[1] - arg[0] < MOST_MEMBERS:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= MOST_MEMBERS else None


def _node(op, arg) -> tuple[set[str] | None, Query]:
    """All lower-case strings that a part matches (None: too many), and what it demands besides."""
    if op is sre.LITERAL:
        return {chr(arg).lower()}, EVERYTHING
    if op is sre.IN:
        return _members(arg), EVERYTHING
    if op is sre.SUBPATTERN:
        return _sequence(arg[-1])
    if op is sre.AT:
        return {""}, EVERYTHING
    if op is sre.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        if all(strings is not None for strings, _ in parts) and len(union := set().union(*(s for s, _ in parts))) <= MOST_STRINGS:
            return union, EVERYTHING
        return None, _absorbed(y for strings, query in parts for y in (query if strings is None else _of_strings(strings)))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, body = arg
        strings, query = _sequence(body)
        if strings is not None and (low, high) == (0, 1):
            return strings | {""}, EVERYTHING
        if strings is not None and low == high and len(strings) ** low <= MOST_STRINGS:
            out = {""}
            for _ in range(low):
                out = {a + b for a in out for b in strings}
            return out, EVERYTHING
        return None, EVERYTHING if not low else query if strings is None else _of_strings(strings)
    return None, EVERYTHING  # any character, look-arounds, back references


def _sequence(parts) -> tuple[set[str] | None, Query]:
    run, query, whole = {""}, EVERYTHING, True
    for op, arg in parts:
        strings, demanded = _node(op, arg)
        query = _both(query, demanded)
        if strings is not None and len(strings) * len(run) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
        else:
            query, run, whole = _both(query, _of_strings(run)), strings or {""}, False
    return (run, query) if whole else (None, _both(query, _of_strings(run)))


def trigram_query(pattern: str) -> Query:
    """Trigrams, in lower case, that every text with a match of ``pattern`` holds: all those of one of the sets."""
    strings, query = _sequence(sre_parser.parse(pattern))
    return query if strings is None else _both(query, _of_strings(strings))


# --- index -------------------------------------------------------------------------------------


def _key(text: Column) -> Column:
    return F.xxhash64(text)


def build_index(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """``texts(text)`` -> stored postings ``(trigram, shard, keys)`` of the given trigrams; ``keys`` are sorted hashes of texts."""
    shards = max(1, -(-texts.count() // SHARD_TEXTS))
    lowered = texts.select(_key(F.col("text")).alias("key"), F.lower("text").alias("t"))
    held = F.filter(F.array(*map(F.lit, trigrams)), lambda g: F.contains(F.col("t"), g))
    rows = lowered.select("key", F.explode(held).alias("trigram")).withColumn("shard", F.pmod("key", F.lit(shards)))
    return materialize(rows.groupBy("trigram", "shard").agg(F.sort_array(F.collect_set("key")).alias("keys")))


def candidates(postings: DataFrame, queries: dict[int, Query]) -> DataFrame:
    """``(key, rules)`` of the texts whose trigrams satisfy a query; ``rules`` has bit i for query i."""
    lists = postings.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("lists"))
    none = F.array().cast("array<bigint>")

    def meet(trigrams: Column) -> Column:
        keys = lambda g: F.coalesce(F.try_element_at("lists", g), none)
        return F.aggregate(trigrams, keys(F.element_at(trigrams, 1)), lambda met, g: F.array_intersect(met, keys(g)))

    spelled = lambda query: F.array(*(F.array(*map(F.lit, sorted(x))) for x in query))
    hits = [F.struct(F.lit(1 << i).cast("long").alias("rule"), F.array_distinct(F.flatten(F.transform(spelled(query), meet))).alias("keys")) for i, query in queries.items()]
    rows = lists.select(F.explode(F.array(*hits)).alias("hit")).select("hit.rule", F.explode("hit.keys").alias("key"))
    return rows.groupBy("key").agg(F.bit_or("rule").alias("rules"))


# --- matches -----------------------------------------------------------------------------------


def _matches(text: Column, rule: Rule, kind: int) -> Column:
    """``array<struct<start, kind, end>>``: leftmost matches that do not overlap, in code points.

    The pieces between matches and the matches themselves follow one another, so their lengths
    add up to offsets. The sums are carried on over groups of ``FOLD`` matches, which keeps a
    text with very many matches from copying a growing array for each of them.
    """
    pattern = F.lit(rule.java)
    parts = F.arrays_zip(F.split(text, rule.java, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"), F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("held"))
    sized = F.transform(parts, lambda x: F.struct(F.char_length(x["gap"]).cast("long").alias("gap"), F.coalesce(F.char_length(x["match"]), F.lit(0)).cast("long").alias("size"), (F.char_length(x["held"]) >= rule.least).alias("good")))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x["size"]).alias("end")))
        return F.struct((start + x["size"]).alias("at"), F.when(x["good"], F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def group(acc: Column, some: Column) -> Column:
        return F.aggregate(some, F.struct(acc["at"].alias("at"), none.alias("out")), step, lambda end: F.struct(end["at"].alias("at"), F.concat(acc["out"], end["out"]).alias("out")))

    def fold(all_: Column) -> Column:
        groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / FOLD).cast("int")), lambda i: F.slice(all_, i * FOLD + 1, F.lit(FOLD)))
        return F.aggregate(groups, F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), group, lambda end: end["out"])

    return F.transform(F.array(sized), fold)[0]


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs(doc_id, text)`` -> a row per input row: ``doc_id`` and ``found``, an array of ``(start, kind, end)``.

    ``kind`` is the rule's place in ``rules``; offsets are code points, the end exclusive; the
    array is ordered by start, then kind. Matches of one rule do not overlap, those of different
    rules may. Further columns are ignored. A null or empty text has no match; rows with a null
    or repeated ``doc_id`` are rows like others. At most 63 rules.
    """
    texts = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    queries = {i: trigram_query(rule.pattern) for i, rule in enumerate(rules)}
    indexed = {i: q for i, q in queries.items() if q != EVERYTHING}
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    if indexed:
        trigrams = sorted(set().union(*(x for q in indexed.values() for x in q)))
        found = few(candidates(build_index(texts, trigrams), indexed))
        texts = texts.withColumn("key", _key(F.col("text"))).join(found, "key", "left")
    spans = [
        F.when(F.coalesce(F.col("rules"), F.lit(0)).bitwiseAND(F.lit(1 << i)) != 0, _matches(F.col("text"), rule, i)).otherwise(none) if i in indexed else _matches(F.col("text"), rule, i)
        for i, rule in enumerate(rules)
    ]
    return texts.select("doc_id", F.array_sort(F.concat(*spans)).alias("found"))


def written(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    kinds = F.array(*(F.lit(rule.kind) for rule in rules))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
