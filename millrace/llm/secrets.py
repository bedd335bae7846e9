"""Secret scans through a trigram index, with DataFrame functions only.

Every rule's regular expression yields a Boolean query over trigrams that each
match must contain. The index has the postings of every trigram that some rule
asks for: the distinct texts that hold it. It is built and stored first; then
each query's posting lists are intersected and united, and only texts that
satisfy a rule's query are verified with its expression. A rule without
mandatory trigrams is run over every text. Entries are distinct texts, so a text
of which there are very many copies is indexed once.

Offsets are code points of the text, the end exclusive. Matches are leftmost
and do not overlap within a kind; a match that fails the rule's length test is
used up and dropped.

Defined results: a null or empty text has no spans; repeated rows are scanned
each; a null ``doc_id`` is carried; an empty table gives no rows; further
columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut


@dataclass(frozen=True)
class Rule:
    """``group`` is the part of a match whose code points must number ``least`` or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The patterns and length tests of the base kinds, in the order that breaks ties.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
# Published prefixes of tokens and keys.
EXTRA_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    # the body may hold hyphens, as the headers of encrypted keys do, but not five of them
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*+(?:-{1,4}[^-]++)*+-----END [A-Z ]*PRIVATE KEY-----)?"),
)
RULES = BASE_RULES + EXTRA_RULES


# --- Boolean trigram queries -------------------------------------------------
#
# A query is True (any text), a trigram, ("and", {queries}) or ("or", {queries}).


def both(a: object, b: object) -> object:
    if a is True or b is True:
        return b if a is True else a
    parts = frozenset().union(*(q[1] if isinstance(q, tuple) and q[0] == "and" else {q} for q in (a, b)))
    return next(iter(parts)) if len(parts) == 1 else ("and", parts)


def either(queries: list[object]) -> object:
    if not queries or any(q is True for q in queries):
        return True
    parts = frozenset(queries)
    return next(iter(parts)) if len(parts) == 1 else ("or", parts)


def of_string(text: str) -> object:
    """All trigrams of a string that the match must contain; cases are folded, as in the index."""
    out: object = True
    for i in range(len(text) - 2):
        out = both(out, text[i : i + 3].lower())
    return out


# A pattern is read into ("chars", set or None: any), ("repeat", low, high, part), ("all", parts) and ("one", parts).

#: What stands behind a backslash for a whole class of characters, or for none.
CLASSES = "dDwWsSbBAZzhHvVRpP"
CONTROLS = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v", "0": "\0"}


class Reader:
    """The part of regular expressions that rules are written in; what it does not know may be any text."""

    def __init__(self, pattern: str) -> None:
        self.pattern, self.at = pattern, 0

    def here(self, size: int = 1) -> str:
        return self.pattern[self.at : self.at + size]

    def one_of(self) -> tuple:
        parts = [self.sequence()]
        while self.here() == "|":
            self.at += 1
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("one", parts)

    def sequence(self) -> tuple:
        parts = []
        while self.here() and self.here() not in "|)":
            parts.append(self.repeated(self.single()))
        return ("all", parts)

    def repeated(self, part: tuple) -> tuple:
        while found := re.compile(r"([*+?]|\{(\d+)(?:(,)(\d*))?\})[?+]?").match(self.pattern, self.at):
            self.at = found.end()
            low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}.get(found[1], (0, 0))
            if found[2]:
                low = int(found[2])
                high = low if not found[3] else int(found[4]) if found[4] else None
            part = ("repeat", low, high, part)
        return part

    def single(self) -> tuple:
        c = self.here()
        self.at += 1
        if c == "(":
            return self.group()
        if c == "[":
            return ("chars", self.bracket())
        if c == "\\":
            return self.escaped()
        return ("all", []) if c in "^$" else ("chars", None) if c == "." else ("chars", {c})

    def group(self) -> tuple:
        look = re.compile(r"\?(?:[a-z]*:|<[A-Za-z]\w*>|P<\w+>|>|(<?[=!])|([a-z]+)\))").match(self.pattern, self.at)
        if look:
            self.at = look.end()
        if look and "x" in look[0].split("<")[0]:
            raise ValueError(f"no comments in patterns: {self.pattern}")
        if look and look[2]:  # flags alone
            return ("all", [])
        inside = self.one_of()
        if self.here() != ")":
            raise ValueError(f"unbalanced: {self.pattern}")
        self.at += 1
        return ("all", []) if look and look[1] else inside

    def escaped(self) -> tuple:
        c = self.here()
        self.at += 1
        if c == "x":
            self.at += 2
            return ("chars", {chr(int(self.pattern[self.at - 2 : self.at], 16))})
        if c in "bBAZz":
            return ("all", [])
        if c.isdigit() and c != "0":
            return ("repeat", 0, None, ("chars", None))  # what a group has held
        if c in CLASSES:
            return ("chars", None)
        if c.isalpha() and c not in CONTROLS:
            raise ValueError(f"unknown \\{c}: {self.pattern}")
        return ("chars", {CONTROLS.get(c, c)})

    def bracket(self) -> set[str] | None:
        """The characters of a class, None if they are many."""
        found: set[str] | None = set()
        if self.here() == "^":
            found = None
            self.at += 1
        begin = self.at
        while self.here() != "]" or self.at == begin:
            if not self.here():
                raise ValueError(f"unbalanced: {self.pattern}")
            if self.here() == "[" or self.here(2) == "&&":
                raise ValueError(f"no classes inside classes: {self.pattern}")
            first = self.single_of_class()
            if self.here() == "-" and self.here(2) != "-]":  # a range is large
                self.at += 1
                self.single_of_class()
                first = None
            found = None if found is None or first is None else found | first
        self.at += 1
        return found


    def single_of_class(self) -> set[str] | None:
        c = self.here()
        self.at += 1
        if c != "\\":
            return {c}
        node = self.escaped()
        return node[1] if node[0] == "chars" else None


#: More alternatives than this of exact strings are cut into queries.
MOST_STRINGS = 16


def analyse(tree: tuple) -> tuple[object, list[str] | None]:
    """A query that each match satisfies, and the exact strings that a match may be (None: others too)."""
    kind = tree[0]
    if kind == "chars":
        return True, sorted(tree[1]) if tree[1] and len(tree[1]) <= 8 else None
    if kind == "repeat":
        low, high, (query, exact) = tree[1], tree[2], analyse(tree[3])
        if exact is not None and (low, high) == (0, 1):
            return True, ["", *exact]
        if exact is not None and low == high and len(exact) == 1:
            return query, [exact[0] * low]
        return query if low else True, None
    if kind == "one":
        found = [analyse(t) for t in tree[1]]
        if all(e is not None for _, e in found):
            strings = [s for _, e in found for s in e]
            return either([of_string(s) for s in strings]), strings
        return either([both(q, either([of_string(s) for s in e]) if e is not None else True) for q, e in found]), None
    query: object = True
    run, whole = [""], True  # the strings that the parts since the last gap may be; is there no gap yet?
    for part in tree[1]:
        inner, exact = analyse(part)
        grown = [a + b for a in run for b in exact] if exact is not None else None
        if grown is None or len(grown) > MOST_STRINGS:
            query, whole = both(both(query, inner), either([of_string(s) for s in run])), False
            run = exact if exact is not None and len(exact) <= MOST_STRINGS else [""]
        else:
            run = grown
    query = both(query, either([of_string(s) for s in run]))
    return query, run if whole else None


@cache
def trigram_query(pattern: str) -> object:
    """The Boolean query of a regular expression; True if it has no mandatory trigram."""
    reader = Reader(pattern)
    tree = reader.one_of()
    if reader.here():
        raise ValueError(f"unbalanced: {pattern}")
    return analyse(tree)[0]


def trigrams_of(query: object) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


def asked_trigrams(rules: tuple[Rule, ...] = RULES) -> list[str]:
    return sorted(set().union(*(trigrams_of(trigram_query(r.pattern)) for r in rules)))


# --- the index and its use ---------------------------------------------------


def text_key(text: Column) -> Column:
    """What names a text in the index: equal texts are indexed once."""
    return F.unhex(F.md5(text))


def postings(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The inverted index of the trigrams that the rules ask for: a row ``trigram``, ``key`` for each distinct text of ``key``, ``text`` that holds it in any case."""
    trigrams = asked_trigrams(rules)

    def held(folded: Column) -> Column:
        return F.array_compact(F.array(*[F.when(F.contains(folded, F.lit(t)), F.lit(t)) for t in trigrams]))

    # a lambda's variable, so that a text is folded once and not once a trigram
    found = F.get(F.transform(F.array(F.lower("text")), held), F.lit(0))
    return texts.select(F.explode(found).alias("trigram"), "key").distinct()


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``key``, ``candidate``: for each text with a posting list entry, which rules' queries it satisfies (those without trigrams none).

    The lists that a query names are intersected and united by key: every entry
    is one bit, and the bits of a text are added up where its entries meet, on
    either side of one shuffle by key.
    """
    trigrams = asked_trigrams(rules)
    none = F.lit(0).cast("long")
    bits = []
    for k, start in enumerate(range(0, len(trigrams), 62)):
        bit = F.create_map(*[x for i, t in enumerate(trigrams[start : start + 62]) for x in (F.lit(t), F.lit(1 << i).cast("long"))])
        bits.append(F.bit_or(F.coalesce(F.try_element_at(bit, F.col("trigram")), none)).alias(f"postings_{k}"))
    met = index.groupBy("key").agg(*bits)
    tests = [F.lit(False) if (q := trigram_query(narrowed(r).pattern)) is True else satisfied(q, trigrams) for r in rules]
    return met.select("key", F.array(*tests).alias("candidate")).where(F.exists("candidate", lambda c: c))


def satisfied(query: object, trigrams: list[str]) -> Column:
    """The query over the posting bits; conjunctions of trigrams are one test."""
    if query is True:
        return F.lit(True)
    if isinstance(query, str):
        query = ("and", frozenset({query}))
    kind, parts = query
    if kind == "or":
        tests = [satisfied(q, trigrams) for q in sorted(parts, key=repr)]
        out = tests[0]
        for t in tests[1:]:
            out = out | t
        return out
    masks: dict[int, int] = {}
    out = None
    for q in sorted(parts, key=repr):
        if isinstance(q, str):
            at = trigrams.index(q)
            masks[at // 62] = masks.get(at // 62, 0) | 1 << at % 62
        else:
            out = satisfied(q, trigrams) if out is None else out & satisfied(q, trigrams)
    for i, mask in masks.items():
        test = F.col(f"postings_{i}").bitwiseAND(F.lit(mask)) == F.lit(mask)
        out = test if out is None else out & test
    return out


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, kind, end) for the rule's matches in a text, in code points."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    between = F.split(text, rule.pattern, -1)  # the texts before, between and behind the matches
    steps = F.arrays_zip(F.slice(between, 1, F.size(whole)).alias("gap"), whole.alias("found"), tested.alias("part"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["found"])
        span = F.struct(begin.alias("start"), F.lit(order).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(F.length(x["part"]) >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(steps, start, step, lambda acc: acc["out"])


def narrowed(rule: Rule) -> Rule:
    """A pattern of one repeated class with a length test is the same rule with that many repeats:
    its matches are maximal runs, and a run that is too short has no longer match inside."""
    whole = re.fullmatch(r"(.*)(\[[^\]]+\])\+", rule.pattern)
    if whole and not rule.group and re.fullmatch(r"[A-Za-z]*", whole[1]) and rule.least > len(whole[1]):
        return Rule(rule.kind, f"{whole[1]}{whole[2]}{{{rule.least - len(whole[1])},}}", 0, rule.least)
    return rule


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, index: DataFrame | None = None) -> DataFrame:
    """``doc_id``, ``text``, ``row`` if given, and ``spans``: array of (start, rank, kind, end), sorted.

    ``index``: the stored ``postings`` of these texts and rules; built here if it is not given.
    """
    carried = ["row"] if "row" in docs.columns else []
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select("doc_id", text.alias("text"), text_key(text).alias("key"), *carried)
    if index is None:
        index = cut(postings(docs.select("key", "text"), rules))
    # few texts are candidates; Spark picks the join by measured size, and splits the key of many copies
    found = docs.join(candidates(index, rules), "key", "left")
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    columns = []
    for k, rule in enumerate(rules):
        rule = narrowed(rule)
        # a rule without trigrams tests every text; its one cheap test spares the rest the span arithmetic
        candidate = F.col("text").rlike(rule.pattern) if trigram_query(rule.pattern) is True else F.coalesce(F.get("candidate", F.lit(k)), F.lit(False))
        columns.append(F.when(candidate, spans_of(F.col("text"), rule, k)).otherwise(none).alias(f"spans_{k}"))
    found = found.select("doc_id", "text", *carried, *columns)
    return found.select("doc_id", "text", *carried, F.sort_array(F.concat(*[F.col(f"spans_{k}") for k in range(len(rules))])).alias("spans"))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_rank(rank: int) -> Callable[[Column], Column]:
    return lambda s: s["rank"] == rank


def report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans of each document."""
    found = scan(docs.select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_RULES))
    counts = [F.size(F.filter("spans", of_rank(k))).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(BASE_RULES)]
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; spans that overlap share one mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        mark = F.when(s["start"] >= acc["at"], F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit(""))
        new = F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, mark).alias("out"))
        return F.when(s["end"] <= acc["at"], acc).otherwise(new)

    whole = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(whole)
