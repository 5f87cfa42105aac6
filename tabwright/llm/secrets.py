"""Secret scans through a trigram inverted index.

A rule is a regular expression. ``trigram_query`` parses it and derives which trigrams every match
must contain, as a conjunction of disjunctions of conjunctions. The index holds one posting
(trigram, document) for each trigram that some rule asks for and some document contains; a rule's
candidates are the documents whose postings satisfy its Boolean query, and only their texts are
verified by the regular expression. Rules without mandatory trigrams scan every text.

Everything is a column expression. Match positions come from splitting the text at the matches and
summing lengths, so they count code points.

Scale: postings are slim rows and are reduced per document with map-side combination, whatever
group of copies the document belongs to. One pass over a text finds all asked-for trigrams. Candidates are
broadcast while their counted number is under ``BROADCAST_ROWS``; beyond that each text is verified where its
own postings satisfy the query, so that texts are never shuffled.

Defined results: a null text is an empty one and has no spans; a row with a null id is scanned like
any other (joins are null-safe); repeated rows each give a row; extra columns are ignored, since the
scan selects only id and text; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import Scratch, text_of

#: Candidate rows (id, hash, mask: under 40 bytes each) that may be broadcast.
BROADCAST_ROWS = 1_000_000
#: A literal run of a regular expression is expanded into so many strings at most.
EXPAND = 64


@dataclass(frozen=True)
class Rule:
    """kind: name in results. group, least: the group whose length is limited, and its least length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The three base kinds in their order, then further kinds of well-known credentials.
#: Greedy runs with a least length equal runs filtered by length, because a run is always taken whole.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("stripe", r"sk_live_[0-9A-Za-z]{16,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"://[A-Za-z0-9._-]{1,64}:[A-Za-z0-9._-]{1,64}@"),
)
RULES = BASE + MORE


def _runs(tree) -> list[set[str]]:
    """Split a parsed pattern into maximal runs with a finite set of strings each.

    Runs are separated by parts that stand for too many strings. Every match contains, for each
    run, one of its strings.
    """
    runs: list[set[str]] = [{""}]

    def times(options: set[str]) -> None:
        if len(runs[-1]) * len(options) <= EXPAND:
            runs[-1] = {x + y for x in runs[-1] for y in options}
        else:
            runs.append(set(options))

    for op, arg in tree:
        if op is sre.LITERAL:
            times({chr(arg).lower()})
        elif op is sre.IN and all(x[0] is sre.LITERAL for x in arg) and len(arg) <= 8:
            times({chr(x[1]).lower() for x in arg})
        elif op is sre.SUBPATTERN:
            inner = _runs(arg[3])
            times(inner[0])
            runs.extend(inner[1:])
        elif op is sre.BRANCH:
            options = [_runs(x) for x in arg[1]]
            whole = set().union(*[x[0] for x in options]) if all(len(x) == 1 for x in options) else None
            if whole is not None and len(whole) <= EXPAND:
                times(whole)
            else:
                runs.append({""})
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, what = arg
            inner = _runs(what)
            if len(inner) == 1 and high == low and low <= 8 and len(inner[0]) <= 8:
                for _ in range(low):
                    times(inner[0])
            elif len(inner) == 1 and low == 0 and high == 1 and len(inner[0]) <= 8:
                times(inner[0] | {""})
            else:
                if len(inner) == 1 and low:
                    for _ in range(min(low, 8)):
                        if len(inner[0]) > 1:
                            break
                        times(inner[0])
                runs.append({""})
        elif op is not sre.AT:
            runs.append({""})
    return runs


def trigram_query(pattern: str) -> frozenset:
    """Boolean trigram query of a pattern, in lower case; empty where nothing is mandatory.

    All of its clauses must hold, of each clause one alternative, of an alternative all trigrams.
    """
    clauses = set()
    for run in _runs(sre_parser.parse(pattern)):
        if run and all(len(x) >= 3 for x in run):
            clauses.add(frozenset(frozenset(x[i : i + 3] for i in range(len(x) - 2)) for x in run))
    return frozenset(clauses)


_SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def spans(text: Column, rule: Rule) -> Column:
    """Array of (start, rank, end, kind) of the rule's matches, in code points, end exclusive.

    Steps (gap, match) are summed up in stretches of about the root of their number, and stretches are moved
    on by the lengths before them, so that arrays which grow step by step stay short in texts full of matches.
    """
    rank = [r.kind for r in RULES].index(rule.kind) if rule in RULES else len(RULES)
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.least else whole
    between = F.split(text, rule.pattern, -1)
    steps = F.arrays_zip(F.transform(between, F.length).alias("gap"), F.transform(whole, F.length).alias("own"), F.transform(part, F.length).alias("part"))
    empty = F.array().cast(_SPANS)

    def add(state: Column, step: Column) -> Column:
        start = state["at"] + step["gap"]
        end = start + F.coalesce(step["own"], F.lit(0))
        found = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind")))
        good = step["own"].isNotNull() & (step["part"] >= rule.least)
        return F.struct(end.alias("at"), F.when(good, F.concat(state["found"], found)).otherwise(state["found"]).alias("found"))

    def stretches(all_steps: Column) -> Column:
        size = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(all_steps)))).cast("int")
        at = F.sequence(F.lit(1), F.size(all_steps), size)
        return F.transform(at, lambda i: F.aggregate(F.slice(all_steps, i, size), F.struct(F.lit(0).alias("at"), empty.alias("found")), add))

    def moved(state: Column, stretch: Column) -> Column:
        shift = lambda x: F.struct((x["start"] + state["at"]).alias("start"), x["rank"].alias("rank"), (x["end"] + state["at"]).alias("end"), x["kind"].alias("kind"))
        own = F.array(F.struct(F.transform(stretch["found"], shift).alias("found")))
        return F.struct((state["at"] + stretch["at"]).alias("at"), F.concat(state["found"], own).alias("found"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<found:{_SPANS}>>").alias("found"))
    folded = F.aggregate(stretches(steps), start, moved, lambda x: F.flatten(x["found"]["found"]))
    return F.when(text.rlike(rule.pattern), folded).otherwise(empty)


def trigram_pattern(trigrams: list[str]) -> str:
    """Pattern that stands before each place of an asked-for trigram, as a trie of their characters: one pass finds all."""
    trie: dict[str, dict[str, list[str]]] = {}
    for a, b, c in sorted(trigrams):
        trie.setdefault(a, {}).setdefault(b, []).append(c)
    some = lambda cs: "[" + "".join(map(_quoted, cs)) + "]"
    heads = [_quoted(a) + "(?:" + "|".join(_quoted(b) + some(cs) for b, cs in tails.items()) + ")" for a, tails in trie.items()]
    return "(?=(" + "|".join(heads) + "))"


def _quoted(character: str) -> str:
    return character if character.isalnum() else f"\\x{{{ord(character):x}}}"


def present(text: Column, trigrams: list[str]) -> Column:
    """Distinct asked-for trigrams of a text, any case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(trigram_pattern(trigrams)), F.lit(1)))


def index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Inverted index: a posting (number of the trigram, document key) for each asked-for trigram."""
    numbers = F.transform(present(text_of(), trigrams), lambda t: F.array_position(F.lit(trigrams), t) - 1)
    return docs.select("doc_id", F.xxhash64(text_of()).alias("_h"), F.explode(numbers).alias("trigram"))


def mask_of(has: Callable[[frozenset], Column], rules: list[tuple[Rule, frozenset]]) -> Column:
    """A bit for each rule whose Boolean query holds, ``has`` telling whether all trigrams of a set are there."""
    mask = F.lit(0).cast("long")
    for k, (_, query) in enumerate(rules):
        ok = F.lit(True)
        for clause in query:
            ok = ok & reduce(lambda x, y: x | y, [has(alternative) for alternative in clause])
        mask = mask.bitwiseOR(F.when(ok, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return mask


def candidates(postings: DataFrame, trigrams: list[str], rules: list[tuple[Rule, frozenset]]) -> DataFrame:
    """Intersect postings: documents that satisfy some rule's query, with a bit for each such rule."""
    place = {t: divmod(i, 63) for i, t in enumerate(trigrams)}
    sums = [
        F.bit_or(F.when(F.floor(F.col("trigram") / 63) == w, F.expr("shiftleft(1L, CAST(trigram % 63 AS INT))")).otherwise(F.lit(0).cast("long"))).alias(f"_m{w}")
        for w in range(-(-len(trigrams) // 63))
    ]

    def has(wanted: frozenset) -> Column:
        bits: dict[int, int] = {}
        for t in wanted:
            bits[place[t][0]] = bits.get(place[t][0], 0) | 1 << place[t][1]
        return reduce(lambda x, y: x & y, [F.col(f"_m{w}").bitwiseAND(F.lit(v).cast("long")) == v for w, v in sorted(bits.items())])

    held = postings.groupBy("doc_id", "_h").agg(*sums)
    return held.select("doc_id", "_h", mask_of(has, rules).alias("_rules")).filter("_rules <> 0")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, scratch: Scratch | None = None) -> DataFrame:
    """doc_id and ``found``, the sorted array of (start, rank, end, kind), one row for each input row."""
    queries = {r: trigram_query(r.pattern) for r in rules}
    indexed = [(r, q) for r, q in queries.items() if q]
    full = [r for r in rules if not queries[r]]
    keyed = docs.select("doc_id", text_of().alias("text")).withColumn("_h", F.xxhash64("text"))
    nothing = F.array().cast(_SPANS)
    out = keyed.select("doc_id", "_h", (F.concat(*[spans(F.col("text"), r) for r in full]) if full else nothing).alias("_full"))
    if not indexed:
        return out.select("doc_id", F.array_sort("_full").alias("found"))
    trigrams = sorted({t for _, q in indexed for clause in q for alternative in clause for t in alternative})
    picked = (scratch or Scratch(docs.sparkSession)).table(candidates(index(docs, trigrams), trigrams, indexed), "candidates")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_k"))
    if picked.count() <= BROADCAST_ROWS:
        hit = keyed.join(F.broadcast(picked.select(F.col("doc_id").alias("_id"), F.col("_h").alias("_k"), "_rules")), same).select("_id", "_k", "text", "_rules")
    else:
        # Too many to be sent to the texts, and texts are not shuffled to them: each row intersects its own postings.
        own = keyed.withColumn("_own", present(F.col("text"), trigrams))
        rules_of = mask_of(lambda wanted: F.size(F.array_intersect(F.col("_own"), F.lit(sorted(wanted)))) == len(wanted), indexed)
        hit = own.select(F.col("doc_id").alias("_id"), F.col("_h").alias("_k"), "text", rules_of.alias("_rules")).filter("_rules <> 0")
    some = [F.when(F.col("_rules").bitwiseAND(F.lit(1 << k)) != 0, spans(F.col("text"), r)).otherwise(nothing) for k, (r, _) in enumerate(indexed)]
    verified = hit.select("_id", "_k", F.concat(*some).alias("_some")).filter(F.size("_some") > 0).dropDuplicates(["_id", "_k"])
    return out.join(verified, same, "left").select("doc_id", F.array_sort(F.concat("_full", F.coalesce("_some", nothing))).alias("found"))


def as_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
