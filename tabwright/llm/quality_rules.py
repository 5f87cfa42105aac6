"""Quality rules: a threshold table compiled into one Spark projection.

Each rule of the table names a measure, a comparison and a limit. ``judge`` turns measures
and rules into columns of a single ``select`` over the scan: there is no shuffle, no user function
and nothing that depends on other rows, so the operator scales with the number of scan tasks and a
lost task is simply run again.

Defined results: a null text is an empty one; an empty text has zero in every measure and fails
``n_words``; repeated rows and rows with a null id are measured like any other; an empty table gives
an empty result; columns of the input are never touched, as added ones carry a prefix that none has.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import text_of, words_of

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that it was for on as with by at be this are or from an "
    "le la les de des du et un une en que qui dans pour par sur pas au avec est "
    "der die das und ein eine in zu den von mit ist nicht auf für im dem auch als "
    "el la los las de del y un una en que es por con para se no su al lo"
).split()
#: Languages of these words.
STOP_LANGUAGES = ("en", "fr", "de", "es")
SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A document fails the rule where the measure is below ``least`` or above ``most``."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: The base rules of the contract, then those of the method. Limits of the latter are loose on
#: purpose: clean prose of any language has to pass, however short.
BASE_RULES = (
    Rule("too_short", "n_words", least=20),
    Rule("repeated_windows", "pct_repeat_words", most=30),
)
METHOD_RULES = (
    Rule("symbols_per_word", "symbols_per_word", most=0.1),
    Rule("mean_word_length", "mean_word_chars", least=2.5, most=14),
    Rule("capital_letters", "capital_ratio", most=0.6),
    Rule("words_with_letters", "letter_word_ratio", least=0.7),
    Rule("repeated_lines", "dup_line_ratio", most=0.5),
    Rule("stop_words", "stop_word_ratio_long", least=0.02),
    Rule("same_word_next", "same_next_ratio", most=0.3),
)


def _after(values: Column, steps: int) -> Column:
    """The array without its first entries: what lies that many steps after each entry."""
    return F.slice(values, steps + 1, F.greatest(F.size(values) - steps, F.lit(0)))


def prefix_of(docs: DataFrame) -> str:
    """``_q_``, or longer where the input has columns of such names: what ``judge`` puts before its own."""
    prefix = "_q_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return prefix


def with_measures(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Add every measure to ``docs`` as a column named by its prefix.

    Windows are compared by 64-bit hashes, which double in length: two neighbouring words, two such
    pairs, two such fours. A text whose windows all differ stops at one distinct count; for others the
    (hash, position) pairs are sorted, so that a long repetitive text costs n log n and not n squared.

    The measures leave the projections through a generator of one row. No filter passes a generator, so
    that a filter on a verdict is never pushed below it, where every use would spell the measures out anew.
    """
    pre, text = prefix_of(docs), text_of(text_column)
    q = lambda name: F.col(pre + name)
    same_as = lambda steps, of: F.zip_with(of, _after(of, steps), lambda x, y: F.xxhash64(x, y))
    df = docs.withColumn(pre + "words", words_of(text))
    df = df.withColumn(pre + "one", F.transform(q("words"), lambda w: F.xxhash64(w)))
    df = df.withColumn(pre + "two", same_as(1, q("one"))).withColumn(pre + "four", same_as(2, q("two")))
    full = F.greatest(F.size(q("words")) - (WINDOW - 1), F.lit(0))
    df = df.withColumn(pre + "hashes", F.slice(same_as(4, q("four")), F.lit(1), full))
    df = df.withColumn(pre + "lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    paired = F.array_sort(F.transform(q("hashes"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    df = df.withColumn(pre + "sorted", F.when(F.size(F.array_distinct(q("hashes"))) < F.size(q("hashes")), paired).otherwise(none))
    order = q("sorted")
    same = lambda x, i: (F.get(order, i - 1)["h"] == x["h"]) | (F.get(order, i + 1)["h"] == x["h"])
    df = df.withColumn(pre + "hit", F.array_sort(F.transform(F.filter(order, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"])))
    hit, words = q("hit"), q("words")
    covered = F.aggregate(
        F.transform(hit, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(hit, i + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    lines = F.size(q("lines"))
    measures = {
        "n_words": F.size(words),
        "word_chars": F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")),
        "n_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
        "n_dup_lines": lines - F.size(F.array_distinct(q("lines"))),
        "n_lines": lines,
        "n_repeat_words": covered,
        "n_letters": F.length(F.regexp_replace(text, r"[^\p{L}]+", "")),
        "n_capitals": F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")),
        "n_letter_words": F.regexp_count(text, F.lit(r"\p{L}[^\x20\x09-\x0D]*")),
        "n_stop_words": F.size(F.filter(words, lambda w: w.isin(*STOP_WORDS))),
        "n_same_next": F.size(F.filter(words, lambda w, i: F.coalesce(F.get(words, i + 1) == w, F.lit(False)))),
    }
    one_row = F.array(F.struct(*[v.cast("long").alias(pre + k) for k, v in measures.items()]))
    df = df.select(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns], F.inline_outer(one_row))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    ratios = {
        "pct_repeat_words": share(100 * q("n_repeat_words"), q("n_words")),
        "symbols_per_word": share(q("n_symbols"), q("n_words")),
        "mean_word_chars": share(q("word_chars"), q("n_words")),
        "capital_ratio": share(q("n_capitals"), q("n_letters")),
        "letter_word_ratio": share(q("n_letter_words"), q("n_words")),
        "dup_line_ratio": share(q("n_dup_lines"), q("n_lines")),
        # A short text may well be without a function word: it is not held to the share.
        "stop_word_ratio_long": F.when(q("n_words") < 50, 1.0).otherwise(share(q("n_stop_words"), q("n_words"))),
        "same_next_ratio": share(q("n_same_next"), q("n_words")),
    }
    return df.withColumns({pre + k: v for k, v in ratios.items()})


def failed(rule: Rule, prefix: str = "_q_") -> Column:
    """Whether a row fails a rule. The share of repeated words is compared as integers (100 * repeated > 30 *
    words), so that this verdict does not hang on a division."""
    if rule.measure == "pct_repeat_words":
        return 100 * F.col(prefix + "n_repeat_words") > int(rule.most) * F.col(prefix + "n_words")
    value, hit = F.col(prefix + rule.measure), F.lit(False)
    if rule.least is not None:
        hit = hit | (value < rule.least)
    if rule.most is not None:
        hit = hit | (value > rule.most)
    return hit


def judge(docs: DataFrame, rules: tuple[Rule, ...] = METHOD_RULES, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """Rows of ``docs`` with the measures, ``base_failed``, ``kept`` and the ``reasons``: names of failed rules.

    The added columns carry the prefix of ``prefix_of(docs)``.
    """
    df, pre = with_measures(docs), prefix_of(docs)

    def any_of(some: tuple[Rule, ...]) -> Column:
        return reduce(lambda x, r: x | failed(r, pre), some, F.lit(False))

    reasons = F.array_compact(F.array(*[F.when(failed(r, pre), r.name) for r in (*base, *rules)]))
    return df.withColumns({pre + "base_failed": any_of(base), pre + "reasons": reasons, pre + "kept": ~any_of((*base, *rules))})


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass every rule, with the columns of ``docs``.

    The rule of stop words is held against a document only where its ``lang`` names a language that the
    list covers: prose of another or an unknown language has few of them, however clean.
    """
    pre = prefix_of(docs)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    listed = F.coalesce(F.lower(F.split(lang, "[-_]")[0]).isin(*STOP_LANGUAGES), F.lit(False))
    hit = [failed(r, pre) & (listed if r.name == "stop_words" else F.lit(True)) for r in BASE_RULES + METHOD_RULES]
    return with_measures(docs).filter(~reduce(lambda x, y: x | y, hit)).select(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])
