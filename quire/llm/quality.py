"""Quality rules as a short-circuit cascade, in SQL functions only.

Each rule is a predicate that rejects a text.  The cascade measures every rule
on a random sample of fixed seed (cost: least seconds of some passes of one task
that evaluates the rule alone on several copies of the sample, less those of a
pass that evaluates nothing; selectivity: share of rows it rejects) and orders
the rules by rejection per cost.  A ``CASE`` evaluates them in that order and
stops at the first that rejects: signals that only later rules need are not made.
The order changes the time a corpus takes, never which rows pass.
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, words_sql

#: Rows, about, on which costs and selectivities are estimated, how often each counts, and passes; verdicts never depend on them.
SAMPLE_ROWS, COPIES, PASSES = 256, 4, 3
SEED = 11
MIN_WORDS = 10
#: Largest share of words inside repeated five-word windows, in percent.
MAX_REPEATED = 20
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """``rejects``: SQL over the columns of ``signals``; ``base`` rules come from the contract."""

    name: str
    rejects: str
    base: bool = False


RULES = (
    Rule("few_words", f"n_words < {MIN_WORDS}", base=True),
    Rule("repeated_words", f"100 * n_repeat_words > {MAX_REPEATED} * n_words", base=True),
    Rule("symbols", "20 * n_symbols > word_chars"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("shouting", "10 * n_upper > 6 * n_letters"),
)

#: Each signal as SQL over ``text`` (never null), ``words`` and ``lines``.
SIGNALS = {
    "n_words": "cast(size(words) as bigint)",
    "word_chars": r"cast(length(array_join(words, '')) as bigint)",
    "n_symbols": rf"cast(regexp_count(text, r'[{SYMBOLS}]') as bigint)",
    "n_lines": "cast(size(lines) as bigint)",
    "n_dup_lines": "cast(size(lines) - size(array_distinct(lines)) as bigint)",
    "n_upper": r"cast(length(regexp_replace(text, r'\P{Lu}+', '')) as bigint)",
    "n_letters": r"cast(length(text) - length(regexp_replace(text, r'\p{L}+', '')) as bigint)",
}
#: Signals that a report has for every row; the cascade makes the others where it comes to them.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words() -> str:
    """SQL for the number of words that lie in a five-word window found twice or more in ``words``.

    Texts without a repeated window (most) stop at comparing the number of
    distinct window hashes with the number of windows.  Otherwise the windows
    are sorted by hash, those equal to a neighbour are kept, and the words their
    places cover are counted in order of place.
    """
    n = WINDOW
    # The words' hashes are bound as a lambda's variable: were they written out by the optimizer, they would be made once per window.
    some = ", ".join(f"hs[i + {k}]" for k in range(n))
    grams = f"element_at(transform(array(transform(words, w -> xxhash64(w))), hs -> transform(sequence(0, size(hs) - {n}), i -> xxhash64({some}))), 1)"
    placed = "array_sort(transform(grams, (g, i) -> struct(g as g, i as i)))"
    repeated = "filter(transform(s, (x, k) -> if(x.g <=> get(s, k - 1).g or x.g <=> get(s, k + 1).g, x.i, null)), p -> p is not null)"
    covered = f"aggregate(places, struct(0L as n, -{n} as at), (a, p) -> struct(a.n + least({n}, p - a.at) as n, p as at), a -> a.n)"
    return (
        f"case when size(words) <= {n} then 0L else "
        f"element_at(transform(array({grams}), grams -> case when size(array_distinct(grams)) = size(grams) then 0L else "
        f"element_at(transform(array({placed}), s -> element_at(transform(array(array_sort({repeated})), places -> {covered}), 1)), 1) end), 1) end"
    )


def _ready(text: Column, docs: DataFrame, keep: list[str]) -> DataFrame:
    clean = docs.select(*keep, F.coalesce(text, F.lit("")).alias("text"))
    return clean.selectExpr(
        *keep, "text", f"{words_sql('text')} as words", r"filter(split(text, '\n'), l -> l rlike r'[^ \t-\r]') as lines"
    )


def signals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and every signal of each row's whole text; null texts are empty, repeated rows repeat."""
    made = _ready(F.col(text), docs.select(F.col(doc_id).alias("doc_id"), F.col(text)), ["doc_id"])
    return made.selectExpr("doc_id", *(f"{sql} as {name}" for name, sql in SIGNALS.items()), f"{repeat_words()} as n_repeat_words")


def _over_text(rule: Rule, made: tuple[str, ...] = ()) -> str:
    """The rule's predicate with its signals, but those already ``made``, written out over ``text``, ``words`` and ``lines``."""
    bodies = {**SIGNALS, "n_repeat_words": repeat_words()}
    return re.sub(r"[a-z]\w*", lambda m: f"({bodies[m.group()]})" if m.group() in bodies and m.group() not in made else m.group(), rule.rejects)


def plan(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS, seed: int = SEED) -> list[Rule]:
    """The rules in order of rejection per cost on about ``sample_rows`` rows, twice as many at most; ties keep their order."""
    share = min(1.0, sample_rows / max(docs.count(), 1))
    sample = cut(docs.select("text").sample(share, seed).limit(2 * sample_rows).coalesce(1))
    many = sample.select(F.explode(F.array_repeat("text", COPIES)).alias("text"))
    ready = _ready(F.col("text"), many, [])

    def seconds(frame: DataFrame) -> tuple[float, int, int]:
        took = []
        for _ in range(PASSES):
            began = time.perf_counter()
            n, hits = frame.collect()[0]
            took.append(time.perf_counter() - began)
        return min(took), n, hits or 0

    nothing = ready.agg(F.count(F.lit(1)), F.sum(F.size("words") + F.size("lines")))
    floor, ranked = seconds(nothing)[0], []
    for i, rule in enumerate(rules):
        took, n, hits = seconds(ready.agg(F.count(F.lit(1)), F.sum(F.expr(f"int({_over_text(rule)})"))))
        ranked.append((-(hits / max(n, 1)) / max(took - floor, 1e-3), i, rule))
    return [rule for _, _, rule in sorted(ranked, key=lambda x: x[:2])]


def first_rejection(rules: list[Rule], made: tuple[str, ...] = ()) -> Column:
    """Name of the first rule of the cascade that rejects, else null; later rules are then not evaluated."""
    return F.expr("case " + " ".join(f"when {_over_text(r, made)} then '{r.name}'" for r in rules) + " end")


def keep_good(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects; columns as they are.  Null texts are empty, an empty table gives no rows."""
    ordered = plan(docs, rules)
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col("text"))
    # The row number keeps the filter above the projection that splits the text, which it would otherwise repeat.
    ready = _ready(F.col("text"), rows, ["__row"]).withColumn("__n", F.monotonically_increasing_id())
    return ready.where(first_rejection(ordered).isNull() & (F.col("__n") >= 0)).select("__row.*")


def report(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, the signals of ``REPORTED``, base_failed, kept and the rule that rejected first in the cascade's order."""
    ordered = plan(docs, rules)
    base = " or ".join(f"({r.rejects})" for r in rules if r.base)
    bodies = {**SIGNALS, "n_repeat_words": repeat_words()}
    made = _ready(F.col("text"), docs.select("doc_id", "text"), ["doc_id"]).selectExpr("doc_id", "text", "words", "lines", *(f"{bodies[k]} as {k}" for k in REPORTED))
    made = made.select("doc_id", *REPORTED, F.expr(base).alias("base_failed"), first_rejection(ordered, REPORTED).alias("rejected_by"))
    return made.selectExpr("*", "rejected_by is null as kept")
