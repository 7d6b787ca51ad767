"""Acceptance gates for what a model returns; each names the first gate that fails (null: accepted)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.placeholders import applies, keeps_content, parity

CYRILLIC_TARGETS = ("bg", "ru", "uk", "sr", "mk", "be")


def _first(gates: list[tuple[str, str]]) -> Column:
    return F.expr("case " + " ".join(f"when not coalesce({ok}, false) then '{name}'" for name, ok in gates) + " end")


def _between(ratio: str, lo: float, hi: float) -> str:
    return f"{ratio} between {lo}D and {hi}D"


def _cyrillic(target: str) -> str:
    return f"{target} in ({', '.join(map(repr, CYRILLIC_TARGETS))})"


def translation_gate(source: str = "source", candidate: str = "candidate", target: str = "target") -> Column:
    """Gates of a translated unit."""
    words = T.plain_words(source)
    return _first([
        ("empty", f"{T.strip(candidate)} <> ''"),
        ("parity", parity(source, candidate)),
        ("nesting", applies(source, candidate)),
        ("emphasis", keeps_content(source, candidate)),
        ("length", f"{words} < 12 or {_between(f'{T.plain_words(candidate)} / {words}', 0.5, 1.9)}"),
        ("echo", f"not {T.is_echo(source, candidate)}"),
        ("script", f"not ({_cyrillic(target)}) or {T.plain_words(candidate)} < 8 or {T.cyrillic_ratio(T.without_placeholders(candidate))} >= 0.45D"),
    ])


def polish_gate(pre: str = "pre", candidate: str = "candidate", source: str | None = None) -> Column:
    """Gates of a polished unit; ``source`` (the unit's own text) adds the nesting gate."""
    chars = f"length({T.without_placeholders(candidate)}) / length({T.without_placeholders(pre)})"
    words = f"{T.plain_words(candidate)} / {T.plain_words(pre)}"
    raw = T.looks_untranslated(pre)
    return _first([
        ("empty", f"{T.strip(candidate)} <> ''"),
        ("parity", parity(pre, candidate)),
        *([("nesting", applies(source, candidate))] if source else []),
        ("emphasis", keeps_content(pre, candidate)),
        ("chars", f"length({T.without_placeholders(pre)}) < 40 or if({raw}, {_between(chars, 0.35, 3.0)}, {_between(chars, 0.4, 2.5)})"),
        ("words", f"{T.plain_words(pre)} < 12 or {raw} or {_between(words, 0.5, 2.2)}"),
        ("script", f"{T.plain_words(candidate)} < 8 or {T.cyrillic_ratio(T.without_placeholders(candidate))} >= 0.5D or {T.letters(T.without_placeholders(pre))} < 24"),
    ])


def label_gate(source: str = "source", candidate: str = "candidate", target: str = "target") -> Column:
    """Gates of a translated navigation label."""
    words = T.word_count(source)
    return _first([
        ("empty", f"{T.strip(candidate)} <> ''"),
        ("length", f"{words} < 3 or {_between(f'{T.word_count(candidate)} / {words}', 0.3, 3.0)}"),
        ("echo", f"not {T.is_echo(source, candidate, 4)}"),
        ("script", f"not ({_cyrillic(target)}) or {T.word_count(candidate)} < 3 or {T.cyrillic_ratio(candidate)} >= 0.45D"),
    ])


def polished_label_gate(source: str = "source", candidate: str = "candidate") -> Column:
    """Gates of a polished navigation label."""
    return _first([
        ("empty", f"{T.strip(candidate)} <> ''"),
        ("untranslated", f"not {T.looks_untranslated(candidate)}"),
        ("same", f"{T.folded(source)} <> {T.folded(candidate)}"),
        ("script", f"{T.word_count(candidate)} < 3 or {T.cyrillic_ratio(candidate)} >= 0.5D"),
    ])


def is_safe(source: str = "source", pre: str = "pre") -> Column:
    """Whether an earlier text may be applied to its unit."""
    return F.expr(f"{pre} is null or {T.strip(pre)} = '' or {pre} = {source} or ({applies(source, pre)} and {keeps_content(source, pre)})")


def fidelity(source: str = "source", output: str = "output") -> Column:
    """Words of the output by words of the source (null without source words); 0.70 to 1.20 passes, as does null."""
    return F.expr(f"try_divide({T.word_count(output)}, {T.word_count(source)})")


def is_faithful(source: str = "source", output: str = "output") -> Column:
    ratio = fidelity(source, output)
    return ratio.isNull() | ratio.between(0.70, 1.20)


def fingerprint_matches(found: str = "source_fp", source: str = "source") -> Column:
    """Whether a checkpoint entry belongs to its unit: no fingerprint (old format) or the unit's own."""
    return F.expr(f"{found} is null or {found} = {T.fingerprint(source)}")
