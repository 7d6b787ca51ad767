"""Inline markup as placeholders ``[[n]]``, ``[[/n]]`` and ``[[n/]]``: parity, nesting and kept content, as SQL."""

from __future__ import annotations

from .text import PLACEHOLDER, strip


def tokens(s: str) -> str:
    """Array of struct(idx, kind) in order of the text; kinds are open, close, void."""
    kind = "case when startswith(t, '[[/') then 'close' when endswith(t, '/]]') then 'void' else 'open' end"
    return rf"transform(regexp_extract_all({s}, r'{PLACEHOLDER}', 0), t -> struct(cast(regexp_extract(t, r'(\d+)', 1) as int) as idx, {kind} as kind))"


def parity(a: str, b: str) -> str:
    """Whether two texts have the same placeholders, as often."""
    return f"(sort_array({tokens(a)}) = sort_array({tokens(b)}))"


def applies(source: str, candidate: str) -> str:
    """Whether the candidate's placeholders are known to the source and nest: one pass with a stack of open ones."""
    known = f"transform({tokens(source)}, x -> x.idx)"
    step = (
        "case when not a.ok then a when not array_contains(a.known, t.idx) then struct(a.known as known, a.st as st, false as ok)"
        " when t.kind = 'void' then a when t.kind = 'open' then struct(a.known as known, array_append(a.st, t.idx) as st, true as ok)"
        " when try_element_at(a.st, -1) = t.idx then struct(a.known as known, slice(a.st, 1, size(a.st) - 1) as st, true as ok)"
        " else struct(a.known as known, a.st as st, false as ok) end"
    )
    return f"aggregate({tokens(candidate)}, struct({known} as known, cast(array() as array<int>) as st, true as ok), (a, t) -> {step}, a -> a.ok and size(a.st) = 0)"


def spans(s: str) -> str:
    """Map from each paired index to whether its span has text of its own (placeholders are none)."""
    ids = rf"array_distinct(transform(regexp_extract_all({s}, r'\[\[(\d+)\]\]', 1), i -> cast(i as int)))"
    inner = rf"regexp_extract({s}, concat('(?s)\\[\\[', i, '\\]\\](.*?)\\[\\[/', i, '/?\\]\\]'), 1)"
    closed = rf"filter({ids}, i -> {s} rlike concat('(?s)\\[\\[', i, '\\]\\].*?\\[\\[/', i, '/?\\]\\]'))"
    return f"map_from_arrays({closed}, transform({closed}, i -> {strip(rf'''regexp_replace({inner}, r'{PLACEHOLDER}', '')''')} <> ''))"


def keeps_content(source: str, candidate: str) -> str:
    """Whether every pair that holds text in the source holds text in the candidate."""
    return f"forall(map_entries({spans(source)}), e -> not e.value or coalesce(try_element_at({spans(candidate)}, e.key), false))"


def rebuilt(text: str, inlines: str) -> str:
    """XHTML of a unit: placeholders become tags again; ``inlines``: MAP<INT, STRUCT<tag, attrs>>."""
    parts = rf"split({text}, r'\[\[/?\d+/?\]\]', -1)"
    escaped = "replace(replace(replace(p, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    attrs = f"array_join(transform(map_entries(element_at({inlines}, t.idx).attrs), x -> concat(' ', x.key, '=\"', replace(replace(x.value, '&', '&amp;'), '\"', '&quot;'), '\"')), '')"
    tag = f"case t.kind when 'close' then concat('</', element_at({inlines}, t.idx).tag, '>') when 'void' then concat('<', element_at({inlines}, t.idx).tag, {attrs}, '/>') else concat('<', element_at({inlines}, t.idx).tag, {attrs}, '>') end"
    return f"array_join(zip_with(transform({parts}, p -> {escaped}), transform({tokens(text)}, t -> {tag}), (p, t) -> concat(p, coalesce(t, ''))), '')"
