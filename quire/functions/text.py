"""Text functions as SQL expressions over a column name or any SQL expression.

Every function returns a string of Spark SQL for ``F.expr``, so all of them stay
in the JVM.  White space, letters and case follow Unicode where plain ``trim``,
``\\s`` or ``\\d`` would not.
"""

from __future__ import annotations

WS = r"(?U)[\s\x1c-\x1f]"
# Fixed value: what stands for inline markup.
PLACEHOLDER = r"\[\[(/?)(\d+)(/?)\]\]"

# English names of language codes.
LANGUAGE_NAMES = {
    "bg": "Bulgarian", "ru": "Russian", "uk": "Ukrainian", "de": "German", "fr": "French", "es": "Spanish", "it": "Italian", "pl": "Polish",
    "pt": "Portuguese", "nl": "Dutch", "cs": "Czech", "sr": "Serbian", "el": "Greek", "tr": "Turkish", "ro": "Romanian", "hu": "Hungarian", "en": "English",
}
LATIN = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
CYRILLIC = "абцдефгхийклмнопярстувщчюзАБЦДЕФГХИЙКЛМНОПЯРСТУВЩЧЮЗ"


def let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, which is made once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def strip(s: str) -> str:
    """Without white space at both ends."""
    return rf"regexp_replace({s}, r'^{WS}+|{WS}+$', '')"


def word_count(s: str) -> str:
    return rf"size(filter(split({s}, r'{WS}+'), w -> w <> ''))"


def lines(s: str) -> str:
    """Array of lines; a final line end makes no empty line."""
    return rf"split(regexp_replace({s}, r'(\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}])\z', ''), r'\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')"


def without_placeholders(s: str, by: str = " ") -> str:
    return rf"regexp_replace({s}, r'{PLACEHOLDER}', '{by}')"


def plain_words(s: str) -> str:
    """Words outside placeholders."""
    return word_count(without_placeholders(s))


def letters(s: str) -> str:
    return rf"length(regexp_replace({s}, r'[^\p{{L}}]', ''))"


def cyrillic_letters(s: str) -> str:
    return rf"length(regexp_replace({s}, r'[^\x{{0400}}-\x{{04FF}}]|[\x{{0482}}-\x{{0489}}]', ''))"


def cyrillic_ratio(s: str) -> str:
    return let("cs", s, f"coalesce(try_divide({cyrillic_letters('cs')}, {letters('cs')}), 0D)")


def single_line(s: str) -> str:
    """White space folded to single spaces; null if nothing is left."""
    return f"nullif({strip(rf'''regexp_replace({s}, r'{WS}+', ' ')''')}, '')"


def language(s: str) -> str:
    """A valid language tag, else null."""
    return rf"case when {strip(s)} rlike r'^[A-Za-z]{{2,3}}(-[A-Za-z0-9]{{1,8}})*\z' then {strip(s)} end"


def language_name(s: str) -> str:
    known = ", ".join(f"'{k}', '{v}'" for k, v in LANGUAGE_NAMES.items())
    return f"coalesce(try_element_at(map({known}), lower(split({s}, '-')[0])), {s})"


def slug(s: str) -> str:
    runs = rf"regexp_replace(lower({strip(s)}), r'(?U)[^\w]+', '-')"
    return rf"coalesce(nullif(regexp_replace({runs}, r'^[-_]+|[-_]+$', ''), ''), 'book')"


def host(s: str) -> str:
    """A host (and path) without scheme, www., surrounding marks and a final slash, in lower case."""
    bare = rf"regexp_replace(regexp_replace({strip(s)}, r'^[*_()\[\]]+|[*_()\[\]]+$', ''), r'(?i)^(https?://)?(www\.)?', '')"
    return rf"lower(regexp_replace({bare}, r'/+$', ''))"


def unfenced(s: str) -> str:
    """The inside of a text that is one fenced block, else the text."""
    pattern = r"(?s)^\s*```(?:markdown|md|json|text)?[ \t]*\n(.*?)\n?```\s*\z"
    return f"case when {s} rlike r'{pattern}' then regexp_extract({s}, r'{pattern}', 1) else {s} end"


def is_image_block(s: str) -> str:
    return rf"({s} rlike r'^\s*!\[[^\]]*\]\([^)]*\)\s*\z')"


def fingerprint(s: str) -> str:
    """16 hex digits that identify a source text."""
    return f"substring(sha1({s}), 1, 16)"


def cache_key(*parts: str) -> str:
    """10 hex digits over all that a result depends on, the model or transform included."""
    return f"substring(sha1(concat_ws(char(0), {', '.join(parts)})), 1, 10)"


def folded(s: str) -> str:
    """Placeholders and white space folded, case folded (with the German sharp s as two)."""
    return f"coalesce({single_line(f'''replace(lower({without_placeholders(s)}), 'ß', 'ss')''')}, '')"


def is_echo(source: str, candidate: str, min_words: int = 8) -> str:
    """Whether a candidate of some length is its source."""
    same = let("ef", folded(source), f"ef = {folded(candidate)} and size(filter(split(ef, ' '), w -> w <> '')) >= {min_words}")
    return f"({same})"


def looks_untranslated(s: str, min_words: int = 8) -> str:
    """Whether text that should be Cyrillic is not: long enough, or short and nearly free of Cyrillic.  Its words are counted only where its letters leave that open."""
    words = let("uw", word_count("ut"), f"(uw >= {min_words} and un >= 24) or (1D - us >= 0.9D and ((uw >= 4 and un >= 12) or (uw >= 3 and un >= 16)))")
    share = let("us", f"coalesce(try_divide({cyrillic_letters('ut')}, un), 0D)", f"us < 0.5D and ({words})")
    return let("ut", without_placeholders(s), let("un", letters("ut"), f"un >= 12 and {share}"))


def without_labels(s: str) -> str:
    """The [BG] part of a text that echoes [BG]/[EN] labels."""
    t = strip(s)
    body = rf"regexp_replace(substring({t}, 5), r'^\n+', '')"
    part = rf"split({body}, r'\n\[EN\]', 2)[0]"
    return rf"regexp_replace(case when startswith({t}, '[BG]') then {part} else {t} end, r'^\n+|\n+\z', '')"


def token_budget(s: str, factor: float = 1.8, cap: int = 16384) -> str:
    return f"least({cap}, greatest(512, int(floor(greatest(64, length({s}) div 3) * {factor}D))))"


def pseudo_translated(s: str) -> str:
    """Letters of the Latin alphabet as Cyrillic ones: an offline stand-in for a translation."""
    return f"translate({s}, '{LATIN}', '{CYRILLIC}')"
