"""Instructions for the model stages, in our own words, and how they are filled in."""

from __future__ import annotations

from ..functions.text import LANGUAGE_NAMES

CLEAN = (
    "You get part of a book that was read from a printed page layout. Give the same text back as clean Markdown. Keep every word and its order; do not add, "
    "shorten or explain. Join words and lines that the page broke, drop running heads and page numbers, keep headings, emphasis, lists and image references. Answer with the Markdown only."
)
CLEAN_SHORT = CLEAN + " An earlier answer left parts of the text out or summed them up: give all of it, word for word; only what belongs to the page's layout goes."
CLEAN_LONG = CLEAN + " An earlier answer had more than the text, or had parts of it twice: give what is there once, word for word; only what belongs to the page's layout goes."
METADATA = "Read the start of a book. Answer with one JSON object with title, author, language (a tag such as en or pt-BR) and language_name; use null where the text does not say."
TRANSLATE = (
    "Translate the numbered units of a book into {language}, faithfully and as literature. Each unit starts with a line <<<n>>>; answer with the same units under the same numbers. "
    "Marks such as [[1]], [[/1]] and [[2/]] stand for formatting: keep each of them around the words it belongs to. Do not leave units out and do not comment."
)
POLISH = (
    "Improve the wording of numbered units in Bulgarian: natural word order, idiom, agreement; meaning, names and marks such as [[1]] stay. A unit in English is to be translated. "
    "If a unit has a part [EN], it is the source for comparison only. Answer with the same units under the same numbers."
)


def system(prompt: str, language: str | None = None, glossary: str = "") -> str:
    """A prompt with its language's name and, if given, the glossary's lines."""
    name = LANGUAGE_NAMES.get((language or "").lower().split("-")[0], language or "")
    return prompt.format(language=name) + (f"\n\nUse these terms:\n{glossary}" if glossary else "")
