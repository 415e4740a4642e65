"""Strings: headers, bodies, phrases and the marked parts of prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioquery import fixed


def strip(text: Column) -> Column:
    """Without white space at either end, line ends included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group, or null where nothing matches."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def truncate_header(text: Column, most: int = fixed.HEADER_LENGTH) -> Column:
    """At most ``most`` characters, cut at the last space within them if there is one."""
    head = F.substring(text, 1, most)
    return F.when(F.length(text) <= most, text).when(F.instr(head, " ") > 0, F.regexp_extract(head, r"(?s)^(.*) ", 1)).otherwise(head)


def first_line(content: Column) -> Column:
    """The first line that is not blank, stripped; null if there is none."""
    return F.get(F.filter(F.transform(F.split(content, "\n"), strip), lambda x: x != ""), 0)


def body(content: Column) -> Column:
    """What follows the first line, blank or not."""
    return F.regexp_replace(content, r"^[^\n]*\n?", "")


def header_date(header: Column) -> Column:
    """A date as written in a header, the word Unknown, or null."""
    return F.coalesce(found(header, fixed.HEADER_DATE_BRACKET), F.when(header.rlike(fixed.HEADER_DATE_UNKNOWN), F.lit("Unknown")), found(header, fixed.HEADER_DATE_PLAIN))


def header_provider(header: Column) -> Column:
    """Second segment of an underlined bracket, else what follows a cover letter's dash."""
    segments = F.split(found(header, fixed.HEADER_BRACKET), " - ")
    return F.coalesce(strip(F.get(segments, 1)), strip(found(header, fixed.HEADER_COVER)))


def labelled_date(text: Column) -> Column:
    """The first date that follows a date-of-service label."""
    return found(text, fixed.LABELLED_DATE)


def phrases(text: Column, words: int = fixed.PHRASE_WORDS) -> Column:
    """Parts between full stops, semicolons, colons and line ends with at least ``words`` words, stripped."""
    parts = F.regexp_extract_all(text, F.lit(r"[^.;:\n\s](?:[^.;:\n]*[^.;:\n\s])?"), F.lit(0))
    return F.filter(parts, lambda x: x.rlike(rf"^(?:\S+\s+){{{words - 1}}}\S"))


def provider_present(name: Column) -> Column:
    return ~blank(name) & (F.lower(strip(name)) != "unknown")


def contains_any_case(text: Column, term: Column | str) -> Column:
    return F.contains(F.lower(text), F.lower(F.lit(term) if isinstance(term, str) else term))


def tagged(text: Column, tag: str) -> Column:
    """What stands between <tag> and </tag>, stripped; null without it."""
    return strip(found(text, rf"(?s)<{tag}>(.*?)</{tag}>"))


def tagged_or_all(text: Column, tag: str) -> Column:
    return F.coalesce(found(text, rf"(?s)<{tag}>(.*?)</{tag}>"), text)


def labelled(text: Column, *labels: str) -> Column:
    """What follows the first of the labels that begins a line anywhere, stripped; earlier labels win over earlier lines."""
    return F.coalesce(*[strip(found(text, fixed.PROMPT_LABEL.format(label=label))) for label in labels])


def resource_id(text: Column, segment: str) -> Column:
    """A number as given, or the one that follows a segment of an address."""
    return F.coalesce(found(text, r"^\s*(\d+)\s*$"), found(text, rf"/{segment}/(\d+)"))


def case_name(name: Column) -> Column:
    """A file's name without folders and ending."""
    return F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.[^.]*$", "")


def project_case_name(name: Column) -> Column:
    """A project's words in reverse, joined by underscores; null without a name."""
    words = F.filter(F.split(strip(name), r"\s+"), lambda w: w != "")
    return F.nullif(F.array_join(F.reverse(words), "_"), F.lit(""))


def bytes_text(n: Column) -> Column:
    """B, KB or MB with one decimal from a kilobyte on."""
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1024 * 1024, F.format_string("%.1f KB", n / 1024.0)).otherwise(F.format_string("%.1f MB", n / (1024.0 * 1024.0)))


def messages_text(messages: Column, separator: str = ": ") -> Column:
    """Prompt messages (role, template) joined by blank lines."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(separator), m["template"])), "\n\n")
