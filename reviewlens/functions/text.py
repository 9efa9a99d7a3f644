"""Scalar text functions as columns: paths, normal forms, tokens, globs, hashes, templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The lower-case extension with its dot; empty without one."""
    return F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"(\.[^./]*)$", 1))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def message_key(text: Column) -> Column:
    """White space collapsed, lower case, 240 characters: trivial differences fall away."""
    return F.left(F.lower(collapse(text)), F.lit(240))


def left_truncated(text: Column, width: int) -> Column:
    """The end of a text, marked where its start is cut."""
    return F.when(F.length(text) <= width, text).otherwise(F.concat(F.lit("..."), F.right(text, F.lit(width - 3))))


def escape_cell(text: Column) -> Column:
    """For a Markdown table: pipes escaped, line breaks as spaces."""
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def node_label(ident: Column) -> Column:
    return F.translate(ident, "./ ", "___")


def neutral(diff: Column) -> Column:
    """Closing tags of the prompt's own sections can't end them from inside a diff."""
    return F.regexp_replace(diff, r"</(diff_input|diff|user_input)", "<\\\\/$1")


def fill(template: str, values: dict[str, Column]) -> Column:
    """``{{name}}`` replaced by columns."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), value)
    return out


def estimated_tokens(text: Column, given: Column | None = None) -> Column:
    """A positive count that comes with the entry, else a quarter of the characters, at least 1."""
    own = F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")
    return own if given is None else F.when(given > 0, given).otherwise(own)


def provider_tokens(count: Column, provider: str) -> Column:
    """Base counts, raised by 15 % and rounded up for the provider whose tokens are finer."""
    return F.ceil(count * 1.15).cast("int") if provider.lower() == "claude" else count


def code_tokens(text: Column) -> Column:
    """Identifier and number tokens: camel case, acronyms and snake case split, lower case, two characters or more."""
    split = F.regexp_replace(text, r"([a-z])([A-Z])", "$1 $2")
    split = F.regexp_replace(split, r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    # underscores and punctuation are in no token, nor are runs of one character, so nothing is translated or filtered
    return F.regexp_extract_all(F.lower(split), F.lit(r"[a-z][a-z0-9]+|[0-9]{2,}"), F.lit(0))


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression for the whole path: ``**/`` any folders, ``**`` anything, ``*`` and ``?`` within a name."""
    out, i = [], 0
    while i < len(pattern):
        for glob, regex in (("**/", "(.*/)?"), ("**", ".*"), ("*", "[^/]*"), ("?", "[^/]")):
            if pattern.startswith(glob, i):
                out.append(regex)
                i += len(glob)
                break
        else:
            c = pattern[i]
            out.append(c if c.isalnum() or c in "/_- " else "\\" + c)
            i += 1
    return "^" + "".join(out) + "$"


def matches_glob(path: Column, *patterns: str) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | path.rlike(glob_regex(p))
    return hit


def in_directory(path: Column, *directories: str) -> Column:
    """Whether a path lies in one of the directories, at its start or deeper. Only a leading ``./`` is removed."""
    clean = F.regexp_replace(path, r"^\./", "")
    hit = F.lit(False)
    for d in directories:
        d = d.removeprefix("./").strip("/")
        hit = hit | clean.startswith(d + "/") | clean.contains("/" + d + "/")
    return hit


def context_hash(model: str | None, rules: list[str] | None, language: str | None, pipeline: bool, prompt_hash: str | None = None) -> Column:
    """The hash of a review's settings; the order of the rules doesn't matter."""
    names = ",".join(sorted(r.strip() for r in rules or [] if r and r.strip()))
    raw = f"{model if model is not None else '<unset>'}|rules={names}|lang={language or ''}|pipeline={str(pipeline).lower()}|prompt={prompt_hash or ''}"
    return F.sha2(F.lit(raw), 256)


def cache_key(path: Column, diff: Column, context: Column) -> Column:
    """SHA-256 over path, diff and context, without separators."""
    return F.sha2(F.concat(path, diff, F.coalesce(context, F.lit(""))), 256)


def count_of(text: Column, part: str) -> Column:
    """Occurrences of a string, without overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def duration(ms: Column) -> Column:
    """Milliseconds below a second, else seconds with one decimal."""
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).otherwise(F.format_string("%.1fs", ms / 1000))
