"""Scalar functions on columns; all are built-in expressions that run inside generated code."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRST_ID = 10_000


def stable_id(kind: str | Column, key: str | Column) -> Column:
    """A reproducible id: FIRST_ID plus 48 bits of the md5 of `kind:key`. Ids under FIRST_ID are left to hand-made graphs."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.conv(F.substring(F.md5(F.concat_ws(":", kind, F.col(key) if isinstance(key, str) else key).cast("binary")), 1, 12), 16, 10).cast("bigint") + FIRST_ID


def stable_id_of(kind: str, key: str) -> int:
    """stable_id of a known key, so that a look-up is a filter with a constant."""
    return int(hashlib.md5(f"{kind}:{key}".encode()).hexdigest()[:12], 16) + FIRST_ID


def title_case(c: Column | str) -> Column:
    """Words between underscores and white space with their first letter in upper case; the rest stays as it is."""
    words = F.filter(F.split(c, r"[_\s]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2**31 - 1))), " ")


def person_name(c: Column | str) -> Column:
    """Title case for lower-case names with underscores only."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.contains("_") & (F.lower(c) == c), title_case(c)).otherwise(c)


def distinctive_key(c: str | Column, least: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return (F.length(c) >= least) & c.rlike("[0-9]")


def link_tokens(c: str, least: int = 6) -> Column:
    """Tokens of letters, digits, underscores and dashes, in lower case, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"[a-z0-9_-]{{{least},}}"), F.lit(0))


def non_empty(*cs: str) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs])


def embedding_text(*cs: str, most: int = 4000) -> Column:
    """Non-empty parts, one on a line, the first `most` characters of all."""
    return F.substring(F.concat_ws("\n", *[F.nullif(F.col(c), F.lit("")) for c in cs]), 1, most)


def truncated(c: str | Column, most: int) -> Column:
    """Longer strings are cut and say how many characters are missing."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("… [truncated "), (F.length(c) - most).cast("string"), F.lit(" chars]"))).otherwise(c)


def unescaped(c: str) -> Column:
    """Literal backslash sequences for line ends and tabs become these characters."""
    return F.regexp_replace(F.regexp_replace(c, r"\\r\\n|\\n", "\n"), r"\\t", "\t")


def thread_subject(c: str) -> Column:
    return F.regexp_replace(c, r"(?i)^\s*((re|fwd?|aw|sv)\s*:\s*)+", "")


def is_bot(c: str) -> Column:
    return F.col(c).rlike(r"(?i)bot$|^ci$|webhook|alerts?$")


def address(c: str) -> Column:
    """struct<name, address>: `Name <addr>`, or a bare address, or a bare name."""
    full = F.trim(F.regexp_extract(c, r"^(.*?)<([^<>]*)>\s*$", 1)), F.regexp_extract(c, r"^(.*?)<([^<>]*)>\s*$", 2)
    bare = F.trim(c)
    named = F.col(c).rlike(r"<[^<>]*>\s*$")
    name = F.when(named, F.regexp_replace(full[0], r'^"|"$', "")).when(bare.contains("@"), F.lit("")).otherwise(bare)
    return F.struct(name.alias("name"), F.when(named, full[1]).when(bare.contains("@"), bare).otherwise(F.lit("")).alias("address"))


def recipients(c: str) -> Column:
    """Parts between commas that are not inside angle brackets, trimmed."""
    return F.filter(F.transform(F.split(c, r",(?![^<]*>)"), lambda x: F.trim(x)), lambda x: x != "")


def mentions(c: str) -> Column:
    return F.regexp_extract_all(c, F.lit(r"@\[([^\]]+)\]"), F.lit(1))


def without_mentions(c: str) -> Column:
    """Mention brackets replaced by the names in them."""
    return F.regexp_replace(c, r"@\[([^\]]+)\]", "$1")


def source_label(c: str, names: dict[str, str]) -> Column:
    known = F.create_map(*[F.lit(x) for kv in sorted(names.items()) for x in kv]) if names else F.create_map().cast("map<string,string>")
    return F.coalesce(F.try_element_at(known, F.col(c)), F.replace(F.col(c), F.lit("_"), F.lit(" ")))


def display_time(c: str) -> Column:
    """`9 Jan 2026, 10:00` in UTC; what is no time stays as it is."""
    return F.coalesce(F.date_format(F.try_to_timestamp(F.col(c)), "d MMM yyyy, HH:mm"), F.col(c))


def percent(c: str | Column) -> Column:
    """A share as a whole percentage; null is `n/a`."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.concat(F.round(c * 100).cast("bigint").cast("string"), F.lit("%")), F.lit("n/a"))


def mention_at(text: str | Column, cursor: str | Column) -> Column:
    """struct<start, query> of the mention being typed before the cursor (a number of characters); null if there is none.

    An open bracket `@[words` counts first; else the word after the last `@`, if white space or nothing stands before it.
    """
    text, cursor = (F.col(x) if isinstance(x, str) else x for x in (text, cursor))
    before = F.substring(text, F.lit(1), cursor)
    bracket, bare = r"(?s)^(.*)@\[([^\]]*)$", r"(?s)^(|.*\s)@((?!\[)[^\s@]*)$"
    found = lambda p: F.struct(F.length(F.regexp_extract(before, p, 1)).alias("start"), F.regexp_extract(before, p, 2).alias("query"))
    return F.when(before.rlike(bracket), found(bracket)).when(before.rlike(bare), found(bare))


def display_type(c: str) -> Column:
    return F.lower(F.replace(F.col(c), F.lit("_"), F.lit(" ")))


def short_title(c: str, most: int = 42) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(F.col(c))


#: Words of a name that may be in lower case, unless they come first.
PARTICLES = ("de", "del", "der", "den", "van", "von", "la", "le", "du", "da", "dos", "bin", "al")


def looks_like_name(c: str | Column) -> Column:
    """One to four words between any white space, each capitalised, or a particle in any case that is not the first."""
    c = F.col(c) if isinstance(c, str) else c
    word = r"\p{Lu}[\p{L}'’.-]*"
    return F.coalesce(c.rlike(rf"^\s*{word}(\s+({word}|(?i:{'|'.join(PARTICLES)}))){{0,3}}\s*$"), F.lit(False))


def token_overlap(a: str, b: str) -> Column:
    """Whether a word of one is a prefix of a word of the other, in lower case."""
    words = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
    return F.exists(words(a), lambda x: F.exists(words(b), lambda y: x.startswith(y) | y.startswith(x)))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, na: Column | None = None, nb: Column | None = None) -> Column:
    """0 where either vector is zero or the dimensions differ."""
    scale = (norm(a) if na is None else na) * (norm(b) if nb is None else nb)
    return F.when((scale == 0) | (F.size(a) != F.size(b)), F.lit(0.0)).otherwise(dot(a, b) / scale)
