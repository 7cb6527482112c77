"""Text expressions: tokens, term splitting, names, prompts, digests."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no content in a query.
STOP_WORDS = [
    "a", "an", "the", "my", "your", "his", "her", "its", "their", "of", "in", "on", "at", "to", "for", "with",
    "and", "or", "is", "are", "was", "were", "be", "some", "this", "that", "these", "those", "there", "photo", "picture", "image",
]


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits; other letters are dropped."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def content_tokens(text: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Tokens that are not stop words."""
    return F.filter(tokens(text), lambda t: ~t.isin(stop))


def is_compound(text: Column) -> Column:
    """More than two content tokens."""
    return F.size(content_tokens(text)) > 2


def content_words(query: str) -> list[str]:
    """`content_tokens` of a query on the driver."""
    return [w for w in re.findall("[a-z0-9]+", query.lower()) if w not in STOP_WORDS]


def is_compound_text(query: str) -> bool:
    """`is_compound` of a query on the driver."""
    return len(content_words(query)) > 2


def split_terms(query: str) -> list[tuple[str, bool]]:
    """(term, quoted) of a query in order: quoted phrases whole, lower-cased, blanks squeezed; the rest by content words. A query
    without any is one phrase."""
    out: list[tuple[str, bool]] = []
    for n, part in enumerate(re.sub(r'"([^"]*)"', "\x00\\1\x00", query).split("\x00")):
        if n % 2 == 0:
            out += [(w, False) for w in content_words(part)]
        elif part.strip():
            out.append((" ".join(part.lower().split()), True))
    whole = " ".join(query.lower().split())
    return out or ([(whole, True)] if whole else [])


def segment(words: list[str], vocabulary: set[str], longest: int = 3) -> list[str] | None:
    """Greedy longest n-grams over a vocabulary; None unless every word is covered."""
    out, i = [], 0
    while i < len(words):
        for n in range(min(longest, len(words) - i), 0, -1):
            if (g := " ".join(words[i : i + n])) in vocabulary:
                out.append(g)
                i += n
                break
        else:
            return None
    return out


def normalise_name(name: Column) -> Column:
    """Underscores and hyphens to blanks, parentheses dropped, blanks squeezed, lower case."""
    bare = F.regexp_replace(F.regexp_replace(name, r"\([^)]*\)", " "), r"[_\-]", " ")
    return F.lower(F.trim(F.regexp_replace(bare, r"\s+", " ")))


def prompt(name: Column) -> Column:
    """'a photo of a/an NAME.'"""
    article = F.when(F.lower(F.substring(name, 1, 1)).rlike("[aeiou]"), "an").otherwise("a")
    return F.concat(F.lit("a photo of "), article, F.lit(" "), name, F.lit("."))


def base_name(path: Column) -> Column:
    """Last component of a path."""
    return F.element_at(F.split(path, "/"), -1)


def path_number(path: Column) -> Column:
    """The number that a file is named by, null if it is named otherwise."""
    return F.regexp_extract(path, r"([^/]+)\.[^./]*$", 1).try_cast("bigint")


def config_sha(spec: dict) -> str:
    """16 hex digits of the canonical JSON of a configuration."""
    return hashlib.sha256(json.dumps(spec, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def prompt_sha(prompts: Column) -> Column:
    """16 hex digits of prompts joined by a zero character."""
    return F.substring(F.sha2(F.array_join(prompts, "\x00"), 256), 1, 16)


def parse_pairs(pairs: Column) -> Column:
    """Array of 'key=value' to a map, split at the first equals sign, trimmed; entries without a sign or key are left out and of
    equal keys the last counts."""
    kv = F.transform(F.filter(pairs, lambda x: x.rlike(r"^\s*[^=\s]")  & x.contains("=")), lambda x: F.split(x, "=", 2))
    trimmed = F.transform(kv, lambda x: F.struct(F.trim(x[0]).alias("k"), F.trim(x[1]).alias("v")))
    last = F.filter(trimmed, lambda x, i: ~F.exists(F.slice(trimmed, i + 2, F.size(trimmed)), lambda y: y.k == x.k))
    return F.map_from_entries(last)
