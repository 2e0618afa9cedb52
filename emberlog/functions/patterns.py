"""Key patterns: the prefix dialect, shell globs and plain containment, as pushable column predicates where possible."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def prefix_pattern(key: Column, pattern: str) -> Column:
    """'p/*' and 'p*' are prefixes (pushed to Parquet as such), anything else is the key itself."""
    return key.startswith(pattern[:-1]) if pattern.endswith("*") else key == F.lit(pattern)


def glob_regex(pattern: str) -> str:
    """A shell glob as an anchored regular expression; '*' and '?' also match '/' and newlines, [!x] negates."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + 2 + (pattern[i + 1 : i + 2] == "!"))) > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[" + ("^" + body[1:] if body[:1] == "!" else "\\" + body if body[:1] == "^" else body) + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "\\z"


def glob_pattern(key: Column, pattern: str) -> Column:
    """Shell glob; the literal head of the pattern is also given as a prefix, which reaches the scan."""
    head = re.split(r"[*?\[]", pattern)[0]
    match = key.rlike(glob_regex(pattern))
    return key.startswith(head) & match if head else match


def key_matches(key: Column, pattern: str, mode: str = "glob") -> Column:
    """mode: 'glob', 'prefix' or 'contains'."""
    if mode == "contains":
        return key.contains(pattern)
    return {"glob": glob_pattern, "prefix": prefix_pattern}[mode](key, pattern)


def segment(key: Column, n: int) -> Column:
    """The n-th '/'-separated part of a key, from 0; null beyond the last."""
    return F.get(F.split(key, "/"), F.lit(n))


def indexed_key(prefix: str, i: Column, width: int = 8) -> Column:
    """prefix and i, zero padded to ``width`` digits (longer numbers are kept whole)."""
    s = i.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0")))
