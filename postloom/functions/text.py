"""Text expressions. Everything here is a Column built from JVM functions.

White space is Unicode's, and U+001C..U+001F as well, which count as white space in
the texts' own rules. The classes name the characters, which a scan tests much faster
than the property.
"""
from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterable, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_BREAKS = r"\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029"
_BLANKS = r"\t\x1f\xa0\u1680\u2000-\u200a\u202f\u205f\u3000"     # without U+0020
SPACE = rf"[ {_BREAKS}{_BLANKS}]"
SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"
RARE_SPACE = r"[\x00-\x09\x0b-\x1f\x7f-\xa0\u1680\u2000-\u206f\u3000]"     # what holds none of these has no white space but " " and "\n"
# white space that holds a line break, or stands after one of ".;:", from its first character on; looking back
# only where there is white space
_GAP = "{space}(?<=[.;:]{space}){space}*+|{breaks}{space}*+|{blanks}(?<!{space}{space}){blanks}*+{breaks}{space}*+"
SEGMENT_GAP = _GAP.format(space=SPACE, breaks=f"[{_BREAKS}]", blanks=f"[ {_BLANKS}]")
PLAIN_SEGMENT_GAP = _GAP.format(space=r"[ \n]", breaks=r"\n", blanks=" ")
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
WORD_TOKEN = r"[a-zA-Z][a-zA-Z0-9+#.\-]{1,}"
PLAIN_TOKEN = r"[\p{L}\p{N}_]{2,}"


_built: dict[tuple, Column] = {}


def built_once(make: Callable[..., Column], *args: str | tuple) -> Column:
    """A column expression kept for reuse: building a long one takes many calls into the JVM."""
    key = (id(SparkContext._gateway), make.__qualname__, *args)
    if key not in _built:
        _built[key] = make(*args)
    return _built[key]


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, which may use it often.

    Referring to a projected column from inside a lambda lets the optimiser inline
    the projection there, where it would run once per array element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def sql_literal(value: object) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


def literal_strings(values: Iterable[str]) -> Column:
    """A constant array, built in one call however long it is."""
    listed = list(values)
    return F.expr(f"array({', '.join(map(sql_literal, listed))})" if listed else "cast(array() as array<string>)")


def literal_map(entries: Mapping[str, object]) -> Column:
    """A constant map, built in one call."""
    return F.expr(f"map({', '.join(sql_literal(x) for pair in entries.items() for x in pair)})")


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only U+0020."""
    return F.btrim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    """White-space runs become one space; none at the ends. A lone space is no match, so most texts have few."""
    return F.trim(F.regexp_replace(c, rf"[{_BREAKS}{_BLANKS}]{SPACE}*+| {SPACE}++", " "))


def normalize_text(c: Column) -> Column:
    """K1: lower case, single spaces, trimmed."""
    return collapse(F.lower(c))


def text(c: Column) -> Column:
    """Missing strings count as empty."""
    return F.coalesce(c, F.lit(""))


def lines(c: Column) -> Column:
    return F.split(c, LINE_BREAK, -1)


def segment_pieces(c: Column) -> Column:
    """Lines cut after ``.;:`` and white space, trimmed. Short classes are several times as fast, and do for most texts."""
    bare = strip(c)
    return F.when(bare.rlike(RARE_SPACE), F.split(bare, SEGMENT_GAP, -1)).otherwise(F.split(bare, PLAIN_SEGMENT_GAP, -1))


def sentences(c: Column) -> Column:
    """K3: sentence-like pieces in order, trimmed, without empty ones."""
    parts = F.split(c, rf"(?<=[.!?;\n]){SPACE}+|\n+", -1)
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def word_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD_TOKEN), 0)


def plain_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(PLAIN_TOKEN), 0)


def without(tokens: Column, words: Iterable[str]) -> Column:
    """Drop the given words; a long literal list becomes a hash lookup."""
    listed = list(words)
    return F.filter(tokens, lambda t: ~t.isin(listed)) if listed else tokens


def run_lengths(values: Column) -> Column:
    """Array of scalars -> array<struct<value, n>>, without leaving the row.

    Sorting brings equal values together; each run's length is the distance to the
    next run's start. A whole text is counted in O(n log n) with no shuffle.
    """
    def counted(s: Column) -> Column:
        starts = F.filter(
            F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1) != x), i)),
            lambda i: i.isNotNull(),
        )
        return bind(starts, lambda at: F.transform(
            at,
            lambda i, k: F.struct(
                F.get(s, i).alias("value"),
                (F.coalesce(F.get(at, k + 1), F.size(s)) - i).cast("long").alias("n"),
            ),
        ))

    return bind(F.sort_array(values), counted)


def counted_tokens(tokens: Column, stop_words: Iterable[str]) -> Column:
    """``run_lengths`` of a long array of tokens without the given words, counted for many rows at a time in Arrow batches."""
    dropped = list(stop_words)

    # defined inside, so that it travels by value and workers need not import us
    def counted(lists: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        names = coded.dictionary.take(order)
        rank = np.empty(len(names), np.int64)
        rank[order.to_numpy()] = np.arange(len(names))
        keep = ~pc.is_in(names, value_set=pa.array(dropped, pa.string())).to_numpy(zero_copy_only=False)
        code = rank[coded.indices.to_numpy()]
        row = np.repeat(np.arange(len(sizes)), sizes)[keep[code]]
        found, n = np.unique(row * max(1, len(names)) + code[keep[code]], return_counts=True)
        row, code = found // max(1, len(names)), found % max(1, len(names))
        runs = pa.StructArray.from_arrays([names.take(pa.array(code)), pa.array(n.astype(np.int64))], ["value", "n"])
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(sizes)))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), runs, mask=lists.is_null())

    return F.arrow_udf(counted, "array<struct<value:string,n:bigint>>")(tokens)


def count_substring(haystack: Column, needle: Column) -> Column:
    """Non-overlapping occurrences, scanned from the left."""
    gone = F.length(haystack) - F.length(F.replace(haystack, needle, F.lit("")))
    return F.when(F.length(needle) > 0, F.floor(gone / F.length(needle))).otherwise(0).cast("long")


def has_any_term(c: Column, terms: Iterable[str]) -> Column:
    """N6 over a list: phrases match as substrings, single words on boundaries.

    All single words share one pattern, so a gate costs one scan of the text.
    """
    cleaned = [t.lower().strip() for t in terms]
    phrases = [t for t in cleaned if t and " " in t]
    words = [t for t in cleaned if t and " " not in t]
    hit = F.lit(False)
    if words:
        either = "|".join(re.escape(w) for w in words)
        hit = hit | c.rlike(f"(?<![a-z0-9])(?:{either})(?![a-z0-9])")
    for phrase in phrases:
        hit = hit | c.contains(phrase)
    return hit


def term_in(c: Column, term: Column) -> Column:
    """N6 with the term as a column."""
    t = strip(F.lower(term))
    bounded = F.concat(F.lit(r"(?<![a-z0-9])\Q"), t, F.lit(r"\E(?![a-z0-9])"))
    return F.when(t == "", False).when(t.contains(" "), F.contains(c, t)).otherwise(F.rlike(c, bounded))


# --- markup -----------------------------------------------------------------

def drop_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", " ")


def strip_markup_plain(c: Column) -> Column:
    """Tags become spaces; entities stay as they are."""
    return collapse(drop_tags(text(c)))


def strip_markup_board(c: Column) -> Column:
    """Tags first, then five entities in this order: escaped tags survive as text."""
    out = drop_tags(text(c))
    for entity, char in (("&amp;", "&"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return collapse(out)


def _unescape(c: Column) -> Column:
    # defined inside, so that it travels by value and workers need not import us
    def unescaped(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else html.unescape(v))

    return F.pandas_udf(unescaped, StringType())(c)


def strip_markup_page(c: Column) -> Column:
    """Scripts and styles go with their content, then tags, then every HTML entity.

    Only texts with an ampersand visit Python; the others are handed over as null.
    """
    bare = F.regexp_replace(text(c), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    bare = drop_tags(bare)
    decoded = _unescape(F.when(bare.contains("&"), bare))
    return collapse(F.coalesce(decoded, bare))
