"""Column functions for message text. All but the unescaped ones are built-in expressions, so they stay in generated code."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space of any script but the line and page separators, those separators, and both.
GAPS = " \t\x1f\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
WS = GAPS + BREAKS


def strip_ws(x: Column) -> Column:
    """Trims white space of any kind and script at both ends, not spaces alone."""
    return F.btrim(x, F.lit(WS))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def or_empty(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def first_truthy(*values: Column) -> Column:
    """The first value that is neither null nor empty; empty if there is none."""
    return F.coalesce(*[F.when(v != "", v) for v in values], F.lit(""))


def contains_any(x: Column, words) -> Column:
    """Whether any of the words stands in x; one alternation, so the text is read once."""
    return x.rlike("|".join(f"\\Q{w}\\E" for w in words))


@F.pandas_udf(StringType())
def unescaped(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Character references decoded, named and numeric ones; without an ampersand a text stays as it is."""
    for batch in texts:
        yield batch.map(lambda x: html.unescape(x) if isinstance(x, str) and "&" in x else x)


_TERMINATED = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z0-9]+;)")


@F.pandas_udf(StringType())
def unescaped_terminated(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Character references that end in ';' decoded; a name without it, or one that isn't known, stays as it is."""
    one = lambda m: html.unescape(m[0]) if m[1][0] == "#" else html5.get(m[1], m[0])
    for batch in texts:
        yield batch.map(lambda x: _TERMINATED.sub(one, x) if isinstance(x, str) and "&" in x else x)


#: One piece of HTML: text, a comment, a script or style with its body, a tag whose quoted values may hold '>', a
#: declaration, markup that is cut off, or a '<' that opens nothing. Quantifiers are possessive, so no piece is tried twice.
_ATTRIBUTES = r"""(?:[\s/]++|(?<=['"\s/])[^\s/>][^\s/=>]*+(?:\s*+=++\s*+(?:'[^']*+'|"[^"]*+"|(?!['"])[^>\s]*+))?+)*+"""
_BODY = rf"(?<!/)>(?:.*?</\s*+{{0}}\s*+>|.*+)"
HTML_PIECE = (
    r"(?is)[^<]++|<!--.*?--\s*+>"
    + "".join(rf"|<{n}(?=[\s/>]){_ATTRIBUTES}{_BODY.format(n)}" for n in ("script", "style"))
    + rf"|<[a-z][^\s/>]*+{_ATTRIBUTES}>|</[^>]*+>|<!\[(?:cdata|temp|ignore|include|rcdata)\[.*?\]\s*+\]\s*+>|<!\[(?:if|else|endif).*?\]\s*+>|<!(?!--)[^>]*+>|<\?[^>]*+>|<[a-z/!?].*+|<"
)
#: Tags that end a line: an end tag, or an empty one, whose slash isn't part of a value.
LINE_END = r"(?is)^</\s*(?:p|br|div|tr)\s*>$|^</(?:p|br|div|tr)[\s/].*$|^<(?:p|br|div|tr)(?:[\s/].*)?/>$"
_BARE_SLASH = r"(?s)=\s*[^\s'\"][^\s>]*/>$"
#: Stands between pieces while references are decoded, so that none is read across a tag; no text holds this code point.
_SEAM = "\uffff"


def html_to_text(html: Column, terminated: bool = False) -> Column:
    """Text of HTML mail: scripts and styles dropped, a new line at the end tags of p, br, div and tr.

    A '<' opens markup only before a letter, '/', '!' or '?', and quoted values may hold '>'. Markup that is cut
    off takes the rest of the text with it, and so does a script that isn't closed. Text after the last tag is
    left out if a reference at its end may be cut off, that is, an '&' among its last 34 characters after which
    there is neither white space nor ';'. At most one blank line stays. References are decoded last: also
    those that lack their ';', as browsers do, unless only terminated ones are asked for.
    """
    cut_off = lambda x: (x == "<") | (~x.startswith("<") & F.right(x, F.lit(34)).rlike(r"(?U)&[^\s;&]*+\z"))
    kept = lambda xs: F.when((F.size(xs) > 0) & cut_off(F.get(xs, F.size(xs) - 1)), F.slice(xs, F.lit(1), F.size(xs) - 1)).otherwise(xs)
    shown = lambda x: F.when(~x.startswith("<") | (x == "<"), x).when(x.rlike(LINE_END) & ~x.rlike(_BARE_SLASH), "\n").otherwise("")
    x = F.array_join(F.transform(let(F.regexp_extract_all(html, F.lit(HTML_PIECE), F.lit(0)), kept), shown), _SEAM)
    return strip_ws(F.regexp_replace(F.replace((unescaped_terminated if terminated else unescaped)(x), F.lit(_SEAM), F.lit("")), r"\n{3,}", "\n\n"))


def strip_quoted_reply(body: Column) -> Column:
    """Drops quoted lines and original-message separators, and everything from an underscore separator on.

    What stands after an original-message separator stays; the separator reaches from its dashes to the end of the
    line that holds its words.
    """
    x = F.regexp_replace(body, r"\n>[^\n]*", "")
    x = F.when(x.contains("原始邮件"), F.regexp_replace(x, r"(?s)\n-{3,}.*?原始邮件.*?\n", "\n")).otherwise(x)
    return strip_ws(F.regexp_replace(x, r"(?s)\n_{3,}\n.*$", ""))


def header(mail: Column, name: str) -> Column:
    """The first header of that name at the start of a line; empty if there is none."""
    return strip_ws(or_empty(F.regexp_extract(mail, rf"(?m)^{name}:[ \t]*(\S[^\n]*)$", 1)))


def mail_body(mail: Column) -> Column:
    return strip_ws(F.regexp_replace(mail, r"(?m)^(From|To|Subject|Date|CC|BCC):[^\n]*\n?", ""))


def minute_from_seconds(ts: Column) -> Column:
    """'yyyy-MM-dd HH:mm' of epoch seconds in text; a value that isn't a number stays as it is."""
    return F.coalesce(F.date_format(F.timestamp_seconds(ts.try_cast("double")), "yyyy-MM-dd HH:mm"), ts)


def minute_from_millis(ms: Column) -> Column:
    return F.coalesce(F.date_format(F.timestamp_millis(ms.try_cast("bigint")), "yyyy-MM-dd HH:mm"), ms.cast("string"))


def hms(seconds: Column) -> Column:
    """HH:MM:SS of a number of seconds, cut to whole ones."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)


def slugify(name: Column, default: str = "colleague", mapping: dict[str, str] | None = None) -> Column:
    """ASCII letters, digits, '-' and '_' in lower case, a space as '_'; runs of '_' squeezed.

    What a mapping has is put in its place first, as a word of its own.
    """
    name = transliterated(name, {k: f"_{v}_" for k, v in mapping.items()}) if mapping else name
    kept = F.regexp_replace(F.replace(F.lower(name), F.lit(" "), F.lit("_")), r"[^a-z0-9_-]", "")
    slug = F.regexp_replace(F.regexp_replace(kept, "_+", "_"), "^_+|_+$", "")
    return F.when(or_empty(slug) == "", F.lit(default)).otherwise(slug)


def transliterated(name: Column, mapping: dict[str, str]) -> Column:
    """name with each longest run of characters that the mapping has in its place, characters it hasn't as they are.

    From left to right; where several keys begin at a character the longest is taken. The mapping is a bounded
    dictionary: its keys become one alternation, its entries a map, both of which are part of the plan.
    """
    if not mapping:
        return name
    keys = sorted((k for k in mapping if k), key=lambda k: (-len(k), k))
    quoted = "|".join("\\Q" + k.replace("\\E", "\\E\\\\E\\Q") + "\\E" for k in keys)
    table = F.create_map(*[F.lit(x) for k in keys for x in (k, mapping[k])])
    pieces = F.regexp_extract_all(name, F.lit(f"(?s){quoted}|."), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(F.element_at(table, p), p)), "")


def bounded_mapping(rows: DataFrame, source: str = "source", target: str = "target", most: int = 20_000) -> dict[str, str]:
    """A mapping table as a dictionary; more than ``most`` entries are an error, as they'd be part of every plan.

    Rows without a source or target are left out; of equal sources the smallest target counts.
    """
    sound = rows.where(F.col(source).isNotNull() & F.col(target).isNotNull() & (F.col(source) != ""))
    found = sound.groupBy(F.col(source).alias("s")).agg(F.min(target).alias("t")).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"the mapping has more than {most} entries")
    return {r.s: r.t for r in found}


def rename_frontmatter(markdown: Column, name: Column) -> Column:
    """Sets ``name:`` in a leading front matter block, or inserts it as the first line; else unchanged."""
    block = r"(?s)^---\n(.*?)\n---\n"
    inner = F.regexp_extract(markdown, block, 1)
    body = F.regexp_replace(F.regexp_replace(markdown, block, ""), r"^\n+", "")
    line = F.concat(F.lit("name: "), name)
    lines = F.split(inner, "\n")
    named = F.exists(lines, lambda x: x.startswith("name:"))
    kept = F.transform(lines, lambda x: F.when(x.startswith("name:"), line).otherwise(x))
    new = F.when(named, F.array_join(kept, "\n")).otherwise(F.concat(line, F.lit("\n"), inner))
    return F.when(markdown.rlike(block), F.concat(F.lit("---\n"), new, F.lit("\n---\n\n"), body)).otherwise(markdown)


def markdown_cell(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("|"), F.lit("｜")), F.lit("\n"), F.lit(" "))


def lines_of(text: Column) -> Column:
    """Lines of a text; a closing line break makes no further line."""
    return F.split(F.regexp_replace(text, r"\n$", ""), "\n")
