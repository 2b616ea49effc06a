"""The main text of stored pages by text density. Built-in functions only.

A page is cut into blocks where block-level tags begin or end. A block's density is the logarithm of (one and)
its characters outside links for each tag in it (and one), so that one long paragraph doesn't outweigh the short ones; a block's score averages its own density, twice, with its two neighbours'. Blocks stay whose
score reaches ``share`` of the page's mean density, each block weighing as much as its text is long, and whose text lies outside
links for the larger part. So menus, link lists and short labels go, whatever they are called, and short lines within an article
stay. Null and empty pages give the empty text; a page without tags is one block; work is linear in the page.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: What holds no readable text, where blocks end, and the entities that are decoded (the last one last).
UNREAD = r"(?i)<!--.*?-->|<script\b[^>]*>.*?</script *>|<style\b[^>]*>.*?</style *>|<noscript\b[^>]*>.*?</noscript *>|<template\b[^>]*>.*?</template *>|<head\b[^>]*>.*?</head *>"
BLOCK = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|option|p|pre|section|select|table|tbody|td|tfoot|th|thead|tr|ul)\b[^>]*>"
ENTITIES = (("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
_OPEN, _CLOSE, _TAG = "\x02", "\x03", "\x04"


def marked(html: Column) -> Column:
    """The page with a line a block, links between two marks, and a mark for each other tag."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"[\x00-\x20]+", " ")
    out = F.regexp_replace(F.regexp_replace(out, UNREAD, " "), BLOCK, "\n")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)<a\b[^>]*>", _OPEN), r"(?i)</a *>", _CLOSE)
    out = F.regexp_replace(out, "<[^>]*>", _TAG)
    for name, sign in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(sign))
    return out


def blocks(html: Column) -> Column:
    """Array of (text, n_chars, n_linked, n_tags) of the blocks with text, in order."""
    plain = lambda b: F.trim(F.regexp_replace(F.regexp_replace(b, "[\x02\x03\x04]", ""), " +", " "))
    linked = lambda b: F.aggregate(F.regexp_extract_all(b, F.lit("\x02([^\x02\x03]*)"), F.lit(1)), F.lit(0), lambda n, t: n + F.length(plain(t)))
    tags = lambda b: F.length(F.regexp_replace(b, "[^\x02\x04]+", ""))
    made = F.transform(F.split(marked(html), "\n"), lambda b: let(plain(b), lambda p: F.struct(p.alias("text"), F.length(p).alias("n_chars"), linked(b).alias("n_linked"), tags(b).alias("n_tags"))))
    return F.filter(made, lambda b: b.n_chars > 0)


def main_blocks(found: Column, share: float = 0.5) -> Column:
    """Those of a page's blocks that stay."""
    def densities(all_blocks: Column) -> Column:
        return F.transform(all_blocks, lambda b: F.log(1 + F.greatest(b.n_chars - b.n_linked, F.lit(0)).cast("double") / (b.n_tags + 1)))

    def judged(x: Column) -> Column:
        total = F.aggregate(x.b, F.lit(0), lambda n, b: n + b.n_chars)
        mean = F.aggregate(F.zip_with(x.b, x.d, lambda b, d: b.n_chars * d), F.lit(0.0), lambda s, v: s + v) / total
        score = lambda d, i: (2 * d + F.coalesce(F.get(x.d, i - 1), F.lit(0.0)) + F.coalesce(F.get(x.d, i + 1), F.lit(0.0))) / 4
        kept = lambda b, i: (score(F.get(x.d, i), i) >= share * mean) & (2 * b.n_linked < b.n_chars)
        return F.filter(x.b, kept)

    return let(found, lambda b: let(F.struct(b.alias("b"), densities(b).alias("d")), judged))


def main_text(html: Column, share: float = 0.5) -> Column:
    """The texts of the blocks that stay, a line each."""
    return F.array_join(F.transform(main_blocks(blocks(html), share), lambda b: b.text), "\n")
