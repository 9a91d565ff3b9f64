"""Text and structured facts out of HTML, with Spark's own functions."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from adweave.functions.text import bound, tidy

#: The names of the HTML standard, and the characters that they stand for.
ENTITIES = {name[:-1]: chars for name, chars in sorted(html5.items()) if name.endswith(";")}
#: Names that the standard knows without a semicolon too, long ones first.
BARE = sorted((name for name in html5 if not name.endswith(";")), key=lambda n: (-len(n), n))
#: What numbers of the controls 128 to 159 stand for in pages: Windows' characters where it has one.
CONTROLS = "".join(bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160))
#: Elements that the HTML standard shows as blocks, and the line break.
BLOCKS = "address|article|aside|blockquote|br|dd|details|dialog|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hgroup|hr|li|main|nav|ol|p|pre|section|table|tr|ul"


def _character(digits: Column, base: int) -> Column:
    """The character of a number as browsers read it: none for controls and other points that no text
    may have, the replacement character for zero and for what is no code point."""
    bare = F.regexp_replace(digits, "^0+", "")
    point = F.when(F.length(bare) > 7, F.lit(0x110000)).otherwise(F.coalesce(F.conv(bare, base, 10).cast("int"), F.lit(0)))
    no_text = point.between(1, 8) | (point == 11) | point.between(14, 31) | (point == 127) | point.between(0xFDD0, 0xFDEF) | (point.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    return (
        F.when((point == 0) | point.between(0xD800, 0xDFFF) | (point > 0x10FFFF), F.lit("\ufffd"))
        .when(point.between(128, 159), F.substring(F.lit(CONTROLS), point - 127, F.lit(1)))
        .when(no_text, F.lit(""))
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))
    )


def unescape(s: Column) -> Column:
    """Entities as characters, as the HTML standard has browsers read them: numbers by rule, names by
    table, some also without a semicolon; each is read once.  What isn't an entity stays as it is."""
    names = F.from_json(F.lit(json.dumps(ENTITIES)), "map<string,string>")  # one literal, folded to a map

    def decoded(part: Column) -> Column:
        cut = lambda pattern: F.regexp_extract(part, pattern, 0)
        inside = lambda pattern: F.regexp_extract(part, pattern, 1)
        decimal, hexadecimal, named, bare = "^#([0-9]+);?", "^#[xX]([0-9a-fA-F]+);?", "^([A-Za-z][A-Za-z0-9]{1,31});", f"^({'|'.join(BARE)})"
        after = lambda char, whole: F.concat(char, F.substr(part, F.length(whole) + 1))
        by_name = F.try_element_at(names, inside(named))
        return (
            F.when(part.rlike("^#[0-9]"), after(_character(inside(decimal), 10), cut(decimal)))
            .when(part.rlike("^#[xX][0-9a-fA-F]"), after(_character(inside(hexadecimal), 16), cut(hexadecimal)))
            .when(part.startswith("amp;"), F.concat(F.lit("&"), F.substring(part, 5, 1 << 30)))
            .when(part.startswith("nbsp;"), F.concat(F.lit("\u00a0"), F.substring(part, 6, 1 << 30)))
            .when(by_name.isNotNull(), after(by_name, cut(named)))
            .when(inside(bare) != "", after(F.try_element_at(names, inside(bare)), inside(bare)))
            .otherwise(F.concat(F.lit("&"), part))
        )

    def read(parts: Column) -> Column:
        return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: decoded(x)), ""))

    return bound(s, lambda x: F.when(x.contains("&"), bound(F.split(x, "&"), read)).otherwise(x))


def _strip(s: Column) -> Column:
    def without_tags(x: Column) -> Column:
        bare = F.regexp_replace(x, "(?is)<(script|style|noscript)\\b.*?</\\1\\s*>|<!--.*?-->|<![^>]*>", " ")
        bare = F.regexp_replace(bare, "(?i)<li\\b[^>]*>", "\n• ")
        bare = F.regexp_replace(bare, f"(?i)</?(?:{BLOCKS})\\b[^>]*>", "\n")
        return F.regexp_replace(bare, "<[^<>]*>", "")

    return bound(s, lambda x: F.when(x.contains("<"), without_tags(x)).otherwise(x))


def html_to_text(s: Column) -> Column:
    """Readable text: blocks on lines of their own, list items with a bullet.

    Markup that was escaped shows after the first pass and is stripped in a
    second one.  A null page gives an empty text.
    """
    first = unescape(_strip(F.coalesce(s, F.lit(""))))
    again = lambda x: F.when(x.rlike("(?i)</?(?:p|div|br|li|ul|b|strong|span)\\b"), unescape(_strip(x))).otherwise(x)
    return tidy(bound(first, again))


#: The attributes of a tag; a quoted value may hold any character.
ATTRIBUTES = """(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
UNSEEN = "(?is)<(script|style)\\b.*?</\\1\\s*>|<!--.*?-->"


def start_tag(tag: str, attribute: str = "", named: str = "") -> str:
    """A pattern for the start tags of elements ``tag`` (a pattern) with ``named`` in an attribute.

    All repetition over what may be long is possessive, which Java runs in a loop.
    """
    wanted = f"(?<![\\w-]){attribute}=(?:\"[^\"]*{named}[^\"]*\"|'[^']*{named}[^']*')"
    with_it = f"(?=(?:(?!{wanted})(?:\"[^\"]*+\"|'[^']*+'|[^>\"']))*+{wanted})" if attribute else ""
    return f"(?is)<(?:{tag})\\b{with_it}{ATTRIBUTES}>"


def _seen(html: Column) -> Column:
    """A page without comments and scripts; null is an empty page."""
    return bound(F.coalesce(html, F.lit("")), lambda x: F.when(x.rlike("(?i)<!--|<script|<style"), F.regexp_replace(x, UNSEEN, " ")).otherwise(x))


def element(html: Column, start: str | Column) -> Column:
    """The first element whose start tag matches ``start``: ``struct<tag, content>``, or null.

    ``tag`` is its start tag.  The content ends at the element's own end: start
    and end tags of its name are counted, so that elements of one name may be
    nested.  One that isn't closed reaches to the end of ``html``.  Comments and
    scripts are left out.
    """
    pattern = F.lit(start) if isinstance(start, str) else start

    def within(whole: Column) -> Column:
        return bound(F.call_function("regexp_extract", whole, pattern, F.lit(0)), lambda tag: F.when(tag != "", F.struct(tag.alias("tag"), after(whole, tag).alias("content"))))

    def after(whole: Column, tag: Column) -> Column:
        any_tag = F.concat(F.lit("(?is)</?"), F.regexp_extract(tag, "^<([A-Za-z][A-Za-z0-9-]*)", 1), F.lit("(?![A-Za-z0-9-])" + ATTRIBUTES + ">"))
        rest = F.substr(whole, F.position(tag, whole) + F.length(tag))
        return bound(F.struct(rest.alias("rest"), any_tag.alias("p")), lambda r: bound(F.struct(r["rest"].alias("rest"), F.split(r["rest"], r["p"]).alias("parts"), F.regexp_extract_all(r["rest"], r["p"], F.lit(0)).alias("tags")), up_to_end))

    def up_to_end(x: Column) -> Column:
        step = lambda t: F.when(t.startswith("</"), -1).when(t.endswith("/>"), 0).otherwise(1)
        zero = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("seen"), F.lit(-1).alias("end"))
        go = lambda a, t: F.when(a["end"] >= 0, a).otherwise(
            F.struct((a["depth"] + step(t)).alias("depth"), (a["seen"] + 1).alias("seen"), F.when(a["depth"] + step(t) == 0, a["seen"]).otherwise(-1).alias("end"))
        )
        end = F.aggregate(x["tags"], zero, go, lambda a: a["end"])
        inside = lambda n: F.concat(x["parts"][0], F.array_join(F.zip_with(F.slice(x["tags"], F.lit(1), n), F.slice(x["parts"], F.lit(2), n), lambda t, p: F.concat(t, p)), ""))
        return bound(end, lambda n: F.when(n < 0, x["rest"]).otherwise(inside(n)))

    return bound(_seen(html), within)


def elements(html: Column, start: str) -> Column:
    """The contents of all elements whose start tag matches, in order; of elements of that
    kind inside one another, the outer one ends where the inner one begins."""
    whole = _seen(html)
    pieces = F.filter(F.split(whole, f"(?={start})"), lambda b: b.rlike(f"^(?:{start})"))
    return F.transform(pieces, lambda b: element(b, start)["content"])


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute in a start tag, or null."""
    quoted = f"(?is)\\s{name}\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)')"
    value = bound(tag, lambda t: F.concat(F.regexp_extract(t, quoted, 1), F.regexp_extract(t, quoted, 2)))
    return bound(F.trim(unescape(value)), lambda v: F.nullif(v, F.lit("")))


def marked(html: Column, name: str) -> Column:
    """What a page marks with ``itemprop``: the ``content`` of its tag, else the text inside; null if neither."""
    found = element(html, start_tag("[a-z][a-z0-9-]*", "itemprop", f"(?<=[\"'\\s]){name}(?=[\"'\\s])"))
    return bound(found, lambda e: F.coalesce(attribute(e["tag"], "content"), bound(html_to_text(e["content"]), lambda t: F.nullif(t, F.lit("")))))


def job_posting(html: Column) -> Column:
    """The first JobPosting among a page's linked-data blocks, as a variant, or null.

    Blocks may be an object, a list or a graph; one that can't be read is skipped.
    """
    blocks = F.regexp_extract_all(html, F.lit("(?is)<script[^>]*application/ld\\+json[^>]*>(.*?)</script>"), F.lit(1))
    parsed = F.transform(blocks, F.try_parse_json)
    lists = F.transform(parsed, lambda v: F.coalesce(F.try_variant_get(v, "$['@graph']", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"), F.array(v)))
    kind = lambda v: F.coalesce(F.try_variant_get(v, "$['@type']", "array<string>"), F.array(F.try_variant_get(v, "$['@type']", "string")))
    found = F.filter(F.flatten(lists), lambda v: F.coalesce(F.array_contains(kind(v), "JobPosting"), F.lit(False)))
    return F.get(found, F.lit(0))


def fact(posting: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(posting, path, kind)
