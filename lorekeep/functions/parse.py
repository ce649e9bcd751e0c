"""Small parsers as columns: embeds, zones, headings, anchors, paths, magic bytes, captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def embeds(df: DataFrame, text_col: str) -> DataFrame:
    """One row for each ``![[path#part|alias]]``: path and whether it names an image."""
    inner = F.regexp_extract_all(text_col, F.lit(r"!\[\[([^\]|#]+)"), F.lit(1))
    out = df.withColumn("path", F.explode(inner))
    return out.withColumn("image", F.lower("path").rlike(r"\.(png|jpe?g|gif|webp|svg)$"))


def zone(text: Column, name: str) -> Column:
    """Inside of the first zone of that name; empty without one."""
    return F.regexp_extract(text, f"(?s)<!-- {name} -->(.*?)<!-- /{name} -->", 1)


def strip_code(text: Column) -> Column:
    """Text without fenced and inline code."""
    for pattern in ("(?s)```.*?```", "(?s)~~~.*?~~~", "`[^`]*`"):
        text = F.regexp_replace(text, pattern, "")
    return text


def demote(line: Column, levels: int) -> Column:
    """A heading pushed down by ``levels``, to the sixth at most."""
    marks = F.length(F.regexp_extract(line, "^(#+)", 1))
    moved = F.concat(F.expr("repeat('#', 6)").substr(F.lit(1), F.least(marks + levels, F.lit(6))), F.regexp_replace(line, "^#+", ""))
    return F.when(line.rlike("^#{1,6} "), moved).otherwise(line)


def taxonomy(lines: DataFrame, file: str, order: str, text: str) -> DataFrame:
    """(section, tag) of back-ticked bullets under their ``##`` headings."""
    w = Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    section = F.last(F.nullif(F.regexp_extract(text, "^## (.+)$", 1), F.lit("")), ignorenulls=True).over(w)
    return lines.withColumn("section", section).withColumn("tag", F.regexp_extract(text, "^- `([^`]+)`", 1)).filter("tag <> ''")


_CLOCK = r"((?:[0-9]+:)?[0-9]{2}:[0-9]{2})"


def time_range(anchor: Column) -> tuple[Column, Column]:
    """(first, last) seconds of ``[H:]MM:SS-[H:]MM:SS``; nulls for anything else."""

    def seconds(i: int) -> Column:
        parts = F.split(F.nullif(F.regexp_extract(anchor, f"^{_CLOCK}-{_CLOCK}$", i), F.lit("")), ":")
        return F.aggregate(F.transform(parts, lambda p: p.try_cast("int")), F.lit(0), lambda s, x: s * 60 + x)

    return seconds(1), seconds(2)


def safe_path(path: Column) -> Column:
    """Relative, without back-slashes and steps up."""
    return (path != "") & ~path.startswith("/") & ~path.contains("\\") & ~path.rlike(r"(^|/)\.\.(/|$)")


def image_type(data: Column) -> Column:
    """Extension by magic bytes (fixed values), null for none of them."""
    head = F.hex(F.substring(data, 1, 12))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "png")
        .when(head.startswith("FFD8FF"), "jpg")
        .when(head.startswith("474946383961") | head.startswith("474946383761"), "gif")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
    )


def figure_label(text: Column) -> Column:
    return text.rlike(r"(?i)^(fig(ure)?\.?|table) *[0-9]+")


def good_alt(text: Column) -> Column:
    """Alternative text that says more than a file name."""
    return (text != "") & ~text.rlike(r"(?i)^(image|img|photo|picture)?[-_ ]*[0-9]*(\.(png|jpe?g|gif))?$")


def join_wrapped(lines: Column) -> Column:
    """Lines joined; a space only between two ASCII letters or digits."""
    kept = F.filter(F.transform(lines, lambda x: F.regexp_replace(F.trim(x), r"^\x{3000}+", "")), lambda x: x != "")
    gap = lambda acc, x: F.when(acc.rlike("[A-Za-z0-9]$") & x.rlike("^[A-Za-z0-9]"), " ").otherwise("")
    return F.aggregate(kept, F.lit(""), lambda acc, x: F.concat(acc, gap(acc, x), x))


def latin_alias(aliases: Column) -> Column:
    """First alias without Han characters or kana, else a Latin part in parentheses, else null."""
    foreign = r"[\x{3040}-\x{30ff}\x{3400}-\x{9fff}]"
    plain = F.filter(aliases, lambda a: ~a.rlike(foreign) & a.rlike("[A-Za-z]"))
    inner = F.filter(F.transform(aliases, lambda a: F.regexp_extract(a, r"\(([^)]*[A-Za-z][^)]*)\)", 1)), lambda a: (a != "") & ~a.rlike(foreign))
    return F.coalesce(F.get(plain, F.lit(0)), F.get(inner, F.lit(0)))


def grammar_key(pattern: Column) -> Column:
    """Grammar pattern without wave dashes and ellipses, lower case."""
    return F.lower(F.regexp_replace(F.trim(pattern), "[～〜…]", ""))


def join_pages(pages: Column) -> Column:
    """Page texts joined: a new paragraph after a sentence's end, else only a new line."""
    ended = r"[.!?。！？][\"'”’」』）)]*\s*$"
    step = lambda acc, x: F.when(acc == "", x).when(acc.rlike(ended), F.concat(acc, F.lit("\n\n"), x)).otherwise(F.concat(acc, F.lit("\n"), x))
    return F.aggregate(F.filter(F.transform(pages, lambda x: F.trim(x)), lambda x: x != ""), F.lit(""), step)


def resolve_path(base: Column, ref: Column) -> Column:
    """``ref`` relative to the folder of ``base``; null where it leaves the root, is absolute, a URL or data."""
    whole = F.concat(F.regexp_replace(base, "[^/]*$", ""), F.regexp_replace(ref, "[?#].*$", ""))
    parts = F.filter(F.split(whole, "/"), lambda p: (p != "") & (p != "."))
    up = lambda acc, p: F.when(acc.isNull(), acc).when(p != "..", F.concat(acc, F.array(p))).when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1))
    walked = F.aggregate(parts, F.array().cast("array<string>"), up)
    return F.when(ref.rlike(r"^(/|[A-Za-z][A-Za-z0-9+.-]*:)"), None).otherwise(F.array_join(walked, "/"))


def cjk_sentences(text: Column) -> Column:
    """Sentences after ``。！？`` with the closing quotes that follow; the rest is a sentence of its own."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit("[^。！？]++(?:[。！？]++[」』）”]*+|\\z)"), F.lit(0)), lambda x: F.trim(x)), lambda x: x != "")


def image_sources(html: Column) -> Column:
    """Distinct sources of img, image and source elements, in order; data URLs are left out."""
    found = F.regexp_extract_all(html, F.lit(r"(?i)<(?:img|image|source)\b[^>]*?\b(?:src|href|srcset)=\"([^\" ,>]+)"), F.lit(1))
    return F.filter(F.array_distinct(found), lambda x: ~x.startswith("data:"))


def cites_now(paragraph: Column, source_id: str, anchor: str = "") -> Column:
    """Whether the last citation group of a paragraph names exactly this source and anchor."""
    groups = F.regexp_extract_all(paragraph, F.lit(r"\[src:([^\]]*)\]"), F.lit(1))
    parts = F.transform(F.split(F.element_at(groups, -1), ","), lambda p: F.regexp_replace(F.trim(p), r"(?i)^src:\s*", ""))
    return F.when(F.size(groups) == 0, False).otherwise(F.array_contains(parts, f"{source_id}#{anchor}" if anchor else source_id))


def callouts(text: Column, mark: str = "AI") -> Column:
    """Bodies of quoted callouts ``> [!mark]``, quote marks taken off."""
    found = F.regexp_extract_all(text, F.lit(rf"(?m)^> \[!{mark}\][^\n]*((?:\n>[^\n]*)*)"), F.lit(1))
    return F.transform(found, lambda x: F.trim(F.regexp_replace(x, r"(?m)^>[ \t]?", ""), F.lit(" \n")))


def kanji_added(before: Column, after: Column) -> Column:
    """How many more Han characters the second text has."""
    count = lambda c: F.length(F.regexp_replace(c, r"[^\x{3400}-\x{9fff}]", ""))
    return F.greatest(count(after) - count(before), F.lit(0))


def privacy_findings(text: Column) -> Column:
    """Kinds of private material in a file: home folders, key blocks, bearer tokens."""
    rules = {"home": r"(/home/|/Users/|C:\\Users\\)[A-Za-z0-9._-]+", "key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "token": r"(?i)\b(bearer|token|secret)[ =:]+[A-Za-z0-9_\-]{20,}"}
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in rules.items()]))
