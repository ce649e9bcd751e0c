"""Page rewriting as columns: zones, links, headings, front matter lines, inline rendering, event frames."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def quote_zone(text: Column) -> Column:
    """Every line of a generated zone quoted once; bare source headings go."""
    lines = F.filter(F.split(F.trim(text), "\n"), lambda x: ~x.rlike(r"(?i)^#+ *sources? *$"))
    return F.array_join(F.transform(lines, lambda x: F.when(x.startswith(">"), x).otherwise(F.rtrim(F.concat(F.lit("> "), x)))), "\n")


def rewrite_link(text: Column, old: str, new: str) -> Column:
    """Wikilinks to ``old`` now go to ``new``; anchors and labels stay."""
    literal = "\\Q" + old.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    to = new.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(text, rf"\[\[{literal}(#[^\]|]*)?(\|[^\]]*)?\]\]", f"[[{to}$1$2]]")


def rewrite_h1(text: Column, title: Column) -> Column:
    """The first heading of the first level becomes ``title``."""
    head = F.regexp_extract(text, r"(?m)^# .*$", 0)
    at = F.call_function("instr", text, head)
    before = F.substring(text, F.lit(1), at - 1)
    after = F.substring(text, at + F.length(head), F.lit(1 << 30))
    return F.when(head == "", text).otherwise(F.concat(before, F.lit("# "), title, after))


def upsert_field(text: Column, key: str, value: Column) -> Column:
    """Front matter with ``key: value``, replaced where it is, else added as the last line; other texts unchanged."""
    has_head = text.rlike(r"(?s)\A---\n.*?\n---")
    line = F.concat(F.lit(f"{key}: "), value)
    head = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---", 1)
    rest = F.substring(text, F.length(head) + F.lit(5), F.lit(1 << 30))
    lines = F.split(head, "\n")
    mine = lambda x: x.rlike(rf"^{key}:")
    put = F.when(F.exists(lines, mine), F.transform(lines, lambda x: F.when(mine(x), line).otherwise(x))).otherwise(F.concat(lines, F.array(line)))
    return F.when(has_head, F.concat(F.lit("---\n"), F.array_join(put, "\n"), rest)).otherwise(text)


def promote(text: Column, marker: Column, note: Column) -> Column:
    """A note at the end of the human zone, once for each marker."""
    mark = F.concat(F.lit("<!-- note:"), marker, F.lit(" -->"))
    close = "<!-- /human-zone -->"
    added = F.concat(F.substring_index(text, close, 1), mark, F.lit("\n"), note, F.lit("\n" + close), F.substring(text, F.length(F.substring_index(text, close, 1)) + len(close) + 1, F.lit(1 << 30)))
    return F.when(F.contains(text, mark) | ~F.contains(text, F.lit(close)), text).otherwise(added)


#: Order of the inline renderer: embeds, then links, then citations, then highlights.
_RENDER = (
    (r"!\[\[([^\]|#]+)[^\]]*\]\]", '<img src="$1">'),
    (r"\[\[([^\]|]+)\|([^\]]+)\]\]", '<a href="$1">$2</a>'),
    (r"\[\[([^\]]+)\]\]", '<a href="$1">$1</a>'),
    (r"\[src:([^\]]+)\]", '<cite data-src="$1"></cite>'),
    (r"==([^=]+)==", "<mark>$1</mark>"),
)


def render_inline(text: Column) -> Column:
    out = text
    for entity, plain in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    for pattern, to in _RENDER:
        out = F.regexp_replace(out, pattern, to)
    return out


def asset_url(path: Column) -> Column:
    """Path with every segment percent-encoded."""
    form = lambda s: F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    return F.array_join(F.transform(F.split(path, "/"), form), "/")


def event_frames(text: Column) -> Column:
    """Array of (event, data) of a server-sent event stream; frames end at blank lines, data lines are joined."""
    frames = F.filter(F.split(F.regexp_replace(text, "\r\n", "\n"), "\n\n"), lambda f: f.rlike("(?m)^data:"))
    name = lambda f: F.coalesce(F.nullif(F.trim(F.regexp_extract(f, "(?m)^event:(.*)$", 1)), F.lit("")), F.lit("message"))
    data = lambda f: F.array_join(F.transform(F.regexp_extract_all(f, F.lit("(?m)^data: ?(.*)$"), F.lit(1)), lambda x: x), "\n")
    return F.transform(frames, lambda f: F.struct(name(f).alias("event"), data(f).alias("data")))


def environment(text: Column) -> Column:
    """Map of KEY=value lines; comments and ``export`` go, quotes are taken off."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*(export\s+)?[A-Za-z_]\w*="))
    key = lambda x: F.regexp_extract(x, r"^\s*(?:export\s+)?([A-Za-z_]\w*)=", 1)
    value = lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"^[^=]*=", "")), "^[\"']|[\"']$", "")
    return F.map_from_entries(F.transform(F.reverse(F.array_distinct(F.reverse(lines))), lambda x: F.struct(key(x), value(x))))


def capped(text: Column, limit: int) -> Column:
    """At most ``limit`` code points and a mark of what is missing."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("\n[…truncated at "), F.lit(str(limit)), F.lit("]"))).otherwise(text)


@pandas_udf(StringType())
def salvage_json(texts: pd.Series) -> pd.Series:
    """The first JSON object inside noisy text, in canonical form; null without one."""
    decoder = json.JSONDecoder()

    def first(text: str) -> str | None:
        at = text.find("{")
        while at >= 0:
            try:
                value, _ = decoder.raw_decode(text, at)
                return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
            except ValueError:
                at = text.find("{", at + 1)
        return None

    return texts.map(first, na_action="ignore")


@pandas_udf(StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """JSON with sorted keys and no spaces; null where it is malformed."""

    def canonical(text: str) -> str | None:
        try:
            return json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        except ValueError:
            return None

    return texts.map(canonical, na_action="ignore")


#: Fixed value: the digits of Crockford's base 32.
BASE32 = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def base32(bits: Column, digits: int) -> Column:
    """The lowest ``5 * digits`` bits of a whole number, highest digit first."""
    digit = lambda i: F.substring(F.lit(BASE32), F.shiftright(bits, 5 * i).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1))
    return F.concat(*[digit(i) for i in reversed(range(digits))])


def page_id(path: Column, created_ms: Column) -> Column:
    """26 digits that sort by time: 48 bits of milliseconds, then 80 bits of the path's SHA-256.

    No random bits, so that a task run again gives the page the same id.
    """
    h = F.sha2(F.concat_ws("\x1f", path, created_ms.cast("string")), 256)
    parts = [F.conv(F.substring(h, 5 * i + 1, 5), 16, 10).cast("long") for i in range(4)]
    return F.concat(base32(created_ms.cast("long"), 10), *[base32(p, 4) for p in parts])


def assign_page_id(page: Column, new_id: Column) -> Column:
    """Front matter without ``page_id`` gets one, below its ``type`` line or else at its end; pages without front matter stay."""
    pattern = r"\A---\n([\s\S]*?)\n---(?:\n|\z)"
    whole, head = (F.regexp_extract(page, pattern, i) for i in (0, 1))
    line = F.concat(F.lit("page_id: "), new_id)
    typed = F.regexp_replace(head, F.lit(r"\A((?:.*\n)*?type:.*)"), F.concat(F.lit("$1\n"), line))
    last = F.concat(F.rtrim(head, F.lit("\n")), F.lit("\n"), line)
    rest = F.substring(page, F.length(whole) + 1, F.length(page))
    placed = F.concat(F.lit("---\n"), F.when(head.rlike("(?m)^type:"), typed).otherwise(last), F.lit("\n---\n"), rest)
    return F.when((whole == "") | head.rlike("(?m)^page_id:"), page).otherwise(placed)
