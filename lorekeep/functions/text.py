"""Scalar text functions as Spark columns.

White space is spelled out where engines differ: ``WS`` is ASCII white space,
``WIDE_WS`` adds the Unicode separators and the byte order mark.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed character classes.
WS = r"[ \t\n\r\f\x0B]"
WIDE_WS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}\x1C-\x1F]"


def squeeze(c: Column, ws: str = WS) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, ws + "+", " "))


def without_space(c: Column) -> Column:
    """Text form that hashes are taken of: no white space, no byte order mark."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), WIDE_WS + "+", "")


def hash8(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 8)


def block_id(kind: Column, text: Column) -> Column:
    """Content identity of a reader block: ``h-`` or ``p-`` and 8 hex digits over kind and squeezed text."""
    prefix = F.when(kind == "heading", F.lit("h-")).otherwise(F.lit("p-"))
    return F.concat(prefix, hash8(F.concat(kind, F.lit("\x1f"), without_space(text))))


def section_id(label: Column) -> Column:
    return F.concat(F.lit("s-"), hash8(F.concat(F.lit("SEC\x1f"), without_space(label))))


def encode_anchor(label: Column) -> Column:
    """``sec=`` and the label percent-encoded with no safe punctuation but ``-._~``."""
    form = F.url_encode(label)
    for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        form = F.replace(form, F.lit(old), F.lit(new))
    return F.concat(F.lit("sec="), form)


def decode_anchor(anchor: Column) -> Column:
    """Label of a ``sec=`` anchor (raw where its bytes are no UTF-8); other anchors as they are."""
    value = F.regexp_replace(F.trim(F.coalesce(anchor, F.lit(""))), "^#", "")
    coded = F.substring(value, 5, 1 << 30)
    plain = F.try_url_decode(F.replace(coded, F.lit("+"), F.lit("%2B")))
    return F.when(value.startswith("sec="), F.coalesce(plain, coded)).otherwise(value)


def url_slug(url: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(url, "^https?://", ""), "[^A-Za-z0-9._-]+", "-"), 1, 80)


def safe_name(name: Column) -> Column:
    """File name: separators to one dash, none in front or before a dot."""
    out = name
    for pattern, to in ((r"[ \t\n\r\f\x0B,()]+", "-"), ("-+", "-"), ("^-", ""), (r"-\.", ".")):
        out = F.regexp_replace(out, pattern, to)
    return out


def tag_slug(tag: Column) -> Column:
    return F.replace(tag, F.lit("/"), F.lit("__"))


def chapter_key(title: Column) -> Column:
    """Label without ``|`` and ``:``, ``whole`` where nothing is left."""
    return F.coalesce(F.nullif(squeeze(F.regexp_replace(title, "[|:]", " ")), F.lit("")), F.lit("whole"))


def chapter_part(label: Column) -> Column:
    """URL part of at most 64 characters; Han and kana stay."""
    kept = F.regexp_replace(F.lower(F.trim(F.coalesce(label, F.lit("")))), r"[^a-z0-9\x{4e00}-\x{9fff}\x{3040}-\x{30ff}_-]+", "-")
    return F.substring(F.regexp_replace(kept, "^-+|-+$", ""), 1, 64)


def canonical_url(url: Column) -> Column:
    """Feed identity: scheme and host lower-case, no user, ``www.``, default port, fragment or closing slash; query as it is."""
    m = lambda i: F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]+))?([^?#]*)(\?[^#]*)?", i)
    scheme, host = F.lower(m(1)), F.regexp_replace(F.lower(m(2)), r"^www\.", "")
    default = ((scheme == "http") & (m(3) == "80")) | ((scheme == "https") & (m(3) == "443"))
    port = F.when((m(3) == "") | default, F.lit("")).otherwise(F.concat(F.lit(":"), m(3)))
    path = F.coalesce(F.nullif(F.regexp_replace(m(4), "/+$", ""), F.lit("")), F.lit("/"))
    query = F.when(m(5) == "?", F.lit("")).otherwise(m(5))
    return F.when(m(1) == "", url).otherwise(F.concat(scheme, F.lit("://"), host, port, path, query))


def video_id(url: Column) -> Column:
    """Eleven-character video id of short and long links, null without one."""
    forms = (r"youtu\.be/([A-Za-z0-9_-]{11})", r"youtube\.com/(?:watch\?(?:.*&)?v=|shorts/|embed/|v/)([A-Za-z0-9_-]{11})")
    return F.coalesce(*[F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in forms])


def clean_title(name: Column) -> Column:
    """File name to title: no leading date, no extension, dashes to spaces."""
    out = F.regexp_replace(name, r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[-_ ]+", "")
    out = F.regexp_replace(out, r"\.(md|pdf|epub|html|txt)$", "")
    return squeeze(F.regexp_replace(out, "[-_]+", " "))


def excerpt(c: Column, limit: int = 150) -> Column:
    """One line without callouts, citations and link syntax, cut at ``limit`` code points."""
    out = F.regexp_replace(c, r"^\s*\[!\w+\]\s*", "")
    out = F.regexp_replace(out, r"\[src:[^\]]*\]", "")
    out = F.regexp_replace(out, r"!?\[\[[^\]|]+\|([^\]]+)\]\]", "$1")
    out = F.regexp_replace(out, r"!?\[\[([^\]|]+)\]\]", "$1")
    out = squeeze(F.regexp_replace(out, "==+", ""))
    return F.when(F.length(out) > limit, F.concat(F.trim(F.substring(out, 1, limit)), F.lit("…"))).otherwise(out)


#: Steps of the inline cleaner: (pattern, replacement), in order.
_INLINE = (
    (r"!\[([^\]]*)\]\([^)]+\)", "$1"),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"\[\[[^\]|]+\|([^\]]+)\]\]", "$1"),
    (r"\[\[([^\]]+)\]\]", "$1"),
    (r"`([^`]*)`", "$1"),
    (r"[*_~]{1,3}", ""),
)


def clean_markdown(c: Column) -> Column:
    """Inline markdown to plain text: quote and list marks, table bars, images, links, code and emphasis."""
    out = F.coalesce(c, F.lit(""))
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(plain))
    out = F.regexp_replace(out, r"^[ \t]{0,3}>[ \t]?", "")
    out = F.regexp_replace(out, r"^[ \t]{0,3}(?:[-+*]|[0-9]+[.)])[ \t]+", "")
    bars = F.replace(F.regexp_replace(F.trim(out), r"^\|+|\|+$", ""), F.lit("|"), F.lit(" · "))
    out = F.when(out.rlike(r"^[ \t]*\|") | out.rlike(r"[ \t]\|[ \t]"), bars).otherwise(out)
    for pattern, to in _INLINE:
        out = F.regexp_replace(out, pattern, to)
    return squeeze(out)


def fold_controls(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\x00-\x1f]", " "))


def hiragana(c: Column) -> Column:
    """Katakana to hiragana: the two blocks run in parallel, U+30A1.. over U+3041.."""
    kata = "".join(chr(i) for i in range(0x30A1, 0x30F7))
    return F.translate(c, kata, "".join(chr(ord(k) - 0x60) for k in kata))


def clock(seconds: Column) -> Column:
    """``MM:SS``, with hours where there are any; fractions are dropped."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    short = F.format_string("%02d:%02d", m, r)
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), short)).otherwise(short)


def plain_html(c: Column) -> Column:
    """Visible text: scripts, styles, navigation, header, footer and comments go, then tags; five entities are decoded."""
    out = c
    for tag in ("script", "style", "noscript", "nav", "footer"):
        out = F.regexp_replace(out, f"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    out = F.regexp_replace(out, "(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, "<[^>]*>", " ")
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return squeeze(out)


#: Fixed word lists: phrases by which a page speaks of its source instead of its subject.
FORBIDDEN_ENGLISH = ("the chapter", "the section", "the source", "the text", "the book", "the author", "according to", "it is argued that")
FORBIDDEN_CHINESE = (
    "按照本章", "作者认为", "作者指出", "书中认为", "书中指出", "书中提出", "这一章", "本章", "本节", "本书", "该章", "该节", "文中", "书中", "文献",
)
CHINESE_CHAPTER = r"第\s*(?:[0-9]+|[一二三四五六七八九十百千零〇两]+|N)\s*章"


def forbidden(text: Column) -> Column:
    """Array of the forbidden phrases in prose; code and citations do not count."""
    prose = F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?```|~~~.*?~~~", ""), r"\[src:[^\]]*\]", "")
    words = [F.when(prose.rlike(r"(?i)\b" + p.replace(" ", r"\s+") + r"\b"), F.lit(p)) for p in FORBIDDEN_ENGLISH]
    signs = [F.when(F.contains(prose, F.lit(p)), F.lit(p)) for p in FORBIDDEN_CHINESE]
    return F.array_compact(F.array(*words, *signs, F.when(prose.rlike(CHINESE_CHAPTER), F.lit("第N章"))))
