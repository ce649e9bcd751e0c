"""Contract vectors and properties of the column functions."""

from __future__ import annotations

import pytest
from lorekeep.functions import parse as P
from lorekeep.functions import text as X
from lorekeep.functions.unicode import normalize_name, study_key_text, wikilink_key
from lorekeep.operators import segment
from pyspark.sql import functions as F


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "s string").select(f(F.col("s")).alias("x")).first().x


@pytest.mark.parametrize(
    "kind,text,want",
    [
        ("paragraph", "ATP stores energy.", "p-5f5e6d26"),
        ("paragraph", "ATP stores\nenergy.", "p-5f5e6d26"),
        ("paragraph", "﻿ATP stores energy.", "p-5f5e6d26"),
        ("heading", "第1章  導入", "h-726a6de9"),
        ("paragraph", "酵素　は 働く。", "p-f8ea23fa"),
    ],
)
def test_block_ids(spark, kind, text, want):
    assert one(spark, text, lambda s: X.block_id(F.lit(kind), s)) == want


@pytest.mark.parametrize(
    "label,anchor",
    [
        ("Chapter 1", "sec=Chapter%201"),
        ("A, B] #100% · 第一章", "sec=A%2C%20B%5D%20%23100%25%20%C2%B7%20%E7%AC%AC%E4%B8%80%E7%AB%A0"),
        ("reserved !'()* /?&=", "sec=reserved%20%21%27%28%29%2A%20%2F%3F%26%3D"),
        ("sec=Introduction", "sec=sec%3DIntroduction"),
        ("a~b-c_d.e+f", "sec=a~b-c_d.e%2Bf"),
    ],
)
def test_section_anchors(spark, label, anchor):
    assert one(spark, label, X.encode_anchor) == anchor
    assert one(spark, anchor, X.decode_anchor) == label
    assert one(spark, "#" + anchor, X.decode_anchor) == label


def test_anchor_that_is_no_utf8_stays_raw(spark):
    assert one(spark, "sec=%zz", X.decode_anchor) == "%zz"
    assert one(spark, "00:10-00:18", X.decode_anchor) == "00:10-00:18"
    assert one(spark, None, X.decode_anchor) == ""


def test_alias_equivalence(spark):
    rows = spark.createDataFrame([(x,) for x in ("ATP", "ＡＴＰ", " atp ", "Maße", "MASSE", "οσ", "ος", None)], "s string")
    keys = [r.k for r in rows.select(wikilink_key("s").alias("k")).collect()]
    assert keys[0] == keys[1] == keys[2] == "atp" and keys[3] == keys[4] and keys[5] == keys[6] and keys[7] is None
    names = [r.k for r in rows.select(normalize_name("s").alias("k")).collect()]
    assert names[0] == names[1] == names[2] and names[3] == names[4] and names[7] is None
    assert one(spark, " ÉA ", study_key_text) == "éa"


@pytest.mark.parametrize(
    "url,want",
    [
        ("HTTP://User:pw@WWW.Example.com:80/Feed/?a=%2F#x", "http://example.com/Feed?a=%2F"),
        ("https://example.com:443", "https://example.com/"),
        ("https://example.com:8443/a//", "https://example.com:8443/a"),
        ("no url", "no url"),
    ],
)
def test_canonical_url(spark, url, want):
    assert one(spark, url, X.canonical_url) == want


def test_text_cleaners(spark):
    assert one(spark, "> - **bold** [a](b) [[x|y]] [[z]] `c` &amp; ~~d~~", X.clean_markdown) == "bold a y z c & d"
    assert one(spark, "| a | b |", X.clean_markdown) == "a · b"
    assert one(spark, "[!note] see [src:x#sec=a] [[p|q]] ==mark==", X.excerpt) == "see q mark"
    assert one(spark, "x" * 200, X.excerpt) == "x" * 150 + "…"
    assert one(spark, " | : ", X.chapter_key) == "whole"
    assert one(spark, "  第1章: Über Zellen!  ", X.chapter_part) == "第1章-ber-zellen"
    assert one(spark, "a, (b) -.txt", X.safe_name) == "a-b.txt"
    assert one(spark, "カタカナ", X.hiragana) == "かたかな"
    assert one(spark, "<p>a</p><script>x</script><!-- b -->&lt;c&gt;", X.plain_html) == "a <c>"
    assert one(spark, "3725.9", lambda s: X.clock(s.cast("double"))) == "1:02:05"


def test_parsers(spark):
    assert one(spark, "x", lambda s: P.join_wrapped(F.array(F.lit("one"), F.lit("two"), F.lit("　三"), F.lit("")))) == "one two三"
    df = spark.createDataFrame([(1, "a [src:s1#sec=A%2C%20B, src:s2] b [src: ] [src:s3]")], "id int, body string")
    got = [(r.ord, r.source_id, r.anchor) for r in segment.citations(df, "body").orderBy("ord").collect()]
    assert [g[1:] for g in got] == [("s1", "A, B"), ("s2", ""), ("s3", "")]


def test_quote_places(spark):
    df = spark.createDataFrame([("abc abc abc", "abc", "abc "), ("aaaa", "aa", "z"), ("x.y.x", "x", ""), ("a\\Eb", "\\E", "a")], "t string, q string, p string")
    got = [[(h.at, h.score) for h in r.x] for r in df.select(segment.quote_places("t", "q", "p").alias("x")).collect()]
    assert got[0] == [(0, 0), (4, 2), (8, 2)]
    assert [a for a, _ in got[1]] == [0, 1, 2]
    assert [a for a, _ in got[2]] == [0, 4]
    assert got[3] == [(1, 2)]


def test_forbidden(spark):
    assert one(spark, "According  to The Book, `x`", X.forbidden) == ["the book", "according to"]
    assert one(spark, "本书第三章 ```the text``` [src:the author]", X.forbidden) == ["本书", "第N章"]
    assert one(spark, "plain", X.forbidden) == []
