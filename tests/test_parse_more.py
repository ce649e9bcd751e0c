"""Parsers of pages, paths, sentences, citations."""

from __future__ import annotations

from lorekeep.functions import parse as P
from lorekeep.operators import scanners as S
from pyspark.sql import functions as F


def test_parsers(spark):
    row = spark.range(1)
    one = lambda c: row.select(c.alias("x")).first().x
    s = F.lit
    assert one(P.grammar_key(s(" ～てイル… "))) == "てイル"
    assert one(P.join_pages(F.array(s("One ends."), s(" two goes"), s(""), s("on”")))) == "One ends.\n\ntwo goes\non”"
    assert one(P.resolve_path(s("O/text/a.xhtml"), s("../img/./b.png?x"))) == "O/img/b.png"
    assert one(P.resolve_path(s("a.xhtml"), s("../b.png"))) is None and one(P.resolve_path(s("a/b"), s("http://h/x"))) is None
    assert one(P.cjk_sentences(s("一。「二！」三"))) == ["一。", "「二！」", "三"]
    assert one(P.image_sources(s('<img src="a.png"><IMG alt="x" src="a.png"><source srcset="b.png 2x"><img src="data:q">'))) == ["a.png", "b.png"]
    assert one(P.cites_now(s("x [src:a] y [src:b#sec=1, src:c]"), "c")) and not one(P.cites_now(s("x [src:a] y [src:b]"), "a"))
    assert one(P.cites_now(s("x [src:b#sec=1]"), "b", "sec=1")) and not one(P.cites_now(s("none"), "b"))
    assert one(P.callouts(s("> [!AI] t\n> one\n> two\nrest"))) == ["one\ntwo"]
    assert one(P.kanji_added(s("かんじ"), s("漢字"))) == 2
    assert one(P.privacy_findings(s("see /home/me/x"))) == ["home"] and one(P.privacy_findings(s("fine"))) == []


def test_quotes_and_readings():
    text = "one two three four five six"
    a, b = S.widen_quote(text, 4, 7)
    assert text[a:b] == "two three four five " .strip() or b - a >= 20
    assert S.widen_quote("short", 0, 2) == (0, 5)
    assert S.same_reading("ねこがいる", "猫が居る", {"猫": "ねこ", "居る": "いる"}) and not S.same_reading("ねこ", "犬", {"犬": "いぬ"})
