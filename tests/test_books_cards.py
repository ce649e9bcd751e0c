"""Titles and creators of books, aliases of card banks."""

from __future__ import annotations

import json
import zipfile

from lorekeep.sources import vault


def book(path, package: str) -> None:
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:c"><rootfile full-path="c.opf"/></container>')
        z.writestr("c.opf", package)


def test_epub_metadata(spark, tmp_path):
    dc = '<package xmlns:dc="urn:dc"><metadata>%s</metadata></package>'
    book(tmp_path / "a.epub", dc % "<dc:title> One\n two </dc:title><dc:title>Other</dc:title><dc:creator>A B</dc:creator><dc:creator> </dc:creator><dc:creator>C</dc:creator>")
    book(tmp_path / "b.epub", dc % "<dc:title>Unknown</dc:title><dc:creator>D</dc:creator>")
    book(tmp_path / "c.epub", dc % ("<dc:title>T</dc:title>" + " " * (2 << 20)))
    book(tmp_path / "d.epub", "<broken")
    (tmp_path / "e.epub").write_bytes(b"no zip")
    (tmp_path / "f.epub").write_bytes(b"")
    got = {r.file[-6:]: (r.title, r.creators) for r in vault.epub_metadata(spark, str(tmp_path)).collect()}
    assert got == {"a.epub": ("One two", "A B, C"), "b.epub": ("", "D"), "c.epub": ("", ""), "d.epub": ("", ""), "e.epub": ("", "")}


def test_grammar_aliases(spark, tmp_path):
    lemmas = ["～てから", "だけ（で）／のみ", "のみ", "…", None]
    (tmp_path / "bank.json").write_text(json.dumps({"cards": [{"lemma": x, "n": 1} for x in lemmas]}, indent=1))
    got = {r.alias: r.lemma for r in vault.grammar_aliases(spark, str(tmp_path / "bank.json")).collect()}
    both = "だけ（で）／のみ"
    assert got == {"てから": "～てから", "だけ（で）": both, "だけ": both, "のみ": both}
