"""Operators over stated vectors: small literal inputs that hold the contract cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse as P
from ..functions import text as X
from .registry import query


def _vectors(spark: SparkSession, values: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(values)), "n int, s string")


def _values(values: list[str]) -> str:
    rows = ", ".join("(" + str(i) + ", '" + v.replace("'", "''") + "')" for i, v in enumerate(values))
    return f"(VALUES {rows}) AS v(n, s)"


_URLS = ["https://youtu.be/abcdefghijk?t=3", "https://www.youtube.com/watch?x=1&v=ABCDEFGHIJ_", "https://youtube.com/shorts/0123456789-", "https://example.com/watch?v=abc", ""]


@query(f"""SELECT n, coalesce(nullif(regexp_extract(s, 'youtu\\.be/([A-Za-z0-9_-]{{11}})', 1), ''), nullif(regexp_extract(s, 'youtube\\.com/(?:watch\\?(?:.*&)?v=|shorts/|embed/|v/)([A-Za-z0-9_-]{{11}})', 1), '')) AS video FROM {_values(_URLS)}""")
def video_id_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, _URLS).select("n", X.video_id(F.col("s")).alias("video"))


_CONTROLS = ["a\tb", " x\ny ", "plain", "\x01\x02"]


@query("SELECT n, trim(regexp_replace(s, '[\\x00-\\x1f]', ' ', 'g')) AS folded FROM " + _values(_CONTROLS))
def control_char_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, _CONTROLS).select("n", X.fold_controls(F.col("s")).alias("folded"))


_KANA = ["カタカナ", "ひらがな", "ABCヴ", "漢字カ"]


@query("SELECT n, translate(s, 'カタナヴ', 'かたなゔ') AS kana, regexp_matches(s, '[\\x{4e00}-\\x{9fff}]') AS kanji FROM " + _values(_KANA))
def kana_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, _KANA).select("n", X.hiragana(F.col("s")).alias("kana"), F.col("s").rlike(r"[\x{4e00}-\x{9fff}]").alias("kanji"))


_EMBEDS = ["![[a/b.png#x|cap]]", "![[note]]", "![[pic.JPEG]]", "[[no embed]]", "![[c.svg|]]"]


@query("""SELECT n, path, regexp_matches(lower(path), '\\.(png|jpe?g|gif|webp|svg)$') AS image FROM (SELECT n, regexp_extract(s, '!\\[\\[([^\\]|#]+)', 1) AS path FROM """ + _values(_EMBEDS) + ") WHERE path <> ''")
def embed_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.embeds(_vectors(spark, _EMBEDS), "s").select("n", "path", "image")


_ZONES = ["a <!-- llm-zone -->one<!-- /llm-zone --> b", "none", "x ```code [[k]]``` `in` y", "<!-- llm-zone --><!-- /llm-zone -->"]


@query("""SELECT n, regexp_extract(s, '(?s)<!-- llm-zone -->(.*?)<!-- /llm-zone -->', 1) AS zone, regexp_replace(regexp_replace(s, '(?s)```.*?```', '', 'g'), '`[^`]*`', '', 'g') AS bare FROM """ + _values(_ZONES))
def code_strip_zone_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, _ZONES).select("n", P.zone(F.col("s"), "llm-zone").alias("zone"), P.strip_code(F.col("s")).alias("bare"))


_HEADINGS = ["# one", "## two", "###### six", "no heading", "##### five"]


@query("SELECT n, CASE WHEN regexp_matches(s, '^#{1,6} ') THEN repeat('#', CAST(least(length(regexp_extract(s, '^(#+)', 1)) + 2, 6) AS INTEGER)) || regexp_replace(s, '^#+', '') ELSE s END AS moved FROM " + _values(_HEADINGS))
def heading_demote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, _HEADINGS).select("n", P.demote(F.col("s"), 2).alias("moved"))


_TAXONOMY = ["## Domain", "- `bio`", "- `bio/cell` cells", "## Form", "- `note`", "text", "## Reserved", "- `inbox`"]


@query("SELECT section, tag FROM (SELECT n, regexp_extract(s, '^- `([^`]+)`', 1) AS tag, last_value(nullif(regexp_extract(s, '^## (.+)$', 1), '') IGNORE NULLS) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM " + _values(_TAXONOMY) + ") WHERE tag <> ''")
def taxonomy_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _vectors(spark, _TAXONOMY).withColumn("file", F.lit("taxonomy"))
    return P.taxonomy(lines, "file", "n", "s").select("section", "tag")


_ANCHORS = ["00:10-00:18", "1:02:03-1:02:05", "00:12-00:12", "00:10", "sec=x", "00:20-00:10"]


@query("""
WITH p AS (SELECT n, regexp_extract(s, '^((?:[0-9]+:)?[0-9]{2}:[0-9]{2})-((?:[0-9]+:)?[0-9]{2}:[0-9]{2})$', 1) AS a, regexp_extract(s, '^((?:[0-9]+:)?[0-9]{2}:[0-9]{2})-((?:[0-9]+:)?[0-9]{2}:[0-9]{2})$', 2) AS b FROM """ + _values(_ANCHORS) + """),
t AS (SELECT n, CASE WHEN a <> '' THEN list_reduce(list_transform(string_split(a, ':'), lambda x: CAST(x AS INTEGER)), lambda x, y: x * 60 + y) END AS first, CASE WHEN b <> '' THEN list_reduce(list_transform(string_split(b, ':'), lambda x: CAST(x AS INTEGER)), lambda x, y: x * 60 + y) END AS last FROM p)
SELECT n, first, last, coalesce(first < last, false) AS valid FROM t
""")
def anchor_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time anchors; a range must run forward."""
    first, last = P.time_range(F.col("s"))
    out = _vectors(spark, _ANCHORS).select("n", first.alias("first"), last.alias("last"))
    return out.withColumn("valid", F.coalesce(F.col("first") < F.col("last"), F.lit(False)))


_PATHS = ["a/b.md", "../x", "/etc/x", "a/../../b", "c\\d", "ok/./f", ""]


@query("SELECT n, s <> '' AND NOT starts_with(s, '/') AND NOT contains(s, chr(92)) AND NOT regexp_matches(s, '(^|/)\\.\\.(/|$)') AS safe FROM " + _values(_PATHS))
def path_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, _PATHS).select("n", P.safe_path(F.col("s")).alias("safe"))


_MAGIC = ["89504E470D0A1A0A00", "FFD8FFE000", "474946383961", "524946460000000057454250", "3C737667", ""]


@query("""SELECT n, CASE WHEN starts_with(s, '89504E470D0A1A0A') THEN 'png' WHEN starts_with(s, 'FFD8FF') THEN 'jpg' WHEN starts_with(s, '474946383961') OR starts_with(s, '474946383761') THEN 'gif'
  WHEN starts_with(s, '52494646') AND substr(s, 17, 8) = '57454250' THEN 'webp' END AS ext FROM """ + _values(_MAGIC))
def image_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, _MAGIC).select("n", P.image_type(F.unhex("s")).alias("ext"))


_DIFF = ["diff --git a/x.md b/x.md", "--- a/x.md", "+++ b/x.md", "@@ -1 +1 @@", "+++ /dev/null", "+++ b/dir/y.md"]


@query("SELECT DISTINCT regexp_extract(s, '^\\+\\+\\+ b/(.+)$', 1) AS path FROM " + _values(_DIFF) + " WHERE regexp_matches(s, '^\\+\\+\\+ b/(.+)$')")
def diff_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a unified diff writes."""
    path = F.regexp_extract("s", r"^\+\+\+ b/(.+)$", 1)
    return _vectors(spark, _DIFF).select(path.alias("path")).filter("path <> ''").distinct()


_CAPTIONS = ["Figure 3", "Fig. 12: cells", "IMG_0042.jpg", "A cell divides", "image", ""]


@query("SELECT n, regexp_matches(s, '(?i)^(fig(ure)?\\.?|table) *[0-9]+') AS label, s <> '' AND NOT regexp_matches(s, '(?i)^(image|img|photo|picture)?[-_ ]*[0-9]*(\\.(png|jpe?g|gif))?$') AS good FROM " + _values(_CAPTIONS))
def caption_label_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, _CAPTIONS).select("n", P.figure_label(F.col("s")).alias("label"), P.good_alt(F.col("s")).alias("good"))


_LINES = ["one", " two ", "", "三", "四 ", "end"]


@query("SELECT 'one two三四end' AS joined")
def line_join_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard-wrapped lines joined; a space only between two ASCII letters or digits."""
    lines = F.array(*[F.lit(x) for x in _LINES])
    return spark.range(1).select(P.join_wrapped(lines).alias("joined"))


_ALIASES = ["ATP酶|ATP合成酶|ATP synthase", "ATP酶|ATP酶 (synthase)", "β-氧化|β-oxidation", "漢字|漢"]


@query("SELECT * FROM (VALUES (0, 'ATP synthase'), (1, 'synthase'), (2, 'β-oxidation'), (3, NULL)) AS v(n, alias)")
def latin_alias_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alias shown to readers of English; contract cases."""
    return _vectors(spark, _ALIASES).select("n", P.latin_alias(F.slice(F.split("s", r"\|"), 2, 100)).alias("alias"))
