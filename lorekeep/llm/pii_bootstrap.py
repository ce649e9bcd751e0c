"""Personal data by patterns and by bootstrapped contextual extraction, in DataFrame functions only.

Base spans are the matches of four fixed patterns that pass their checks.  They seed
a pattern-instance graph: an instance is a base span with what touches it, or another
identifier-like token (five digits or an ``@``), a pattern is the lexical context
before it (the last word, the last two words, or a key such as ``account:`` inside the
token; digits masked).  Scores go
back and forth: a pattern's confidence is the mean score of its instances, an
unseen instance's score is the noisy-or of its patterns.  Occurrences of unseen
instances behind patterns of high confidence become spans of kind ``id``.

Positions are code points, and bytes for cutting: the pieces between the matches, from
``split``, and the matches, from ``regexp_extract_all``, are summed along.  Sums run
in blocks of about the cube root of the matches, because a fold that appends to an
array copies it; a text of a hundred thousand matches takes a second.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, split_by_keys

#: The kinds in their order.  The patterns match what the plain forms match; possessive
#: quantifiers and look-behinds keep long runs linear and off the stack.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that a text may hold a match.
_HINTS = {"email": "{t} LIKE '%@%'", "ip": "{t} LIKE '%.%'", "card": "{t} RLIKE '[0-9]'", "phone": "{t} LIKE '%+%'"}
_CHECKS = {
    "email": "true",
    "ip": "forall(split(m, '[.]'), p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(ltrim('0', p) AS int), 0) <= 255)",
    "card": "length(translate(m, ' -', '')) <= 19 AND luhn_check(translate(m, ' -', ''))",
    "phone": "length(regexp_replace(m, '[^0-9]', '')) BETWEEN 9 AND 15",
}
#: Stands for every character of a base span where tokens are looked for; the texts' own become \x02 there.
_MASK = "\x01"
_TOKEN = r"(?<!\S)(?=[^\s@\x01]*+[@\x01]|(?:[^\s0-9]*+[0-9]){5})\S++"
#: start and end in code points, ostart and oend in bytes.
_SPAN = "array<struct<start:int,rank:int,end:int,ostart:int,oend:int>>"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _in_blocks(items: str) -> str:
    """A non-empty array as an array of blocks of about the cube root of its size."""
    size = "cast(ceil(cbrt(size(its))) AS int)"
    return _let("its", items, f"transform(sequence(0, (size(its) - 1) div {size}), k -> slice(its, k * {size} + 1, {size}))")


def _located(text: str, pattern: str, hint: str, check: str, made: str, kind: str) -> str:
    """SQL of an array over the matches that pass ``check`` of z.m; ``made`` builds an element from z: m, gap g, start, ostart."""
    p = _quoted(pattern)
    matches = f"""zip_with(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), (g, m) ->
      struct(g, m, length(g) AS gl, octet_length(g) AS gb, length(g) + coalesce(length(m), 0) AS l, octet_length(g) + coalesce(octet_length(m), 0) AS b))"""
    offsets = """aggregate(transform(bs, x -> struct(aggregate(x, 0, (s, y) -> s + y.l) AS l, aggregate(x, 0, (s, y) -> s + y.b) AS b)),
      struct(0 AS l, 0 AS b, cast(array() AS array<struct<l:int,b:int>>) AS out),
      (acc, x) -> struct(acc.l + x.l AS l, acc.b + x.b AS b, concat(acc.out, array(struct(acc.l AS l, acc.b AS b))) AS out), acc -> acc.out)"""
    inner = f"""aggregate(x, struct(o.l AS l, o.b AS b, cast(array() AS {kind}) AS out),
      (acc, y) -> struct(acc.l + y.l AS l, acc.b + y.b AS b,
        CASE WHEN y.m IS NULL THEN acc.out
             ELSE concat(acc.out, transform(filter(array(struct(y.m AS m, y.g AS g, acc.l + y.gl AS start, acc.b + y.gb AS ostart)), z -> {check}), z -> {made})) END AS out),
      acc -> acc.out)"""
    found = _let("bs", _in_blocks(matches), f"flatten(zip_with(bs, {offsets}, (x, o) -> {inner}))")
    return f"CASE WHEN {hint.format(t=text)} THEN {found} ELSE cast(array() AS {kind}) END"


def _base(text: str) -> str:
    parts = []
    for rank, (kind, pattern) in enumerate(KINDS.items()):
        check = _CHECKS[kind].replace("(m,", "(z.m,")
        made = f"struct(z.start AS start, {rank} AS rank, z.start + length(z.m) AS end, z.ostart AS ostart, z.ostart + octet_length(z.m) AS oend)"
        parts.append(_located(text, pattern, _HINTS[kind], check, made, _SPAN))
    return f"sort_array(concat({', '.join(parts)}))"


def base_spans(text: str) -> Column:
    """Sorted array of (start, rank of the kind, end, ostart, oend) of the base matches of a non-null text column."""
    return F.expr(_base(text))


def _rewritten(text: str, spans: str, first: str, more: str) -> str:
    """SQL of ``text`` with the sorted ``spans`` covered: ``first`` for a span s, ``more`` for what an overlapping one adds behind byte acc.pos."""
    piece = "cast(substring(bin, {a} + 1, {b} - {a}) AS string)"
    before = """aggregate(transform(bs, x -> array_max(transform(x, s -> s.oend))), struct(0 AS pos, cast(array() AS array<int>) AS out),
      (acc, x) -> struct(greatest(acc.pos, x) AS pos, concat(acc.out, array(acc.pos)) AS out), acc -> acc.out)"""
    inner = f"""aggregate(x, struct(o AS pos, cast(array() AS array<string>) AS out),
      (acc, s) -> CASE WHEN s.oend <= acc.pos THEN acc
        WHEN s.ostart < acc.pos THEN struct(s.oend AS pos, concat(acc.out, array({more})) AS out)
        ELSE struct(s.oend AS pos, concat(acc.out, array({piece.format(a="acc.pos", b="s.ostart")}, {first})) AS out) END,
      acc -> acc.out)"""
    last = "array_max(transform(sp, s -> s.oend))"
    body = _let("bs", _in_blocks("sp"), f"array_join(flatten(zip_with(bs, {before}, (x, o) -> {inner})), '')")
    whole = f"concat({body}, {_let('e', last, piece.format(a='e', b='octet_length(bin)'))})"
    covered = _let("bin", f"cast({text} AS binary)", whole)
    return _let("sp", spans, f"CASE WHEN size(sp) = 0 THEN {text} ELSE {covered} END")


_FOUND = "array<struct<start:int,end:int,ostart:int,oend:int,instance:bigint,seed:boolean,key:string,before:array<string>>>"


def _candidates(text: str, base: str) -> Column:
    """Base spans with what touches them, and other identifier-like tokens, without closing punctuation and key."""
    mark = f"'{_MASK}'"
    plain = f"translate({text}, {mark}, '\x02')"
    masked = _rewritten(plain, base, f"repeat({mark}, s.oend - s.ostart)", f"repeat({mark}, s.oend - acc.pos)")
    key, trimmed = "regexp_extract(z.m, '^[A-Za-z_]{3,32}[=:]', 0)", "rtrim('.,;:)\"', z.m)"
    inside = f"cast(substring(bin, z.ostart + length({key}) + 1, octet_length({trimmed}) - length({key})) AS string)"
    made = (
        f"struct(z.start + length({key}) AS start, z.start + length({trimmed}) AS end, z.ostart + length({key}) AS ostart, z.ostart + octet_length({trimmed}) AS oend,"
        f" xxhash64(lower({inside})) AS instance, instr(z.m, {mark}) > 0 AS seed, lower({key}) AS key,"
        " slice(reverse(split(trim(regexp_replace(lower(right(z.g, 80)), '\\\\s+', ' ')), ' ')), 1, 2) AS before)"
    )
    tokens = _located("ms", _TOKEN, "{t} RLIKE '[0-9@\x01]'", "true", made, _FOUND)
    return F.expr(_let("ms", masked, _let("bin", f"cast({text} AS binary)", tokens)))


def spelled(spans: Column) -> Column:
    """kind:start:end of sorted spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in (*KINDS, "id")])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, h, base, found) of each document: base spans and candidate tokens; h is the text's hash."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    based = rows.select("doc_id", F.xxhash64("text").alias("h"), "text", base_spans("text").alias("base"))
    return based.select("doc_id", "h", "base", _candidates("text", "base").alias("found"))


def discovered(scanned: DataFrame, rounds: int = 3, least_seeds: int = 5, least_confidence: float = 0.8, prior: float = 2.0) -> DataFrame:
    """(doc_id, h, extra): spans of kind ``id`` that no base span overlaps, of documents that have any.

    scanned: what ``scan`` returns.  A pattern needs ``least_seeds`` different seed
    instances; ``prior`` pulls rare patterns down.
    """
    spark = scanned.sparkSession
    occurrences = scanned.select("doc_id", "h", F.explode("found").alias("c")).select(
        "doc_id", "h", *[f"c.{x}" for x in ("start", "end", "ostart", "oend", "instance", "seed", "key")], F.transform("c.before", lambda w: F.regexp_replace(w, "[0-9]", "9")).alias("w")
    ).filter(F.col("end") - F.col("start") >= 5)
    context = F.filter(
        F.array(
            F.when(F.length("key") > 0, F.concat(F.lit("k "), "key")),
            F.when((F.size("w") > 0) & (F.length(F.get("w", F.lit(0))) > 0), F.concat(F.lit("1 "), F.get("w", F.lit(0)))),
            F.when(F.size("w") > 1, F.concat(F.lit("2 "), F.get("w", F.lit(1)), F.lit(" "), F.get("w", F.lit(0)))),
        ),
        lambda p: p.isNotNull(),
    )
    seen = materialise(occurrences.select("doc_id", "h", "start", "end", "ostart", "oend", "instance", "seed", context.alias("patterns")), "pii-occurrences")
    # An instance is a seed if any of its occurrences is.
    seeds = seen.groupBy("instance").agg(F.max("seed").alias("seed"))
    pairs = seen.select(F.explode("patterns").alias("pattern"), "instance").groupBy("pattern", "instance").agg(F.count("*").alias("n"))
    pairs = pairs.join(seeds, "instance")
    fit = pairs.groupBy("pattern").agg(F.sum(F.col("seed").cast("long")).alias("s")).filter(F.col("s") >= least_seeds).select("pattern")
    edges = materialise(pairs.join(fit, "pattern"), "pii-edges")
    scores = None
    patterns = None
    for _ in range(rounds):
        scored = edges.withColumn("x", F.col("seed").cast("double")) if scores is None else edges.join(scores, "instance", "left").withColumn(
            "x", F.when(F.col("seed"), F.lit(1.0)).otherwise(F.coalesce("score", F.lit(0.0)))
        )
        patterns = scored.groupBy("pattern").agg((F.sum(F.col("n") * F.col("x")) / (F.sum("n") + prior)).alias("confidence"))
        patterns = materialise(patterns, "pii-patterns")
        scores = (
            edges.filter("NOT seed")
            .join(patterns, "pattern")
            .groupBy("instance")
            .agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))).alias("score"))
        )
    sure = patterns.filter(F.col("confidence") >= least_confidence).select("pattern")
    behind = seen.filter("NOT seed").select("doc_id", "h", "start", "end", "ostart", "oend", F.explode("patterns").alias("pattern")).join(sure, "pattern", "left_semi")
    return behind.groupBy("doc_id", "h").agg(
        F.sort_array(F.collect_set(F.struct(F.col("start"), F.lit(len(KINDS)).alias("rank"), F.col("end"), F.col("ostart"), F.col("oend")))).cast(_SPAN).alias("extra")
    )


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, base, spans): sorted arrays of (start, rank, end, ostart, oend), rank 4 is kind ``id``; one row for each document.

    Null texts are empty.  Rows repeated with id and text each get the same spans.
    Other columns are ignored.
    """
    scanned = materialise(scan(docs, id_col, text_col), "pii-scan")
    more = discovered(scanned, **options)
    joined = scanned.select("doc_id", "h", "base").join(
        more.select(F.col("doc_id").alias("d2"), F.col("h").alias("h2"), "extra"), F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")), "left"
    )
    return joined.select("doc_id", "base", F.sort_array(F.concat("base", F.coalesce("extra", F.array().cast(_SPAN)))).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in angle brackets; overlapping spans by the first's."""
    scanned = materialise(scan(docs, id_col, text_col), "pii-scan")
    more = discovered(scanned, **options).select(F.col("doc_id").alias("__pii_d"), F.col("h").alias("__pii_h"), F.col("extra").alias("__pii_extra"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumn("__pii_t", text).withColumn("__pii_k", F.xxhash64("__pii_t"))
    # Only documents that may hold discovered spans meet the list of them; the texts of the others are not shuffled.
    more = materialise(more, "pii-discovered")
    clear, doubtful = split_by_keys(keyed, [F.col(id_col).cast("long"), F.col("__pii_k")], more.select("__pii_d", "__pii_h"))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__pii_d")) & (F.col("__pii_k") == F.col("__pii_h"))
    joined = clear.withColumn("__pii_extra", F.array().cast(_SPAN)).unionByName(doubtful.join(more, same, "left").drop("__pii_d", "__pii_h"))
    spans = F.sort_array(F.concat(base_spans("__pii_t"), F.coalesce("__pii_extra", F.array().cast(_SPAN))))
    names = "array(" + ", ".join(f"'<{k.upper()}>'" for k in (*KINDS, "id")) + ")"
    rewritten = joined.withColumn("__pii_s", spans).withColumn("__pii_m", F.expr(_rewritten("__pii_t", "__pii_s", f"{names}[s.rank]", "''")))
    return rewritten.withColumn(text_col, F.when(F.col(text_col).isNotNull(), F.col("__pii_m"))).select(*docs.columns)
