"""Personal data: fixed patterns, and contextual extraction bootstrapped from what they find.

All of it is DataFrame and SQL functions. The base spans are the seeds. The words just before and after a
token are its lexical patterns. Candidates are all tokens of several digits, or with a written-out at sign,
that are left when the base spans are blanked out; they have no kind of their own. Scores then go round the
bipartite graph of patterns and instances: a pattern is worth, for a kind, the mean confidence of its instances
(seeds count 1, instances unknown so far what they have earned), an instance the noisy-or of its patterns.
Instances above a threshold count as found from the next round on, so that they bear patterns of their own; in
the end they join the spans of the kind that they score highest for.

Every step is linear in the length of a text and in its number of matches: matches and the gaps between them
are two arrays, places come from a running sum in blocks, and texts are put together again by one join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.logits import let

from .common import numbered, pick, place, skew_join, table

KINDS = ("email", "ip", "card", "phone")
#: Java patterns of the base kinds. A match can only begin where a run of its first characters begins, or
#: where the last match ended (\\G); possessive loops keep long texts from overflowing the matcher's stack.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind's pattern to match at all.
_NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": "[0-9](?:[ -]?[0-9]){15}", "phone": r"\+[0-9]"}
#: Candidates: tokens with five digits or more, or with a written-out at sign, from their first letter, digit or bracket on.
CANDIDATE = r"(?<!\S)(?=(?:[^\s0-9]*+[0-9]){5}|[^\s(\[]*+[(\[]at[)\]])\S++"
#: The marks around a token that do not belong to its instance.
_HEAD, _TAIL = r"^[^\p{L}0-9(\[+]++", r"(?<![^\p{L}0-9)\]])[^\p{L}0-9)\]]++$"
#: Confident instances that a pattern needs; what it must be worth; rounds; damping of what unknown instances earn; least confidence.
LEAST_SEEDS, WORTH, ROUNDS, DAMPING, CONFIDENCE = 3, 0.5, 4, 0.5, 0.6
#: Edges of a pattern or an instance in a part.
PART_EDGES = 100_000
_BLOCK = 256

_SPAN = "array<struct<start:int,end:int,text:string,before:string,after:string>>"


def _running(sizes: Column) -> Column:
    """The sum of all entries before each, block by block: appending to one array for all would be quadratic."""

    def add(acc: Column, x: Column) -> Column:
        return F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))

    def whole(sizes: Column) -> Column:
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.sequence(F.lit(1), F.greatest(F.size(sizes), F.lit(1)), F.lit(_BLOCK))
        blocks = F.transform(starts, lambda b: F.aggregate(F.slice(sizes, b, F.lit(_BLOCK)), none, add))
        return let(blocks, lambda bs: F.flatten(F.zip_with(bs, F.aggregate(bs, none, lambda acc, x: add(acc, x["at"]))["out"], lambda x, base: F.transform(x["out"], lambda i: i + base))))

    return let(sizes, whole)


def _cut(text: Column, pattern: str, then: Callable[[Column, Column], Column]) -> Column:
    """``then(matches, gaps)``: all matches of ``pattern`` and the gaps around them, one more."""
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda w: let(F.split(text, pattern, -1), lambda g: then(w, g)))


def _spans(words: Column, gaps: Column) -> Column:
    """The matches as structs of start, end (code points), text and the ends of the gaps around."""
    n = F.size(words)
    begins = _running(F.zip_with(words, F.slice(gaps, 1, n), lambda w, g: F.length(w) + F.length(g)))
    matches = F.zip_with(words, begins, lambda w, at: F.struct(w.alias("w"), at.alias("at")))
    around = F.zip_with(F.slice(gaps, 1, n), F.slice(gaps, 2, n), lambda g, h: F.struct(g.alias("g"), h.alias("h")))

    def span(m: Column, g: Column) -> Column:
        start = m["at"] + F.length(g["g"])
        return F.struct(start.alias("start"), (start + F.length(m["w"])).alias("end"), m["w"].alias("text"), F.substring(g["g"], -40, 40).alias("before"), F.substring(g["h"], 1, 40).alias("after"))

    return F.zip_with(matches, around, span)


def _luhn(digits: Column) -> Column:
    """Does the Luhn sum of these digits end in 0?"""
    places = F.sequence(F.lit(1), F.length(digits))

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), 1, 1 << 20).substr(i, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def _valid(kind: str, span: Column) -> Column:
    digits = F.regexp_replace(span["text"], r"[^0-9]", "")
    if kind == "ip":
        return ~F.exists(F.split(span["text"], r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))).isin(0, 1, 2, 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) > 255) | (F.length(F.ltrim(p, F.lit("0"))) > 3))
    if kind == "card":
        return F.length(digits).between(16, 19) & F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _holds(text: Column, kind: str) -> Column:
    need = _NEEDS[kind]
    return F.contains(text, F.lit(need)) if len(need) == 1 else text.rlike(need)


def base_spans(text: Column, kind: str) -> Column:
    """The base spans of ``kind`` in ``text``: leftmost, not overlapping; failing matches are dropped, not retried."""
    found = _cut(text, PATTERNS[kind], lambda w, g: F.filter(_spans(w, g), lambda s: _valid(kind, s)))
    return F.when(_holds(text, kind), found.cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def _replace(text: Column, pattern: str, new: Callable[[Column], Column]) -> Column:
    """``text`` with every match w replaced by new(w)."""

    def join(words: Column, gaps: Column) -> Column:
        told = F.transform(words, lambda w: new(w))
        return F.concat(F.array_join(F.zip_with(F.slice(gaps, 1, F.size(words)), told, lambda g, w: F.concat(g, w)), ""), F.element_at(gaps, -1))

    return _cut(text, pattern, join)


def _blank(text: Column, kind: str, fill: Callable[[Column], Column]) -> Column:
    """``text`` with the valid matches of ``kind`` replaced by fill(match)."""
    new = _replace(text, PATTERNS[kind], lambda w: F.when(_valid(kind, F.struct(w.alias("text"))), fill(w)).otherwise(w))
    return F.when(_holds(text, kind), new).otherwise(text)


#: In this order a text is blanked out: what an e-mail address or a telephone number holds is no address of its own.
_ORDER = ("email", "card", "phone", "ip")


def _blanked(text: Column, fill: Callable[[str, Column], Column]) -> Column:
    """``text`` with the valid matches of all kinds replaced by fill(kind, match)."""

    def step(kind: str) -> Callable[[Column], Column]:
        return lambda t: _blank(t, kind, lambda w: fill(kind, w))

    for kind in _ORDER:
        text = let(text, step(kind))
    return text


def candidates(text: Column) -> Column:
    """Spans of the candidates in a text whose base spans are blanked out."""
    found = _cut(text, CANDIDATE, _spans)
    return F.when(text.rlike(CANDIDATE), found.cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def _contexts(span: Column) -> Column:
    """Lexical patterns of a span: the word before it, the word after it, both; lower-cased and without marks."""
    near = lambda s: F.lower(F.regexp_replace(s, r"^[^\p{L}]+|[^\p{L}]+$", ""))
    before, after = near(F.regexp_extract(span["before"], r"(\S+)\s*$", 1)), near(F.regexp_extract(span["after"], r"^\s*(\S+)", 1))
    some = lambda ok, *parts: F.when(ok, F.concat(*parts))
    every = F.array(some(before != "", F.lit("<"), before), some(after != "", F.lit(">"), after), some((before != "") & (after != ""), F.lit("="), before, F.lit(" "), after))
    return F.filter(every, lambda p: p.isNotNull())


def _core(word: Column) -> Column:
    """A candidate without the marks at its end: the name of its instance."""
    return F.regexp_replace(word, f"{_HEAD}|{_TAIL}", "")


def _occurrences(kind: str | None, spans: str) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).cast("string").alias("kind"), (s["text"] if kind else _core(s["text"])).alias("instance"), _contexts(s).alias("patterns")))


def discover(rows: DataFrame, *, least_seeds: int = LEAST_SEEDS, worth: float = WORTH, rounds: int = ROUNDS, confidence: float = CONFIDENCE) -> DataFrame | None:
    """High-confidence instances (instance, kind, c) from ``rows`` (kind, instance, patterns); None without candidates.

    ``rows`` has one row per occurrence; kind is null for candidates. Every round joins the edges, aggregated
    to distinct (kind, instance, pattern), with what is known of the instances and back; nothing is collected.
    A pattern counts for a kind if ``least_seeds`` instances, seeds or found ones, bear it and it is worth at
    least ``worth``; an instance is found once its confidence reaches ``confidence`` (ties: first kind by name).
    Patterns that many instances bear, and instances that bear many patterns, have their edges dealt out over
    parts of PART_EDGES, so that no join gathers one of them.
    """
    edges = table(rows.select("kind", "instance", F.explode("patterns").alias("pattern")).distinct(), "pii-edges")
    if not edges.where("kind IS NULL").head(1):
        return None
    seeds = edges.where("kind IS NOT NULL").select("kind", "instance", "pattern", F.lit(1.0).alias("c"))
    # an instance that is a seed somewhere is known; elsewhere it is no candidate
    unknown = edges.where("kind IS NULL").drop("kind").join(seeds.select("instance").distinct(), "instance", "left_anti")
    parts = lambda n: F.ceil(F.col(n) / PART_EDGES).cast("int")
    size = table(edges.groupBy("pattern").agg(F.count_distinct("instance").alias("size")).withColumn("parts", parts("size")), "pii-patterns")
    unknown = table(unknown, "pii-candidates")
    degree = table(unknown.groupBy("instance").agg(F.count("*").alias("degree")).withColumn("spread", parts("degree")), "pii-instances")
    hot = [t.agg(F.max(c)).first()[0] or 1 for t, c in ((size, "parts"), (degree, "spread"))]
    if hot == [1, 1]:  # no pattern or instance needs a second part
        unknown = unknown.select("instance", "pattern", F.lit(0).alias("part"), F.lit(0).alias("at"))
    else:
        unknown = skew_join(unknown, size.select("pattern", "parts", "size"), "pattern", "size").drop("size")
        unknown = skew_join(unknown, degree, "instance", "degree").drop("degree")
        deal = lambda other, n: F.pmod(F.hash(other), F.col(n))
        unknown = table(unknown.select("instance", "pattern", deal("instance", "parts").alias("part"), deal("pattern", "spread").alias("at")), "pii-unknown")
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
    found = None
    for _ in range(rounds):
        known = seeds if found is None else seeds.unionByName(unknown.join(found.select("instance", "kind", "c", every("spread", "at")), ["instance", "at"]).select("kind", "instance", "pattern", "c"))
        sums = known.groupBy("kind", "pattern").agg(F.sum(F.when(F.col("c") >= confidence, F.col("c")).otherwise(F.col("c") * DAMPING)).alias("sum"), F.count_if(F.col("c") >= confidence).alias("sure"))
        good = sums.where(F.col("sure") >= least_seeds).join(size, "pattern").select("kind", "pattern", "parts", F.least(F.col("sum") / F.col("size"), F.lit(0.999)).alias("worth")).where(F.col("worth") >= worth)
        earned = unknown.join(good.select("kind", "pattern", "worth", every("parts", "part")), ["pattern", "part"]).groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("worth"))))).alias("c"))
        best = earned.groupBy("instance").agg(F.max(F.struct("c", (-F.ascii("kind")).alias("first"), "kind")).alias("b"))
        found = table(best.select("instance", "b.kind", "b.c").join(degree.select("instance", "spread"), "instance"), "pii-found")
    return found.where(F.col("c") >= confidence).drop("spread")


def _told(rows: DataFrame, new: DataFrame) -> DataFrame:
    """The ``rows`` (with a column instance) whose instance is in ``new``, with its kind. An instance may stand in any share of the rows."""
    counts = rows.groupBy("instance").agg(F.count("*").alias("n"))
    classes = table(counts.join(new.select("instance", "kind"), "instance", "left"), "pii-told")
    return skew_join(rows, classes, "instance", "n").where("kind IS NOT NULL").drop("n")


def _written(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and base_sha256 are of the base spans, ``spans`` also holds discovered ones: kind:start:end,
    comma-joined, by kind as in KINDS and then by start; places are code points, the end exclusive. Null and
    empty texts have none (base_sha256 is that of the empty text). Repeated ids are repeated rows. Texts may
    be of any length and hold any number of matches. Extra columns are ignored. Empty in, empty out.
    """
    docs = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    left = _blanked(F.col("text"), lambda kind, w: F.repeat(F.lit("."), F.length(w)))
    # rows are numbered before they are written: whoever reads the table finds the same numbers
    slim = table(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", *(base_spans(F.col("text"), k).alias(k) for k in KINDS), F.when(F.col("text").rlike(CANDIDATE), let(left, candidates)).otherwise(F.array().cast(_SPAN)).alias("other")), "pii-spans")
    new = discover(_seen(slim), **options)
    base = F.concat(*(_written(k, F.col(k)) for k in KINDS))
    every = base
    if new is not None:
        # spans of one text are few or many, but never more than its tokens
        each = _told(slim.select("row", F.explode("other").alias("s")).select("row", "s", _core(F.col("s.text")).alias("instance")), new)
        lead = F.col("s.start") + F.length(F.regexp_extract("s.text", _HEAD, 0))
        own = each.groupBy("row").agg(*(F.collect_list(F.when(F.col("kind") == k, F.struct(lead.alias("start"), (lead + F.length("instance")).alias("end")))).alias(f"m_{k}") for k in KINDS))
        slim = slim.join(own, "row", "left")
        plain = lambda k: F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
        every = F.concat(*(_written(k, F.array_sort(F.concat(plain(k), F.coalesce(f"m_{k}", F.array().cast("array<struct<start:int,end:int>>"))))) for k in KINDS))
    return slim.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(every, ",").alias("spans"))


def _seen(slim: DataFrame) -> DataFrame:
    """The occurrences (kind, instance, patterns) of seeds and candidates."""
    every = F.concat(*(_occurrences(k, k) for k in KINDS), _occurrences(None, "other"))
    return slim.select(F.explode(every).alias("s")).select("s.*")


def mask_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", **options: float) -> DataFrame:
    """The rows of ``docs``, all columns, with base and discovered spans replaced by [EMAIL], [IP], [CARD] or [PHONE].

    Kinds are masked one after another (e-mail addresses, cards, telephone numbers, then IP addresses), so of
    spans within each other the outer one names the whole. ``length_col``, if there, becomes the new length.
    Null texts stay null, empty ones empty, repeated rows stay. Texts may be of any length and hold any number
    of matches, column names may clash in any way. Empty in, empty out.
    """
    at = place(docs, text_col)
    own = {c.lower() for c in docs.columns}
    long = place(docs, length_col) if length_col and length_col.lower() in own else None
    rows = numbered(docs)
    text = F.coalesce(F.col(f"c{at}"), F.lit(""))
    left = _blanked(text, lambda kind, w: F.lit(f"[{kind.upper()}]"))
    # a text is marked once, and written
    rest = [f"c{i}" for i in range(len(docs.columns)) if i != at]
    marked = rows.select(*rest, F.col(f"c{at}").isNull().alias("none"), left.alias("masked"), *(base_spans(text, k).alias(k) for k in KINDS))
    marked = table(marked.withColumn("other", candidates(F.col("masked"))), "pii-marked")
    new = discover(_seen(marked), **options)
    if new is not None:
        # the few texts that hold what was found; a text is known by its hash, equal ones have equal spans
        some = marked.where(F.size("other") > 0).withColumn("key", F.sha2("masked", 256))
        hits = _told(some.select("key", F.explode("other").alias("s")).select("key", _core(F.col("s.text")).alias("instance")).distinct(), new)
        told = hits.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("instance", "kind"))).alias("told"))
        swap = lambda w: F.when(F.element_at("told", _core(w)).isNull(), w).otherwise(F.concat(F.regexp_extract(w, _HEAD, 0), F.lit("["), F.upper(F.element_at("told", _core(w))), F.lit("]"), F.regexp_extract(w, _TAIL, 0)))
        copies = table(some.groupBy("key").agg(F.count("*").alias("n")).join(told, "key", "left"), "pii-copies")
        more = skew_join(some, copies, "key", "n").drop("n").withColumn("masked", F.when(F.col("told").isNull(), F.col("masked")).otherwise(_replace(F.col("masked"), CANDIDATE, swap)))
        marked = marked.where(F.size("other") == 0).unionByName(more.drop("key", "told"))
    new_text = F.when(~F.col("none"), F.col("masked"))
    cols = [new_text if i == at else F.length(new_text).cast(docs.schema[i].dataType) if i == long else F.col(f"c{i}") for i in range(len(docs.columns))]
    return marked.select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).toDF(*docs.columns)
