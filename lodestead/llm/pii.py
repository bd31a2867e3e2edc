"""Personal data, and the terms that give it away, in DataFrame expressions only.

**Base spans.** Emails, IP addresses, card and phone numbers are found by fixed
patterns; matches that fail their kind's rule (parts up to 255, 12 to 19 digits
that pass Luhn, 9 to 15 digits) are dropped. The patterns are written with
possessive repetition and a look at the character before, which match the same
and take linear time on any text.

**Disclosure.** Each distinct value found is a protected entity. Corpus
co-occurrence tells how strongly a term reveals it: with n_e distinct contexts of the
entity (``CONTEXT`` words on either side), n_te of them with the term, and n_t of N
distinct texts with the term anywhere,

    disclosure = log(N * n_te / (n_t * n_e)) / log(N / n_e)

is the share of the entity's information content that the term carries (1: the
term occurs with that entity only). Every rare word beside a value met it once, so the
meeting that makes a pair a candidate tells nothing: the same share is estimated with one
text left out (each count of texts, N too, less one), where n_te and n_e count the texts that
contexts stand in. It needs no least number: what recurs with a value in a second text counts,
what one text alone shows gets none. Pairs of ``SUPPORT`` contexts or more, be they of one text, may
reach ``ALPHA`` by the plain share as well. A term whose disclosure, the greater of both, reaches
``ALPHA`` is a span of kind ``term`` wherever a text names the entity, unless it lies in a
base span. Equal contexts and equal texts count once, so that copies of one text disclose
nothing.

What is broadcast is checked: candidate terms and disclosing pairs beyond
``BROADCAST_ROWS`` are joined by shuffling. Spans of a text are gathered within
its row; what is kept between steps holds texts only of documents with base spans.

Defined results: null text is the empty text without spans; repeated rows repeat;
an empty table gives an empty one; start and end are code points, end exclusive,
in order of start, then kind as listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestead.checkpoints import cut
from lodestead.llm.decontaminate import words_of

KINDS = ("email", "ip", "card", "phone", "term")
CONTEXT = 8
SUPPORT = 3
ALPHA = 0.9
BROADCAST_ROWS = 100_000
#: Characters on either side of a mention in which its context is looked for: the first that hold
#: all its words, or else the whole side.
REACHES = (200, 4000)

_LOCAL = "A-Za-z0-9._%+-"
_LABEL = "[A-Za-z0-9-]++"
_PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@{_LABEL}(?:\.{_LABEL})++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _rule(kind: str):
    return lambda span: _valid(kind, span["value"])


def _of_kind(i: int):
    return lambda span: span["kind"] == i


def _possible(kind: str, text: Column) -> Column:
    """A quick condition that texts with a match meet."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    if kind == "ip":
        return text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")
    return text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")


def _places(pieces: Column, matches: Column, kind: int) -> Column:
    """Spans of the matches, given the pieces of text before and behind them."""
    pairs = F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("size"), m.alias("value")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans"))

    def add(so_far: Column, x: Column) -> Column:
        begin = so_far["at"] + x["gap"]
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), (begin + x["size"]).alias("end"), x["value"].alias("value"))
        return F.struct((begin + x["size"]).alias("at"), F.concat(so_far["spans"], F.array(span)).cast(_SPAN).alias("spans"))

    return F.aggregate(pairs, start, add, lambda x: x["spans"])


def base_spans(text: Column) -> Column:
    """Spans (start, kind, end, value) of the four kinds, in order of start, then kind."""
    found = []
    for i, kind in enumerate(KINDS[:4]):
        pattern = _PATTERNS[kind]
        spans = _places(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), i)
        spans = F.filter(spans, _rule(kind))
        found.append(F.when(_possible(kind, text), spans).otherwise(F.array().cast(_SPAN)))
    return F.sort_array(F.concat(*found))


def _entity(span: Column) -> Column:
    """A value as it is compared: kind and lower-cased text, numbers by their digits."""
    plain = F.when(span["kind"] >= 2, F.regexp_replace(span["value"], "[^0-9]", "")).otherwise(F.lower(span["value"]))
    return F.concat_ws(":", span["kind"].cast("string"), plain)


def _named(names: dict[int, str], kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for i, name in names.items():
        out = F.when(kind == i, name).otherwise(out)
    return out


def joined(spans: Column) -> Column:
    names = dict(enumerate(KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", _named(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _nearest(text: Column, begin: Column, end: Column) -> Column:
    """The ``CONTEXT`` words before ``begin`` and after ``end``, or as many as there are."""
    last = lambda w: F.slice(w, F.greatest(F.size(w) - CONTEXT, F.lit(0)) + 1, F.lit(CONTEXT))
    before = last(words_of(F.substring(text, F.lit(1), begin)))
    after = F.slice(words_of(F.substring(text, end + 1, F.length(text))), 1, CONTEXT)
    for reach in reversed(REACHES):
        start = F.greatest(begin - reach, F.lit(0))
        piece = F.substring(text, start + 1, begin - start)
        # a word that the reach cuts is left out, and looked for farther off if it is needed
        found = words_of(F.when(start > 0, F.regexp_replace(piece, r"^[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "")).otherwise(piece))
        before = F.when((F.size(found) >= CONTEXT) | (start == 0), last(found)).otherwise(before)
        piece = F.substring(text, end + 1, F.lit(reach))
        found = words_of(F.when(F.length(piece) == reach, F.regexp_replace(piece, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+$", "")).otherwise(piece))
        after = F.when((F.size(found) >= CONTEXT) | (F.length(piece) < reach), F.slice(found, 1, CONTEXT)).otherwise(after)
    return F.concat(before, after)


def _contexts(rows: DataFrame) -> DataFrame:
    """Distinct (entity, context) with the context's distinct terms and a text that has it."""
    mention = rows.select("text", F.xxhash64("text").alias("print"), F.explode("base").alias("s"))
    seen = mention.select(_entity(F.col("s")).alias("entity"), _nearest(F.col("text"), F.col("s.start"), F.col("s.end")).alias("near"), "print")
    seen = seen.groupBy("entity", F.xxhash64("near").alias("context")).agg(F.first("near").alias("near"), F.min("print").alias("print"))
    return seen.select("entity", "print", F.filter(F.array_distinct("near"), lambda t: (F.length(t) >= 3) & t.rlike("[^0-9]")).alias("terms"))


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def _disclosure(n: float, n_t: Column, support: int) -> Column:
    """The disclosure of a term that ``n_t`` texts have, from counts of contexts (c) and of their texts (n)."""
    plain = F.log(F.try_divide(n * F.col("c_te"), n_t * F.col("c_e"))) / F.log(n / F.col("c_e"))
    plain = F.when((F.col("c_te") >= support) & (F.col("c_e") < n), plain)
    others = F.try_divide((n - 1) * (F.col("n_te") - 1), (n_t - 1) * (F.col("n_e") - 1))
    left_out = F.when((F.col("n_te") > 1) & (F.col("n_e") < n), F.log(others) / F.log((n - 1) / (F.col("n_e") - 1)))
    return F.least(F.lit(1.0), F.greatest(plain, left_out))


def disclosing(docs: DataFrame, rows: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """``entity``, ``term`` and ``disclosure`` for the terms that reach ``alpha``. ``docs`` has the texts of the
    corpus, ``rows`` those with base spans."""
    contexts = cut(_contexts(rows))

    def counted(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
        by_text = rows.groupBy(*keys, "print").agg(F.count("*").alias("c"))
        return by_text.groupBy(*keys).agg(F.sum("c").alias(f"c_{name}"), F.count("*").alias(f"n_{name}"))

    met = contexts.select("entity", "print", F.explode("terms").alias("term"))
    recurring = lambda name: (F.col(f"n_{name}") > 1) | (F.col(f"c_{name}") >= support)
    entities = counted(contexts.select("entity", "print"), ["entity"], "e").where(recurring("e"))
    pairs = counted(met, ["entity", "term"], "te").where(recurring("te"))
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = float(max(1, texts.select(F.xxhash64("text")).distinct().count()))
    # a term is in at least as many texts as contexts show: pairs that cannot reach alpha any more need no counting
    least = met.select("term", "print").distinct().groupBy("term").agg(F.count("*").alias("least"))
    pairs = pairs.join(entities, "entity").join(least, "term")
    pairs = cut(pairs.where(_disclosure(n, F.col("least"), support) >= alpha - 1e-9))
    terms = pairs.select("term").distinct()
    if pairs.isEmpty():
        return pairs.select("entity", "term", F.lit(0.0).alias("disclosure"))
    words = texts.select(F.xxhash64("text").alias("print"), F.explode(words_of(F.col("text"))).alias("term"))
    counts = words.join(_small(terms), "term", "left_semi").distinct().groupBy("term").agg(F.count("*").alias("n_t"))
    scored = pairs.join(counts, "term").select("entity", "term", _disclosure(n, F.col("n_t"), support).alias("disclosure"))
    return cut(scored.where(F.col("disclosure") >= alpha))


def _term_spans(text: Column, term: Column) -> Column:
    """Every place of a term, as a whole word in any ASCII case."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    pattern = F.concat(F.lit(r"(?<![^\x00-\x2F\x3A-\x60\x7B-\x7F])"), term, F.lit(r"(?![^\x00-\x2F\x3A-\x60\x7B-\x7F])"))
    pieces = F.split(low, pattern, F.lit(-1))
    return _places(pieces, F.array_repeat(term, F.size(pieces) - 1), 4)


def find(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """Every row of ``docs`` (all its columns) with ``base`` and ``spans``, the base spans and all spans."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    names = [c for c in docs.columns if c not in ("base", "spans")]
    light = [c for c in names if c != "text"]
    rows = docs.select(*[F.col(f"`{c}`") for c in light], text.alias("text")).withColumn("base", base_spans(F.col("text")))
    return _with_terms(docs, rows, alpha, support).select(*[F.col(f"`{c}`") for c in names], "base", "spans")


def _with_terms(docs: DataFrame, rows: DataFrame, alpha: float, support: int) -> DataFrame:
    """``rows`` (with ``text`` and ``base``) with ``spans``."""
    marked = rows.withColumn("_print", F.when(F.size("base") > 0, F.xxhash64("text")))
    some = cut(rows.where(F.size("base") > 0).select("text", "base"))
    pairs = disclosing(docs, some, alpha, support)
    named = some.select(F.xxhash64("text").alias("_print"), "text", "base", F.explode(F.array_distinct(F.transform("base", _entity))).alias("entity"))
    hits = named.join(_small(pairs), "entity").select("_print", "text", "base", "term")
    hits = hits.groupBy("_print", "term").agg(F.first("text").alias("text"), F.first("base").alias("base"))
    spans = F.filter(_term_spans(F.col("text"), F.col("term")), lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    extra = hits.select("_print", F.explode(spans).alias("s")).groupBy("_print").agg(F.collect_list("s").alias("_terms"))
    extra = cut(extra)
    known = marked.where("_print IS NOT NULL").join(_small(extra), "_print", "left")
    known = known.withColumn("spans", F.sort_array(F.concat("base", F.coalesce("_terms", F.array().cast(_SPAN))))).drop("_print", "_terms")
    return known.unionByName(marked.where("_print IS NULL").drop("_print").withColumn("spans", F.col("base")))


def report(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """``doc_id``, the counts of each base kind, and ``base`` and ``spans`` as kind:start:end lists."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("base", base_spans(F.col("text")))
    light = cut(rows.select("doc_id", F.when(F.size("base") > 0, F.col("text")).alias("text"), "base"))
    found = _with_terms(docs, light, alpha, support)
    counts = [F.size(F.filter("base", _of_kind(i))).cast("long").alias(f"n_{kind}") for i, kind in enumerate(KINDS[:4])]
    return found.select("doc_id", *counts, joined(F.col("base")).alias("base"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """The documents with every span generalised to its kind in brackets; of overlapping spans the first
    stands for all. Null texts stay null."""
    names = docs.columns
    found = find(docs.withColumn("_null", F.col("text").isNull()), alpha, support)
    labels = {i: f"[{kind.upper()}]" for i, kind in enumerate(KINDS)}
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(so_far: Column, s: Column) -> Column:
        before = F.substring(F.col("text"), so_far["at"] + 1, s["start"] - so_far["at"])
        new = F.struct(s["end"].alias("at"), F.concat(so_far["parts"], F.array(before, _named(labels, s["kind"]))).alias("parts"))
        grown = F.struct(F.greatest(so_far["at"], s["end"]).alias("at"), so_far["parts"].alias("parts"))
        return F.when(s["start"] >= so_far["at"], new).otherwise(grown)

    whole = F.aggregate("spans", start, add, lambda x: F.concat(F.array_join(x["parts"], ""), F.substring(F.col("text"), x["at"] + 1, F.length("text"))))
    text = F.when(F.col("_null"), F.lit(None).cast("string")).otherwise(F.when(F.size("spans") > 0, whole).otherwise(F.col("text")))
    return found.withColumn("text", text).select(*[F.col(f"`{c}`") for c in names])
