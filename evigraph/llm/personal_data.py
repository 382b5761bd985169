"""Personal data: fixed patterns, and identifiers that bootstrapped lexical patterns find beyond them. DataFrame operations only.

Entities of the fixed patterns are seeds. A candidate is a run of words with digits or an at sign that is shaped like an identifier (neither a
date nor an amount); the one or two words before it and after it are lexical patterns. Patterns and the values that they take in form
a graph, whose ends are scored in turn:

* the confidence of a pattern is the weight of what it takes in, by the scores of the values (a seed: 1), as a share of ALL
  occurrences of its words in the whole corpus, so that `the` or `is` stay worthless although seeds follow them; it counts from MIN_CONFIDENCE on
  and if the scores of its distinct values add up to MIN_SUPPORT, so that copies of one document are no evidence;
* the score of a value joins its best pattern before and its best pattern after as independent evidence: 1 - (1 - a)(1 - b).

After ROUNDS rounds every occurrence of a value with a score of MIN_SCORE is reported as a span of kind `found`, unless it overlaps
a base span. What the graph takes from a text depends on the text alone, so equal texts are one row with a count before anything is grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm._common import discard, materialize

#: The kinds in their order of listing.
KINDS = ("email", "ip", "card", "phone")
#: The base patterns. What they match is the contract's; the possessive quantifiers and the bounds before the first character (no
#: match starts inside a run that an earlier start has failed on) keep the search linear and off the stack.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without these characters has no match.
NEEDS = {"email": "@", "phone": "+"}
IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
CARD_DIGITS, PHONE_DIGITS = (13, 19), (9, 15)

#: Words between white space, colons and equals signs; those of a candidate have a digit or an at sign and stand next to each other.
_WORD = r"[^\s:=0-9@]*+[0-9@][^\s:=]*+"
CANDIDATE = rf"(?<![^\s:=]){_WORD}(?:\x20{_WORD})*+"
DATE = r"^(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4})$"
AMOUNT = r"^\d{1,3}(?:[,.]\d{3})*(?:[,.]\d{1,2})?$"
CONTEXT_WORD = r"[\p{L}\p{N}]+"
CONTEXT_WORDS = 2

ROUNDS, MIN_CONFIDENCE, MIN_SUPPORT, MIN_SCORE = 4, 0.5, 3, 0.6
#: Word sequences whose corpus counts are looked up in a broadcast table (8 bytes each); more of them are joined by shuffle.
BROADCAST_GRAMS = 1_000_000


def _length(x: Column) -> Column:
    return F.char_length(x).cast("long")


def _running(lengths: str) -> Column:
    """0 and the running totals of an array column. Root-n blocks: an array can't be appended to without copying it."""
    block = F.greatest(F.ceil(F.sqrt(F.size(lengths))).cast("int"), F.lit(1))
    zero = F.array(F.lit(0).cast("long"))
    inner = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(lengths), F.lit(1)), block),
        lambda k: F.aggregate(F.slice(lengths, k, block), zero, lambda seen, x: F.concat(seen, F.array(F.element_at(seen, -1) + x))),
    )
    return F.aggregate(inner, zero, lambda seen, part: F.concat(seen, F.transform(F.slice(part, 2, F.size(part)), lambda x: x + F.element_at(seen, -1))))


def _located(df: DataFrame, name: str, pattern: str, needs: str | None = None) -> DataFrame:
    """Adds {name}: array of (s, e, v) of the matches in column text, in code points; and {name}_between: the texts around them (n + 1 or none)."""
    every = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    df = df.withColumn("m", F.when(F.contains("text", F.lit(needs)), every).otherwise(F.array().cast("array<string>")) if needs else every)
    df = df.withColumn(f"{name}_between", F.when(F.size("m") > 0, F.split("text", pattern, -1)).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("sizes", F.zip_with(f"{name}_between", "m", lambda gap, m: _length(gap) + F.coalesce(_length(m), F.lit(0))))
    df = df.withColumn("ends", F.when(F.size("m") > 0, _running("sizes")))
    at = F.transform("m", lambda m, i: F.struct((F.get("ends", i + 1) - _length(m)).alias("s"), F.get("ends", i + 1).alias("e"), m.alias("v")))
    return df.withColumn(name, at).drop("m", "sizes", "ends")


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of a few digits passes the check sum."""
    back = F.reverse(digits)

    def weighed(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda total, i: total + weighed(i)) % 10 == 0


def _holds(kind: str, v: Column) -> Column:
    if kind == "ip":
        return v.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(_digits(v)).between(*CARD_DIGITS), luhn(_digits(v))).otherwise(False)
    return F.length(_digits(v)).between(*PHONE_DIGITS) if kind == "phone" else F.lit(True)


def _valid(kind: str) -> Column:
    return F.filter(kind, lambda x: _holds(kind, x["v"]))


def _spans(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat(F.lit(f"{kind}:"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string")))


def base_entities(rows: DataFrame) -> DataFrame:
    """rows, which have a column text (not null), with a column of (s, e, v) for each kind."""
    for kind in KINDS:
        rows = _located(rows, kind, PATTERNS[kind], NEEDS.get(kind)).drop(f"{kind}_between")
        rows = rows.withColumn(kind, _valid(kind))
    return rows


def _identifier(v: Column) -> Column:
    digits, letters = F.length(_digits(v)), F.length(F.regexp_replace(v, r"[^\p{L}]", ""))
    shaped = (digits >= 5) | ((digits >= 4) & (letters > 0)) | (F.contains(v, F.lit("@")) & (letters >= 2))
    return shaped & ~v.rlike(DATE) & ~v.rlike(AMOUNT)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(CONTEXT_WORD), F.lit(0))


def candidates(rows: DataFrame) -> DataFrame:
    """rows, which have a column text, with cands: (s, e, v, before, after); before and after are the patterns of an occurrence."""
    rows = _located(rows, "c", CANDIDATE).withColumn("around", F.transform("c_between", _words))

    def grams(words: Column, last: bool) -> Column:
        """The nearest word and the nearest two, where there are so many."""
        near = [F.slice(words, -k, k) if last else F.slice(words, 1, k) for k in range(1, CONTEXT_WORDS + 1)]
        return F.filter(F.array(*[F.when(F.size(words) >= k, F.concat_ws(" ", x)) for k, x in enumerate(near, 1)]), lambda x: x.isNotNull())

    def trimmed(x: Column, i: Column) -> Column:
        start = F.regexp_replace(x["v"], r"^[^\p{L}\p{N}@+#]+", "")
        v = F.reverse(F.regexp_replace(F.reverse(start), r"^[^\p{L}\p{N}]+", ""))
        s = x["e"] - _length(start)
        return F.struct(s.alias("s"), (s + _length(v)).alias("e"), v.alias("v"), grams(F.get("around", i), True).alias("before"), grams(F.get("around", i + 1), False).alias("after"))

    return rows.withColumn("cands", F.filter(F.transform("c", trimmed), lambda x: _identifier(x["v"]))).drop("c", "c_between", "around")


def _scanned(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """A written row for each document: id, counts, base spans; key, base and cands only where there are candidates."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = candidates(base_entities(docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))))
    some = F.size("cands") > 0
    plain = F.concat(*[F.transform(k, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))) for k in KINDS])
    return materialize(
        rows.select(
            "id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.concat_ws(",", *[_spans(k, F.col(k)) for k in KINDS]).alias("base_spans"),
            F.when(some, F.unhex(F.sha2(F.col("text").cast("binary"), 256))).alias("key"), F.when(some, plain).alias("base"), F.when(some, F.col("cands")).alias("cands"),
        ),
        "personal-rows",
    )


def _occurrences(scanned: DataFrame) -> DataFrame:
    """A written row for each candidate of each distinct text: key, s, e, v, before, after, n (rows that have the text), seed (it overlaps a base span)."""
    texts = scanned.where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first("base").alias("base"), F.first("cands").alias("cands"))
    none = F.array().cast("array<string>")
    base = F.transform("base", lambda b: F.struct(F.lit(True).alias("is_base"), b["s"].alias("s"), b["e"].alias("e"), F.lit("").alias("v"), none.alias("before"), none.alias("after")))
    cand = F.transform("cands", lambda c: F.struct(F.lit(False).alias("is_base"), c["s"].alias("s"), c["e"].alias("e"), c["v"].alias("v"), c["before"].alias("before"), c["after"].alias("after")))
    rows = texts.select("key", "n", F.explode(F.concat(base, cand)).alias("x")).select("key", "n", "x.*")
    own = Window.partitionBy("key")
    reached = F.max(F.when(F.col("is_base"), F.col("e"))).over(own.orderBy("s", F.desc("is_base")).rowsBetween(Window.unboundedPreceding, 0))
    coming = F.min(F.when(F.col("is_base"), F.col("s"))).over(own.orderBy(F.desc("s"), F.desc("is_base")).rowsBetween(Window.unboundedPreceding, 0))
    marked = rows.withColumn("reached", reached).withColumn("coming", coming)
    seed = F.coalesce(F.col("reached") > F.col("s"), F.lit(False)) | F.coalesce(F.col("coming") < F.col("e"), F.lit(False))
    return materialize(marked.where("NOT is_base").select("key", "n", "s", "e", "v", "before", "after", seed.alias("seed")), "personal-occurrences")


def _corpus_counts(docs: DataFrame, text_col: str, grams: DataFrame) -> DataFrame:
    """(g, total): how often the word sequences with the hashes g occur in all texts."""
    words = _words(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    texts = docs.select(words.alias("w"))
    pairs = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.size("w")), lambda a, b: F.xxhash64(F.concat_ws(" ", a, b)))
    every = texts.select(F.explode(F.concat(F.transform("w", lambda x: F.xxhash64(x)), pairs)).alias("g"))
    asked = F.broadcast(grams) if grams.count() <= BROADCAST_GRAMS else grams
    return every.join(asked, "g", "left_semi").groupBy("g").agg(F.count(F.lit(1)).alias("total"))


PATTERN_KEY = ["side", "gram"]


def _viable(docs: DataFrame, text_col: str, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph: edges (side, gram, v, n, seed) of the patterns that could be accepted if all their values were seeds, and the patterns' totals."""

    def named(side: str) -> Column:
        return F.transform(side, lambda g: F.struct(F.lit(side).alias("side"), g.alias("gram")))

    sides = F.concat(named("before"), named("after"))
    ends = seen.select("v", "n", "seed", F.explode(sides).alias("p")).select("p.side", "p.gram", "v", "n", "seed")
    edges = materialize(ends.groupBy(*PATTERN_KEY, "v").agg(F.sum("n").alias("n"), F.max("seed").alias("seed")), "personal-edges")
    stats = materialize(edges.groupBy(*PATTERN_KEY).agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("n")).where(F.col("values") >= MIN_SUPPORT).withColumn("g", F.xxhash64("gram")), "personal-patterns")
    totals = _corpus_counts(docs, text_col, stats.select("g").distinct())
    # a sequence that a candidate cuts (its own words) is not counted, so a total is no less than what the pattern takes in
    able = stats.join(totals, "g").select(*PATTERN_KEY, F.greatest("total", "n").alias("total"), "n").where(F.col("n") >= MIN_CONFIDENCE * F.col("total"))
    able = materialize(able.drop("n"), "personal-viable")
    kept = materialize(edges.join(able.select(*PATTERN_KEY), PATTERN_KEY, "left_semi"), "personal-graph")
    for done in (edges, stats):
        discard(done)
    return kept, able


def _scored(edges: DataFrame, patterns: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """The accepted patterns (side, gram, confidence, support, total) and the scores (v, score) of values beyond the seeds, after the last round."""
    values, accepted = None, None
    for k in range(rounds):
        if values is None:
            rated = edges.select(*PATTERN_KEY, "n", F.col("seed").cast("double").alias("score"))
        else:
            rated = edges.join(values, "v", "left").select(*PATTERN_KEY, "n", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"))
        mass = rated.groupBy(*PATTERN_KEY).agg(F.sum(F.col("score") * F.col("n")).alias("mass"), F.sum("score").alias("support"))
        scored = patterns.join(mass, PATTERN_KEY).withColumn("confidence", F.col("mass") / F.col("total"))
        done = [x for x in (accepted, values) if x is not None]
        accepted = materialize(scored.where((F.col("confidence") >= MIN_CONFIDENCE) & (F.col("support") >= MIN_SUPPORT)).drop("mass"), f"personal-accepted-{k}")
        best = edges.where("NOT seed").join(accepted, PATTERN_KEY).groupBy("v", "side").agg(F.max("confidence").alias("best"))
        fresh = best.groupBy("v").agg((1 - F.coalesce(F.max(F.when(F.col("side") == "before", 1 - F.col("best"))), F.lit(1.0)) * F.coalesce(F.max(F.when(F.col("side") == "after", 1 - F.col("best"))), F.lit(1.0))).alias("score"))
        values = materialize(fresh, f"personal-values-{k}")
        for x in done:
            discard(x)
    return accepted, values


def _learned(docs: DataFrame, scanned: DataFrame, text_col: str, rounds: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    seen = _occurrences(scanned)
    edges, patterns = _viable(docs, text_col, seen)
    if patterns.isEmpty():
        return seen, None, None
    accepted, values = _scored(edges, patterns, rounds)
    discard(edges)
    discard(patterns)
    return seen, accepted, values


def learn_patterns(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rounds: int = ROUNDS) -> DataFrame:
    """The accepted patterns: side (before, after), gram (one or two words), confidence, support (of distinct values), total (occurrences in the corpus)."""
    scanned = _scanned(docs, text_col, id_col)
    _, accepted, _ = _learned(docs, scanned, text_col, rounds)
    columns = ["side", "gram", "confidence", "support", "total"]
    if accepted is None:
        return docs.sparkSession.createDataFrame([], "side string, gram string, confidence double, support double, total long")
    return accepted.select(*columns)


def find_personal_data(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rounds: int = ROUNDS) -> DataFrame:
    """A row for every row of docs: the id, n_email, n_ip, n_card, n_phone, n_found, base_spans and spans.

    Spans are kind:start:end in code points, end exclusive, joined by commas, by kind in the order email, ip, card, phone, found
    and then by start. A null text counts as empty: zero counts, empty strings. Null ids are ids like others; repeated rows give repeated results, and
    a text that many rows hold is looked at once for what it teaches, counted as often as it occurs. Texts may be of any length.
    An empty table gives an empty result; other columns are not read, whatever their names.
    """
    scanned = _scanned(docs, text_col, id_col)
    seen, accepted, values = _learned(docs, scanned, text_col, rounds)
    columns = [F.col("id").alias(id_col), *[f"n_{k}" for k in KINDS]]
    plain = [*columns, F.lit(0).cast("long").alias("n_found"), "base_spans", F.col("base_spans").alias("spans")]
    if values is None:
        return scanned.select(*plain)
    hits = seen.where("NOT seed").join(values.where(F.col("score") >= MIN_SCORE), "v", "left_semi")
    lists = hits.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("found"))
    found = materialize(lists.select("key", F.size("found").cast("long").alias("n_found"), F.concat_ws(",", _spans("found", F.col("found"))).alias("more")), "personal-found")
    for done in (seen, accepted, values):
        discard(done)
    joined = scanned.where("key IS NOT NULL").join(found, "key", "left")
    more = joined.select(*columns, F.coalesce("n_found", F.lit(0).cast("long")).alias("n_found"), "base_spans", F.concat_ws(",", F.when(F.col("base_spans") != "", F.col("base_spans")), "more").alias("spans"))
    return scanned.where("key IS NULL").select(*plain).unionByName(more)
