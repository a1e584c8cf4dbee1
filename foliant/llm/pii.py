"""Personal data: pattern spans, and terms that disclose them by corpus co-occurrence. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm.common import cut, free, sized

#: Kinds in the order of a result's spans; "term" is what the co-occurrence method adds.
KINDS = ("email", "ip", "card", "phone", "term")
#: The patterns, with possessive repeats and starts only at the head of a run (or where the last match ended),
#: which finds the same leftmost matches in linear time.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
_GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": "+"}
_WORD = r"[\p{L}\p{N}]+"


def _matches(text: Column, kind: str, context: int) -> Column:
    """Array of (kind, i, gap, value, before, after): gap is the length of the text since the last match."""
    pattern = F.lit(PATTERNS[kind])
    gate = F.contains(text, F.lit(_GATES[kind])) if len(_GATES[kind]) == 1 else text.rlike(_GATES[kind])
    pieces = F.when(gate, F.split(text, PATTERNS[kind], -1)).otherwise(F.array().cast("array<string>"))
    found = F.when(gate, F.regexp_extract_all(text, pattern, 0)).otherwise(F.array().cast("array<string>"))
    gaps = F.transform(pieces, lambda p: F.struct(F.length(p).alias("gap"), F.right(p, F.lit(context)).alias("before"), F.left(p, F.lit(context)).alias("head")))
    tails = F.slice(gaps, F.lit(2), F.greatest(F.size(gaps) - 1, F.lit(0)))
    zipped = F.arrays_zip(F.slice(gaps, F.lit(1), F.greatest(F.size(gaps) - 1, F.lit(0))).alias("g"), found.alias("m"), tails.alias("n"))
    return F.transform(zipped, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["g"]["gap"].alias("gap"), x["m"].alias("value"), x["g"]["before"].alias("before"), x["n"]["head"].alias("after")))


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return total + F.when(i % 2 == 0, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _holds(kind: Column, value: Column) -> Column:
    """Whether a match passes its kind's test."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", F.forall(parts, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False)))
        .when(kind == "card", F.when(n.between(13, 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(9, 15))
    )


def rows_of(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text_hash, text): rows numbered by their place in the table; a null text is empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), "text")


def find_base(docs: DataFrame, context: int = 100) -> DataFrame:
    """(row, doc_id, text_hash, kind, start, end, value, before, after): one line for each match that passes its
    test, and one with a null kind for each row of docs, so that no row is lost. Positions are code points.

    Matches are cut out and counted along the row, so a text with very many of them costs in proportion.
    """
    rows = rows_of(docs)
    none = F.lit(None)
    own = F.array(F.struct(none.cast("string").alias("kind"), F.lit(0).alias("i"), none.cast("int").alias("gap"), none.cast("string").alias("value"), none.cast("string").alias("before"), none.cast("string").alias("after")))
    parts = rows.select("row", "doc_id", "text_hash", F.explode_outer(F.concat(own, *(_matches(F.col("text"), k, context) for k in PATTERNS))).alias("m")).select("row", "doc_id", "text_hash", "m.*")
    end = F.expr("sum(gap + length(value)) over (partition by row, kind order by i rows between unbounded preceding and current row)")
    placed = parts.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))
    return placed.where(F.col("kind").isNull() | _holds(F.col("kind"), F.col("value"))).select("row", "doc_id", "text_hash", "kind", "start", "end", "value", "before", "after")


def _context_words(side: Column, whole: Column, at: Column, before: bool, context: int) -> Column:
    """Array of (term, start, end) of the whole words of one side of a match."""
    words, gaps = F.regexp_extract_all(side, F.lit(_WORD), 0), F.split(side, _WORD, -1)
    sizes = F.arrays_zip(F.transform(gaps, F.length).alias("g"), F.transform(words, F.length).alias("w"))
    ends = F.transform(words, lambda w, i: F.aggregate(F.slice(sizes, F.lit(1), i + 1), F.lit(0), lambda a, s: a + s["g"] + s["w"]))
    spans = F.transform(F.arrays_zip(words.alias("w"), ends.alias("e")), lambda x: F.struct(F.lower(x["w"]).alias("term"), (at + x["e"] - F.length(x["w"])).alias("start"), (at + x["e"]).alias("end")))
    cut_off = F.length(side) >= context
    return F.filter(spans, lambda s: ~(cut_off & ((s["start"] == at) if before else (s["end"] == at + F.length(side)))))


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_WORD), 0))


def disclosures(docs: DataFrame, base: DataFrame, context: int = 100, support: int = 2, least: float = 0.8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """How much each candidate term gives away of an entity: (term, entity, disclosure) from ``least`` on;
    (row, entity); and the terms' places beside entities (row, doc_id, text_hash, term, entity, start, end).

    An entity is a distinct value of a base span. Candidates are words within ``context`` characters of an entity, in
    ``support`` distinct contexts at least, so copies of one text are no evidence. For these,
    disclosure = PMI(t, e) / IC(e) with PMI = log2(n(t, e) N / (n(t) n(e))) and IC = log2(N / n(e)); every n counts the
    documents of the whole corpus that hold the term, the entity or both anywhere, so both sides of the ratio count
    alike. 1 says that t stands in no document without e.

    n(t, e) is at most n(t) and n(e), which bounds the disclosure before pairs are counted: frequent words fall out
    there, and only occurrences of the words left are shuffled. n(t) itself leaves a task as one number for each word.
    """
    entities = base.where("kind is not null").withColumn("entity", F.xxhash64("kind", F.lower("value")))
    sides = F.concat(
        _context_words(F.col("before"), F.col("before"), (F.col("start") - F.length("before")).cast("int"), True, context),
        _context_words(F.col("after"), F.col("after"), F.col("end").cast("int"), False, context),
    )
    near = entities.select("row", "doc_id", "text_hash", "entity", F.xxhash64(F.lower("before"), F.lower("after")).alias("place"), F.explode_outer(sides).alias("s"))
    near = near.where("s is not null").select("row", "doc_id", "text_hash", "entity", "place", F.col("s.term").alias("term"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    seen = near.select("term", "entity", "place").distinct().groupBy("term", "entity").agg(F.count("*").alias("places"))
    pairs = cut(seen.where(F.col("places") >= support).select("term", "entity"))
    each = rows_of(docs).select("row", F.explode_outer(_words(F.col("text"))).alias("term")).where("term is not null")
    wanted = sized(cut(pairs.select("term").distinct()), 200_000)
    n_term = each.join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_term"))
    with_entity = cut(entities.select("row", "entity").distinct())
    n_entity = with_entity.groupBy("entity").agg(F.count("*").alias("n_entity"))
    n = float(max(base.where("kind is null").count(), 1))

    def ratio(both: Column) -> Column:
        return F.log2(both * n / (F.col("n_term") * F.col("n_entity"))) / F.log2(n / F.col("n_entity"))

    known = pairs.join(n_term, "term").join(n_entity, "entity").where(F.col("n_entity") < n)
    likely = cut(known.where(ratio(F.least("n_term", "n_entity")) >= least))
    held = cut(each.join(sized(cut(likely.select("term").distinct()), 200_000), "term", "left_semi"))
    met = held.join(likely.select("term", "entity"), "term").join(with_entity, ["row", "entity"], "left_semi")
    n_pair = met.groupBy("term", "entity").agg(F.count("*").alias("n_pair"))
    found = likely.join(n_pair, ["term", "entity"]).withColumn("disclosure", ratio(F.col("n_pair"))).where(F.col("disclosure") >= least)
    return cut(found.select("term", "entity", "disclosure")), with_entity, near.drop("place")


def disclosing_terms(docs: DataFrame, base: DataFrame, context: int = 100, support: int = 2, threshold: float = 0.8) -> DataFrame:
    """(row, doc_id, text_hash, start, end, disclosure): occurrences of terms that give away an entity of their text.

    A term whose disclosure of an entity reaches the threshold is marked wherever it stands as a word in a text that
    holds this entity, however far from it. See disclosures().
    """
    strong, with_entity, near = disclosures(docs, base, context, support, threshold)
    strong = sized(strong, 200_000)
    beside = near.join(strong, ["term", "entity"]).select("row", "doc_id", "text_hash", "start", "end", "disclosure")
    asked = with_entity.join(strong, "entity").groupBy("row", "term").agg(F.max("disclosure").alias("disclosure"))
    rows = rows_of(docs).join(sized(cut(asked), 200_000), "row")
    word = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])\Q"), "term", F.lit(r"\E(?![\p{L}\p{N}])"))
    pieces = rows.select("row", "doc_id", "text_hash", "term", "disclosure", F.posexplode(F.split("text", word, F.lit(-1))).alias("i", "piece"))
    upto = Window.partitionBy("row", "term").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = pieces.withColumn("start", (F.sum(F.length("piece")).over(upto) + F.col("i") * F.length("term")).cast("int"))
    last = F.max("i").over(Window.partitionBy("row", "term"))
    placed = placed.withColumn("last", last).where("i < last").withColumn("end", (F.col("start") + F.length("term")).cast("int"))
    every = beside.unionByName(placed.select(*beside.columns))
    return every.groupBy("row", "doc_id", "text_hash", "start", "end").agg(F.max("disclosure").alias("disclosure"))


def find_spans(docs: DataFrame, context: int = 100, support: int = 2, threshold: float = 0.8) -> DataFrame:
    """(doc_id, text_hash, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans) for every row of docs (doc_id, text).

    Base spans are the leftmost non-overlapping matches of each kind that pass its test; the co-occurrence
    method adds spans of kind "term". base_sha256 is of the base spans, ``kind:start:end`` joined by commas in
    the order of KINDS, then by start; spans has all of them, joined likewise. Null texts count as empty;
    repeated rows and rows without doc_id are rows of their own. Other columns are ignored; no row in, no row out.
    """
    base = cut(find_base(docs, context))
    terms = disclosing_terms(docs, base, context, support, threshold).select("row", "doc_id", "text_hash", F.lit("term").alias("kind"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    spans = base.select("row", "doc_id", "text_hash", "kind", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).unionByName(terms)
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    item = F.when(F.col("kind").isNotNull(), F.struct(order.alias("k"), "start", "end", F.concat_ws(":", "kind", "start", "end").alias("s")))
    grouped = spans.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("text_hash").alias("text_hash"), *(F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in KINDS), F.array_sort(F.collect_list(item)).alias("all"))
    joined = lambda a: F.array_join(F.transform(a, lambda s: s["s"]), ",")
    return grouped.select("doc_id", "text_hash", *(f"n_{k}" for k in KINDS), F.sha2(joined(F.filter("all", lambda s: s["k"] < len(KINDS))), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"))


def sanitise(docs: DataFrame, context: int = 100, support: int = 2, threshold: float = 0.8, generalise: bool = False) -> DataFrame:
    """docs with the column text rewritten: a base span becomes [EMAIL], [IP], [CARD] or [PHONE], a disclosing
    term [TERM], or, generalised, the class that its shape has in common with others: [NUMBER], [NAME] (an upper-case
    letter first) or [WORD]. Of overlapping spans, the first (then the longest) is replaced and the others fall in with it.

    All other columns and rows stay as they are; null texts stay null.
    """
    own_id, own_hash, own_spans, own_key = free(docs.columns, "own_id", "own_hash", "own_spans", "own_key")
    found = find_spans(docs, context, support, threshold).where("spans != ''").groupBy(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash)).agg(F.first("spans").alias(own_spans))
    parsed = F.array_sort(F.transform(F.split(own_spans, ","), lambda s: F.struct(F.split(s, ":")[1].cast("int").alias("start"), (-F.split(s, ":")[2].cast("int")).alias("minus_end"), F.split(s, ":")[0].alias("kind"))))
    text = F.col("text").cast("string")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(state: Column, s: Column) -> Column:
        kind = F.upper(s["kind"])
        if generalise:
            word = F.substring(text, s["start"] + 1, -s["minus_end"] - s["start"])
            shape = F.when(word.rlike("^[0-9]+$"), "NUMBER").when(word.rlike(r"^\p{Lu}"), "NAME").otherwise("WORD")
            kind = F.when(s["kind"] == "term", shape).otherwise(kind)
        mark = F.concat(F.lit("["), kind, F.lit("]"))
        more = F.struct((-s["minus_end"]).alias("at"), F.concat(state["parts"], F.array(F.substring(text, state["at"] + 1, s["start"] - state["at"]), mark)).alias("parts"))
        return F.when(s["start"] >= state["at"], more).otherwise(F.struct(F.greatest(state["at"], -s["minus_end"]).alias("at"), state["parts"].alias("parts")))

    rewritten = F.aggregate(parsed, zero, add, lambda state: F.concat(F.array_join(state["parts"], ""), F.substring(text, state["at"] + 1, F.length(text))))
    keyed = docs.withColumn(own_key, F.xxhash64(F.coalesce(text, F.lit(""))))
    joined = keyed.join(found, keyed[own_key].eqNullSafe(found[own_hash]) & keyed["doc_id"].cast("long").eqNullSafe(found[own_id]), "left")
    return joined.withColumn("text", F.when(F.col(own_spans).isNotNull(), rewritten).otherwise(text)).select(*docs.columns)
