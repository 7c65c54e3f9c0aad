"""Personal data, with DataFrame functions alone: entities by pattern, and terms that reveal them by co-occurrence.

Entities are e-mail and IP addresses, card and phone numbers. What is protected is an entity's value and what identifies a part of it: the
domain of an address, the network of an IP, the issuer of a card, the leading digits of a phone number. The words of the documents that hold
it are terms. How strongly a term reveals a protected value is its pointwise mutual information with it in the corpus over the value's
information content: log2(k N / (m d)) / log2(N / m), where of N documents m hold the value, d the term, and k both. 1 means that the term
gives the value away. In the documents that hold the value, every occurrence of a term at or above one threshold is generalised, and of
one at or above a higher threshold removed.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import col, dropped, fresh, joined, looked_up, saved

# Possessive quantifiers and look-behinds keep the leftmost matches of the plain patterns, in time linear in the text and without recursion.
# Card numbers: only runs of digits of a valid length are taken; others could not pass.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold to be searched at all.
SIGN = {"email": "@", "ip": ".", "card": None, "phone": "+"}
TERM = r"\p{L}{4,}+"
GENERALISE, REMOVE = "generalise", "remove"
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"
#: Up to so many terms or pairs, they are broadcast (some 100 bytes each); beyond, they are joined by shuffle.
BROADCAST_ROWS = 100_000


def gaps_and_hits(text: Column, matches: Column, pattern: str) -> Column:
    """Each match with the length of the text between it and the one before."""
    pairs = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)), matches, lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))
    return F.when(F.size(matches) > 0, pairs).otherwise(F.array().cast("array<struct<gap:int,hit:string>>"))


def placed(pairs: Column, kind: str, offset: Column | None = None) -> Column:
    """The matches of gaps_and_hits() with their places: start and end in code points, end exclusive.

    Chunks of 256 keep the copying of arrays small where a text has very many matches. `pairs` must be a column, not an expression.
    """

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["hit"].alias("value")))).alias("out"))

    def chunk(state: Column, i: Column) -> Column:
        inner = F.aggregate(F.slice(pairs, i + 1, F.lit(256)), F.struct(state["at"].alias("at"), F.array().cast(SPAN).alias("out")), step)
        return F.transform(F.array(inner), lambda x: F.struct(x["at"].alias("at"), F.concat(state["out"], F.array(x["out"])).alias("out")))[0]

    first = F.lit(0) if offset is None else offset.cast("int")
    chunks = F.aggregate(F.sequence(F.lit(0), F.size(pairs) - 1, F.lit(256)), F.struct(first.alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")), chunk)
    return F.when(F.size(pairs) > 0, F.flatten(chunks["out"])).otherwise(F.array().cast(SPAN))


def luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?(?:\.|$)){4}$")
    if kind == "card":
        return luhn(value)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def valid(kind: str) -> Callable[[Column], Column]:
    return lambda span: passes(kind, span["value"])


def find_entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, key (a hash of the text), text and entities (in the order of PATTERNS, then of start)."""
    rows = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    hits = rows.withColumns({kind: F.when(F.contains("text", F.lit(sign)) if sign else F.lit(True), F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0))).otherwise(none) for kind, sign in SIGN.items()})
    pairs = hits.withColumns({kind: gaps_and_hits(F.col("text"), F.col(kind), p) for kind, p in PATTERNS.items()})
    spans = pairs.withColumns({kind: F.filter(placed(F.col(kind), kind), valid(kind)) for kind in PATTERNS})
    return spans.select("id", F.xxhash64("text").alias("key"), "text", F.concat(*PATTERNS).alias("entities"))


def part_of(entity: Column) -> Column:
    """What identifies a part of an entity: the domain, the network (two numbers), the issuer (six digits) or the leading four digits."""
    kind, value = entity["kind"], F.lower(entity["value"])
    digits = F.regexp_replace(value, "[^0-9]", "")
    part = F.when(kind == "email", F.substring_index(value, "@", -1)).when(kind == "ip", F.substring_index(value, ".", 2)).otherwise(F.substring(digits, 1, F.when(kind == "card", 6).otherwise(4)))
    return F.concat(kind, F.lit(" of "), part)


def terms_of(text: Column) -> Column:
    """The distinct terms of a text: its whole runs of four letters or more, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def find_pii(docs: DataFrame, min_texts: int = 3, generalise_at: float = 0.6, remove_at: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, key (a hash of the text), entities and terms, arrays of (kind, start, end, value).

    entities: in the order email, ip, card, phone, then of start. terms: all occurrences of revealing terms outside entities, of kind
    generalise, then remove, each by start. A term reveals a protected value if they meet in min_texts different texts at least, so
    that copies of one text are no evidence, and its disclosure reaches generalise_at or remove_at.

    Edge cases: null and empty texts have no spans; null ids and repeated rows are rows like others; whole texts are searched,
    in time linear in their length but for the number of matches; a value that every document holds has no information content,
    and no term reveals it; an empty table gives an empty table; other columns are ignored.
    """
    everything = find_entities(docs, id_col, text_col)
    found = saved(everything.select("id", "key", "entities", F.when(F.size("entities") > 0, F.col("text")).alias("text")), "entities")
    n = found.count()
    values = F.array_distinct(F.concat(F.transform("entities", lambda e: F.lower(e["value"])), F.transform("entities", part_of)))
    # Rows of one text are counted together, and its words are looked at once.
    texts = saved(found.filter(F.size("entities") > 0).groupBy("key").agg(F.first("text").alias("text"), F.first("entities").alias("entities"), F.count("*").alias("copies")), "texts")
    holding = texts.select("key", "copies", F.explode(values).alias("entity"))
    # A value in fewer texts than a term needs has no revealing term; it is left out before its documents' words are paired with it.
    holders = saved(holding.groupBy("entity").agg(F.sum("copies").alias("m"), F.count("*").alias("texts")).filter(F.col("texts") >= min_texts).select("entity", "m"), "holders")
    held = looked_up(holding, holders, ["entity"], BROADCAST_ROWS).groupBy(F.col("key").alias("of")).agg(F.collect_list(F.struct("entity", "m")).alias("held"))
    words = texts.join(held, F.col("key") == F.col("of")).select("key", "copies", "held", F.explode(terms_of(F.col("text"))).alias("term"))
    near = words.select("key", "copies", "term", F.explode("held").alias("h")).select("key", "copies", "term", "h.entity", "h.m")
    pairs = near.groupBy("entity", "term").agg(F.sum("copies").alias("k"), F.first("m").alias("m"), F.count("*").alias("texts")).filter(F.col("texts") >= min_texts)
    pairs = saved(pairs, "pairs")
    terms = saved(pairs.select("term").distinct(), "terms")
    # Terms are whole runs of letters here too, so that d counts at least the documents that k counts.
    words = docs.select(F.explode(terms_of(col(text_col).cast("string"))).alias("term"))
    if terms.count() <= BROADCAST_ROWS:
        words = words.join(F.broadcast(terms), "term", "left_semi")
    documents = words.groupBy("term").agg(F.count("*").alias("d"))  # joined to the pairs below, after it is summed
    weight = F.log2(F.col("k") * float(n) / (F.col("m") * F.greatest("d", "k"))) / F.log2(float(n) / F.col("m"))
    revealing = saved(pairs.join(documents, "term").select("entity", "term", weight.alias("disclosure")).filter(F.col("disclosure") >= generalise_at), "revealing")
    flagged = looked_up(near, revealing, ["entity", "term"], BROADCAST_ROWS).groupBy("key", "term").agg(F.max("disclosure").alias("disclosure"))
    flags = flagged.groupBy(F.col("key").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("flags"))
    told = texts.join(flags, F.col("key") == F.col("of")).withColumn("hits", F.regexp_extract_all("text", F.lit(TERM), F.lit(0))).withColumn("pairs", gaps_and_hits(F.col("text"), F.col("hits"), TERM))
    spans = F.filter(placed(F.col("pairs"), "term"), lambda t: F.element_at("flags", F.lower(t["value"])).isNotNull() & ~F.exists("entities", lambda e: (e["start"] < t["end"]) & (e["end"] > t["start"])))
    kind = lambda t: F.when(F.element_at("flags", F.lower(t["value"])) >= remove_at, REMOVE).otherwise(GENERALISE)
    marked = F.transform(spans, lambda t: F.struct(kind(t).alias("kind"), t["start"].alias("start"), t["end"].alias("end"), F.lower(t["value"]).alias("value")))
    own = saved(told.select("key", F.sort_array(marked).alias("terms")), "told")
    dropped(docs.sparkSession, texts, holders, pairs, terms, revealing)
    out = found.drop("text")
    if own.count() <= BROADCAST_ROWS:
        with_terms = out.join(F.broadcast(own), "key", "left")
    else:  # rows without a flagged term, nearly all, need no join; those with one may be copies of one text
        told_keys = own.select("key")
        with_terms = joined(out.join(told_keys, "key", "left_semi"), own, ["key"]).unionByName(out.join(told_keys, "key", "left_anti").withColumn("terms", F.lit(None).cast(SPAN)))
    return with_terms.select(F.col("id").alias(id_col), "key", "entities", F.coalesce("terms", F.array().cast(SPAN)).alias("terms"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """`docs` with entities replaced by [EMAIL], [IP], [CARD] and [PHONE], generalised terms by [TERM], and removed terms left out.

    Of spans that overlap, the first by start, the longest first, stands; one that reaches beyond it is replaced from there on by a mark
    of its own, and one within it has no mark. Settings: those of find_pii(). Null texts stay null.
    """
    spans, of, key = fresh(docs, "pii_spans"), fresh(docs, "pii_of"), fresh(docs, "pii_key")
    found = find_pii(docs, id_col=id_col, text_col=text_col, **settings).select(col(id_col).alias(of), F.col("key").alias(key), F.concat("entities", "terms").alias(spans))
    found = found.filter(F.size(spans) > 0).dropDuplicates([of, key])
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    joined = docs.join(found, col(id_col).eqNullSafe(F.col(of)) & (F.xxhash64(text) == F.col(key)), "left")
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"))))

    def step(state: Column, s: Column) -> Column:
        mark = F.when(s["kind"] == REMOVE, "").when(s["kind"] == GENERALISE, "[TERM]").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        piece = F.concat(F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0))), mark)
        fits = -s["end"] > state["at"]
        return F.struct(F.when(fits, -s["end"]).otherwise(state["at"]).alias("at"), F.when(fits, F.concat(state["out"], F.array(piece))).otherwise(state["out"]).alias("out"))

    state = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step)
    done = F.concat(F.array_join(state["out"], ""), F.substring(text, state["at"] + 1, F.length(text)))
    return joined.select(*[F.when(F.col(spans).isNull(), col(c)).otherwise(done).alias(c) if c == text_col else col(c) for c in docs.columns])
