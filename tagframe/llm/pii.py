"""Information-theoretic sanitisation of personal data.

Protected entities are the e-mail addresses, IP addresses, card numbers and phone
numbers that patterns find (``base`` spans). Which other terms give an entity
away is estimated from the corpus: for a term t that stands in the context of an
entity e (so many code points on either side),

    PMI(e; t) = log P(e | t) / P(e),      IC(e) = -log P(e)

with document frequencies over all documents. A term is disclosing if its PMI is
at least ``disclosure`` times IC(e), that is P(e | t) >= P(e) ** (1 - disclosure),
and if it stands in at least ``support`` different contexts of e (so copies of one
document prove nothing). Everywhere in the documents that hold e, near it or not, it
then gets a span of kind ``term``: generalised to its class, or, at ``removal`` times
IC(e), removed.

Everything is DataFrame functions. Only documents with base spans enter the
co-occurrence; its pairs grow with the number of spans, as contexts have a fixed
width (all pairs of a document's entities and terms would grow with the square of its
length; a term that stands far from an entity in all documents is not assessed). Term
frequencies are summed before they are shuffled. Disclosing pairs meet documents by
their terms: P(e | t) beyond the threshold leaves a term few entities, while an entity
may have very many documents. Documents are matched with their term spans by doc_id
and a hash of the text.

Inputs: null text counts as empty; repeated rows each get the spans of their text;
null doc_ids are ids like any other; an empty table gives no rows; other columns
are ignored by spans() and kept by sanitise().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagframe.llm import common
from tagframe.llm.common import let

#: Fixed patterns, written so that the JVM's matcher neither backtracks nor recurses
#: on long runs: possessive where nothing could be given back, and started only where
#: a run starts or the last match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: A document without these has no match: cheaper than matching.
HINTS = {
    "email": r"@[A-Za-z0-9-]++\.[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){15}",
    "phone": r"\+[0-9]",
}

OCTET = "0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
KINDS = tuple(PATTERNS)
CLASSES = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}

CONTEXT, SUPPORT, DISCLOSURE, REMOVAL = 80, 2, 0.9, 0.98
#: A term: three letters or more between white space, apart from punctuation behind it.
TERM = r"(?<![^\x20\x09-\x0D])\p{L}{3,}+(?=[.,;:!?]*+(?:[\x20\x09-\x0D]|$))"

SPAN = "struct<kind:string,start:int,end:int,value:string>"


def luhn(digits: Column) -> Column:
    """Whether a string of 16 to 19 digits has a valid check digit."""
    reverse = F.split(F.reverse(digits), "")

    def counted(d: Column, i: Column) -> Column:
        n = d.cast("int") * (1 + i % 2)
        return F.when(n > 9, n - 9).otherwise(n)

    total = F.aggregate(F.transform(F.filter(reverse, lambda d: d != ""), counted), F.lit(0), lambda s, x: s + x)
    return total % 10 == 0


def valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(match) > 37, F.lit(False)).otherwise(F.length(digits).between(16, 19) & luhn(digits))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def matches(text: Column, pattern: str, kind: str, accept) -> Column:
    """array<SPAN> of the accepted matches; positions are sums over matches and the gaps before them."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    gaps = F.split(text, pattern, -1)
    none = F.array().cast(f"array<{SPAN}>")

    def add(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["match"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), pair["match"].alias("value"))
        return F.struct(end.alias("at"), F.when(accept(pair["match"]), F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    pairs = let(found, lambda m: F.zip_with(F.slice(gaps, 1, F.greatest(F.size(m), F.lit(0))), m, lambda g, x: F.struct(g.alias("gap"), x.alias("match"))))
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    return F.aggregate(pairs, start, add, lambda s: s["spans"])


def base_spans(text: Column) -> Column:
    """array<SPAN> of the protected entities, by kind as listed, then start."""
    none = F.array().cast(f"array<{SPAN}>")
    return F.concat(*[F.when(text.rlike(HINTS[k]), matches(text, PATTERNS[k], k, lambda m, k=k: valid(k, m))).otherwise(none) for k in KINDS])


def contexts(found: DataFrame, width: int = CONTEXT) -> DataFrame:
    """(id, text_hash, entity, context, term, start, end) for the terms beside each base span of ``found`` (id, text_hash, text, spans)."""
    cut = "\u0001"  # no white space: what touches it is no whole term
    s = found.select("id", "text_hash", "text", F.explode("spans").alias("s"))
    start, end, n = F.col("s.start"), F.col("s.end"), F.length("text")
    left_at = F.greatest(start - width, F.lit(0))
    right_end = F.least(end + width, n)
    left = F.concat(F.when(left_at > 0, F.lit(cut)).otherwise(F.lit(" ")), F.substring(F.col("text"), left_at + 1, start - left_at), F.lit(cut))
    right = F.concat(F.lit(cut), F.substring(F.col("text"), end + 1, right_end - end), F.when(right_end < n, F.lit(cut)).otherwise(F.lit(" ")))
    sides = F.array(F.struct(left.alias("side"), (left_at - 1).alias("shift")), F.struct(right.alias("side"), (end - 1).alias("shift")))
    s = s.select(
        "id",
        "text_hash",
        F.xxhash64(F.col("s.kind"), F.lower("s.value")).alias("entity"),
        F.xxhash64(left, right).alias("context"),
        F.explode(sides).alias("x"),
    )
    s = s.select("id", "text_hash", "entity", "context", F.col("x.shift").alias("shift"), F.explode(matches(F.col("x.side"), TERM, "term", lambda m: F.lit(True))).alias("t"))
    return s.select(
        "id", "text_hash", "entity", "context",
        F.lower("t.value").alias("term"), F.col("t.value").alias("value"),
        (F.col("t.start") + F.col("shift")).alias("start"), (F.col("t.end") + F.col("shift")).alias("end"),
    )


def prepared(docs: DataFrame) -> DataFrame:
    text = common.text_or_empty()
    return docs.select(F.col("doc_id").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def terms_of(text: Column) -> Column:
    """The distinct terms of a whole text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), 0), lambda w: F.lower(w)))


def holders(found: DataFrame) -> DataFrame:
    """(id, text_hash, entity): which documents hold which entities."""
    entities = F.array_distinct(F.transform("spans", lambda s: F.xxhash64(s["kind"], F.lower(s["value"]))))
    return found.select("id", "text_hash", F.explode(entities).alias("entity"))


def disclosing(docs: DataFrame, near: DataFrame, held: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE, removal: float = REMOVAL) -> DataFrame:
    """(entity, term, removed) of the terms beyond the threshold; ``near`` is contexts() and ``held`` holders() of ``docs``."""
    pairs = near.groupBy("entity", "term").agg(F.count_distinct("id", "text_hash").alias("n_both"), F.count_distinct("context").alias("n_contexts")).where(F.col("n_contexts") >= support)
    entities = held.groupBy("entity").agg(F.count_distinct("id", "text_hash").alias("n_entity"))
    n_term = docs.select(F.explode(terms_of(common.text_or_empty())).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    n_docs = docs.agg(F.count("*").alias("n_docs"))
    joined = pairs.join(entities, "entity").join(n_term, "term").join(F.broadcast(n_docs))  # one row
    p_entity = F.col("n_entity") / F.col("n_docs")
    p_given = F.least(F.col("n_both") / F.col("n_term"), F.lit(1.0))
    return joined.where(p_given >= F.pow(p_entity, F.lit(1 - disclosure))).select("entity", "term", (p_given >= F.pow(p_entity, F.lit(1 - removal))).alias("removed"))


def term_spans(docs: DataFrame) -> DataFrame:
    """(id, text_hash, terms) for documents with disclosing terms; terms is array<struct<start,end,value,removed>>."""
    found = prepared(docs).withColumn("spans", base_spans(F.col("text"))).where(F.size("spans") > 0)
    found = common.stage(found, "pii-documents")
    near, held = common.stage(contexts(found), "pii-contexts"), holders(found)
    beyond = common.stage(disclosing(docs, near, held), "pii-disclosing")
    own = found.select("id", "text_hash", F.explode(terms_of(F.col("text"))).alias("term"))
    met = own.join(beyond, "term")
    # Ids may be null: equal then, too.
    held = held.withColumnsRenamed({"id": "h_id", "text_hash": "h_hash", "entity": "h_entity"})
    met = met.join(held, F.col("id").eqNullSafe(F.col("h_id")) & (F.col("text_hash") == F.col("h_hash")) & (F.col("entity") == F.col("h_entity")), "left_semi")
    # At most the terms of one document.
    met = met.groupBy("id", "text_hash", "term").agg(F.max("removed").alias("removed")).groupBy("id", "text_hash")
    met = met.agg(F.map_from_entries(F.collect_list(F.struct("term", "removed"))).alias("marks")).withColumnsRenamed({"id": "m_id", "text_hash": "m_hash"})
    joined = found.dropDuplicates(["id", "text_hash"]).join(met, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("text_hash") == F.col("m_hash")))

    def marked(text: Column, marks: Column) -> Column:
        hit = F.filter(matches(text, TERM, "term", lambda m: F.lit(True)), lambda t: F.map_contains_key(marks, F.lower(t["value"])))
        return F.transform(hit, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["value"].alias("value"), F.element_at(marks, F.lower(t["value"])).alias("removed")))

    return joined.select("id", "text_hash", marked(F.col("text"), F.col("marks")).alias("terms"))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, base and terms of every document."""
    base = prepared(docs).select("id", "text_hash", base_spans(F.col("text")).alias("base"))
    terms = term_spans(docs).withColumnsRenamed({"id": "t_id", "text_hash": "t_hash"})
    joined = base.join(terms, F.col("id").eqNullSafe(F.col("t_id")) & (F.col("text_hash") == F.col("t_hash")), "left")
    none = F.array().cast("array<struct<start:int,end:int,value:string,removed:boolean>>")
    return joined.select(F.col("id").alias("doc_id"), "base", F.coalesce("terms", none).alias("terms"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(docs: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the base spans and the list of all spans of every document."""
    s = spans(docs)
    as_terms = F.transform("terms", lambda t: F.struct(F.lit("term").alias("kind"), t["start"].alias("start"), t["end"].alias("end")))
    plain = F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end")))
    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return s.select(
        "doc_id",
        *[number(k) for k in KINDS],
        F.sha2(listed(plain).cast("binary"), 256).alias("base_sha256"),
        listed(F.concat(plain, as_terms)).alias("spans"),
        F.size("terms").cast("long").alias("n_term"),
    )


def sanitised(text: Column, base: Column, terms: Column) -> Column:
    """The text with its spans replaced; of overlapping spans the first, and of those the longest, counts."""
    named = F.transform(base, lambda b: F.struct(b["start"].alias("start"), (-b["end"]).alias("until"), F.element_at(F.create_map(*[F.lit(x) for p in CLASSES.items() for x in p]), b["kind"]).alias("put")))

    def put(t: Column) -> Column:
        kept = F.when(t["value"].rlike(r"^\p{Lu}"), F.lit("[NAME]")).otherwise(F.lit("[TERM]"))
        return F.struct(t["start"].alias("start"), (-t["end"]).alias("until"), F.when(t["removed"], F.lit("")).otherwise(kept).alias("put"))

    every = F.array_sort(F.concat(named, F.transform(terms, put)))

    def add(state: Column, s: Column) -> Column:
        part = F.concat(F.substring(text, state["at"] + 1, s["start"] - state["at"]), s["put"])
        taken = F.struct((-s["until"]).alias("at"), F.concat(state["parts"], F.array(part)).alias("parts"))
        return F.when(s["start"] < state["at"], state).otherwise(taken)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    return F.aggregate(every, start, add, lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(text, s["at"] + 1, F.length(text))))


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents with personal data and disclosing terms replaced; the rest stays as it is.

    Only documents with base spans meet the term spans; the others pass through without an exchange.
    """
    base, hash_, t_id, t_hash, terms = common.free_names(docs, "base", "hash", "t_id", "t_hash", "terms")
    rows = docs.withColumn(base, base_spans(common.text_or_empty()))
    clean = rows.where(F.size(base) == 0).drop(base)
    found = rows.where(F.size(base) > 0).withColumn(hash_, F.xxhash64("text"))
    marked = term_spans(docs).withColumnsRenamed({"id": t_id, "text_hash": t_hash, "terms": terms})
    joined = found.join(marked, F.col("doc_id").eqNullSafe(F.col(t_id)) & (F.col(hash_) == F.col(t_hash)), "left")
    none = F.array().cast("array<struct<start:int,end:int,value:string,removed:boolean>>")
    done = joined.withColumn("text", sanitised(F.col("text"), F.col(base), F.coalesce(terms, none)))
    return clean.unionByName(done.select(*docs.columns))
