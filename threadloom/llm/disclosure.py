"""Personal data, and terms that reveal it.

Spans of fixed shape (e-mail, IP address, card, phone) are found in every text. Their
values are protected entities. How strongly a term reveals one is estimated from the
corpus, over the places of terms: with N places, n(t) of them holding a term t, and m(e)
within reach of a mention of an entity e, PMI(t; e) = log2(n(t, e) N / (n(t) m(e))), and
the entity's information is IC(e) = log2(N / m(e)). Where PMI / IC reaches a threshold,
knowing the term gives away that share of the entity; in every text that mentions the
entity the term is then generalised, or from a higher threshold on removed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import beside, size_checked, stored
from .spans import PLACES, as_text, count_where, match_spans, replaced, with_kind

KINDS = ("email", "ip", "card", "phone")
#: Each is written so that a failed start is not tried again inside the same run, which
#: keeps the search linear and finds the same leftmost matches as the plain patterns.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_IP = rf"^{_PART}(?:\.{_PART}){{3}}$"

#: What cuts terms from each other.
_CUT = r"[\x20\x09-\x0D.,;:!?\"'()\[\]]"


@dataclass(frozen=True)
class Disclosure:
    """Thresholds of the method."""

    generalise: float = 0.7
    remove: float = 0.9
    #: Terms and mentions on either side of a mention that are within its reach.
    reach: int = 8
    #: Different surroundings in which an entity and a term must meet; fewer are no evidence.
    contexts: int = 3
    #: Bits that an entity must carry; one that stands everywhere identifies nobody.
    least_bits: float = 6.0
    #: Characters of the shortest term considered.
    shortest: int = 2


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def step(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Places of each kind; matches that fail its further condition are dropped."""
    none = F.array().cast(PLACES)
    place = {k: match_spans(text, F.lit(PATTERNS[k])) for k in KINDS}
    return {
        "email": F.when(F.contains(text, F.lit("@")), place["email"]).otherwise(none),
        "ip": F.filter(place["ip"], lambda p: p["value"].rlike(_IP)),
        "card": F.filter(place["card"], lambda p: F.when(F.length(_digits(p["value"])).between(16, 19), luhn(_digits(p["value"]))).otherwise(False)),
        "phone": F.when(F.contains(text, F.lit("+")), F.filter(place["phone"], lambda p: F.length(_digits(p["value"])).between(8, 15))).otherwise(none),
    }


def _words(text: Column) -> Column:
    return F.split(F.lower(text), _CUT + "+", -1)


def _entity(s: Column) -> Column:
    return F.concat_ws(":", s["kind"], F.when(s["kind"] == "email", F.lower(s["value"])).otherwise(_digits(s["value"])))


def _tokens(texts: DataFrame, rules: Disclosure) -> DataFrame:
    """(text_key, times, start, end, entity, value, term): mentions and terms of each text.

    A term that meets a mention is left out: seen from the left, one that starts before
    the end of an earlier mention; from the right, one that ends behind the start of a later.
    """
    mentions = F.transform("base", lambda s: F.struct(s["start"], s["end"], _entity(s).alias("entity"), F.lit(None).cast("string").alias("value")))
    places = F.filter(match_spans(F.col("text"), F.lit(_NOT_CUT + "+")), lambda p: F.length(p["value"]) >= rules.shortest)
    terms = F.transform(places, lambda p: F.struct(p["start"], p["end"], F.lit(None).cast("string").alias("entity"), p["value"]))
    rows = texts.select("text_key", "times", F.explode_outer(F.concat(mentions, terms)).alias("x")).select("text_key", "times", "x.*")
    mention = F.col("entity").isNotNull()
    before = W.partitionBy("text_key").orderBy("start", F.col("entity").isNull()).rowsBetween(W.unboundedPreceding, 0)
    after = W.partitionBy("text_key").orderBy(F.col("start").desc(), F.col("entity").isNull()).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.max(F.when(mention, F.col("end"))).over(before)).withColumn("from", F.min(F.when(mention, F.col("start"))).over(after))
    apart = mention | ((F.coalesce("upto", F.lit(0)) <= F.col("start")) & (F.coalesce("from", F.lit(2**31 - 1)) >= F.col("end")))
    return rows.filter(apart).drop("upto", "from").withColumn("term", F.lower("value"))


def revealing_terms(found: DataFrame, rules: Disclosure) -> DataFrame | None:
    """(text_key, terms): spans of revealing terms for each distinct text that has some.

    ``found`` has text, text_key and base (the base spans). None if no term qualifies.
    Each mention meets at most twice ``rules.reach`` terms, so pairs grow with the input.
    """
    texts = found.filter(F.size("base") > 0).groupBy("text_key").agg(F.count(F.lit(1)).alias("times"), F.first("text").alias("text"), F.first("base").alias("base"))
    texts = stored(texts, "texts-with-entities")
    near = W.partitionBy("text_key").orderBy("start", F.col("entity").isNull()).rowsBetween(-rules.reach, rules.reach)
    mentions = _tokens(texts, rules).withColumn("around", F.array_distinct(F.collect_list("term").over(near))).filter("entity is not null")
    mentions = stored(mentions.select("text_key", "times", "entity", "around", F.xxhash64("around").alias("context")), "mentions")

    entities = mentions.groupBy("entity").agg(F.sum("times").alias("n_entity"), F.count_distinct("context").alias("contexts")).filter(F.col("contexts") >= rules.contexts)
    entities = stored(entities.select("entity", "n_entity"), "entities")
    if not entities.take(1):
        return None
    met = mentions.join(size_checked(entities, 24, ["entity"]), "entity").select("entity", "n_entity", "times", "context", F.explode("around").alias("term"))
    together = met.groupBy("entity", "term", "n_entity").agg(F.sum("times").alias("n_both"), F.count_distinct("context").alias("contexts"))
    together = stored(together.filter(F.col("contexts") >= rules.contexts).drop("contexts"), "pairs")
    asked = stored(together.select("term").distinct(), "asked-terms")

    long_enough = lambda t: F.length(t) >= rules.shortest
    total = float(found.agg(F.sum(F.size(F.filter(_words(F.col("text")), long_enough)))).first()[0] or 1)
    said = found.select(F.explode_outer(_words(F.col("text"))).alias("term"))
    counts = stored(said.join(size_checked(asked, 16, ["term"]), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n_term")), "term-counts")
    reached = F.least(F.lit(1.0), F.col("n_entity") * (2.0 * rules.reach) / total)
    bits = -F.log2(reached)
    share = 1 + F.log2(F.least(F.lit(1.0), F.col("n_both") / F.col("n_term"))) / F.nullif(bits, F.lit(0.0))
    judged = together.join(size_checked(counts, 24, ["term"]), "term").filter(bits >= rules.least_bits).filter(share >= rules.generalise)
    judged = stored(judged.select("entity", "term", (share >= rules.remove).alias("remove")), "revealing")
    if not judged.take(1):
        return None
    of_text = mentions.select("text_key", "entity").distinct().join(size_checked(judged, 24, ["entity", "term"]), "entity")
    chosen = stored(of_text.groupBy("text_key", "term").agg(F.max("remove").alias("remove")), "terms-of-texts")
    holding = stored(chosen.select("text_key").distinct(), "texts-with-terms")
    again = texts.join(size_checked(holding, 48), "text_key", "left_semi")
    located = _tokens(again, rules).filter("term is not null").join(size_checked(chosen, 56, ["term"]), ["text_key", "term"])
    span = F.struct(
        F.when(F.col("remove"), 5).otherwise(4).alias("rank"), "start", "end", F.when(F.col("remove"), "removed_term").otherwise("general_term").alias("kind"), "value"
    )
    per_text = located.groupBy("text_key").agg(F.collect_list(span).alias("terms"))
    by_start = F.array_sort(F.transform("terms", lambda s: F.struct(s["start"].alias("at"), s.alias("s"))))
    return stored(per_text.select("text_key", F.transform(by_start, lambda x: x["s"]).alias("terms")), "term-spans")


_NOT_CUT = "[^" + _CUT[1:]


def sanitise(docs: DataFrame, *, text: str = "text", rules: Disclosure = Disclosure()) -> DataFrame:  # noqa: B008
    """``docs`` with a struct ``personal``: base, terms (spans: rank, start, end, kind, value) and text.

    ``base`` has the spans of fixed shape by kind and start; ``terms`` those of the
    method by start, of kinds general_term and removed_term, wherever they stand in a text
    that mentions their entity. ``text`` has a mark for each base span and each
    generalised term, and no removed term. Counts cover all rows, copies too, but an
    entity and a term must meet in ``rules.contexts`` different surroundings.

    A null text counts as empty and stays null in the result. Repeated rows get equal
    results. An empty table gives no rows. A text may have any length and any number of
    spans: the work grows in proportion. Other columns pass through; one named
    ``personal`` is replaced.
    """
    found = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = found.withColumns({f"at_{k}": v for k, v in base_spans(F.col("text")).items()})
    found = found.withColumn("base", F.concat(*[with_kind(F.col(f"at_{k}"), k, i) for i, k in enumerate(KINDS)])).drop(*[f"at_{k}" for k in KINDS])
    # A text without entities needs no terms; a key that no other has spreads such rows evenly.
    found = found.withColumn("text_key", F.when(F.size("base") > 0, F.md5(F.col("text").cast("binary"))).otherwise(F.concat(F.lit("-"), F.xxhash64("text").cast("string"), F.lit("-"), F.monotonically_increasing_id().cast("string"))))
    terms = revealing_terms(found, rules)
    empty = F.array().cast("array<struct<rank:int,start:int,end:int,kind:string,value:string>>")
    if terms is None:
        joined = found.withColumn("terms", empty)
    else:
        measured = terms.withColumn("said", as_text(F.col("terms")))
        joined = found.join(size_checked(measured, 64, ["said"]).drop("said"), "text_key", "left").withColumn("terms", F.coalesce("terms", empty))
    shown = {k: f"[{k.upper()}]" for k in KINDS} | {"general_term": "[TERM]", "removed_term": ""}
    clean = F.when(F.size("base") > 0, replaced(F.col("text"), F.concat("base", "terms"), shown)).otherwise(F.col("text"))
    clean = F.when(F.col("row").getField(text).isNotNull(), clean)
    return joined.select(*beside(docs, "personal"), F.struct("base", "terms", clean.alias("text")).alias("personal"))


def personal_digest(docs: DataFrame) -> DataFrame:
    """Counts and places of personal data in each document."""
    found = sanitise(docs.select("doc_id", "text"))
    base = F.col("personal.base")
    counts = [count_where(base, "kind", k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.concat(base, "personal.terms")).alias("spans"))
