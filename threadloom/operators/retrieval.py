"""Lexical search for many queries at once, and containment of gold passages."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import WORD, let, query_terms, words
from ..shared import size_checked, stored

TOP_K = 30
#: A query of more words than this is dropped where a unit only echoes it.
ECHO_WORDS = 4
#: Phrases that one pass over the texts looks for.
PHRASE_BLOCK = 500
#: Up to so many phrases are cheaper held against each text than met by its places, however long texts are.
FEW_PHRASES = 100

#: What each signal adds to a score.
WEIGHTS: Mapping[str, int] = {
    "explicit": 100,
    "referenced_symbol": 75,
    "direct_import": 70,
    "consumer": 65,
    "related_test": 60,
    "branch_modified": 40,
    "working_modified": 20,
    "cochanged": 30,
    "same_module": 20,
    "path_proximity": 5,
    "recent_access": 5,
    "graph_distance": -10,
    "redundancy": -35,
    "duplicate_content": -18,
    "exact_phrase": 30,
    "lexical_overlap": 10,
    "conversation_membership": 12,
    "message_adjacency": 18,
    "decision_context": 28,
    "final_state": 55,
    "related_unit": 5,
}


def weights_with(overrides: Mapping[str, int] | None = None) -> dict[str, int]:
    """The weights, some of them replaced; only known names and whole numbers up to 1000 either way."""
    for name, value in (overrides or {}).items():
        if name not in WEIGHTS or not isinstance(value, int) or isinstance(value, bool) or abs(value) > 1000:
            raise ValueError(f"not a weight: {name}={value!r}")
    return {**WEIGHTS, **(overrides or {})}


def stated_blocks(table: DataFrame) -> Iterator[list]:
    """The rows of a stated set, such as queries, in blocks of about PHRASE_BLOCK, one after the other."""
    count = -(-table.count() // PHRASE_BLOCK)
    for i in range(count):
        if block := table.filter(F.pmod(F.xxhash64(*table.columns), F.lit(count)) == i).collect():
            yield block


def _anchored(texts: DataFrame, key: str, text: str, phrases: DataFrame, span: int) -> DataFrame:
    """(key, n, p) of texts that may hold a phrase of ``span`` words or more, by its first ``span`` words.

    In a text with the phrase its first word ends a word, inner ones are whole words, and
    its last one begins a word. So a row for each place in a text meets phrases by the words
    between and one character on either side, and only then are the outer words compared.
    """
    mid = F.col("w")[1] if span > 2 else F.lit("")
    asked = phrases.select("n", "p", F.right(F.col("w")[0], F.lit(1)).alias("ending"), mid.alias("mid"), F.left(F.col("w")[span - 1], F.lit(1)).alias("beginning"), F.col("w")[0].alias("head"), F.col("w")[span - 1].alias("tail"))
    said = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    place = lambda w, i: F.struct(F.get(w, i).alias("before"), (F.get(w, i + 1) if span > 2 else F.lit("")).alias("mid"), F.get(w, i + (span - 1)).alias("after"))
    places = let(said, lambda w: F.when(F.size(w) >= span, F.transform(F.sequence(F.lit(0), F.size(w) - span), lambda i: place(w, i))))
    spoken = texts.select(key, F.explode(places).alias("x")).select(key, "x.*", F.right("x.before", F.lit(1)).alias("ending"), F.left("x.after", F.lit(1)).alias("beginning"))
    met = spoken.join(size_checked(asked, 64, ["p", "head", "mid", "tail"]), ["ending", "mid", "beginning"])
    return met.filter(F.endswith("before", F.col("head")) & F.startswith("after", F.col("tail"))).select(key, "n", "p").distinct()


def holding(texts: DataFrame, key: str, text: str, phrases: DataFrame, name: str, phrase: str) -> DataFrame:
    """(key, name) of the texts that hold a phrase, wherever it stands.

    Phrases of two words and more meet texts by their first two or three words, and are
    looked for in the texts that have these. The others, and a few of any kind, are a stated
    set that is read in blocks, each held against all texts in one pass without a shuffle.
    Empty ones hold nowhere.
    """
    kind = phrases.schema[name].dataType
    found = texts.select(key, F.lit(None).cast(kind).alias(name)).limit(0)
    asked = phrases.select(F.col(name).alias("n"), F.col(phrase).alias("p")).filter("p <> ''")
    asked = stored(asked.withColumn("w", F.regexp_extract_all("p", F.lit(WORD), F.lit(0))), "phrases")
    many = asked.filter(F.size("w") > 1).count() > FEW_PHRASES
    for span, some in ((2, asked.filter(F.size("w") == 2)), (3, asked.filter(F.size("w") > 2))):
        if many and not some.isEmpty():
            near = stored(_anchored(texts, key, text, some, span), "phrase-places")
            held = texts.select(key, text).join(size_checked(near, 40, ["p"]), key).filter(F.contains(text, "p"))
            found = found.unionByName(held.select(key, F.col("n").alias(name)))
    for block in stated_blocks(asked.filter(F.lit(not many) | (F.size("w") < 2)).select("n", "p")):
        every = F.array(*[F.struct(F.lit(r.n).alias("n"), F.lit(r.p).alias("p")) for r in block])
        met = F.filter(every, lambda x: F.contains(F.col(text), x["p"]))
        found = found.unionByName(texts.select(key, F.explode(met).alias("x")).select(key, F.col("x.n").cast(kind).alias(name)))
    return found


def search(units: DataFrame, queries: DataFrame, k: int = TOP_K, weights: Mapping[str, int] | None = None) -> DataFrame:
    """The ``k`` best units of each query, as ``matches`` scores them: query_id, unit_id, score, terms, rank."""
    limited = queries.select("query_id", "query", F.lit(k).cast("long").alias("most"))
    return matches(units, limited, weights).select("query_id", "unit_id", "score", "terms", "rank")


def matches(units: DataFrame, queries: DataFrame, weights: Mapping[str, int] | None = None) -> DataFrame:
    """The best units of each query, ``most`` of its own: query_id, unit_id, score, terms, phrase, rank.

    ``units`` has unit_id and content, ``queries`` query_id, query and most. A term adds
    min(10, idf tf / (1 + 0.25 words / 100)) times the weight of lexical_overlap over 10,
    rounded to three places, with idf = 1 + (N - df + 0.5) / (df + 0.5). A unit that holds
    the whole query, as it stands, gets the weight of exact_phrase more, terms or not; but
    one that holds a query of over ECHO_WORDS words is an echo and is dropped. All matching
    units are scored, and ranked once. A query without terms finds nothing.
    """
    return best(scores(units, queries, weights), queries)


def best(found: DataFrame, queries: DataFrame) -> DataFrame:
    """The first rows of ``found`` for each query, ``most`` of its own, by score and unit_id, with their rank."""
    asked = queries.select("query_id", "most")
    cut = asked.agg(F.max("most")).first()[0] or 0
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "unit_id")
    # The stated bound lets each task leave rows out before they are dealt by their queries.
    ranked = found.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= cut)
    return ranked.join(size_checked(asked, 24), "query_id").filter("rank <= most").drop("most")


def term_gains(units: DataFrame, terms: DataFrame, weight: int) -> DataFrame:
    """(unit_id, term, gain) of each unit and term that it has; ``terms`` are distinct. See ``matches``."""
    said = words(F.col("content"))
    # The length goes with each word: beside the words it would be counted again for each of them.
    counted = let(said, lambda w: F.transform(w, lambda x: F.struct(F.size(w).alias("length"), x.alias("term"))))
    found = units.select("unit_id", F.explode(counted).alias("w")).select("unit_id", "w.length", "w.term")
    found = found.join(size_checked(stored(terms, "asked-terms"), 24, ["term"]), "term", "left_semi")
    postings = stored(found.groupBy("unit_id", "length", "term").agg(F.count(F.lit(1)).alias("tf")), "postings")
    total = units.count()
    df = stored(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "frequencies")
    idf = 1 + (F.lit(float(total)) - F.col("df") + 0.5) / (F.col("df") + 0.5)
    gain = F.round(weight * F.least(F.lit(10.0), idf * F.col("tf") / (1 + 0.25 * F.col("length") / 100)) / 10, 3)
    return postings.join(size_checked(df, 24, ["term"]), "term").select("unit_id", "term", gain.alias("gain"))


def query_signs(units: DataFrame, queries: DataFrame, own: Mapping[str, int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What speaks for a unit, whichever the query; the queries' terms; and (query_id, unit_id) of echoes, all stored.

    A sign has unit_id, gain, flags and the term that the unit has; or else the query_id of the query that it holds
    (flags 1) or echoes (flags 2). Terms have term and by_term, the id of the query.
    """
    asked = queries.select("query_id", F.trim(F.lower("query")).alias("query"))
    asked = stored(asked.withColumns({"terms": query_terms(F.col("query")), "echo": F.size(F.split("query", r"\s+")) > ECHO_WORDS}), "queries")
    terms = stored(asked.select(F.col("query_id").alias("by_term"), F.explode("terms").alias("term")), "query-terms")
    gains = term_gains(units, terms.select("term").distinct(), own["lexical_overlap"])
    held = stored(holding(units.select("unit_id", F.lower("content").alias("said")), "unit_id", "said", asked, "query_id", "query"), "held-queries")
    marks = asked.select("query_id", "echo", (F.size("terms") > 0).alias("asks"))
    held = stored(held.join(size_checked(marks, 24), "query_id").filter("echo or asks"), "marked-queries")
    flags, gain = F.when(F.col("echo"), 2).otherwise(1), F.when(F.col("echo"), 0.0).otherwise(float(own["exact_phrase"]))
    null = F.lit(None).cast(asked.schema["query_id"].dataType)
    signs = gains.select("unit_id", "term", null.alias("query_id"), "gain", F.lit(0).alias("flags"))
    signs = signs.unionByName(held.select("unit_id", F.lit(None).cast("string").alias("term"), "query_id", gain.alias("gain"), flags.alias("flags")))
    return stored(signs, "signs"), terms, held.filter("echo").select("query_id", "unit_id")


def scores(units: DataFrame, queries: DataFrame, weights: Mapping[str, int] | None = None) -> DataFrame:
    """Every unit that matches a query: query_id, unit_id, score, terms and phrase; see ``matches``."""
    signs, terms, _ = query_signs(units, queries, weights_with(weights))
    return scored_pairs(signs, terms)


def scored_pairs(signs: DataFrame, terms: DataFrame) -> DataFrame:
    """A row for each query and unit, of signs that are dealt by units first: pairs are many more, and are not shuffled."""
    dealt = dealt_by_unit(signs, terms).join(size_checked(terms, 24, ["term"]), "term", "left")
    pairs = dealt.withColumn("query_id", F.coalesce("query_id", "by_term")).filter("query_id is not null")
    summed = pairs.groupBy("query_id", "unit_id").agg(F.sum("gain").alias("gain"), F.count("term").alias("terms"), F.bit_or("flags").alias("flags"))
    kept = summed.filter(F.col("flags").bitwiseAND(F.lit(2)) == 0)
    return kept.select("query_id", "unit_id", F.round("gain", 3).alias("score"), "terms", (F.col("flags") > 0).alias("phrase"))


#: Pairs that one task makes of the signs it is dealt.
PAIRS_OF_A_TASK = 2_000_000


def dealt_by_unit(signs: DataFrame, terms: DataFrame) -> DataFrame:
    """Stored ``signs`` dealt by unit_id to as many tasks as the pairs need that they become with the queries of ``terms``."""
    asked = terms.groupBy("term").agg(F.count(F.lit(1)).alias("queries"))
    pairs = signs.groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(asked, "term", "left").agg(F.sum(F.col("n") * F.coalesce("queries", F.lit(1)))).first()[0] or 0
    # A stated number: few bytes that become many pairs would else be made one partition for being small.
    least = int(signs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return signs.repartition(max(least, -(-pairs // PAIRS_OF_A_TASK)), "unit_id")


def relevance_floor(found: DataFrame) -> DataFrame:
    """``found`` with the floor of its query, max(2, min(30, 0.65 best)), and whether it is met."""
    best = F.max("score").over(W.partitionBy("query_id"))
    floor = F.round(F.greatest(F.lit(2.0), F.least(F.lit(30.0), 0.65 * best)), 3)
    return found.withColumn("floor", floor).withColumn("kept", F.col("score") >= F.col("floor"))


def contained(gold: DataFrame, texts: DataFrame, anchor: int = 3) -> DataFrame:
    """(item_id, doc_id) where an item's text stands in a document's.

    Any document with the passage has the item's second to fourth words as whole words,
    so these anchor an equi join of ids, without texts; the exact test follows on the texts
    that are met. Items of fewer words are held against all texts in blocks.
    """
    cut = r"[\x20\x09-\x0D]+"
    items = gold.select("item_id", F.col("text").alias("item"), F.split("text", cut).alias("w"))
    long = stored(items.filter(F.size("w") > anchor + 1).select("item_id", "item", F.array_join(F.slice("w", 2, anchor), " ").alias("anchor")), "anchored-items")
    short = items.filter(F.size("w") <= anchor + 1).select("item_id", "item")
    anchors = stored(long.select("anchor").distinct(), "anchors")
    w = F.split("text", cut)
    grams = texts.select("doc_id", w.alias("w")).filter(F.size("w") >= anchor)
    spread = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - anchor + 1), lambda i: F.array_join(F.slice("w", i, anchor), " ")))
    met = grams.select("doc_id", F.explode(spread).alias("anchor")).join(size_checked(anchors, 24, ["anchor"]), "anchor", "left_semi")
    met = stored(met.join(size_checked(long.select("item_id", "anchor"), 32, ["anchor"]), "anchor").select("item_id", "doc_id").distinct(), "met-anchors")
    pairs = stored(met.join(size_checked(long.select("item_id", "item"), 24, ["item"]), "item_id"), "candidate-passages")
    found = texts.select("doc_id", "text").join(size_checked(pairs, 24, ["item"]), "doc_id").filter(F.contains("text", "item")).select("item_id", "doc_id").distinct()
    return found.unionByName(holding(texts, "doc_id", "text", short, "item_id", "item").select("item_id", "doc_id").distinct())


def _grams(word: Column, most: int = 3) -> Column:
    """The distinct pieces of a word of one to ``most`` characters."""
    none = F.array().cast("array<string>")

    def of_length(n: int) -> Column:
        pieces = F.transform(F.sequence(F.lit(1), F.length(word) - n + 1), lambda i: F.substring(word, i, F.lit(n)))
        return F.when(F.length(word) >= n, pieces).otherwise(none)

    return F.array_distinct(F.concat(*[of_length(n) for n in range(1, most + 1)]))


def repository_scores(files: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, path, score) of files with a score: each word of a query adds 10 if the path has it, 8 if a symbol's
    name does, and its occurrences in the text up to 5; the whole query in the text, as it stands, adds 10.

    ``files`` has path, symbols (names in lower case, joined) and content. All words of a
    query count, as often as it has them. A word stands inside one word of a text wherever
    it stands, so words of queries meet the distinct words of all files once, by their
    first letters, and files meet queries by equi joins from there.
    """
    asked = stored(queries.select("query_id", F.lower("query").alias("query"), words(F.col("query")).alias("terms")).filter(F.size("terms") > 0), "asked-files")
    terms = stored(asked.select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times")), "file-terms")
    none = F.array().cast("array<struct<field:int,word:string>>")
    marked = lambda name, field: F.coalesce(F.transform(words(F.col(name)), lambda x: F.struct(F.lit(field).alias("field"), x.alias("word"))), none)
    each = F.concat(*[marked(name, field) for field, name in enumerate(("path", "symbols", "content"))])
    spoken = files.select("path", F.explode(each).alias("w")).select("path", "w.field", "w.word")

    keyed = stored(terms.select("term", F.substring("term", 1, 3).alias("gram")).distinct(), "term-grams")
    pieces = spoken.select("word").distinct().select("word", F.explode(_grams(F.col("word"))).alias("gram"))
    held = pieces.join(size_checked(keyed, 32, ["term"]), "gram").filter(F.contains("word", F.col("term")))
    times = F.floor((F.length("word") - F.length(F.replace("word", F.col("term"), F.lit("")))) / F.length("term"))
    inside = stored(held.select("word", "term", times.alias("n")), "terms-in-words")

    met = spoken.join(size_checked(inside, 40, ["word", "term"]), "word").groupBy("path", "term")
    has = lambda field: F.max(F.when(F.col("field") == field, 1).otherwise(0))
    text = F.least(F.lit(5), F.coalesce(F.sum(F.when(F.col("field") == 2, F.col("n"))), F.lit(0)))
    gains = met.agg((10 * has(0) + 8 * has(1) + text).alias("gain"))
    lexical = gains.join(size_checked(terms, 40, ["term"]), "term").groupBy("query_id", "path").agg(F.sum(F.col("gain") * F.col("times")).alias("lexical"))
    phrases = holding(files.select("path", F.lower("content").alias("said")), "path", "said", asked, "query_id", "query").distinct()
    both = lexical.join(phrases.withColumn("phrase", F.lit(10)), ["query_id", "path"], "full_outer")
    return both.select("query_id", "path", (F.coalesce("lexical", F.lit(0)) + F.coalesce("phrase", F.lit(0))).cast("long").alias("score"))
