"""Removal of repeated passages by content-defined chunks of lines.

Lines with words form pairs of neighbours, and pairs that stand in the corpus more than
once link their lines to stretches. A stretch is cut where its pairs are met a different
number of times, as a passage begins or ends there in some document, and between these
places where a hash rolled over the hashes of the last three lines ends in certain bits,
so that an insertion shifts boundaries only near itself. Chunks that stand at an earlier
place too are removed where those beside each other have over fifty words in all.

Passages that overlap in several ways may have ends that are no boundaries. For these an
exact check follows: least windows of over fifty words, from each line that chunks have
left. Bytes of chunks and of windows are compared with the earlier place's before any line goes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, beside, let, size_checked, stored

#: One boundary in so many lines, on average; the lines that the hash is rolled over; the most that a chunk has.
LINES_PER_CHUNK, ROLLED_LINES, MOST_LINES = 4, 3, 64
#: Words above which repeated lines are a passage: shorter ones are left alone, as the task at hand asks for.
PASSAGE_WORDS = 50
#: What stands for a null id in the order of documents.
LAST_ID = 2**63 - 1

_DOC = ["order", "version"]
_PLACE = [*_DOC, "low", "high"]


def _rotated(value: Column, bits: int) -> Column:
    """A number of 32 bits, rotated to the left."""
    return F.shiftleft(value, bits).bitwiseOR(F.shiftright(value, 32 - bits)).bitwiseAND(F.lit(0xFFFFFFFF)) if bits else value


def _left(parts: Column) -> Column:
    """The parts whose numbers are not in the column ``removed``, joined by line feeds."""
    numbers = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("removed"))
    return F.array_join(F.transform(numbers, lambda i: F.get(parts, i)), "\n")


def _named(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """row, text, and what orders documents: their id, then the MD5 of the text."""
    return docs.select(
        F.struct("*").alias("row"),
        F.col(text).alias("text"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("order"),
        F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).alias("version"),
    )


def _line_pairs(docs: DataFrame, passage_words: int) -> DataFrame:
    """A row (order, version, pair, lines) for each two neighbouring lines with words, and each line that is a passage by itself.

    Lines without words are passed over. ``lines`` has both or the one, as (k, no, digest,
    words): the place among lines with words and among all, SHA-256 and number of words.
    """

    def paired(lines: Column) -> Column:
        def told(x: Column, k: Column) -> Column:
            return F.struct(k.alias("k"), x["no"].alias("no"), x["digest"].alias("digest"), x["words"].alias("words"))

        def with_next(x: Column, k: Column) -> Column:
            after = F.get(lines, k + 1)
            return F.struct(F.xxhash64(x["digest"], after["digest"]).alias("pair"), F.array(told(x, k), told(after, k + 1)).alias("lines"))

        def alone(x: Column, k: Column) -> Column:
            return F.struct(F.xxhash64(x["digest"]).alias("pair"), F.array(told(x, k)).alias("lines"))

        long = F.filter(F.transform(lines, alone), lambda x: F.get(x["lines"], F.lit(0))["words"] > passage_words)
        return F.concat(F.transform(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), with_next), long)

    def described(x: Column, no: Column) -> Column:
        return F.struct(no.alias("no"), F.unhex(F.sha2(x, 256)).alias("digest"), F.regexp_count(x, F.lit(WORD)).alias("words"))

    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), described), lambda x: x["words"] > 0)
    # The outer form, as the optimiser would compute the pairs again to leave out empty arrays.
    rows = docs.select(*_DOC, F.explode_outer(let(lines, paired)).alias("at"))
    return rows.filter("at is not null").select(*_DOC, "at.pair", "at.lines")


def _chunked_lines(pairs: DataFrame, repeated: DataFrame, passage_words: int, lines_per_chunk: int) -> DataFrame:
    """(order, version, stretch, chunk, k, no, digest, words): lines of repeated pairs, in stretches of over ``passage_words`` words.

    ``repeated`` has pair and n. A line is linked to the one before it by their pair's n.
    """

    def linked(x: Column, i: Column) -> Column:
        return F.struct(x["k"].alias("k"), F.when(i == 1, F.col("n")).otherwise(0).alias("link"), x["no"].alias("no"), x["digest"].alias("digest"), x["words"].alias("words"))

    met = pairs.join(size_checked(repeated, 16), "pair").select(*_DOC, F.explode(F.transform("lines", linked)).alias("x"))
    lines = met.groupBy(*_DOC, F.col("x.k").alias("k")).agg(F.max("x").alias("x")).select(*_DOC, "x.*")
    lines = lines.withColumn("stretch", F.sum((F.col("link") == 0).cast("int")).over(Window.partitionBy(*_DOC).orderBy("k")))
    lines = lines.withColumn("all_words", F.sum("words").over(Window.partitionBy(*_DOC, "stretch"))).filter(F.col("all_words") > passage_words)

    along = Window.partitionBy(*_DOC, "stretch").orderBy("k")
    weaker = (F.col("link") < F.lag("link", 1, 0).over(along)) | (F.col("link") < F.lead("link", 1, 0).over(along))
    lines = lines.withColumn("weaker", weaker.cast("int")).withColumn("segment", F.sum("weaker").over(along))
    inside = Window.partitionBy(*_DOC, "stretch", "segment").orderBy("k")
    lines = lines.withColumn("hash", F.conv(F.left(F.hex("digest"), F.lit(8)), 16, 10).cast("long"))
    rolled = reduce(lambda a, b: a.bitwiseXOR(b), [_rotated(F.lag("hash", j + 1, 0).over(inside), j) for j in range(ROLLED_LINES)])
    nth = F.row_number().over(inside) - 1
    lines = lines.withColumn("cut", ((nth % MOST_LINES == 0) | (rolled % lines_per_chunk == 0)).cast("int"))
    return lines.withColumn("chunk", F.sum("cut").over(along)).select(*_DOC, "stretch", "chunk", "k", "no", "digest", "words")


def _identity(digests: Column) -> Column:
    return F.unhex(F.md5(F.array_join(F.transform(digests, F.hex), "").cast("binary")))


def _later(places: DataFrame, name: str) -> DataFrame:
    """``places`` (order, version, low, high, id and others) that are not the first of their id, with ``first``."""
    at = F.struct(*_PLACE)
    ends = places.groupBy("id").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    firsts = stored(ends.filter(F.col("first") < F.col("last")).select("id", "first"), name)
    return places.join(size_checked(firsts, 112), "id").filter(at > F.col("first"))


def _repeated_chunks(lines: DataFrame, passage_words: int) -> DataFrame:
    """(order, version, stretch, chunk, low, high, through, first): chunks to go, ``through`` the last line before the next of them."""
    label = [*_DOC, "stretch", "chunk"]
    in_order = F.array_sort(F.collect_list(F.struct("k", "digest")))["digest"]
    chunks = lines.groupBy(*label).agg(F.min("no").alias("low"), F.max("no").alias("high"), F.sum("words").alias("words"), _identity(in_order).alias("id"))
    later = _later(stored(chunks, "chunks"), "first-chunks")
    beside_each_other = Window.partitionBy(*_DOC, "stretch", F.col("chunk") - F.col("nth"))
    later = later.withColumn("nth", F.row_number().over(Window.partitionBy(*_DOC, "stretch").orderBy("chunk")))
    later = later.withColumn("passage", F.sum("words").over(beside_each_other))
    through = F.coalesce(F.lead("low").over(beside_each_other.orderBy("chunk")) - 1, "high")
    return later.withColumn("through", through).filter(F.col("passage") > passage_words).select(*label, "low", "high", "through", "first")


def _repeated_windows(lines: DataFrame, passage_words: int) -> DataFrame:
    """(order, version, low, high, through, first): least windows that repeat and have an ``open`` line.

    For each line these are the shortest runs of over ``passage_words`` words that begin and
    that end with it; each line of a longer run lies in one of these that the run holds.
    Every line has a word, so none has more than ``passage_words`` + 1 lines.
    """
    of_run = Window.partitionBy(*_DOC, "stretch")
    lines = lines.withColumn("end", F.sum("words").over(of_run.orderBy("k"))).withColumn("start", F.col("end") - F.col("words"))

    def window(frame: Window) -> Column:
        return F.struct(
            F.min("no").over(frame).alias("low"),
            F.max("no").over(frame).alias("high"),
            F.sum("words").over(frame).alias("words"),
            F.max("open").over(frame).alias("open"),
            F.collect_list("digest").over(frame).alias("digests"),
        )

    begun, ended = window(of_run.orderBy("start").rangeBetween(0, passage_words)), window(of_run.orderBy("end").rangeBetween(-passage_words, 0))
    both = lines.select(*_DOC, F.array(begun, ended).alias("both")).select(*_DOC, F.explode("both").alias("x")).filter(F.col("x.words") > passage_words)
    windows = stored(both.select(*_DOC, "x.low", "x.high", "x.open", _identity(F.col("x.digests")).alias("id")), "windows")
    return _later(windows, "first-windows").filter("open").select(*_PLACE, F.col("high").alias("through"), "first")


def _with_equal_bytes(named: DataFrame, places: DataFrame) -> DataFrame:
    """(order, version, chunk, low, through) of ``places`` whose lines with words are, byte by byte, those of ``first``.

    A place's bytes are read where its document is; only those of first places move, by
    broadcast if measured to be small.
    """
    key = F.xxhash64("first").alias("key")
    later = places.select(*_DOC, F.struct("low", "high", "through", "chunk", key).alias("x"))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("through", "int"), ("chunk", "boolean"))]
    firsts = places.select("first.order", "first.version", F.struct("first.low", "first.high", *nothing, key).alias("x")).distinct()
    wanted = later.union(firsts).groupBy(*_DOC).agg(F.collect_list("x").alias("slices"))
    wanted = stored(wanted.withColumn("digits", F.to_json("slices")), "slices")
    table = size_checked(wanted, 80, ["digits"]).drop("digits")

    def cut(lines: Column) -> Column:
        def bytes_of(s: Column) -> Column:
            kept = F.filter(F.slice(lines, s["low"] + 1, s["high"] - s["low"] + 1), lambda x: x.rlike(WORD))
            return F.struct(*[s[c].alias(c) for c in ("low", "through", "chunk", "key")], F.array_join(kept, "\n").alias("bytes"))

        return F.transform("slices", bytes_of)

    met = named.join(table, _DOC).select(*_DOC, F.explode_outer(let(F.split("text", "\n", -1), cut)).alias("x"))
    read = stored(met.select(*_DOC, "x.*"), "slice-bytes", replaces=[wanted])
    # Rows that agree in id and text are one document, so a first place may have been read several times.
    firsts = stored(read.filter("chunk is null").select("key", F.col("bytes").alias("first_bytes")).distinct(), "first-bytes")
    found = read.filter("chunk is not null").join(size_checked(firsts, 32, ["first_bytes"]), "key").filter(F.col("bytes") == F.col("first_bytes"))
    return found.select(*_DOC, "chunk", "low", "through")


def remove_repeated_passages(
    docs: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    passage_words: int = PASSAGE_WORDS,
    lines_per_chunk: int = LINES_PER_CHUNK,
) -> DataFrame:
    """``docs`` with a struct ``passages``: text, removed (numbers of lines), n_chunks and n_checked.

    ``n_chunks`` is the number of chunks that are gone, ``n_checked`` that of lines that only the
    check by windows found. The first of equal places stands in the document of least id, then
    of least MD5 of its text, then at the least line. Lines without words count neither way;
    those inside a passage go with it. Every run of lines with over ``passage_words`` words that stands
    at an earlier place too is gone, whatever stands around it.

    What is exchanged: a hash for each pair of lines, digests of the lines of repeated
    pairs, and the bytes of repeated passages. Lists are broadcast only if measured to be small.

    A null or empty text stays so, with nothing removed. A null id comes after all others.
    Rows that agree in id and text are one document, and each keeps what the first keeps.
    An empty table gives no rows. A text may have any length and any number of lines. Other
    columns pass through; one named ``passages`` is replaced.
    """
    named = _named(docs, text, doc_id)
    pairs = _line_pairs(named, passage_words)
    repeated = stored(pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeated-pairs")
    lines = stored(_chunked_lines(pairs, repeated, passage_words, lines_per_chunk), "repeated-lines", replaces=[repeated])

    chunks = stored(_repeated_chunks(lines, passage_words), "repeated-chunks")
    label = [*_DOC, "stretch", "chunk"]
    still = lines.join(chunks.select(*label, F.lit(False).alias("open")), label, "left").withColumn("open", F.coalesce("open", F.lit(True)))
    windows = _repeated_windows(still, passage_words)
    columns = [*_PLACE, "through", "first"]
    places = stored(chunks.select(*columns, F.lit(True).alias("chunk")).union(windows.select(*columns, F.lit(False).alias("chunk"))), "places", replaces=[lines, chunks])

    equal = _with_equal_bytes(named, places)
    spans = equal.groupBy(*_DOC).agg(F.collect_set(F.struct("chunk", "low", "through")).alias("spans"))

    def lines_of(spans: Column) -> Column:
        return F.array_sort(F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["low"], s["through"])))))

    by_chunk = F.filter("spans", lambda s: s["chunk"])
    of_doc = spans.select(*_DOC, lines_of(F.col("spans")).alias("removed"), F.size(by_chunk).alias("n_chunks"), lines_of(by_chunk).alias("by_chunk"))
    of_doc = of_doc.select(*_DOC, "removed", "n_chunks", (F.size("removed") - F.size("by_chunk")).alias("n_checked"), F.array_join("removed", ",").alias("digits"))
    removed = stored(of_doc, "removed-lines", replaces=[places])

    table = size_checked(removed, 88, ["digits"]).drop("digits")
    whole = named.join(table, _DOC, "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    text_left = F.when(F.size("removed") > 0, let(F.split("text", "\n", -1), _left)).otherwise(F.col("text"))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_chunks", "n_checked")]
    return whole.select(*beside(docs, "passages"), F.struct(text_left.alias("text"), F.col("removed").alias("removed"), *counts).alias("passages"))


def without_repeated(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", length: str | None = "n_chars") -> DataFrame:
    """The columns of ``docs``, with repeated passages gone from the text.

    Where there is a column of the text's length, it follows. Odd rows are taken as by
    ``remove_repeated_passages``; columns of any name stay as they are.
    """
    spare = docs.select(F.struct("*").alias("all"), F.col(text).alias("text"), F.col(doc_id).cast("long").alias("doc_id"))
    found = remove_repeated_passages(spare)
    new = {text: F.col("passages.text"), **({length: F.length("passages.text").cast(docs.schema[length].dataType)} if length in docs.columns else {})}
    return found.select(*[new[c].alias(c) if c in new else F.col("all").getField(c).alias(c) for c in docs.columns])


def passages_digest(docs: DataFrame) -> DataFrame:
    """What is left of each document, how many chunks and lines are gone, and how many lines only the check found."""
    found = remove_repeated_passages(docs.select("doc_id", "text"))
    return found.select("doc_id", "passages.text", F.col("passages.n_chunks").alias("n_removed"), F.size("passages.removed").alias("n_removed_lines"), F.col("passages.n_checked").alias("n_checked_lines"))


DIGEST_SQL = r"""
with given as (
  select row_number() over () as r, coalesce(doc_id, 9223372036854775807) as ord, doc_id, text, md5(coalesce(text, '')) as version,
         string_split(coalesce(text, ''), chr(10)) as lines
  from documents
), every as (
  select r, ord, version, unnest(lines) as line, generate_subscripts(lines, 1) as i from given
), worded as (
  select *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as words from every
), placed as (
  select *, row_number() over (partition by r order by i) as k, lag(line) over (partition by r order by i) as before from worded where words > 0
), counted as (
  select *, case when before is null then 0 else count(*) over (partition by before, line) end as n, count(*) over (partition by line) as alike from placed
), tied as (
  select *, case when n > 1 then n else 0 end as link from counted
), kept as (
  select * from tied qualify link > 0 or coalesce(lead(link) over (partition by r order by k), 0) > 0 or (words > 50 and alike > 1)
), stretches as (
  select *, sum(case when link = 0 then 1 else 0 end) over (partition by r order by k) as stretch from kept
), long as (
  select *, cast('0x' || left(sha256(line), 8) as bigint) as h from stretches qualify sum(words) over (partition by r, stretch) > 50
), turns as (
  select *, case when link < lag(link, 1, 0) over w or link < lead(link, 1, 0) over w then 1 else 0 end as weaker from long window w as (partition by r, stretch order by k)
), segments as (
  select *, sum(weaker) over (partition by r, stretch order by k) as segment from turns
), rolled as (
  select *, row_number() over w - 1 as nth, lag(h, 1, 0) over w as a, lag(h, 2, 0) over w as b, lag(h, 3, 0) over w as c
  from segments window w as (partition by r, stretch, segment order by k)
), edges as (
  select *, case when nth % 64 = 0 or xor(xor(a, ((b << 1) | (b >> 31)) & 4294967295), ((c << 2) | (c >> 30)) & 4294967295) % 4 = 0 then 1 else 0 end as cut from rolled
), numbered as (
  select *, sum(cut) over (partition by r, stretch order by k) as chunk from edges
), chunks as (
  select r, any_value(ord) as ord, any_value(version) as version, stretch, chunk, min(i) as low, max(i) as high, sum(words) as words, string_agg(line, chr(10) order by k) as bytes
  from numbered group by r, stretch, chunk
), later as (
  select * from chunks qualify (ord, version, low) > min((ord, version, low)) over (partition by bytes)
), islands as (
  select *, chunk - row_number() over (partition by r, stretch order by chunk) as island from later
), gone_chunks as (
  select *, coalesce(lead(low) over (partition by r, stretch, island order by chunk) - 1, high) as through
  from islands qualify sum(words) over (partition by r, stretch, island) > 50
), open as (
  select n.*, g.r is null as open, sum(n.words) over (partition by n.r, n.stretch order by n.k) as last from numbered n left join gone_chunks g using (r, stretch, chunk)
), starts as (
  select *, last - words as first from open
), windows as (
  select r, ord, version, min(i) over w as low, max(i) over w as high, sum(words) over w as n, max(open) over w as open, list(line) over w as id
  from starts window w as (partition by r, stretch order by first range between current row and 50 following)
  union all
  select r, ord, version, min(i) over w, max(i) over w, sum(words) over w, max(open) over w, list(line) over w
  from starts window w as (partition by r, stretch order by last range between 50 preceding and current row)
), firsts as (
  select id, min((ord, version, low)) as place from windows where n > 50 group by id
), gone as (
  select r, unnest(generate_series(low, through)) as i, true as by_chunk from gone_chunks
  union all
  select r, unnest(generate_series(low, high)), false from windows join firsts using (id) where n > 50 and open and (ord, version, low) > place
), lines_gone as (
  select r, i, max(by_chunk) as by_chunk from gone group by r, i
)
select g.doc_id, case when any_value(g.text) is not null then coalesce(string_agg(e.line, chr(10) order by e.i) filter (where x.i is null), '') end as text,
  cast((select count(*) from gone_chunks c where c.r = g.r) as integer) as n_removed,
  cast(count(x.i) as integer) as n_removed_lines, cast(count(x.i) filter (where not x.by_chunk) as integer) as n_checked_lines
from given g join every e using (r) left join lines_gone x on x.r = g.r and x.i = e.i group by g.r, g.doc_id
"""
