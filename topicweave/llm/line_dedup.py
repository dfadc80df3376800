"""Line deduplication by an exact set-similarity join.

Lines are compared as sets of lower-cased words. Two lines match when the Jaccard
similarity of their sets is 0.8 or more. A line goes when a line before it, in the order of
``doc_id`` and of the lines of a document, matches it.

1. Lines with equal texts are a class, with the place of the first of them.
2. The words of a class are ordered from rare to frequent. Matching lines share one of
   their rarest fifth (prefix filter), so classes are joined on those words. A pair has
   to have close sizes (length filter), room for enough common words after the shared
   one (positional filter), and bitmaps of their words that differ in few bits. The shorter of
   two lines needs a still shorter prefix.
3. Where very many classes have the same smallest or largest word hash, as near copies of
   one line do, each is first compared with the first lines of that group. Two classes
   that are both found to be later matches need no comparison with each other.
4. Jaccard is verified on the whole sets of what is left.

How frequent a word is comes from counts of all words of all texts, in a table of fixed
size by word hash; any order is right, a good one is fast. The driver sees none of it.

* Null texts have no lines. Lines without a word match nothing and stay.
* Repeated rows with one id are one document: what goes, goes from each of them.
* Documents with a null id come first and lose no line, but others can match them.
* A one-line text of any length is one line. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicweave.plans.tables import materialise, released_shuffles, scratch

#: Slots of the word counts and of the filters on lines.
SLOTS = 1 << 20
#: Classes of a group up to which they are compared pair by pair.
CROWD = 32
SPACE = r"[\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), SPACE), "")


def lines(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``line_no``, ``line`` and ``class``, a hash of the lower-cased line."""
    split = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return split.withColumn("class", F.xxhash64(F.lower("line")))


def word_ranks(docs: DataFrame) -> DataFrame:
    """One row with ``ranks``: a level of frequency for each slot of word hashes."""
    counted = (docs.select(F.explode(_words(F.col("text"))).alias("word"))
               .groupBy(F.xxhash64("word").bitwiseAND(F.lit(SLOTS - 1)).alias("slot")).agg(F.count("*").alias("n")))
    every = docs.sparkSession.range(SLOTS).select(F.col("id").alias("slot"), F.lit(0).cast("long").alias("n"))
    level = F.least(F.lit(127), F.floor(4 * F.log2(F.sum("n") + 1))).cast("tinyint")
    levels = materialise(counted.unionByName(every).groupBy("slot").agg(level.alias("level")), "word_levels")
    in_order = F.sort_array(F.collect_list(F.struct("slot", "level")))
    return materialise(levels.agg(in_order.alias("s")).select(F.col("s.level").alias("ranks")), "word_ranks")


def _mark(of: DataFrame, *by: str) -> DataFrame:
    """One row with ``marks``: 1 for each slot of the hash of ``by`` that occurs."""
    taken = of.select(F.pmod(F.xxhash64(*by), F.lit(SLOTS)).alias("slot"), F.lit(1).cast("tinyint").alias("mark")).distinct()
    every = of.sparkSession.range(SLOTS).select(F.col("id").alias("slot"), F.lit(0).cast("tinyint").alias("mark"))
    marks = materialise(taken.union(every).groupBy("slot").agg(F.max("mark").alias("mark")), "line_marks")
    return materialise(marks.agg(F.sort_array(F.collect_list(F.struct("slot", "mark"))).alias("s"))
                       .select(F.col("s.mark").alias("marks")), "marks")


def classes(docs: DataFrame) -> DataFrame:
    """One row for each distinct line that has words.

    ``first`` (its first place), ``copies``, ``n`` (its distinct words), ``low`` and
    ``high`` (smallest and largest word hash), two bitmaps and ``prefix``.
    """
    hashes = F.array_distinct(F.transform(_words(F.col("line")), lambda w: F.xxhash64(w)))
    # A generated column is computed once, whatever filters and columns use it. The table of
    # ranks is looked up in the one expression that uses it, so that no row carries it.
    hashed = lines(docs).select("class", "doc_id", "line_no", F.explode_outer(F.array(hashes)).alias("hashes")).where("size(hashes) > 0")
    ranked = hashed.withColumn("tables", F.array(word_ranks(docs).scalar()))
    flip = "aggregate(hashes, 0L, (bits, h) -> bits ^ if((h & 1) = {half}, shiftleft(1L, cast(shiftrightunsigned(h, 58) as int)), 0L))"
    shown = ranked.select(
        "class", "doc_id", "line_no", F.size("hashes").alias("n"), F.array_min("hashes").alias("low"), F.array_max("hashes").alias("high"),
        F.expr(flip.format(half=0)).alias("even_bits"), F.expr(flip.format(half=1)).alias("odd_bits"),
        F.expr(f"""transform(slice(sort_array(flatten(transform(tables, ranks -> transform(hashes, h ->
            shiftleft(cast(ranks[cast(h & {SLOTS - 1}L as int)] as bigint), 56) | (h & {(1 << 56) - 1}L))))),
            1, size(hashes) - (4 * size(hashes) + 4) div 5 + 1), k -> k & {(1 << 48) - 1}L)""").alias("prefix"))
    same = [F.first(c).alias(c) for c in ("n", "low", "high", "even_bits", "odd_bits", "prefix")]
    return materialise(shown.groupBy("class").agg(F.min(F.struct("doc_id", "line_no")).alias("first"),
                                                  F.count("*").alias("copies"), *same), "line_classes")


def _able(a: str, b: str) -> Column:
    """Whether two sizes and bitmaps allow a match: sizes within 4 to 5, at most a ninth of all words in one only."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    bits = sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in ("even_bits", "odd_bits")), F.lit(0))
    return (5 * na >= 4 * nb) & (5 * nb >= 4 * na) & (9 * bits <= na + nb)


def _verify(docs: DataFrame, found: DataFrame, pairs: DataFrame) -> DataFrame:
    """``class`` of the later line of each pair whose whole sets match."""
    pairs = materialise(pairs, "line_pairs")
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("class")).distinct()
    places = materialise(found.select("class", "first").join(wanted, "class", "left_semi"), "line_places")
    marks = _mark(places, "class")
    slot = F.pmod(F.xxhash64("class"), F.lit(SLOTS)).cast("int")
    shown = (lines(docs).where(F.get(marks.scalar(), slot) == 1)
             .join(places, "class")
             .where(F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.line_no") == F.col("line_no")))
             .select("class", "first", F.array_distinct(F.transform(_words(F.col("line")), lambda w: F.xxhash64(w))).alias("hashes"))
             .dropDuplicates(["class"]))
    shown = materialise(shown, "line_sets")
    left, right = (shown.select(*(F.col(c).alias(f"{side}_{c}") for c in shown.columns)) for side in ("x", "y"))
    both = (pairs.join(left, F.col("x") == F.col("x_class")).join(right, F.col("y") == F.col("y_class")))
    common = F.size(F.array_intersect("x_hashes", "y_hashes"))
    matching = both.where(9 * common >= 4 * (F.size("x_hashes") + F.size("y_hashes")))
    later = F.when(F.col("x_first") < F.col("y_first"), F.col("y")).otherwise(F.col("x"))
    return materialise(matching.select(later.alias("class")).distinct(), "line_matches")


def _crowded_pairs(found: DataFrame) -> DataFrame:
    """Each class of a large group by smallest or largest hash with the classes of the group's first document."""
    slim = found.select("class", "first", "n", "even_bits", "odd_bits", F.explode(F.array("low", "high")).alias("group"))
    hubs = materialise(slim.groupBy("group").agg(F.min("first.doc_id").alias("hub"), F.count("*").alias("n"))
                       .where(F.col("n") > CROWD).select("group", "hub"), "line_hubs")
    members = materialise(slim.join(hubs, "group"), "line_groups")
    first = members.where(F.col("first.doc_id").eqNullSafe(F.col("hub")))
    return (members.alias("b").join(first.alias("a"), "group")
            .where((F.col("a.class") != F.col("b.class")) & _able("a", "b"))
            .select(F.least("a.class", "b.class").alias("x"), F.greatest("a.class", "b.class").alias("y")).distinct())


def _prefix_pairs(found: DataFrame, later: DataFrame) -> DataFrame:
    """Pairs that pass all filters and of which one at least is not yet known as a later match."""
    known = found.join(later.withColumn("known", F.lit(True)), "class", "left").withColumn("open", F.col("known").isNull())
    entries = known.select("class", "n", "even_bits", "odd_bits", "open", F.posexplode("prefix").alias("at", "word"))
    na, nb, i, j = F.col("a.n"), F.col("b.n"), F.col("a.at"), F.col("b.at")
    needed = 4 * (na + nb)
    room = F.least(na - i, nb - j)

    def short(n: Column) -> Column:
        return n - F.ceil(8 * n / 9) + 1

    return (entries.alias("a").join(entries.alias("b"), "word")
            .where((F.col("a.class") < F.col("b.class")) & (F.col("a.open") | F.col("b.open"))
                   & ((na > nb) | (i < short(na))) & ((nb > na) | (j < short(nb))) & (9 * room >= needed) & _able("a", "b"))
            .select(F.col("a.class").alias("x"), F.col("b.class").alias("y")).distinct())


def removed_lines(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``removed``, the numbers of the lines that go, of the documents that lose any."""
    docs = docs.select("doc_id", "text")
    found = classes(docs)
    crowded = _verify(docs, found, _crowded_pairs(found))
    later = crowded.union(_verify(docs, found, _prefix_pairs(found, crowded))).distinct()
    judged = found.select("class", "first", "copies").join(later.withColumn("late", F.lit(True)), "class", "left")
    gone = materialise(judged.where("late OR copies > 1"), "line_verdicts")
    again = ~(F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.line_no") == F.col("line_no")))
    rows = lines(docs).select("doc_id", "line_no", "class").join(gone, "class").where(F.coalesce("late", F.lit(False)) | again)
    return rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))


def label_documents(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_lines`` and ``removed`` (numbers of lines from 0) of every document."""
    sized = docs.select("doc_id", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n_lines"))
    gone = materialise(removed_lines(docs), "removed_lines")
    return sized.join(gone, "doc_id", "left").select(
        "doc_id", "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def drop_lines(docs: DataFrame) -> DataFrame:
    """Documents without the lines that go; a document of which no word is left goes as a whole.

    All columns stay, and ``n_chars`` is the new length where there is such a column. Of the tables written on the way only that of
    the lines that go stays.
    """
    with scratch(docs.sparkSession) as keep, released_shuffles(docs.sparkSession):
        gone = keep(removed_lines(docs), "removed_lines").select(F.col("doc_id").alias("gone_id"), "removed")
    whole = docs.select(F.struct(*docs.columns).alias("doc"))
    joined = whole.join(gone, F.col("doc.doc_id") == F.col("gone_id"), "left")
    whole_text, intact = F.col("doc.text"), F.col("removed").isNull()
    kept = F.array_join(F.filter(F.split(whole_text, "\n"), lambda line, i: ~F.array_contains("removed", i)), "\n")
    shown = joined.withColumn("kept", F.when(intact, whole_text).otherwise(kept)).where(intact | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        length = F.char_length("kept").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(intact, F.col("doc.n_chars")).otherwise(length)
    return shown.select(*(new.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns))
