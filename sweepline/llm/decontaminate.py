"""Finds passages of benchmark items in training texts by a distributed positional inverted index.

The index is a table of postings (term, document, position) of every training word that is a term
of the benchmark. Each passage is looked up from its rarest terms: their posting lists, each
shifted by the term's place in the passage, are intersected on where the passage would begin; what
is left is intersected with the lists of all other terms. DataFrame functions only.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..runtime import FEW_ROWS, few, prepare, written

#: Words after A-Z were lower-cased: ASCII letters and digits, and every character beyond ASCII.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows looked up together. What is held for one place in a text is bounded by it, however long an item is.
UNIT_WINDOWS = 64


def words_of(text: Column) -> Column:
    """The words of a text; none for a null one."""
    low = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(F.regexp_extract_all(low, F.lit(WORDS), F.lit(0)), F.array().cast("array<string>"))


def term_key(word: Column | str) -> Column:
    return F.xxhash64(word)


def units_of(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = 10) -> DataFrame:
    """Items cut into units of UNIT_WINDOWS windows: unit, item (its id as text), win, terms (its words).

    win is the length of the unit's windows: `window`, or all of an item that has fewer words.
    Items without words have no unit. Rows with equal id and text are one item; a null id is 'null'.
    """
    item = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    src = items.select(item.alias("item"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0).distinct()
    cuts = F.sequence(F.lit(0), F.floor(F.greatest(F.size("w") - window, F.lit(0)) / UNIT_WINDOWS).cast("int"))
    units = src.withColumn("cut", F.explode(cuts))
    words = F.slice("w", F.col("cut") * UNIT_WINDOWS + 1, F.lit(UNIT_WINDOWS + window - 1))
    win = F.least(F.size("w"), F.lit(window))
    return units.select(F.xxhash64("item", "w", "cut").alias("unit"), "item", win.alias("win"), words.alias("terms"))


def build_index(docs: DataFrame, terms: DataFrame, n_terms: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (doc_id, body, term, at): one per training word that is one of `terms` (word), written to the shared folder.

    A row is told by its id and body, a hash of its text: rows equal in both have equal postings.
    at counts words from 1. Every row of docs also has one posting without a term, whose at is its
    number of words. Terms are broadcast where they number FEW_ROWS at most.
    """
    held = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("body"), words_of(F.col(text_col)).alias("w"))
    # the number of words leads the words, as if it were one
    listed = F.concat(F.array(F.size("w").cast("string")), F.col("w"))
    met = held.select("doc_id", "body", F.posexplode(listed).alias("at", "word")).join(few(terms, n_terms).withColumnRenamed("term", "key"), "word", "left")
    head = F.col("at") == 0
    postings = met.where(head | F.col("key").isNotNull())
    return written(postings.select("doc_id", "body", F.when(~head, F.col("key")).alias("term"), F.when(head, F.col("word").cast("int")).otherwise(F.col("at")).alias("at")))


def anchors_of(units: DataFrame, index: DataFrame) -> DataFrame:
    """The two rarest terms of each window: unit, win, at (0-based in the unit), term. Ties go to the earlier word."""
    counts = index.where("term is not null").groupBy("term").agg(F.count("*").alias("n"))
    placed = units.select("unit", "win", F.posexplode("terms").alias("at", "word")).select("unit", "win", "at", term_key("word").alias("term"))
    known = placed.join(counts, "term", "left").groupBy("unit", "win").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0)).alias("n"), "term"))).alias("t"))

    def rarest(start: Column) -> Column:
        inside = F.transform(F.slice("t", start + 1, F.col("win")), lambda x: F.struct(x["n"].alias("n"), x["at"].alias("at"), x["term"].alias("term")))
        return F.slice(F.array_sort(inside), 1, 2)

    starts = F.sequence(F.lit(0), F.size("t") - F.col("win"))
    picked = known.select("unit", "win", F.explode(F.array_distinct(F.flatten(F.transform(starts, rarest)))).alias("a"))
    return picked.select("unit", "win", F.col("a")["at"].alias("offset"), F.col("a")["term"].alias("term"), F.col("a")["n"].alias("n"))


def phrases(index: DataFrame, units: DataFrame, window: int = 10, few_rows: int = FEW_ROWS) -> DataFrame:
    """Every place where windows of an item occur: doc_id, body, item, first, last (words from 1).

    A span is a longest run of overlapping or touching windows of one unit of an item, in step with
    the text. All lists are met by equi-joins on terms and on (document, place, term), so that
    neither a common term nor a passage shared by many documents gathers in one task; only tables
    counted as few rows are broadcast.
    """
    anchors = written(anchors_of(units, index))
    n_anchors = anchors.count()
    hits = index.where("term is not null").join(few(anchors.drop("n"), n_anchors, few_rows), "term")
    begin = F.col("at") - F.col("offset")
    places = hits.groupBy("unit", "win", "doc_id", "body", begin.alias("begin")).agg(F.min("offset").alias("low"), F.max("offset").alias("high"))
    places = written(places.where("low < high or win = 1"))  # both rarest terms of some window stand in step
    n_places = places.count()

    sizes = units.select("unit", "item", F.transform("terms", term_key).alias("terms"))
    many = places.groupBy("unit").agg(F.count("*").alias("n"))
    near = places.join(few(sizes.join(many, "unit", "left_semi"), units.count(), few_rows // 50), "unit")
    range_ = F.sequence(F.greatest(F.col("low") - window + 1, F.lit(0)), F.least(F.col("high") + window - 1, F.size("terms") - 1))
    asked = F.transform(range_, lambda o: F.struct(o.alias("offset"), F.get("terms", o).alias("term")))
    wanted = near.select("unit", "item", "win", "doc_id", "body", "begin", F.inline(asked)).withColumn("at", F.col("begin") + F.col("offset"))

    texts = places.select(F.col("doc_id").alias("d"), F.col("body").alias("b")).distinct()
    # postings of other documents are left out before the join
    lists = index.where("term is not null").join(few(texts, n_places, few_rows), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("body") == F.col("b")), "left_semi")
    lists = lists.select(F.col("doc_id").alias("d"), F.col("body").alias("b"), F.col("term").alias("t"), F.col("at").alias("p"))
    met = wanted.join(lists, (F.col("at") == F.col("p")) & (F.col("term") == F.col("t")) & (F.col("body") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("d")))
    # equal rows have equal postings
    met = met.select("unit", "item", "win", "doc_id", "body", "begin", "offset", "at").distinct()

    step = Window.partitionBy("unit", "doc_id", "body", "begin").orderBy("offset")
    runs = met.withColumn("run", F.col("offset") - F.row_number().over(step))
    spans = runs.groupBy("unit", "item", "win", "doc_id", "body", "begin", "run").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    return spans.where("last - first + 1 >= win").select("doc_id", "body", "item", "first", "last")


def near_matches(index: DataFrame, units: DataFrame, slop: int = 5, few_rows: int = FEW_ROWS) -> DataFrame:
    """Windows whose words all stand close together, in any order: doc_id, body, item, start, words, at, span.

    One row per window (its start in the unit) and occurrence `at` of its rarest term in a text near
    which the window's distinct words all occur within its length plus slop words; span is the
    smallest such number of words around that occurrence. A phrase is a proximity match as well.

    The rarest list leads: each of its postings asks for the window's other terms in the cells of
    the text around it, which is an equi-join; no more than twice the span is gathered for one.
    """
    placed = units.select("unit", "item", "win", F.transform("terms", term_key).alias("terms"))
    windows = placed.select("unit", "item", "win", F.explode(F.sequence(F.lit(0), F.size("terms") - F.col("win"))).alias("start"), "terms")
    windows = windows.select("unit", "item", "win", "start", F.array_distinct(F.slice("terms", F.col("start") + 1, F.col("win"))).alias("words"))
    counts = index.where("term is not null").groupBy("term").agg(F.count("*").alias("n"))
    ranked = windows.select("unit", "start", F.explode("words").alias("term")).join(counts, "term")
    lead = ranked.groupBy("unit", "start").agg(F.min(F.struct("n", "term")).alias("x"), F.count("*").alias("known"))
    # a window with a word that no text has is nowhere
    leads = windows.join(lead, ["unit", "start"]).where("known = size(words)").select("unit", "item", "start", "words", (F.col("win") + slop).alias("reach"), F.col("x")["term"].alias("term"))
    leads = written(leads)
    lists = index.where("term is not null")
    seeds = lists.join(few(leads, leads.count(), few_rows), "term").select("doc_id", "body", "unit", "item", "start", "words", "reach", "at").distinct()
    cell = F.floor(F.col("at") / F.col("reach"))
    asked = seeds.withColumn("cell", F.explode(F.sequence(cell - 1, cell + 1))).withColumn("t", F.explode("words"))
    reaches = [r[0] for r in leads.select("reach").distinct().collect()]  # as many as there are lengths of windows
    cells = lists.select(F.col("doc_id").alias("d"), F.col("body").alias("b"), F.col("term").alias("t2"), F.col("at").alias("p"))
    cells = cells.withColumn("r", F.explode(F.array(*[F.lit(r) for r in reaches]) if reaches else F.array().cast("array<int>"))).withColumn("c", F.floor(F.col("p") / F.col("r")))
    same = (F.col("t") == F.col("t2")) & (F.col("cell") == F.col("c")) & (F.col("reach") == F.col("r")) & (F.col("body") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("d"))
    met = asked.join(cells, same).where("abs(p - at) < reach")
    keys = ["doc_id", "body", "unit", "item", "start", "words", "reach", "at"]
    around = met.groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct("p", "t"))).alias("near"))

    def width(low: Column) -> Column:
        """From place low on, how many words it takes until all terms have come; null beyond reach."""
        after = F.filter("near", lambda x: x["p"] >= low)
        ends = F.transform("words", lambda w: F.array_min(F.transform(F.filter(after, lambda x: x["t"] == w), lambda x: x["p"])))
        # the span also holds the leading occurrence itself
        return F.when(~F.exists(ends, lambda e: e.isNull()), F.greatest(F.array_max(ends), F.col("at")) - low + 1)

    lows = F.filter(F.transform("near", lambda x: x["p"]), lambda p: p <= F.col("at"))
    out = around.withColumn("span", F.array_min(F.transform(lows, width)))
    return out.where("span <= reach").select("doc_id", "body", "item", "start", "words", "at", "span")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, few_rows: int = FEW_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, item_ids (sorted as texts), contaminated.

    A word is hit where it stands inside an occurrence of `window` consecutive words of an item, or
    of all words of an item that has fewer. Null texts have no words; items without words occur
    nowhere; a null item id is listed as 'null'. Rows that repeat an id are judged each by its
    text; equal rows get equal results. Ties between equally rare terms do not change the result.
    Other columns are not read. An empty table of documents gives no rows; without items no word is
    hit.
    """
    prepare(docs.sparkSession)
    units = written(units_of(items, item_col, item_text_col, window))
    terms = units.select(F.explode("terms").alias("word")).distinct().withColumn("term", term_key("word"))
    n = terms.agg(F.count("*").alias("words"), F.count_distinct("term").alias("keys")).first()
    if n["words"] != n["keys"]:
        raise ValueError("two benchmark words share a 64-bit hash")
    index = build_index(docs, terms, n["words"], id_col, text_col)
    spans = written(phrases(index, units, window, few_rows))
    inside = spans.select("doc_id", "body", F.explode(F.sequence("first", "last")).alias("at")).distinct()
    n_hit = inside.groupBy("doc_id", "body").agg(F.count("*").alias("n_hit"))
    listed = spans.select("doc_id", "body", "item").distinct().groupBy("doc_id", "body").agg(F.sort_array(F.collect_list("item")).alias("item_ids"))
    found = n_hit.withColumnsRenamed({"doc_id": "d", "body": "b"}).join(listed.withColumnsRenamed({"doc_id": "d2", "body": "b2"}), F.col("d").eqNullSafe(F.col("d2")) & (F.col("b") == F.col("b2")))
    every = index.where("term is null").select("doc_id", "body", F.col("at").cast("long").alias("n_words"))
    out = every.join(found.select("d", "b", "n_hit", "item_ids"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("body") == F.col("b")), "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), (n_hit > 0).alias("contaminated"))
