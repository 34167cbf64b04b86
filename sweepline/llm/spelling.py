"""Groups spelling variants: words one edit apart, found on a trie held as a table.

The vocabulary's words make a trie and, read backwards, a second one. Chains of nodes without a
branch are one edge with a longer label. A frontier of states (word, position, node, edits) moves
over the table of nodes and edges by joins, level by level: a state without an edit stands on its
word's own path; it makes its one edit where it leaves that path, and follows the rest of its word
exactly. States that end with their word where a word ends are neighbours.

An edit lies in a word's second half or, read backwards, in its second half there. So each trie
takes edits in second halves only, where nodes have few edges.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import map_arrow, prepare, shared_path, written
from .common import join_keyed

PRIME, BASE = (1 << 61) - 1, 0x1D8AF066_1B2C3D5
END = -1


def observed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, misspelt: int = 199) -> DataFrame:
    """(word, n): how often each word of at least least_length letters occurs.

    Words are runs of ASCII and Latin-1 letters, A-Z lower-cased. Where `misspelt` divides the
    crc32 of `<id>:<word>`, the word loses the letter at that crc32 modulo its length; a null id
    reads 'null'.
    """
    low = F.translate(F.col(text_col), string.ascii_uppercase, string.ascii_lowercase)
    found = F.regexp_extract_all(low, F.lit("[a-z\\u00C0-\\u00FF]{%d,}" % least_length), F.lit(0))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.explode(found).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substr(F.col("run"), at + 2))
    word = F.when(F.col("h") % misspelt == 0, cut).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))


def _prefixes(word: str, tree: int, least_depth: int) -> Iterator[tuple[int, int, int]]:
    """(depth, node, next letter) of the word's own path; nodes are hashes of prefixes, told apart by tree."""
    h = tree + 1
    for depth, c in enumerate(reversed(word) if tree else word):
        if depth >= least_depth:
            yield depth, h, ord(c)
        h = (h * BASE + ord(c) + 1) % PRIME
    yield len(word), h, END


def trie_paths(words: DataFrame, least_depth: int) -> DataFrame:
    """(word, n, tree, path): the nodes of the word's own path where the trie branches or a word ends.

    path holds (depth, node) by depth. Two prefixes with one hash make one node of both, which
    only adds paths to words that the last comparison then refuses.
    """

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for w in b.column(0).to_pylist():
                for tree in (0, 1):
                    seen.update((node, c) for _, node, c in _prefixes(w, tree, least_depth))
            yield pa.RecordBatch.from_pydict({"node": pa.array([k[0] for k in seen], pa.int64()), "next": pa.array([k[1] for k in seen], pa.int32()), "n": pa.array(seen.values(), pa.int64())})

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 2000):
                word, times, trees, depths, nodes = [], [], [], [], []
                for w, n in zip(b.column(0).slice(start, 2000).to_pylist(), b.column(1).slice(start, 2000).to_pylist(), strict=True):
                    for tree in (0, 1):
                        for depth, node, _ in _prefixes(w, tree, least_depth):
                            word.append(w)
                            times.append(n)
                            trees.append(tree)
                            depths.append(depth)
                            nodes.append(node)
                yield pa.RecordBatch.from_pydict({"word": word, "n": pa.array(times, pa.int64()), "tree": pa.array(trees, pa.int32()), "depth": pa.array(depths, pa.int32()), "node": pa.array(nodes, pa.int64())})

    counted = map_arrow(words.select("word"), below, "node long, next int, n long").groupBy("node").agg(F.min("next").alias("low"), F.max("next").alias("high"), F.sum("n").alias("below"))
    kept = written(counted.where(f"low <> high or low = {END}").select("node", "below"))
    total = kept.agg(F.coalesce(F.sum("below"), F.lit(0))).first()[0]
    steps = map_arrow(words.select("word", "n"), along, "word string, n long, tree int, depth int, node long")
    met = join_keyed(steps, kept, "node", "below", total)
    return met.groupBy("word", "n", "tree").agg(F.sort_array(F.collect_list(F.struct("depth", "node"))).alias("path"))


def _rest(text: Column | str, start: Column) -> Column:
    return F.substr(F.col(text) if isinstance(text, str) else text, start)


def trie_nodes(paths: DataFrame) -> DataFrame:
    """One row per node: node, word and times of the word that ends there, out (label, child), below."""
    spelt = F.when(F.col("tree") == 1, F.reverse("word")).otherwise(F.col("word"))
    at = paths.select("word", "n", spelt.alias("s"), "path", F.posexplode("path").alias("i", "here"))
    to = F.get("path", F.col("i") + 1)
    label = F.substr("s", F.col("here")["depth"] + 1, to["depth"] - F.col("here")["depth"])
    rows = at.select(F.col("here")["node"].alias("node"), label.alias("label"), to["node"].alias("child"), F.when(to.isNull(), F.col("word")).alias("word"), F.when(to.isNull(), F.col("n")).alias("times"))
    edges = rows.groupBy("node", "label", "child").agg(F.max("word").alias("word"), F.max("times").alias("times"), F.count("*").alias("below"))
    # as many edges as there are letters, at most
    return edges.groupBy("node").agg(F.max("word").alias("word"), F.max("times").alias("times"), F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "child"))).alias("out"), F.sum("below").alias("below"))


def one_edit_neighbours(words: DataFrame, least_length: int = 6) -> DataFrame:
    """(word, other, other_n) for every two words of which one becomes the other by one letter more, less or changed.

    words: word and n, no word twice, none shorter than least_length. Each pair comes in both
    directions, once each. The number of joins grows with the branches on a path, not with the
    length of words. Nodes that very many words pass are broadcast, the others shuffled.
    """
    spark = prepare(words.sparkSession)
    paths = written(trie_paths(words, least_length // 2))
    nodes = written(trie_nodes(paths).withColumnsRenamed({"word": "ending", "times": "ending_n"}))
    total = nodes.agg(F.coalesce(F.sum("below"), F.lit(0))).first()[0]
    spelt = F.when(F.col("tree") == 1, F.reverse("word")).otherwise(F.col("word"))
    half = F.when(F.col("tree") == 1, F.ceil(F.length("word") / 2)).otherwise(F.floor(F.length("word") / 2))
    start = paths.select("tree", spelt.alias("s"), F.explode(F.filter("path", lambda x: x["depth"] >= half)).alias("x"))
    start = start.select("tree", "s", F.col("x")["depth"].alias("pos"), F.col("x")["node"].alias("node"))

    met = join_keyed(start, nodes, "node", "below", total)
    pos, length = F.col("pos"), F.length("s")
    letter = F.substr("s", pos + 1, F.lit(1))
    after = F.substr("s", pos + 2, F.lit(1))
    state = lambda p, node: F.struct(p.cast("int").alias("pos"), node.alias("node"))
    # the letter itself is left out of the word: the next one must leave the path here
    less = F.when((pos < length) & (after != letter), F.array(state(pos + 1, F.col("node")))).otherwise(F.array().cast("array<struct<pos:int,node:bigint>>"))
    others = F.filter("out", lambda e: F.substr(e["label"], F.lit(1), F.lit(1)) != letter)
    tail = lambda e: _rest(e["label"], F.lit(2))
    size = lambda e: F.length(e["label"])
    changed = F.filter(others, lambda e: (pos < length) & (tail(e) == F.substr("s", pos + 2, size(e) - 1)))
    more = F.filter(others, lambda e: tail(e) == F.substr("s", pos + 1, size(e) - 1))
    edited = F.concat(less, F.transform(changed, lambda e: state(pos + size(e), e["child"])), F.transform(more, lambda e: state(pos + size(e) - 1, e["child"])))
    folder = shared_path(spark, "frontier")
    schema = "tree int, s string, pos int, node long, other string, other_n long"
    made = met.select("tree", "s", F.inline(edited)).withColumns({"other": F.lit(None).cast("string"), "other_n": F.lit(None).cast("long")})

    level = 0
    while True:
        made.select("tree", "s", "pos", "node", "other", "other_n").write.parquet(f"{folder}/level={level}")
        states = spark.read.schema(schema).parquet(f"{folder}/level={level}").where("other is null").drop("other", "other_n")
        if states.isEmpty():
            break
        met = join_keyed(states, nodes, "node", "below", total)
        ends = pos == F.length("s")
        along = F.filter("out", lambda e: e["label"] == F.substr("s", pos + 1, size(e)))  # one edge, if any
        ahead = F.when(ends, F.array(state(pos, F.col("node")))).otherwise(F.transform(along, lambda e: state(pos + size(e), e["child"])))
        made = met.where(~ends | F.col("ending").isNotNull()).select("tree", "s", F.inline(ahead), F.when(ends, F.col("ending")).alias("other"), F.when(ends, F.col("ending_n")).alias("other_n"))
        level += 1

    found = spark.read.schema(f"{schema}, level int").parquet(folder).where("other is not null").select("tree", F.when(F.col("tree") == 1, F.reverse("s")).otherwise(F.col("s")).alias("word"), "other", "other_n")
    h = F.floor(F.length("word") / 2).cast("int")
    # what differs in the second half only was found forwards
    once = (F.col("tree") == 0) | (F.substr("word", F.lit(1), h) != F.substr("other", F.lit(1), h))
    return found.where(once & (F.levenshtein("word", "other", 1) == 1)).select("word", "other", "other_n")


def variant_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_count: int = 5, factor: int = 5, misspelt: int = 199) -> DataFrame:
    """One row per word of at least least_length letters and least_count occurrences: word, n, n_near, form, form_n, root.

    form is the near word (one edit apart) of largest n, in code-point order among equals, if it
    occurs factor times as often as the word; root is where following forms ends. Null and empty
    texts have no words; rows that repeat an id count as rows; a null id reads 'null' in the hash.
    Very long words are words. Other columns are not read; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    words = written(observed(docs, id_col, text_col, least_length, misspelt).where(F.col("n") >= least_count))
    near = one_edit_neighbours(words, least_length).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("other"))).alias("best"))
    # tables of words grow with the input: none of them is broadcast
    joined = words.join(near.hint("merge"), "word", "left").withColumn("best_n", -F.col("best")["minus"])
    has = F.col("best_n") >= F.col("n") * factor
    rows = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best")["other"]).alias("form"), F.when(has, F.col("best_n")).alias("form_n")))
    # counts grow along forms, so chains end; each round doubles what a word has followed
    roots = written(rows.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        on = roots.select(F.col("word").alias("w2"), F.col("root").alias("r2"))
        longer = written(roots.join(on.hint("merge"), F.col("root") == F.col("w2"), "left").select("word", F.coalesce("r2", "root").alias("root"), F.col("r2").isNotNull().alias("moved")))
        roots = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            break
    return rows.join(roots.hint("merge"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
