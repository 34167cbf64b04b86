"""Quality rules: plain counts, and language-specific bands of n-gram perplexity.

The language model is a modified Kneser-Ney model over the characters of a text, one for each
language: order five, lower case, digits as zeros, words joined by single blanks, so that contexts
reach across the borders of words. Spark counts every n-gram of every text; lower orders come from continuation counts,
discounts from counts of counts, and n-grams of three characters and more that were seen once are
pruned (their mass goes to the back-off). What a text costs is given per word, by passages of 50
words; the text's value is the median of its passages, so one odd passage condemns no text.

Nothing of the model passes the driver. It is written to the shared folder as arrays ordered by a
64-bit hash, which the scoring tasks load: whole, where it has few enough entries; else cut to size,
for every input file the n-grams that occur in it. Then only arrays move, never the texts, and each
is as large as the distinct n-grams of one file.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ROW_GROUP, map_arrow, prepare, shared_path, written
from .common import WORD

ORDER = 5
PRUNED_FROM = 3  # from this length on, n-grams counted once are left to the back-off
PASSAGE = 50  # words; the base rules ask for as many
START = "\x02"
SYMBOLS = frozenset("#*$%&|<>")
NO_LANG = "und"
SHARDS = 16  # files an array is written in, so that a large input file is no hot key
FLUSH = 1_000_000  # characters whose n-grams a task sorts at a time
HELD = 1_500_000  # distinct n-grams that a task holds
_MUL = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


def base_counts(text: str | None, words: list[str] | None = None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = WORD.findall(text) if words is None else words
    symbols = sum(map(text.count, SYMBOLS))
    dup = 0
    if "\n" in text:
        lines = [x for x in text.split("\n") if WORD.search(x)]
        dup = len(lines) - len(set(lines))
    repeated = 0
    if len(set(zip(words, words[1:], words[2:], strict=False))) < len(words) - 2:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        seen = Counter(windows)
        upto = 0  # words before this place are counted
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    return len(words), sum(map(len, words)), symbols, dup, repeated


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def stream(words: list[str]) -> np.ndarray:
    """Code points of the lower-case words, each followed by a blank, after ORDER - 1 marks; digits are zeros."""
    codes = np.frombuffer((START * (ORDER - 1) + " ".join(words).lower() + " ").encode("utf-32-le"), dtype="<u4").astype(np.uint32)
    codes[(codes >= 48) & (codes < 58)] = 48
    return codes


def slots(codes: np.ndarray, lang: str) -> np.ndarray:
    """64-bit hashes of all n-grams of the highest order, one for each character after the marks."""
    n = len(codes) - ORDER + 1
    h = np.full(n, xxhash.xxh3_64_intdigest(lang), dtype=np.uint64)
    for i in range(ORDER):
        h ^= codes[i : i + n]
        h *= _MUL
        h ^= h >> _SHIFT
    return h.view(np.int64)


def count_grams(docs: DataFrame) -> DataFrame:
    """(block, lang, gram, slot, n) from (block, text, lang): n-grams of the highest order, of every text.

    A task adds up a block's counts while they fit in HELD entries: an n-gram may have several rows.
    """
    names = ["block", "lang", "gram", "slot", "n"]

    def merge(h: np.ndarray, n: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(h)
        first = np.flatnonzero(np.concatenate([[True], np.diff(h[order]) != 0]))
        return h[order[first]], np.add.reduceat(n[order], first), windows[order[first]]

    def counted(texts: list[np.ndarray], lang: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hashes = [slots(c, lang) for c in texts]
        h = np.concatenate(hashes)
        order = np.argsort(h)
        first = np.flatnonzero(np.concatenate([[True], np.diff(h[order]) != 0]))
        at = order[first]
        # where each n-gram begins in the texts laid end to end
        skip = np.repeat(np.arange(len(texts)) * (ORDER - 1), [len(x) for x in hashes])
        return h[at], np.diff(np.append(first, len(h))), np.concatenate(texts)[(at + skip[at])[:, None] + np.arange(ORDER)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[str, list[np.ndarray]] = {}
        sums: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        size, now = 0, None

        def add_up() -> None:
            for lang, got in texts.items():
                new = counted(got, lang)
                sums[lang] = merge(*(np.concatenate(x) for x in zip(sums[lang], new, strict=True))) if lang in sums else new
            texts.clear()

        def hand_on() -> Iterator[pa.RecordBatch]:
            for lang, (h, n, windows) in sums.items():
                for i in range(0, len(h), 100_000):
                    flat = windows[i : i + 100_000].astype("<u4").tobytes().decode("utf-32-le")
                    grams = [flat[j : j + ORDER] for j in range(0, len(flat), ORDER)]
                    k = len(grams)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(k, now)), pa.array([lang] * k), pa.array(grams), pa.array(h[i : i + k]), pa.array(n[i : i + k])], names=names)
            sums.clear()

        for b in batches:
            for block, text, lang in zip(*(b.column(i) for i in range(3)), strict=True):
                if (block := block.as_py()) != now:
                    add_up()
                    yield from hand_on()
                    now = block
                if words := WORD.findall(text.as_py() or ""):
                    c = stream(words)
                    texts.setdefault(lang.as_py(), []).append(c)
                    size += len(c)
                if size > FLUSH:
                    add_up()
                    size = 0
                    if sum(len(x[0]) for x in sums.values()) > HELD:
                        yield from hand_on()
        add_up()
        yield from hand_on()

    return map_arrow(docs.select("block", "text", "lang"), run, "block long, lang string, gram string, slot long, n long")


def _discount(counts: dict[int, int], k: int) -> tuple[float, float, float]:
    """D1, D2, D3+ of order k from counts of counts; 0.5, 1.0, 1.5 where the counts do not allow them."""
    n1, n2, n3, n4 = (counts.get(i, 0) for i in (1, 2, 3, 4))
    d = (0.5, 1.0, 1.5)
    if n1 and n2 and n3:
        y = n1 / (n1 + 2 * n2)
        d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        d = tuple(x if 0 < x < i else i / 2 for i, x in enumerate(d, 1))
    return (1.0, *d[1:]) if k >= PRUNED_FROM else d


def count_orders(counts: DataFrame) -> DataFrame:
    """(lang, gram, slot, c, k): counts of the highest order; below it, of the characters before an n-gram (slot null)."""
    top = written(counts.groupBy("lang", "gram", "slot").agg(F.sum("n").alias("c")))
    below = [F.struct(F.lit(k).alias("k"), F.substring("gram", ORDER - k + 1, k).alias("gram"), F.substring("gram", ORDER - k, 1).alias("left")) for k in range(1, ORDER)]
    lower = top.select("lang", F.explode(F.array(*below)).alias("x")).select("lang", "x.*").distinct().groupBy("lang", "k", "gram").agg(F.count("*").alias("c"))
    return written(top.withColumn("k", F.lit(ORDER)).unionByName(lower, allowMissingColumns=True))


def log_probs(orders: DataFrame) -> DataFrame:
    """(slot, logp): of every n-gram of the highest order the log probability of its last character, backed off in full.

    Modified Kneser-Ney: p(w|h) = (c - D(c)) / total + gamma(h) * p(w|h'), with gamma(h) the share
    of h that discounts have freed. Orders below the highest count the characters that an n-gram
    was seen after. All of it is joins and groupings of distinct n-grams; the driver gets the
    counts of counts, five numbers an order and language.
    """
    spark = prepare(orders.sparkSession)
    of: dict[tuple, dict[int, int]] = {}
    for r in orders.groupBy("lang", "k", F.least("c", F.lit(5)).alias("c")).agg(F.count("*").alias("n")).collect():
        of.setdefault((r["lang"], r["k"]), {})[r["c"]] = r["n"]
    rows = [(x, k, *_discount(c, k), 1.0 / (sum(of[x, 1].values()) + 1)) for (x, k), c in of.items()]
    discounts = F.broadcast(spark.createDataFrame(rows, "lang string, order int, d1 double, d2 double, d3 double, bottom double"))  # ORDER rows a language
    cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    same = Window.partitionBy("lang", "context")  # at most an alphabet of rows
    seen, gamma = (F.col("c") - F.col("cut")) / F.sum("c").over(same), F.sum("cut").over(same) / F.sum("c").over(same)
    shorter = None
    for k in range(1, ORDER + 1):
        t = orders.where(F.col("k") == k).join(discounts.where(F.col("order") == k), "lang").withColumn("context", F.substring("gram", 1, k - 1))
        t = t.withColumn("cut", F.least(cut, F.col("c").cast("double"))).select("lang", "gram", "slot", "bottom", seen.alias("seen"), gamma.alias("gamma"))
        if shorter is not None:
            t = t.withColumn("tail", F.substring("gram", 2, k - 1)).join(shorter, ["lang", "tail"])
        p = F.col("seen") + F.col("gamma") * F.col("bottom" if shorter is None else "p")
        shorter = t.select("lang", F.col("gram").alias("tail"), "slot", p.alias("p")) if k == ORDER else t.select("lang", F.col("gram").alias("tail"), p.alias("p"))
    return shorter.select("slot", F.log("p").cast("float").alias("logp"))


def write_arrays(docs: DataFrame, folder: str, whole_model: int) -> bool:
    """Count, build the model and write it under folder/block=.../; whether it is whole, as block 0.

    With more than whole_model entries every block gets the n-grams that occur in it. The texts are
    then read once more to find those.
    """
    orders = count_orders(count_grams(docs))
    model = log_probs(orders)
    whole = orders.where(F.col("k") == ORDER).count() <= whole_model
    if whole:
        met = model.withColumn("block", F.lit(0).cast("long"))
    else:
        met = count_grams(docs).select("block", "slot").join(model, "slot")
    met.repartition("block", F.pmod("slot", F.lit(SHARDS))).write.option("parquet.block.size", ROW_GROUP).partitionBy("block").parquet(folder)
    return whole


class Arrays:
    """The arrays of one block at a time (of the only one, if the model is whole): hashes in ascending order, log probabilities."""

    def __init__(self, folder: str, whole: bool):
        from pyarrow import fs

        self.store, self.base = fs.FileSystem.from_uri(folder)
        self.whole = whole
        self.block: int | None = None

    def surprise(self, block: int, hashes: np.ndarray) -> np.ndarray:
        block = 0 if self.whole else block
        if block != self.block:
            import pyarrow.parquet as pq

            got = pq.read_table(f"{self.base}/block={block}", filesystem=self.store, columns=["slot", "logp"], partitioning=None)
            s, p = got["slot"].to_numpy(), got["logp"].to_numpy()
            self.slots, first = np.unique(s.view(np.uint64), return_index=True)
            self.logs, self.block = p[first].astype(np.float64), block
            bits = max(8, int(len(s)).bit_length() + 1)
            self.shift = np.uint64(64 - bits)
            # where the hashes with each leading bits begin: a lookup takes a step or two from there
            self.begin = self.slots.searchsorted(np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        h = hashes.view(np.uint64)
        at = self.begin[h >> self.shift]
        wrong = np.flatnonzero(self.slots.take(at, mode="clip") != h)
        while len(wrong):
            at[wrong] += 1
            if at.max() >= len(self.slots) or (self.slots[at[wrong]] > h[wrong]).any():
                raise RuntimeError("the texts have changed since their n-grams were counted")
            wrong = wrong[self.slots[at[wrong]] != h[wrong]]
        return -self.logs[at]


def passages(codes: np.ndarray, surprise: np.ndarray) -> np.ndarray:
    """Mean nats a word of each passage of PASSAGE words; what is left over belongs to the last one."""
    ends = np.flatnonzero(codes[ORDER - 1 :] == 32) + 1
    total = np.concatenate([[0.0], np.cumsum(surprise)])
    cuts = np.append(np.arange(0, max(1, len(ends) // PASSAGE)) * PASSAGE, len(ends))
    at = np.concatenate([[0], ends])[cuts]
    return np.diff(total[at]) / np.diff(cuts)


def measure(docs: DataFrame, folder: str, whole_model: bool, kind: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, the base counts, base_failed, nats (median of the passages), passages, and carry."""
    names = ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "nats", "passages", *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = Arrays(folder, whole_model)
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                b = whole.slice(start, 1000)
                base, nats, each = [], [], []
                for block, text, lang in zip(*(b.column(i) for i in range(3)), strict=True):
                    text, lang = text.as_py(), lang.as_py()
                    words = WORD.findall(text or "")
                    base.append(base_counts(text, words))
                    if words:
                        c = stream(words)
                        means = passages(c, arrays.surprise(block.as_py(), slots(c, lang)))
                        nats.append(float(np.median(means)))
                        each.append(means)
                    else:
                        nats.append(None)
                        each.append([])
                cols = [pa.array([r[i] for r in base], pa.int64()) for i in range(5)]
                failed = pa.array([base_failed(r[0], r[4]) for r in base], pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column(3), b.column(2), *cols, failed, pa.array(nats, pa.float64()), pa.array(each, pa.list_(pa.float64())), *(b.column(i) for i in range(4, b.num_columns))], names=names)

    kept = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return map_arrow(docs.select("block", "text", "lang", "doc_id", *carry), run, f"doc_id {kind}, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, nats double, passages array<double>{kept}")


def bands(measured: DataFrame, width: float = 5.0, grain: float = 0.01) -> dict[str, tuple[float, float]]:
    """Of each language the lower and upper bound of nats a word.

    Quartiles of all passages of the rows that pass the base rules, read off a histogram whose bins
    are `grain` wide; the band reaches `width` times the distance between the median and each
    quartile to either side of the median, so it rejects outliers and no fixed share. A distance
    counts as one bin at least: the histogram tells no smaller ones apart.
    """
    each = measured.where("not base_failed").select("lang", F.explode("passages").alias("nats"))
    bins = each.groupBy("lang", F.round(F.col("nats") / grain).cast("long").alias("bin")).agg(F.count("*").alias("n")).collect()
    by_lang: dict[str, list[tuple[int, int]]] = {}
    for r in bins:
        by_lang.setdefault(r["lang"], []).append((r["bin"], r["n"]))
    out = {}
    for lang, got in by_lang.items():
        got.sort()
        at, n = np.array([g[0] for g in got]) * grain, np.cumsum([g[1] for g in got])
        q1, q2, q3 = (float(at[np.searchsorted(n, q * n[-1])]) for q in (0.25, 0.5, 0.75))
        out[lang] = (q2 - width * max(grain, q2 - q1), q2 + width * max(grain, q3 - q2))
    return out


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", width: float = 5.0, whole_model: int = 5_000_000, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, base counts, base_failed, perplexity, kept, and the columns in carry.

    kept is false where the base rules fail (fewer than 50 words, or over half the words in
    repeated 3-word windows), else true where the perplexity a word lies in the band of the
    row's language. Rows with a null language form a language of their own. Null and empty texts
    have no words and fail; their perplexity is null. Repeated rows and null ids each keep their
    row; other columns are not read (carry may name none of this function's own columns). An empty
    table gives an empty result.

    `docs` is read more than once and must give the same texts each time. A task loads the model
    whole while it has up to whole_model entries (16 bytes each), else the part that its input
    file's texts need. Rows should then come straight from files (a scan, filters, projections):
    those that come from no file count as one file.
    """
    spark = prepare(docs.sparkSession)
    source = docs.select(F.xxhash64(F.input_file_name()).alias("block"), F.col(text_col).alias("text"), F.coalesce(F.col(lang_col), F.lit(NO_LANG)).alias("lang"), F.col(id_col).alias("doc_id"), *carry)
    folder = shared_path(spark, "ngrams")
    whole = write_arrays(source, folder, whole_model)
    measured = measure(source, folder, whole, docs.schema[id_col].dataType.simpleString(), carry).checkpoint()
    inside = F.lit(False)
    for lang, (low, high) in sorted(bands(measured, width).items()):  # as many branches as there are languages
        inside = inside | ((F.col("lang") == lang) & F.col("nats").between(low, high))
    return measured.withColumns({"kept": ~F.col("base_failed") & inside, "perplexity": F.exp("nats")}).drop("lang", "nats", "passages")
