import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from sweepline import runtime
from sweepline.llm import decontaminate, spelling, vector_codes
from sweepline.llm.common import join_keyed

from test_operators import DOCS, ODD, docs

# vector codes


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, code string, bits int, n long")


def _brute_codes(rows, n_parts=8, n_entries=16, rounds=6):
    """Full scans in Python integers."""
    kept = sorted((r for r in rows), key=lambda r: (r[0] is None, r[0] or 0, np.floor(np.array(r[1]) * 4096).astype(np.int32).tobytes()))
    q = np.array([np.floor(np.array(r[1], dtype=np.float64) * 4096).astype(np.int64) for r in kept])
    parts = np.split(q, n_parts, axis=1)
    books = [p[:n_entries].copy() for p in parts]
    for turn in range(rounds + 1):
        codes, dist = [], []
        for x, c in zip(parts, books, strict=True):
            d = ((x[:, None] - c[None]) ** 2).sum(-1)
            codes.append(d.argmin(1))
            dist.append(d.min(1))
        if turn < rounds:
            for x, c, a in zip(parts, books, codes, strict=True):
                for j in range(len(c)):
                    if (a == j).any():
                        c[j] = [int(s) // int((a == j).sum()) for s in x[a == j].sum(0)]
    error = np.sum(dist, axis=0)
    by_label = Counter()
    for r, e in zip(kept, error, strict=True):
        by_label[r[2]] += int(e)
    text = ["".join(f"{int(codes[p][i]):02x}" for p in range(n_parts)) for i in range(len(kept))]
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()
    return sorted(((r[0], t, int(e), by_label[r[2]]) for r, t, e in zip(kept, text, error, strict=True)), key=repr), digest


def _plain_vectors(n=600, size=16, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((20, size))
    out = []
    for i in range(n):
        v = centres[rng.integers(20)] + 0.2 * rng.standard_normal(size)
        out.append((i, v.tolist(), None if i % 7 == 0 else i % 3, "x", 1, 2))
    return out + [(5, out[5][1], 1, "x", 1, 2), (None, out[9][1], 2, "x", 1, 2), (2000, [0.0] * size, 0, "x", 1, 2), (2001, [0.25] * size, 0, "x", 1, 2)]


def test_codes_equal_full_scans(spark):
    rows = _plain_vectors()
    bad = [(3000, None, 1), (3001, [], 1), (3002, [float("nan")] * 16, 1), (3003, [None] + [0.5] * 15, 1), (3004, [float("inf")] * 16, None), (3005, [1.0] * 15, 1), (3006, [2.0**17] + [0.0] * 15, 0)]
    codes, books = vector_codes.compress(_vectors(spark, rows + [(*r, "x", 1, 2) for r in bad]).repartition(3))
    want, digest = _brute_codes(rows)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in codes.collect()), key=repr) == want
    assert books.sha256() == digest
    # the first round measures everything, later ones less
    measured = [a / b for a, b in books.measured]
    assert measured[0] == 1 and measured[-1] < 0.75 and len(measured) == 6


def test_codes_of_few_and_equal_vectors(spark):
    rows = [(i, [float(i // 2)] * 8, 0, "x", 1, 2) for i in range(6)]
    codes, books = vector_codes.compress(_vectors(spark, rows))
    want, digest = _brute_codes(rows)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in codes.collect()), key=repr) == want and books.sha256() == digest
    assert {r[1] for r in want if r[0] < 2} == {"00" * 8}  # ties go to the lower entry
    empty, none = vector_codes.compress(_vectors(spark, []))
    assert none is None and empty.count() == 0 and empty.columns == codes.columns


def test_bounds_use_net_displacement():
    """An entry that comes back to where it was leaves bounds of that time as they were."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-50, 50, (300, 2)), rng.integers(950, 1050, (300, 2))]).astype(np.int64)
    here = np.array([[0, 0], [5000, 0], [5000, 10], [5000, 20], [1000, 1000], [0, 5000], [10, 5000], [20, 5000]], dtype=np.int64)
    away = here + np.array([0, 300])
    bounds, stamps = np.zeros((600, 2)), np.zeros((600, 2), dtype=np.uint8)
    code, _, first = vector_codes.assign_part(x, [here], None, bounds, stamps)
    assert first == 600 * 8
    kept = bounds.copy(), stamps.copy()
    code, near, again = vector_codes.assign_part(x, [here, away, here], code, bounds, stamps)
    assert again == 600 and (bounds == kept[0]).all() and (stamps == kept[1]).all()
    assert (near == ((x[:, None] - here[None]) ** 2).sum(-1).min(1)).all()


# spelling variants


def _near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :]


def test_neighbours_equal_all_pairs(spark):
    rng = random.Random(3)
    words = set()
    for _ in range(80):
        w = "".join(rng.choice("abé") for _ in range(rng.randrange(6, 10)))
        i = rng.randrange(len(w))
        words |= {w, w[:i] + w[i + 1 :], w[:i] + "a" + w[i:], w + "b", w[:i] + "z" + w[i + 1 :]}
    words = sorted(w for w in words if len(w) >= 6) + ["a" * 900 + "b" * 900, "a" * 899 + "b" * 900, "a" * 900 + "b" * 901]
    n = {w: i for i, w in enumerate(words)}
    got = spelling.one_edit_neighbours(spark.createDataFrame(list(n.items()), "word string, n long")).collect()
    assert sorted((r.word, r.other, r.other_n) for r in got) == sorted((a, b, n[b]) for a in words for b in words if _near(a, b))


def _brute_variants(rows):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    out = {}
    for w in n:
        near = sorted((v for v in n if _near(w, v)), key=lambda v: (-n[v], v))
        form = near[0] if near and n[near[0]] >= 5 * n[w] else None
        out[w] = (n[w], len(near), form, n[form] if form else None)
    roots = {}
    for w in out:
        at = w
        while out[at][2]:
            at = out[at][2]
        roots[w] = at
    return {w: (*v, roots[w]) for w, v in out.items()}


def test_only_counted_tables_are_broadcast(spark):
    """Spark sizes what explode() makes by what goes in; here a hot key's rows are broadcast, and nothing else."""
    big = spark.range(3000).select(F.explode(F.array_repeat(F.col("id") % 50, 10)).alias("key"), "id")
    small = spark.createDataFrame([(k, 29_000 if k == 7 else 1, f"v{k}") for k in range(50)], "key long, n long, v string")
    out = join_keyed(big, small, "key", "n", 29_049)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" in plan  # the hot keys: taken, and left out of the rest
    assert sorted(map(tuple, out.collect())) == sorted((i % 50, i, f"v{i % 50}") for i in range(3000) for _ in range(10))
    words = docs(spark, [(1, "handler " * 50 + "handlerr " * 5 + "handlerrs " * 25, "en", "s")])
    plan = spelling.variant_groups(words, misspelt=1 << 40)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_variant_groups(spark):
    rng = random.Random(8)
    stems = ["colour", "Ürsprung", "réalité", "handler", "ANGSTROM"]
    rows = []
    for i in range(60):
        words = [rng.choice(stems) for _ in range(60)]
        words += [w[:3] + w[4:] for w in words[:7]] + [w + "s" for w in words[:4]] + ["colur"] * 2 + ["colouur"] * (i % 2)
        rows.append((i, " ".join(words) + " x1handler2y", "en", "s"))
    rows += ODD + [(500, "handlerss handlerss handlerss handlerss handlerss", "en", "s")]
    got = spelling.variant_groups(docs(spark, rows)).collect()
    want = _brute_variants(rows)
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == want and len(got) == len(want)
    assert want["handlerss"][-1] == "handler" and want["handlerss"][2] == "handlers"  # two steps
    assert spelling.variant_groups(spark.createDataFrame([], DOCS)).count() == 0
    assert spelling.variant_groups(docs(spark, ODD)).count() == 0


# decontamination


def _words(text):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def _brute_hits(rows, items, window=10):
    wins = defaultdict(set)
    for item, text, *_ in items:
        w = _words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wins[tuple(w[i : i + window])].add("null" if item is None else str(item))
    out = []
    for doc_id, text, *_ in rows:
        w, hit, found = _words(text), set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                if got := wins.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= got
        out.append((doc_id, len(w), len(hit), len(found), sorted(found), bool(hit)))
    return sorted(out, key=repr)


def _items(spark, rows):
    return spark.createDataFrame([(*r, "y", 1, 2) for r in rows], "item_id long, text string, unit string, at int, n long")


def _planted(seed=2):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(12)] + ["Über", "naïve", "日本"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.randrange(8, 30))) for i in range(12)] + [(20, text(200)), (21, "Lone"), (22, "two words"), (23, ""), (24, None), (None, text(12)), (25, "a a a a a a a a a a a a"), (25, text(15)), (26, None)]
    rows = []
    for i in range(60):
        parts = [text(rng.randrange(0, 40))]
        for _ in range(i % 3):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randrange(0, max(1, len(w) - 9))
            parts += [", ".join(w[a : a + rng.randrange(8, 90)]).upper().replace("Ü", "ü"), text(5)]
        rows.append((i, " ".join(parts), "en", "s"))
    rows += [(100, items[12][1], "en", "s"), (101, "a " * 3000, "en", "s"), (100, items[0][1], "en", "s"), (100, items[0][1], "en", "s"), (102, "so lone, two; words", "en", "s")]
    return rows, items


def test_decontamination_equals_brute_force(spark):
    rows, items = _planted()
    rows += ODD
    want = _brute_hits(rows, items)
    assert sum(r[5] for r in want) > 20
    for few in (decontaminate.FEW_ROWS, 0):  # tables too large to broadcast give the same
        got = decontaminate.contaminated(docs(spark, rows), _items(spark, items), few_rows=few).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.item_ids, r.contaminated) for r in got), key=repr) == want
    none = decontaminate.contaminated(docs(spark, rows), _items(spark, [])).collect()
    assert len(none) == len(rows) and not any(r.contaminated or r.n_hit or r.item_ids for r in none)
    assert decontaminate.contaminated(spark.createDataFrame([], DOCS), _items(spark, items)).count() == 0


def test_proximity_matches_equal_brute_force(spark):
    rows, items = _planted(5)
    rows, items = rows[:40], [x for x in items if x[1] and len(_words(x[1])) < 20]
    slop = 3
    units = decontaminate.units_of(_items(spark, items), window=5)
    terms = units.select(F.explode("terms").alias("word")).distinct().withColumn("term", decontaminate.term_key("word"))
    index = decontaminate.build_index(docs(spark, rows), terms, terms.count())
    got = {(r.doc_id, r.item, r.start, r.at): r.span for r in decontaminate.near_matches(index, units, slop).collect()}
    freq = Counter(w for _, t, *_ in rows for w in _words(t))
    keys = {r["word"]: r["term"] for r in terms.collect()}
    want = {}
    for item, text in items:
        w = _words(text)
        win = min(5, len(w))
        for start in range(len(w) - win + 1):
            need = set(w[start : start + win])
            if any(not freq[x] for x in need):
                continue
            lead = min(need, key=lambda x: (freq[x], keys[x]))
            for doc_id, body, *_ in rows:
                d = _words(body)
                for at in (i for i, x in enumerate(d) if x == lead):
                    spans = [hi - lo + 1 for lo in range(max(0, at - win - slop + 1), at + 1) for hi in range(at, min(len(d), lo + win + slop)) if need <= set(d[lo : hi + 1])]
                    if spans:
                        want[doc_id, "null" if item is None else str(item), start, at + 1] = min(spans)
    assert len(want) > 30 and got == want


# what they share


def test_samples_never_get_empty(spark):
    """Of 10^11 rows as of few: the share is kept to the hash's grain, and one grain is always left."""
    n = spark.range(200_000).where(runtime.sampled(0.02, "id")).count()
    assert abs(n - 4000) < 400
    grains = 1 << 40
    held = spark.range(1).select(runtime.sample_grains(3000 / 1e11, grains).alias("few"), runtime.sample_grains(3000 / 1e16, grains).alias("least"), runtime.sample_grains(1.0, grains).alias("all")).first()
    assert abs(held["few"] / grains * 1e11 - 3000) < 10 and held["least"] == 1 and held["all"] == grains


def test_shared_folder_is_a_full_address(spark):
    folder = runtime.shared_folder(spark)
    assert folder.startswith("file:///")
    path = runtime.shared_path(spark, "gone")
    spark.range(3).write.parquet(path)
    runtime.delete(spark, path)
    assert not spark._jvm.org.apache.hadoop.fs.FileSystem.getLocal(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path))
