import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimenta.llm import exact_dedup, line_dedup, simhash
from tests.llm.cases import DOCS, awkward, docs


def ascii_lower(t):
    return (t or "").encode().lower().decode()


def expected_groups(rows):
    by = defaultdict(list)
    for r in rows:
        by[ascii_lower(r[1])].append(r[0])
    return by


@pytest.mark.parametrize("clashes", [False, True])
@pytest.mark.parametrize("files_per_batch", [None, 1])
def test_exact_groups(spark, clashes, files_per_batch):
    rows = awkward()
    got = exact_dedup.exact_groups(docs(spark, rows, clashes).repartition(3), files_per_batch=files_per_batch).collect()
    by = expected_groups(rows)
    want = Counter()
    for text, ids in by.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter((r["id"], r["keep_id"], r["group_size"], bytes(r["digest"]).hex()) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(by) and all(r["id"] == r["keep_id"] for r in kept)


def test_exact_collisions_are_told_apart(spark):
    rows = awkward()
    weak = lambda text: (F.length(text) % 3).cast("string").cast("binary")
    got = exact_dedup.exact_groups(docs(spark, rows), digest=weak).collect()
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == len(expected_groups(rows))


def test_exact_state_goes_on(spark, tmp_path):
    rows = [("a", 1), ("a", 2), ("b", 3)], [("a", 4), ("c", 5), ("b", 0)]
    schema = "id long, file string, row long, digest binary"
    arrivals, state = str(tmp_path / "in"), str(tmp_path / "state")
    for part in rows:
        df = spark.createDataFrame([(i, "f", i, t.encode()) for t, i in part], schema)
        df.write.mode("append").parquet(arrivals)
        hits = exact_dedup.advance_state(spark, arrivals, state, df.schema)
    assert {(bytes(r["digest"]), r["keep_id"], r["n"]) for r in hits.collect()} == {(b"a", 4, 3), (b"b", 3, 2)}


@pytest.mark.parametrize("clashes", [False, True])
def test_drop_exact(spark, clashes):
    df = docs(spark, awkward(), clashes)
    out = exact_dedup.drop_exact_duplicates(df)
    assert out.columns == df.columns and out.schema["text"].dataType == df.schema["text"].dataType
    texts = [ascii_lower(r["text"]) for r in out.collect()]
    assert sorted(texts) == sorted(expected_groups(awkward()))
    assert exact_dedup.drop_exact_duplicates(docs(spark, [])).count() == 0


def brute_fingerprint(text, width=3):
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    out = 0
    for bit in range(64):
        if 2 * sum(xxhash.xxh64_intdigest(s, 42) >> bit & 1 for s in shingles) > len(shingles):
            out |= 1 << bit
    return out


def brute_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    """Five-word shingles at least 0.8 similar."""
    return len(a & b) >= 0.8 * len(a | b)


def components(prints, ids, texts=None):
    sets = [brute_set(t) for t in texts] if texts else None
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 or sets and alike(sets[i], sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, own in enumerate(ids):
        r = find(i)
        least[r] = min((x for x in (least.get(r), own) if x is not None), default=None)
    return [least[find(i)] for i in range(len(prints))]


def test_golay_code_is_perfect():
    import numpy as np

    words = np.random.default_rng(1).integers(0, 1 << 23, 3000).astype(np.int32)
    near = simhash.nearest(words)
    where, index = simhash.nearby(words)
    counts = np.bincount(where)
    assert set(counts) <= {1, 6}
    for bit in range(23):
        flipped = simhash.nearest(words ^ (1 << bit))
        found = set(zip(where.tolist(), index.tolist(), strict=True))
        assert all((i, c) in found for i, c in enumerate(flipped.tolist()))
    assert all((i, c) in found for i, c in enumerate(near.tolist()))


def test_near_links_are_all_found(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.int64)
    prints = set(centres.tolist())
    for c in centres:
        for _ in range(12):
            v = int(c) & (1 << 64) - 1
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                v ^= 1 << int(b)
            prints.add(v - (1 << 64) if v >> 63 else v)
    prints = sorted(prints)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = {(r["a"], r["b"]) for r in simhash.near_links(df).collect()}
    want = {(a, b) for a in prints for b in prints if a > b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert got == want and len(want) > 500


@pytest.mark.parametrize("clashes", [False, True])
def test_near_groups(spark, clashes):
    base = [f"w{i % 37} x{i % 11}" for i in range(120)]
    rows = awkward() + [(100 + k, " ".join(base[:k] + ["edit"] + base[k + 1 :]), "en", "a", 1) for k in range(0, 120, 7)] + [(200, " ".join(base), "en", "a", 1)]
    got = simhash.near_groups(docs(spark, rows, clashes)).collect()
    prints = [brute_fingerprint(r[1]) for r in rows]
    want = components(prints, [r[0] for r in rows])
    assert Counter((r["id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got) == Counter(zip([r[0] for r in rows], prints, want, strict=True))
    for least in (None, 0.8):
        kept = simhash.drop_near_duplicates(docs(spark, rows, clashes), least=least)
        want = components(prints, [r[0] for r in rows], [r[1] for r in rows] if least else None)
        assert Counter(r["doc_id"] for r in kept.collect()) == Counter(set(want)) and len(kept.columns) == len(docs(spark, rows, clashes).columns)


def test_similar_texts_are_found_and_others_are_not(spark):
    import random

    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(800)]
    rows, base = [], 0
    for base in range(80):
        words = rng.choices(vocabulary, k=150)
        for copy in range(3):
            own = list(words)
            for at in rng.sample(range(150), copy * rng.choice((1, 1, 8))):
                own[at] = rng.choice(vocabulary)
            rows.append((10 * base + copy, " ".join(own), "en", "a", 1))
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs(spark, rows)).collect()}
    want = components([brute_fingerprint(r[1]) for r in rows], [r[0] for r in rows], [r[1] for r in rows])
    missed = kept - set(want)
    assert set(want) <= kept and len(missed) <= 0.1 * (len(rows) - len(set(want))) and len(set(want)) > 80


def test_similar_texts_are_all_found(spark):
    """Texts of equal fingerprint neighbourhoods, one similar pair among many that sort between its halves."""
    import random

    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(3000)]
    common = " ".join(rng.choices(vocabulary, k=60))
    rows = []
    for base in range(60):
        words = rng.choices(vocabulary, k=300)
        for copy in range(4):
            own = list(words)
            for at in rng.sample(range(300), copy * 4):
                own[at] = rng.choice(vocabulary)
            rows.append((10 * base + copy, f"{common} {' '.join(own)}", "en", "a", 1))
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs(spark, rows)).collect()}
    assert kept == set(components([brute_fingerprint(r[1]) for r in rows], [r[0] for r in rows], [r[1] for r in rows]))


def test_similar_texts_with_other_repeats_are_found(spark):
    import random

    rng = random.Random(6)
    rows = []
    for base in range(40):
        words = [f"w{rng.randrange(500)}" for _ in range(120)]
        last = " ".join(words[-12:])
        rows.append((2 * base, " ".join(words), "en", "a", 1))
        rows.append((2 * base + 1, " ".join([*words, *[last] * 20]), "en", "a", 1))
    far = [(brute_fingerprint(a[1]) ^ brute_fingerprint(b[1])).bit_count() for a, b in zip(rows[::2], rows[1::2], strict=True)]
    assert sum(x > 14 for x in far) > 10
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs(spark, rows)).collect()}
    assert kept == set(components([brute_fingerprint(r[1]) for r in rows], [r[0] for r in rows], [r[1] for r in rows])) == set(range(0, 80, 2))


def _posted(spark):
    import random

    rng = random.Random(2)
    rows = [(k, n, rng.choice((10, 12, 30)), rng.randrange(3), rng.getrandbits(63), rng.randrange(4)) for k in range(5) for n in range(40)]
    frame = spark.createDataFrame(rows, "key long, node long, n int, at int, bits long, component long").repartition(3)
    return frame, {(max(a[1], b[1]), min(a[1], b[1])) for a in rows for b in rows if a[0] == b[0] and a[5] != b[5] and simhash._may_be(*a[2:4], *b[2:4], 0.8)}


def test_pairs_across_components_are_all_met(spark):
    frame, want = _posted(spark)
    assert {(r["a"], r["b"]) for r in simhash._across(frame, 0.8, None).collect()} == want and want


def test_nearest_pairs_are_some_of_all(spark):
    frame, want = _posted(spark)
    few = {(r["a"], r["b"]) for r in simhash._across(frame, 0.8, 1).collect()}
    more = {(r["a"], r["b"]) for r in simhash._across(frame, 0.8, 4).collect()}
    assert few and few < more < want and {x for p in few for x in p} == {x for p in want for x in p}


def test_joined_groups(spark):
    roots = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4), (5, 4), (6, 6)], "node long, root long")
    links = spark.createDataFrame([(5, 2), (3, 1), (2, 1)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash._joined(roots, links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6}


def test_sketch_is_a_byte_a_bucket(spark):
    counts = np.concatenate([np.arange(3000), 1 << np.arange(12, 40)])
    classes = simhash.frequency_class(counts)
    assert classes.dtype == np.uint8 and (np.diff(classes.astype(int)) >= 0).all() and len(set(classes[:9])) == 9
    texts = [" ".join(f"w{(i * j) % 50}" for j in range(40)) for i in range(30)]
    sketch = simhash._sketch(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    want = Counter(int(x) >> 43 for t in texts for x in simhash.shingle_set(t))
    assert sketch.nbytes == 1 << 21 and {int(i): int(sketch[i]) for i in np.flatnonzero(sketch)} == {k: int(simhash.frequency_class(np.array([n]))[0]) for k, n in want.items()}


def test_near_empty_table(spark):
    assert simhash.near_groups(docs(spark, [])).count() == 0
    assert simhash.drop_near_duplicates(docs(spark, [])).count() == 0
    no_ids = docs(spark, [(None, "one text", None, None, None), (None, "quite another text", None, None, None)])
    assert simhash.drop_near_duplicates(no_ids).count() == 2 == simhash.drop_near_duplicates(no_ids, least=None).count()


def brute_lines(rows, min_weight):
    """Lines in a run that starts earlier, by comparing every pair of positions."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    texts = [(rows[i][1] or "").split("\n") for i in order]
    spots = [(d, j) for d, t in enumerate(texts) for j in range(len(t))]
    weight = lambda line: max(1, len(line.encode().split()))
    gone = set()
    for a, (d, j) in enumerate(spots):
        for e, k in spots[:a]:
            n = w = 0
            while j + n < len(texts[d]) and k + n < len(texts[e]) and texts[d][j + n] == texts[e][k + n]:
                w += weight(texts[d][j + n])
                n += 1
            if w >= min_weight:
                gone |= {(d, x) for x in range(j, j + n)}
    return Counter((rows[i][0], "\n".join(x for j, x in enumerate(texts[d]) if (d, j) not in gone), sum((d, j) in gone for j in range(len(texts[d])))) for d, i in enumerate(order))


@pytest.mark.parametrize("seed", range(4))
def test_line_dedup_matches_brute_force(spark, seed):
    import random

    rng = random.Random(seed)
    lines = ["", "one two three", "four", "five six", "a b c d e f g", "same", " ", "x " * 9]
    rows = [(i if i % 9 else -i, "\n".join(rng.choice(lines[: rng.randint(2, 8)]) for _ in range(rng.randint(1, 14))), "en", "a", 1) for i in range(40)]
    rows.append((None, rows[3][1], None, None, None))
    rows += [rows[5], (77, None, "en", "a", 0), (78, "", "en", "a", 0)]
    got = line_dedup.dedup_lines(docs(spark, rows), min_weight=8).collect()
    assert Counter((r["doc_id"], r["text"] or "", r["removed"]) for r in got) == brute_lines(rows, 8)


def test_line_dedup_awkward(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = awkward() + [(20, f"first\n{passage}\nlast", "en", "a", 1), (21, f"{passage}\nother", "en", "a", 1)]
    df = docs(spark, rows, clashes=True)
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    assert got[20]["text"] == f"first\n{passage}\nlast" and got[21]["text"] == "other" and got[21]["removed"] == 1
    assert got[9]["text"] == "" and got[8]["removed"] == 0 and got[3]["text"] is None
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_rows_that_share_a_file_row_are_told_apart(spark, tmp_path):
    docs(spark, [(1, "same", "en", "a", 1), (2, "other", "en", "a", 1)]).write.parquet(str(tmp_path / "d"))
    twice = spark.read.parquet(str(tmp_path / "d")).withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    got = exact_dedup.exact_groups(twice).collect()
    assert len(got) == 4 and sum(r["kept"] for r in got) == 2
    assert exact_dedup.drop_exact_duplicates(twice).count() == 2 == simhash.drop_near_duplicates(twice).count()
