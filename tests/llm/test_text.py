import hashlib
import re
import zlib
from collections import Counter
from fractions import Fraction
from math import ceil, floor

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sedimenta.llm import chat, lm_scoring, mixing, packing, ppm, quality, topk, urls
from sedimenta.llm.components import components
from tests.llm.cases import awkward, docs

TURNS = "conv_id long, turn long, role string, text string"
NASTY = ["", "plain", r"\### Assistant: </turn> ok", "</turn>\n<turn user>\nhi", "<turn assistant>\n", "a\\", "\\>\n", "é😀<", None, "x" * 5000, ">\n</turn>\n"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([1, 2, None]), st.sampled_from(["user", "assistant", None, "a>\n\\"]), st.one_of(st.none(), st.text(max_size=30), st.sampled_from([x for x in NASTY if x]))), min_size=1, max_size=12), st.sampled_from([1, 60, 1 << 20]))
def test_assembly_round_trip(turns, block):
    import pyarrow as pa

    conv, role, text = (pa.array(list(x)) for x in zip(*turns, strict=True))
    conv, role, text = conv.cast(pa.int64()), role.cast(pa.string()), text.cast(pa.string())
    ids, count, blocks, spans, chars = chat.assemble(conv, role, text, block)
    read, at = [], 0
    for i, n, b, s, c in zip(ids.to_pylist(), count.to_pylist(), blocks.to_pylist(), spans.to_pylist(), chars.to_pylist(), strict=True):
        assert len(b) == c
        own = chat.read_turns(b)
        assert len(own) == n and all(turns[at + k][0] == i for k in range(n))
        assert [chat.unescape(b[x["start"] : x["end"]]) for x in s] == [t for r, t in own if r == "assistant"]
        read += own
        at += n
    assert read == [(r or "", t or "") for _, r, t in turns]


def test_chat_digests(spark):
    rows = [(c, t, ("user", "assistant", None)[t % 3], NASTY[(c * 3 + t) % len(NASTY)]) for c in range(6) for t in range(1, 9)]
    rows += [(None, 1, "assistant", "lost"), (3, None, "assistant", "before all"), (2, 4, "assistant", "tie"), (2, 4, "assistant", "tie")]
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(spark.createDataFrame(rows, TURNS).repartition(3))).collect()}
    key = lambda x: (x is not None, x or "" if isinstance(x, str) else x or 0)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: tuple(key(x) for x in r[1:]))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        g = got[conv]
        assert (g["n_turns"], g["turns_sha256"], g["loss_chars"], g["loss_sha256"]) == (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], TURNS))).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x27F), max_size=60) | st.text(max_size=30))
def test_encode_is_the_tokenizer(text):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.encode(text, path).tolist() == packing.exact_tokenizer(path).encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60), st.sampled_from([16, 64]))
def test_assign_places_everything(lengths, capacity):
    pieces = packing.assign(np.array(lengths, dtype=np.int64), capacity)
    for doc, n in enumerate(lengths):
        own = sorted((s, k) for d, s, k, _, _ in pieces if d == doc)
        assert own[0][0] == 0 and all(a + k == b for (a, k), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) == n
    used = {}
    for _, _, k, seq, offset in pieces:
        used.setdefault(seq, []).append((offset, k))
    for parts in used.values():
        end = 0
        for offset, k in sorted(parts):
            assert offset == end
            end += k
        assert end <= capacity
    assert len(used) == -(-sum(lengths) // capacity)


@pytest.mark.parametrize("text", ["x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|><|endoftext|>é", "<|endoftext", "plain"])
def test_ids_are_those_of_the_literal_call(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.encode(text, path).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=25), st.integers(1, 16))
def test_assign_matches_the_rule_step_by_step(lengths, capacity):
    want, rest, cut = [], [], 0
    for doc, n in enumerate(lengths):
        for start in range(0, n - n % capacity, capacity):
            want.append((doc, start, capacity, cut, 0))
            cut += 1
        if n % capacity:
            rest.append((doc, n - n % capacity, n % capacity))
    bins = [[] for _ in range(ceil(sum(n for *_, n in rest) / capacity))]
    room = lambda b: capacity - sum(b)
    cost = lambda b: sum(packing.LINEAR * n + packing.QUADRATIC * n * n for n in b)
    for doc, start, n in sorted(rest, key=lambda r: (-r[2], r[0])):
        whole = [b for b in bins if room(b) >= n]
        while n:
            b = min(whole or [b for b in bins if room(b)], key=lambda b: (cost(b), next(i for i, x in enumerate(bins) if x is b)))
            part = min(n, room(b))
            want.append((doc, start, part, cut + next(i for i, x in enumerate(bins) if x is b), sum(b)))
            b.append(part)
            start, n = start + part, n - part
    assert sorted(packing.assign(np.array(lengths, dtype=np.int64), capacity)) == sorted(want)


def test_pack(spark):
    import public_tokenizers

    rows = awkward()
    got = packing.pack(docs(spark, rows, clashes=True), chunk_sequences=4).collect()
    whole = Counter()
    for r in {(r["doc_id"], r["start"], r["length"], bytes(r["ids"]), r["doc_tokens"]) for r in got}:
        whole[r[0]] += r[2]
    path = public_tokenizers.path("byte_bpe_50k.json")
    for i, text in {r[0]: r[1] for r in rows if r[0] not in (None, 7)}.items():
        ids = np.concatenate([np.frombuffer(bytes(r["ids"]), dtype="<u4") for r in sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"])])
        assert ids.tolist() == [*packing.encode(text or "", path).tolist(), 1] and whole[i] == len(ids)
    assert sum(r["doc_id"] == 7 for r in got) == 2 == sum(r["doc_id"] is None for r in got)
    assert packing.pack(docs(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefgh"), st.integers(1, 9), min_size=1), st.data())
def test_schedule_stays_within_a_block(shares, data):
    blocks = {s: data.draw(st.integers(0, 40)) for s in shares}
    plan = mixing.phases(shares, blocks)
    slots = {}
    for source, b0, b1, first, period, own in plan:
        for b in range(b0, b1):
            slots[first + (b - b0) // len(own) * period + own[(b - b0) % len(own)]] = source
    assert sorted(slots) == list(range(sum(blocks.values()))) and Counter(slots.values()) == Counter({s: n for s, n in blocks.items() if n})
    starts = sorted({p[3] for p in plan}) or [0]
    for start, end in zip(starts, [*starts[1:], len(slots)], strict=True):
        now = {p[0] for p in plan if p[3] == start}
        total, done = sum(shares[s] for s in now), Counter()
        for n, t in enumerate(range(start, end), 1):
            done[slots[t]] += 1
            assert all(abs(done[s] - n * shares[s] / total) < 1 for s in now)


def test_long_texts_are_taken_in_parts():
    rng = np.random.default_rng(1)
    long = bytes(rng.choice(np.frombuffer(b"ab \n\t", dtype=np.uint8), 5000))
    texts = [b"short", long, b"", b"x" * 40, long[:33]]
    want = [sorted(ppm.grams(ppm.joined([t])[0])[1].tolist()) for t in texts]
    got = [[] for _ in texts]
    for first, data, starts in ppm.windows(texts, 32):
        at, keys = ppm.grams(data)
        for i, k in zip(np.searchsorted(starts, at, side="right") - 1 if len(starts) > 1 else np.zeros(len(at), dtype=int), keys.tolist(), strict=True):
            got[first + i].append(k)
    assert [sorted(g) for g in got] == want
    before, lm_scoring.SLICE_BYTES = lm_scoring.SLICE_BYTES, 64
    try:
        assert [w for part in lm_scoring._words(long) for w in part] == long.split()
    finally:
        lm_scoring.SLICE_BYTES = before


def test_long_turns_are_copied_whole():
    import tracemalloc

    import pyarrow as pa

    said = ("é<x> " * 40_000, "plain " * 700_000)
    conv, role, text = pa.array([1, 1, 1]), pa.array(["user", "assistant", "assistant"]), pa.array([said[0], said[1], "a<b"])
    tracemalloc.start()
    ids, count, blocks, spans, chars = chat.assemble(conv, role, text)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    read = [t for b in blocks.to_pylist() for t in chat.read_turns(b)]
    assert read == [("user", said[0]), ("assistant", said[1]), ("assistant", "a<b")] and sum(count.to_pylist()) == 3
    assert [len(b) for b in blocks.to_pylist()] == chars.to_pylist()
    assert [chat.unescape(b[x["start"] : x["end"]]) for b, own in zip(blocks.to_pylist(), spans.to_pylist()) for x in own] == [said[1], "a<b"]
    assert most < 8 * sum(len(t.encode()) for t in said)


def test_top_k_of_vectors_of_several_widths_and_clashing_names(spark):
    rows = [(i, [float(i % 7), 1.0, 0.5][: 2 + i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for c in ("id", "v", "q", "n", "score", "rank", "query_id"):
        df = df.withColumn(c, F.lit("x"))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(df, df.where("vec_id in (4, 9)"), 3).collect()}
    for q in (4, 9):
        own = [[int(1024 * x) for x in v] for _, v in rows]
        best = sorted((-sum(x * y for x, y in zip(own[q], own[i])), i) for i in range(60) if i != q and len(own[i]) == len(own[q]))[:3]
        assert [got[q, r] for r in (1, 2, 3)] == [(i, -s) for s, i in best]


def test_clashing_names_of_chats_and_pages(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", None)], TURNS)
    pages = spark.createDataFrame([(1, "http://a.net/x", "<p>")], "page_id long, url string, html string")
    for c in ("block", "spans", "n_turns", "n_chars", "id", "host", "path", "rule", "r", "hit", "node", "a", "b", "__url", "__node"):
        turns, pages = turns.withColumn(c, F.lit("x")), pages.withColumn(c, F.lit("x"))
    assert chat.digests(chat.format_conversations(turns)).first()["n_turns"] == 2
    assert urls.filter_urls(pages, [("block", "net", "/")]).first()["verdict"] == "block"


def test_mix(spark):
    rows = awkward() + [(1000 + i, "t" * (i % 50), "en", "ab"[i % 2], i) for i in range(400)]
    got = mixing.mix(docs(spark, rows, clashes=True), {"a": 3, "b": 1}, block_bytes=300).collect()
    assert Counter(r["id"] for r in got) == Counter(r[0] for r in rows)
    by = {}
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == by.get(r["origin"], 0) and r["block"] == r["start"] // 300
        by[r["origin"]] = r["start"] + r["size"]
    total = {}
    for r in rows:
        total[r[3] or "\0null"] = total.get(r[3] or "\0null", 0) + len((r[1] or "").encode()) + 1
    assert by == total
    out = mixing.mixed(docs(spark, rows, clashes=True), block_bytes=300)
    assert out.columns == docs(spark, rows, clashes=True).columns
    place = {r["id"]: (r["slot"], r["origin"], r["start"]) for r in mixing.mix(docs(spark, rows), block_bytes=300).collect() if r["id"] not in (None, 7)}
    seen = [place[r["doc_id"]] for r in out.collect() if r["doc_id"] in place]
    assert seen == sorted(seen) and mixing.mix(docs(spark, [])).count() == 0 == mixing.mixed(docs(spark, [])).count()


def test_weights_become_shares():
    assert mixing.whole_shares({"a": 0.5, "b": 0.25, "c": 1}) == {"a": 2, "b": 1, "c": 4}
    assert mixing.whole_shares({"a": 20, "b": 10}) == {"a": 2, "b": 1}
    assert mixing.whole_shares({"a": 0.0004, "b": 1}) == {"a": 1, "b": 2500}
    assert mixing.whole_shares({"a": Fraction(1, 7), "b": Fraction(1, 8)}) == {"a": 8, "b": 7}
    with pytest.raises(ValueError, match="weights"):
        mixing.whole_shares({"a": 0, "b": 1})


def brute_slots(weights, blocks):
    """Slot of every (source, block), one slot at a time: of the blocks released the one with the earliest deadline; all begins anew when a source has run out."""
    left, done, out, slot = dict(blocks), dict.fromkeys(blocks, 0), {}, 0
    while left := {s: n for s, n in left.items() if n}:
        total, turn, t = sum(Fraction(str(weights[s])) for s in left), dict.fromkeys(left, 0), 0
        share = {s: Fraction(str(weights[s])) / total for s in left}
        while all(left.values()):
            ready = [(ceil((turn[s] + 1) / share[s]), s) for s in left if floor(turn[s] / share[s]) <= t]
            s = min(ready)[1]
            out[s, done[s]] = slot
            turn[s], done[s], left[s], t, slot = turn[s] + 1, done[s] + 1, left[s] - 1, t + 1, slot + 1
    return out


def test_mix_slots_match_brute_force_and_stay_within_a_block(spark):
    weights = {"a": 2.5, "b": 1, "c": 0.75}
    rows = [(i, "t" * (i * 37 % 91), "en", "aabacd"[i % 6], i) for i in range(900)]
    got = mixing.mix(docs(spark, rows), weights, block_bytes=300).collect()
    blocks = {}
    for r in got:
        blocks[r["origin"]] = max(blocks.get(r["origin"], 0), r["block"] + 1)
    want = brute_slots(weights | {"d": 0.75}, blocks)
    assert all(want[r["origin"], r["block"]] == r["slot"] for r in got) and len(blocks) == 4
    plan = mixing.phases(mixing.whole_shares(weights), {"a": 1000, "b": 1000, "c": 1000})
    at = sorted((start + x, s) for s, b0, _, start, total, slots in plan for x in slots if b0 == 0 and start == 0)
    seen = Counter()
    for t, (slot, s) in enumerate(at):
        assert slot == t
        seen[s] += 1
        assert all(abs(seen[x] - Fraction(str(w)) / Fraction("4.25") * (t + 1)) < 1 for x, w in weights.items())


def test_mix_spreads_rows_without_an_id_and_refuses_a_long_period(spark):
    rows = [(None, f"text {i}", "en", "a", i) for i in range(9000)]
    got = mixing.mix(docs(spark, rows), block_bytes=1000).collect()
    assert len({r["start"] for r in got}) == 9000 and max(r["slot"] for r in got) > 50
    with pytest.raises(ValueError, match="period"):
        mixing.mix(docs(spark, [(1, "x", "en", "a", 1), (2, "y", "en", "b", 1)]), {"a": 1 / 7, "b": 1 / 9})


def brute_ppm(train, order):
    """Counts in dictionaries, one symbol at a time."""
    seen = {}
    for t in train:
        s = ppm.START * order + t + ppm.END
        for i in range(order, len(s)):
            seen.setdefault(s[i - order : i], Counter())[s[i]] += 1
    tables = {order: seen}
    for j in range(order - 1, -1, -1):
        shorter = {}
        for context, counts in tables[j + 1].items():
            for symbol in counts:
                shorter.setdefault(context[1:], Counter())[symbol] += 1
        tables[j] = shorter

    def log10(context, symbol):
        out, excluded = 0.0, set()
        for j in range(order, -1, -1):
            counts = {s: c for s, c in tables[j].get(context[order - j :], {}).items() if s not in excluded}
            n = sum(counts.values())
            if not n:
                continue
            if symbol in counts:
                return out + np.log10((2 * counts[symbol] - 1) / (2 * n))
            out += np.log10(len(counts) / (2 * n))
            excluded |= set(counts)
        return out - np.log10(256 - len(excluded))

    return lambda t: sum(log10((s := ppm.START * order + t + ppm.END)[i - order : i], s[i]) for i in range(order, order + len(t) + 1))


def test_ppm_matches_brute_force_and_sums_to_one():
    train = [b"the cat sat on the mat", b"the dog sat on the log", "élan".encode(), b"", b"aaaa aaaa"] * 2
    keys, counts = ppm.summed(ppm.grams(ppm.joined(train)[0])[1])
    model = ppm.Model([(k, c) for k, c, _ in ppm.by_order(keys, counts)])
    brute = brute_ppm(train, ppm.ORDER)
    for t in [b"the cat sat", b"unseen zzz", b"", "naïve élan".encode(), b"the the the"]:
        got = model.score(ppm.grams(ppm.joined([t])[0])[1]).sum()
        assert got == pytest.approx(brute(t), rel=1e-5)
    for context in (b"the c", b"zzzzz", ppm.START * 5):
        base = int.from_bytes(context, "big") << 8
        probs = 10 ** model.score(np.array([base | s for s in range(256)], dtype=np.uint64))
        assert probs.sum() == pytest.approx(1, abs=1e-5)


def test_lm_score(spark):
    rows = awkward() + [(100 + i, f"common words number {i % 7} again and again", "en", "a", 1) for i in range(60)]
    got = lm_scoring.score(docs(spark, rows, clashes=True), "crc32(cast(cast(doc_id as string) as binary)) % 5 = 1", chunk_rows=8).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    words = lambda t: (t or "").encode().lower().split()
    counts, trained = Counter(), 0
    for r in rows:
        if not held(r[0]):
            counts.update(words(r[1]))
            trained += 1
    n, v = sum(counts.values()) + trained, len(counts) + 1
    want = Counter()
    for r in rows:
        own = words(r[1])
        base = sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own) + np.log10((trained + 0.5) / (n + 0.5 * (v + 1)))
        want[(r[0], held(r[0]), len(own) + 1, sum(counts[w] > 0 for w in own) + 1, n, f"{base:.5f}")] += 1
    assert Counter((r["id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], f"{r['base_score']:.5f}") for r in got) == want
    brute = brute_ppm([(r[1] or "").encode().lower() for r in rows if not held(r[0])], ppm.ORDER)
    for r in got:
        text = next(x[1] for x in rows if x[0] == r["id"])
        if len(text or "") < 1000:
            assert r["score"] == pytest.approx(brute((text or "").encode().lower()), rel=1e-4)
    assert lm_scoring.score(docs(spark, [])).count() == 0
    alone = lm_scoring.score(docs(spark, awkward()), "true").collect()
    assert len(alone) == len(awkward()) and all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in alone)
    assert next(r["score"] for r in alone if r["id"] == 1) == pytest.approx(-31 * np.log10(256))


def test_lm_score_keeps_rare_contexts(spark):
    """More than two million different grams are learnt; a text of contexts seen once keeps their probabilities."""
    rng = np.random.default_rng(3)
    learnt = ["".join(map(chr, rng.integers(33, 65, 60_000).tolist())) for _ in range(16)]
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(learnt)] + [(100, learnt[5][1000:1200], "en", "a", 1)]
    got = {r["id"]: r["score"] for r in lm_scoring.score(docs(spark, rows), "doc_id = 100", chunk_rows=4).collect()}
    keys, counts = ppm.summed(ppm.grams(ppm.joined([t.encode() for t in learnt])[0])[1])
    tables = ppm.by_order(keys, counts)
    assert sum(len(k) for k, _, _ in tables[2:]) > 2_000_000
    whole = ppm.Model([(k, c) for k, c, _ in tables])
    assert got[100] == pytest.approx(whole.score(ppm.grams(ppm.joined([rows[-1][1].encode()])[0])[1]).sum(), rel=1e-5)


def test_lm_score_with_many_partitions(spark):
    rows = awkward() + [(100 + i, f"common words number {i % 7} again and again", "en", "a", 1) for i in range(60)]
    scores, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("4", "256"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = lm_scoring.score(docs(spark, rows).repartition(3), "doc_id % 2 = 0", chunk_rows=5)
        scores.append(sorted((str(r["id"]), round(r["base_score"], 6), round(r["score"], 6)) for r in got.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert scores[0] == scores[1]


def test_pruned_model_is_still_whole():
    train = [b"the cat sat on the mat", b"a dog sat on a log"] * 3 + [b"rare words once"]
    keys, counts = ppm.summed(ppm.grams(ppm.joined(train)[0])[1])
    tables = [(k[n >= 3], c[n >= 3]) if j > 1 else (k, c) for j, (k, c, n) in enumerate(ppm.by_order(keys, counts))]
    model = ppm.Model(tables)
    for context in (b"the c", b"rare ", b"zzzzz"):
        base = int.from_bytes(context, "big") << 8
        assert (10 ** model.score(np.array([base | s for s in range(256)], dtype=np.uint64))).sum() == pytest.approx(1, abs=1e-5)


VECTORS = "vec_id long, embedding array<float>, label int"


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=4), 1)], 0) for i in range(300)]
    rows += [(1000 + i, [0.5, 0.5, 0.5, 0.5], 0) for i in range(80)]
    rows += [(2000, None, 0), (2001, [float("nan"), 1.0, 1.0, 1.0], 0), (2002, [float("inf"), 1.0, 1.0, 1.0], 0), (2003, [None, 1.0, 1.0, 1.0], 0), (None, [1.0] * 4, 0), (2100, [1.0, 2.0], 0), (5, rows[5][1], 0)]
    df = spark.createDataFrame(rows, VECTORS)
    got = topk.top_k(df.repartition(5), df.where("vec_id % 50 = 0"), 10).collect()
    good = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v, _ in rows if i is not None and v and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v)]
    want = {}
    for q, v in {i: v for i, v in good if i % 50 == 0}.items():
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q)[:10]
        want |= {(q, k): (i, -s) for k, (s, i) in enumerate(best, 1)}
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got} == want


def test_top_k_few_and_large(spark):
    big = [(100 * i, [float(x) for x in v], 0) for i, v in enumerate([[3e15, -2e15], [1e15, 1e15], [-3e15, 2e15]])]
    got = topk.top_k(spark.createDataFrame(big, VECTORS), spark.createDataFrame(big, VECTORS)).collect()
    assert Counter(r["query_id"] for r in got) == {0: 2, 100: 2, 200: 2}
    empty = spark.createDataFrame([], VECTORS)
    assert topk.top_k(empty, empty).count() == 0 == topk.top_k(spark.createDataFrame(big, VECTORS), empty).count()
    assert topk.top_k(spark.createDataFrame(big[:1], VECTORS), spark.createDataFrame(big[:1], VECTORS)).count() == 0


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def test_urls(spark):
    link = '<link rel="canonical" href="%s">'
    rows = [
        (1, "https://a.example.com/x", link % "https://b.example.com/y"),
        (2, "https://b.example.com/y", '<meta http-equiv="Refresh" content="0; URL=http://evil.NET/z">'),
        (3, "https://c.example.com/other", None),
        (4, "http://WWW.Example.net/en/1?q", link % "/moved"),
        (5, "http://www.example.org/fr/1", link % "https://a.example.com/x#part"),
        (6, "http://example.com/de", ""),
        (7, "http://sub.example.com/de/9", ""),
        (8, None, link % "http://evil.net/"),
        (9, "no scheme at all", ""),
        (10, "http://anet/", ""),
        (11, "https://d.example.com/p/q", "<link href=r rel='canonical nofollow'>"),
        (12, "https://d.example.com/p/r", link % "//x.net/a"),
        (13, "https://d.example.com/free", '<link rel="stylesheet" href="http://evil.net/">'),
        (13, "https://d.example.com/free", '<link rel="stylesheet" href="http://evil.net/">'),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = urls.filter_urls(df, RULES).collect()
    verdict = {r["id"]: (r["rule"], r["verdict"]) for r in got}
    assert verdict == {
        1: (None, "block"), 2: (None, "block"), 3: (None, "allow"), 4: ("example.net/en/", "allow"), 5: ("org/fr/", "allow"), 6: (None, "allow"), 7: ("example.com/de/", "block"),
        8: (None, "allow"), 9: (None, "allow"), 10: (None, "allow"), 11: (None, "block"), 12: (None, "block"), 13: (None, "allow"),
    }
    assert len(got) == len(rows) and {r["id"]: (r["host"], r["path"]) for r in got}[4] == ("www.example.net", "/en/1")
    assert urls.filter_urls(df.limit(0), RULES).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, edges):
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_components_of_a_long_chain(spark):
    got = components(spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long"))
    assert got.where("component <> 0").count() == 0 and got.count() == 301


def test_quality(spark):
    good = [(i, f"A sentence of {i} quite ordinary words, and one more. It ends here.", "en", f"s{i % 5}", 1) for i in range(300)]
    bad = [(1000 + i, f"BUY!! NOW!! {i} !! " * 6, "en", f"s{i % 5}", 1) for i in range(60)]
    rows = good + bad + awkward()
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)] + [(1000 + i, 0, 0) for i in range(30)] + [(None, 1, 0), (5, None, 0), (987654, 0, 1)], "doc_id long, quality int, toxic int")
    df = docs(spark, rows, clashes=True)
    got = quality.judge(df, labels).collect()
    kept = {r["id"] for r in got if r["kept"]}
    assert len(got) == len(rows) and {r[0] for r in good} <= kept and not {r[0] for r in bad} & kept
    out = quality.keep_good(df, labels)
    assert out.columns == df.columns and out.count() == sum(r["kept"] for r in got)
    assert quality.judge(docs(spark, []), labels).count() == 0
    assert quality.keep_good(docs(spark, awkward()), labels.limit(0)).count() == len(awkward())


def test_sparse_sites_shrink_to_their_hosts_rate(spark):
    rows = [(i, "word " * (5 + i % 3), "p", "big", 1) for i in range(200)] + [(900, "word word", "q", "big", 1)]
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    rate = {r["path"]: (r["path_rate"], r["host_rate"]) for r in quality.judge(docs(spark, rows), labels).collect()}
    assert abs(rate["q"][0] - rate["q"][1]) < 0.05


def test_quality_posterior_matches_brute_force(spark):
    rows = [(i, f"plain words number {i % 7} here and there" if i % 4 else f"BUY!! {i % 9} !! NOW", "pq"[i % 3 == 0], f"h{i % 3}", 1) for i in range(120)]
    labels = {i: int(i % 4 > 0) if i % 10 else 1 - int(i % 4 > 0) for i in range(0, 120, 3)}
    frame = spark.createDataFrame([(i, y) for i, y in labels.items()], "doc_id long, quality int")
    got = {r["id"]: r for r in quality.judge(docs(spark, rows), frame).collect()}
    mu = np.mean(list(labels.values()))
    logit = lambda p: np.log(p / (1 - p))
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    value = {i: labels.get(i, sigmoid(r["evidence"] + logit(mu))) for i, r in got.items()}

    def strength(groups, means):
        over = sum(len(g) * (np.mean(g) - m) ** 2 for g, m in zip(groups, means))
        inside = max(over - sum(m * (1 - m) for m in means), 0) / sum(len(g) * m * (1 - m) for g, m in zip(groups, means))
        return np.clip((1 - inside) / inside if inside else 1e6, 1, 1e6)

    host, path = {}, {}
    for i, r in got.items():
        host.setdefault(r["host"], []).append(value[i])
        path.setdefault((r["host"], r["path"]), []).append(value[i])
    k = strength(list(host.values()), [mu] * len(host))
    whole = {h: (sum(v) + k * mu) / (len(v) + k) for h, v in host.items()}
    kp = strength(list(path.values()), [whole[h] for h, _ in path])
    for i, r in got.items():
        h, p = host[r["host"]], path[r["host"], r["path"]]
        above = (sum(h) - value[i] + k * mu) / (len(h) - 1 + k)
        own = (sum(p) - value[i] + kp * above) / (len(p) - 1 + kp)
        assert np.allclose([r["host_rate"], r["path_rate"], r["posterior"]], [above, own, sigmoid(r["evidence"] + logit(own))], atol=1e-6)
        assert r["kept"] == (r["posterior"] >= 0.5)


def test_quality_on_labels_it_was_not_fitted_on(spark):
    sf = "/root/testdata/sf0.01"
    known = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    fitted = spark.read.parquet(f"{sf}/labels.parquet").where("doc_id % 5 <> 0")
    kept = {r["id"]: r["kept"] for r in quality.judge(spark.read.parquet(f"{sf}/documents.parquet"), fitted).collect()}
    held = [i for i in known if i % 5 == 0 and i in kept]
    assert len(held) > 50 and sum(kept[i] != bool(known[i]) for i in held) <= 0.02 * len(held)


def test_words_tell_texts_apart_where_shapes_do_not(spark):
    rows = [(i, f"{'apple pear' if i % 2 else 'grape plum'} number {i % 5}", "en", "a", 1) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    assert {r["id"] for r in quality.judge(docs(spark, rows), labels).collect() if r["kept"]} == set(range(1, 200, 2))


def test_host_pattern_is_plain():
    assert re.fullmatch("[^/?#]*", "a.b:80")
