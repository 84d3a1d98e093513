"""Brute-force versions, round trips and edge cases of the corpus operators."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

pytest.importorskip("public_tokenizers")

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double"


def word(r):
    return "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7)))


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, a clashing extra column."""
    r = random.Random(5)
    long_text = " ".join(word(r) for _ in range(20_000))
    rows = [(i, " ".join(word(r) for _ in range(r.randrange(1, 60))), "en", f"src{i % 4}", 5, 0.5) for i in range(60)]
    rows += [(100, None, None, None, None, None), (101, "", "en", "src1", 0, 0.1), (102, " \t\n ", "en", None, 3, 0.2), (103, long_text, "de", "src2", 9, None)]
    rows += [(None, "one two three", None, None, None, None), (7, rows[7][1], "en", "src3", 5, 0.5), (7, rows[7][1], "en", "src3", 5, 0.5), (104, "é" * 5000 + " <|endoftext|> x", "fr", "src0", 1, 0.0)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def key(rows, *names):
    return sorted(tuple(str(r[n]) for n in names) for r in rows)


# ---------------------------------------------------------------- what operators share


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace as Thing

    from matchloom.llm import common

    monkeypatch.setattr(common, "ship", lambda spark: None)
    made = []
    context = Thing(master="spark://host:7077", getCheckpointDir=lambda: None, setCheckpointDir=made.append)
    session = Thing(sparkContext=context, conf=Thing(get=lambda key, default=None: default))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.checkpoint_dir(session)
    session.conf.get = lambda key, default=None: "hdfs://shared/folder"
    assert common.checkpoint_dir(session) == "hdfs://shared/folder" and made == ["hdfs://shared/folder"]


def test_rows_of_a_key_are_numbered_and_joined_part_by_part(spark):
    from matchloom.llm.common import numbered, settled, spread_join

    r = random.Random(17)
    rows = [(7 if i % 3 else r.randrange(20), i if i % 5 else None) for i in range(900)] + [(None, 1)]
    table = settled(spark.createDataFrame(rows, "k long, v long").repartition(6))
    seen = {}
    for x in numbered(table.where("k is not null"), "k", "nth").collect():
        seen.setdefault(x["k"], []).append(x["nth"])
    assert all(sorted(n) == list(range(len(n))) for n in seen.values()) and len(seen[7]) > 600
    values = spark.createDataFrame([(k, f"name {k}") for k in range(0, 20, 2)], "k long, name string")
    for how in ("inner", "left"):
        want = [(k, v, f"name {k}" if k is not None and k % 2 == 0 else None) for k, v in rows if how == "left" or (k is not None and k % 2 == 0)]
        assert key([dict(zip("kvn", x)) for x in want], "k", "v", "n") == key([dict(zip("kvn", x)) for x in spread_join(table, values, "k", "v", how).select("k", "v", "name").collect()], "k", "v", "n")


# ---------------------------------------------------------------- op10


def test_hilbert_curve_visits_each_cell_once_and_steps_to_a_neighbour():
    from matchloom.llm.hilbert_shards import hilbert_index

    cells = {hilbert_index([x, y, z], 2): (x, y, z) for x in range(4) for y in range(4) for z in range(4)}
    assert sorted(cells) == list(range(64))
    assert all(sum(abs(a - b) for a, b in zip(cells[i], cells[i + 1])) == 1 for i in range(63))


def test_shards_are_even_and_gapless(odd_docs, no_docs):
    from matchloom.llm.hilbert_shards import hilbert_shards

    rows = hilbert_shards(odd_docs).collect()
    assert key(rows, "doc_id") == key(odd_docs.collect(), "doc_id")
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(by_shard.get(s, [])) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(x) == list(range(len(x))) for x in by_shard.values())
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(data) + 8 and r["text_crc32"] == zlib.crc32(data)
    order = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in order] == sorted(r["curve"] for r in rows)
    assert hilbert_shards(no_docs).count() == 0


def test_equal_texts_are_neighbours(spark, monkeypatch):
    from pyspark.sql import functions as F

    from matchloom.llm import hilbert_shards as H

    r = random.Random(8)
    rows = [(i, f"text {i // 2 if i < 200 else i}" if i < 700 else "hot", r.choice(["en", "de", None]), f"s{r.randrange(9)}") for i in range(1000)]
    rows += [(5000 + i, None, "en", "s1") for i in range(3)] + [(6000, "", "en", "s2"), (None, "hot", None, None), (7, "text 3", "xx", "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    plain = H.hilbert_shards(docs, shards=20).collect()
    monkeypatch.setattr(H, "PART", 7)
    monkeypatch.setattr(H, "VALUES", 3)
    again = H.hilbert_shards(docs, shards=20).collect()
    assert key(plain, "doc_id", "shard", "slot", "curve") == key(again, "doc_id", "shard", "slot", "curve")
    order = sorted(plain, key=lambda x: (x["shard"], x["slot"]))
    place, curves = {}, {}
    for n, x in enumerate(order):
        group = (x["text_crc32"], x["size"])
        place.setdefault(group, []).append(n)
        curves.setdefault(group, set()).add(x["curve"])
    assert all(max(p) - min(p) == len(p) - 1 and len(curves[g]) == 1 for g, p in place.items() if g[0])
    shards = {g: {order[n]["shard"] for n in p} for g, p in place.items()}
    hot = (zlib.crc32(b"hot"), 11)
    assert len(place[hot]) == 301 and 301 // 51 <= len(shards[hot]) <= 301 // 50 + 2
    assert all(len(s) <= 2 for g, s in shards.items() if g != hot)


# ---------------------------------------------------------------- op5


def test_mix_keeps_targets_and_reruns_agree(spark, odd_docs, no_docs):
    from matchloom.llm.mixing import mix_sources, mixed_documents

    one, two = (mix_sources(odd_docs.repartition(n)).collect() for n in (1, 5))
    assert key(one, "doc_id", "size", "source", "taken") == key(two, "doc_id", "size", "source", "taken")
    sizes = {}
    for r in one:
        assert r["taken"] == r["copies"] * r["size"] and r["taken"] <= 3 * r["size"]
        sizes.setdefault(r["source"], []).append(r)
    weights = dict(zip(sorted((s for s in sizes if s is not None)) + [None], [1, 2, 3, 1, 2]))
    want, open_ = {}, set(sizes)
    total = sum(r["size"] for r in one)
    caps = {s: 3 * sum(r["size"] for r in rows) for s, rows in sizes.items()}
    while True:  # share by weight, fix what is above its cap, share the rest again
        level = (total - sum(want.values())) / sum(weights[s] for s in open_)
        above = {s for s in open_ if level * weights[s] > caps[s]}
        if not above:
            break
        want |= {s: caps[s] for s in above}
        open_ -= above
    want |= {s: level * weights[s] for s in open_}
    for s, rows in sizes.items():
        assert rows[0]["target"] == pytest.approx(want[s])
        assert abs(sum(r["taken"] for r in rows) - want[s]) <= max(r["size"] for r in rows)
    assert mixed_documents(odd_docs).count() == sum(r["copies"] for r in one if r["size"])
    assert mix_sources(no_docs).count() == 0


def test_rounding_keeps_sums_and_expectations():
    from matchloom.llm.mixing import pivotal

    draw = np.random.default_rng(0)
    size, share, hits = np.sort(draw.integers(1, 50, 40))[::-1].astype(float), 0.37, np.zeros(40)
    for _ in range(3000):
        part, held = pivotal(size, np.full(40, share), draw.random(40))
        assert (part * size).sum() == pytest.approx(share * size.sum())
        assert ((part > 0) & (part < 1)).sum() == (held >= 0)
        hits += part
    assert np.abs(hits / 3000 - share).max() < 0.05


def test_settlement_comes_as_near_as_single_copies_can():
    from matchloom.llm.mixing import MAX_COPIES, settlement

    r = random.Random(6)
    for _ in range(200):
        size = np.array([r.choice([0, 1, 3, r.randrange(1, 400)]) for _ in range(r.randrange(1, 40))])
        copies = np.array([r.randrange(0, 4) for _ in size])
        miss = r.uniform(-500, 500)
        left, after = miss, copies.copy()
        for row, change in settlement(size, copies, miss):
            after[row] += change
            assert abs(left - change * size[row]) < abs(left)
            left -= change * size[row]
        assert (after >= 0).all() and (after <= MAX_COPIES).all()
        step = 1 if left > 0 else -1
        free = (after == copies) & (size > 0) & ((copies < MAX_COPIES) if step > 0 else (copies > 0))
        assert len(np.flatnonzero(after != copies)) == 16 or all(abs(left - step * s) >= abs(left) for s in size[free])  # no single copy comes nearer


def test_a_bucket_is_rounded_as_pairs_say_and_repeats_are_spread(spark):
    """Brute force of a small mix: one bucket, pairs from the longest down, what is left settled copy by copy."""
    from pyspark.sql import functions as F

    from matchloom.llm import mixing as M

    r = random.Random(12)
    rows = [(i, " ".join("w" * r.randrange(1, 9) for _ in range(r.randrange(0, 90))), f"s{i % 3}") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {x["doc_id"]: x for x in M.mix_sources(docs).collect()}
    keys = {x[0]: x[1] for x in docs.select("doc_id", F.xxhash64("doc_id", F.regexp_count("text", F.lit(M.WORD)).cast("long"), F.lit(42))).collect()}
    keys = {i: k for i, k in keys.items()}
    draws = {x[0]: x[1] for x in spark.createDataFrame(list(keys.items()), "i long, k long").select("i", F.xxhash64("k", F.lit(0).cast("long"))).collect()}
    for s in ("s0", "s1", "s2"):
        own = [(i, len(t.split()), M.mix64(M.mix64(np.array([draws[i]], np.int64).view(np.uint64) ^ np.uint64(42)))[0]) for i, t, x in rows if x == s and t.split()]
        order = {i: M.mix64(np.array([draws[i]], np.int64).view(np.uint64) ^ np.uint64(42))[0] for i, _, _ in own}
        own.sort(key=lambda o: (-o[1], order[o[0]]))
        target, all_ = got[own[0][0]]["target"], sum(n for _, n, _ in own)
        whole, open_ = {i: int(target / all_) for i, _, _ in own}, None
        for i, n, draw in own:  # probabilities as exact floats, one pair at a time
            p = target / all_ - int(target / all_)
            if not 0 < p < 1:
                continue
            if open_ is None:
                open_ = (i, n, p)
                continue
            j, m, q = open_
            up, down = min((1 - q) * m, p * n), min(q * m, (1 - p) * n)
            q, p = (q + up / m, p - up / n) if float(draw >> np.uint64(11)) * 2.0**-53 * (up + down) < down else (q - down / m, p + down / n)
            near = lambda x: 0 if x < 1e-9 else 1 if x > 1 - 1e-9 else x
            q, p = near(q), near(p)
            whole[j] += q == 1
            whole[i] += p == 1
            open_ = (j, m, q) if 0 < q < 1 else (i, n, p) if 0 < p < 1 else None
        different = [i for i, _, _ in own if got[i]["copies"] != whole[i]]
        assert len(different) <= M.SETTLE + 1  # the last open one and those that settle
        assert abs(sum(got[i]["taken"] for i, _, _ in own) - target) <= 2
    same = spark.createDataFrame([(None, "three words here", "a")] * 3000 + [(None, "two words", "b")] * 3000, "doc_id long, text string, source string")
    mixed = M.mix_sources(same).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("want"), F.count("*").alias("n")).collect()
    assert all(abs(x["t"] - x["want"]) <= 2 and x["n"] == 3000 for x in mixed)
    assert M.mixed_documents(same).groupBy("source").count().count() == 2
    counts = {x["source"]: x["count"] for x in M.mixed_documents(same).groupBy("source").count().collect()}
    assert counts == {x["source"]: x["t"] // (3 if x["source"] == "a" else 2) for x in mixed}


# ---------------------------------------------------------------- op8, op6


def test_packing_round_trip(odd_docs, no_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    from matchloom.llm.packing import pack_documents

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = pack_documents(odd_docs).collect()
    docs = [(r["doc_id"], tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0]) for r in odd_docs.collect()]
    want = []
    for doc_id, ids in docs:
        first = (len(ids) - 1) % 2048 + 1
        for piece, start in enumerate([0, *range(first, len(ids), 2048)]):
            part = ids[start : start + (first if piece == 0 else 2048)]
            want.append((doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(map(str, want)) == sorted(str(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32"))) for r in rows)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in bins.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))] and sum(n for _, n in pieces) <= 2048
    assert pack_documents(no_docs).count() == 0


def best_fit(lengths, capacity):
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [(x, i) for i, x in enumerate(left) if x >= n]
        if fits:
            left[min(fits)[1]] -= n
        else:
            left.append(capacity - n)
    return sorted(left)


def test_plan_is_best_fit_decreasing_piece_by_piece():
    from matchloom.llm.packing import best_fit_plan, place

    r = random.Random(1)
    for _ in range(30):
        lengths = [r.choice([1, 2, 3, 7, r.randrange(1, 65)]) for _ in range(r.randrange(1, 300))]
        histogram = {n: lengths.count(n) for n in set(lengths)}
        plan = best_fit_plan(histogram, 64)
        plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
        length = np.array(sorted(lengths))
        rank = np.concatenate([np.arange(histogram[n]) for n in sorted(histogram)])
        bins, offset = place(plan, length, rank)
        left = [64 - length[bins == b].sum() for b in range(bins.max() + 1)]
        assert sorted(left) == best_fit(lengths, 64)
        for b in range(bins.max() + 1):
            own = np.argsort(offset[bins == b])
            assert (offset[bins == b][own] == np.concatenate([[0], np.cumsum(length[bins == b][own])[:-1]])).all()


def test_token_spans_agree_with_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    from matchloom.llm.token_attribution import attribute, token_spans
    from matchloom.llm.tokens import encoder

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("Héllo wörld\n\nnew  line", "日本語 text 🙂🙂 end", "a<|endoftext|>b", "x"):
        starts, ends = token_spans(text, encoder())
        encoding = tokenizer.encode(text, add_special_tokens=False)
        assert len(starts) == len(encoding.ids)
        for s, e, (a, b) in zip(starts, ends, encoding.offsets):
            assert s <= a and b == e  # offsets there leave out leading spaces
    counts, crossing = attribute(np.array([0, 3, 8]), np.array([3, 8, 9]), np.array([0, 5, 7]), 9, "most")
    assert counts.tolist() == [2, 0, 1] and crossing.tolist() == [1, 1, 1]
    assert attribute(np.array([3]), np.array([8]), np.array([0, 5, 7]), 9, "last")[0].tolist() == [0, 0, 1]


def test_token_counts_add_up(odd_docs, no_docs):
    from matchloom.llm.token_attribution import attribute_tokens
    from matchloom.llm.tokens import encoder

    rows = attribute_tokens(odd_docs, ("source", "text"), joiner=": ", pattern=r"[a-f]+ ", rule="most").collect()
    total = sum(len(encoder().ids(f"{r['source'] or ''}: {r['text'] or ''}")) for r in odd_docs.collect())
    assert sum(r["n_tokens"] for r in rows) == total and sum(r["n_crossing"] for r in rows) > 0
    assert attribute_tokens(no_docs).count() == 0
    with pytest.raises(ValueError):
        attribute_tokens(no_docs, rule="none")


@pytest.mark.parametrize("rule", ["first", "last", "most"])
def test_token_counts_of_sections_by_brute_force(spark, rule):
    import public_tokenizers
    from tokenizers import Tokenizer

    from matchloom.llm.token_attribution import attribute_tokens

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(10)
    rows = [(i, "".join(r.choice(["ab", " the", "é", "\n", "x|", " 日本", "🙂", "  ", "word"]) for _ in range(r.randrange(0, 60))), f"s|{i}") for i in range(40)]
    got = {}
    for x in attribute_tokens(spark.createDataFrame(rows, "doc_id long, text string, source string"), ("source", "text"), joiner=" ", pattern=r"\|", rule=rule).collect():
        got.setdefault(x["doc_id"], []).append((x["section"], x["field"], x["start_char"], x["end_char"], x["n_tokens"]))
    for i, text, source in rows:
        whole, begins, fields, at = f"{source} {text}", [], [], 0
        for name, field, tail in (("source", source, " "), ("text", text, "")):
            parts = field.split("|")
            parts = [p + "|" for p in parts[:-1]] + ([parts[-1]] if parts[-1] or len(parts) == 1 else [])
            for p in parts:
                begins.append(at)
                fields.append(name)
                at += len(p)
            at += len(tail)
        ends, data = [*begins[1:], len(whole)], whole.encode()
        counts, byte = [0] * len(begins), 0
        for token in tokenizer.encode(whole, add_special_tokens=False).ids:  # a token is a run of bytes
            width = len(tokenizer.id_to_token(token))  # a character of the vocabulary stands for a byte
            covered = [c for c in range(len(whole)) if len(whole[:c].encode()) < byte + width and len(whole[: c + 1].encode()) > byte]
            byte += width
            shares = [sum(b <= c < e for c in covered) for b, e in zip(begins, ends)]
            held = [k for k, n in enumerate(shares) if n]
            counts[held[0] if rule == "first" else held[-1] if rule == "last" else max(held, key=lambda k: (shares[k], -k))] += 1
        assert byte == len(data)
        assert sorted(got[i]) == [(k, f, b, e, n) for k, (f, b, e, n) in enumerate(zip(fields, begins, ends, counts))]


# ---------------------------------------------------------------- op4


def components_of(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def shingles_of(text):
    words = (text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w.lower() for w in words if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


@pytest.mark.parametrize("block", [40, 1000])
def test_jaccard_join_is_exact(spark, monkeypatch, block):
    from matchloom.llm import jaccard_join as J

    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "RANGE", 5_000)
    r = random.Random(3)
    vocabulary = [f"W{i}" for i in range(2000)]
    passage, texts = [r.choice(vocabulary) for _ in range(60)], []
    for copies in (1, 2, 20, 120):
        base = [r.choice(vocabulary) for _ in range(r.choice([60, 120]))]
        for _ in range(copies):
            texts.append([r.choice(vocabulary) if r.random() < 0.02 else w for w in base])
    texts += [[r.choice(vocabulary) for _ in range(40)] + passage for _ in range(100)] + [[r.choice(vocabulary) for _ in range(r.randrange(9))] for _ in range(60)]
    rows = list(enumerate(" ".join(t) for t in texts)) + [(9000, None), (9001, ""), (9002, " \t"), (9003, texts and " ".join(texts[0]).lower())]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    sets = {i: shingles_of(t) for i, t in rows}
    ids = sorted(sets)
    linked = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    comp = components_of(ids, linked)
    assert got == {i: (len(sets[i]), comp[i]) for i in ids}


def chained(r, clusters, copies, words=80):
    """Clusters of near copies, each sharing half of its base with the next: one region, in which pivots part clusters."""
    texts, base = [], [f"w{r.randrange(10**6)}" for _ in range(words)]
    for _ in range(clusters):
        for _ in range(copies):
            texts.append(" ".join(w if r.random() > 0.003 else f"x{r.randrange(10**6)}" for w in base))
        base = base[words // 2 :] + [f"w{r.randrange(10**6)}" for _ in range(words // 2)]
    r.shuffle(texts)
    return texts


def brute_components(texts):
    sets = [shingles_of(t) for t in texts]
    linked = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return components_of(range(len(sets)), linked)


@pytest.mark.parametrize("hot", [3, 1000])
def test_pivots_part_large_regions_across_tasks(spark, monkeypatch, hot):
    from matchloom.llm import jaccard_join as J

    monkeypatch.setattr(J, "BLOCK", 40)
    monkeypatch.setattr(J, "HOT", hot)  # 3: nearly all shingles are known by the filter only
    tight, real = [], J.part_cells

    def watched(sets, cells):
        first = cells.groupBy("cell").count().agg({"count": "max"}).first()[0]
        small, left, edges = real(sets, cells)
        tight.append((first, small.groupBy("cell").count().agg({"count": "max"}).first()[0], left.count() if left is not None else 0))
        return small, left, edges

    monkeypatch.setattr(J, "part_cells", watched)
    texts = chained(random.Random(21), 14, 25)
    got = {x["doc_id"]: x["component_id"] for x in J.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    assert got == brute_components(texts)
    (region, cell, left), = tight
    assert cell <= 40 and left == 0 and (region > 80 or hot > 3), tight  # regions of several blocks, parted into cells of one at most


def test_pivots_part_regions_within_a_task():
    from matchloom.llm import jaccard_join as J
    from matchloom.llm.shingles import shingle_sets

    for seed in range(6):
        texts = chained(random.Random(seed), 8, 12)
        join = J.Join(list(shingle_sets(t.encode() for t in texts)))
        edges = join.all()
        assert join.splits > 0 and components_of(range(len(texts)), edges) == brute_components(texts)


def test_a_passage_in_all_documents_joins_nothing(spark, monkeypatch):
    from matchloom.llm import jaccard_join as J

    monkeypatch.setattr(J, "HOT", 50)
    r = random.Random(14)
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [f"{passage} " + " ".join(f"q{r.randrange(10**6)}" for _ in range(60)) for _ in range(400)] + [passage + " tail"] * 2 + [passage]
    got = {x["doc_id"]: x["component_id"] for x in J.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    assert got == {i: min(i, 400) for i in range(403)}


def test_jaccard_join_edge_cases(odd_docs, no_docs):
    from matchloom.llm.jaccard_join import jaccard_join, near_duplicates_dropped

    rows = jaccard_join(odd_docs).collect()
    assert key(rows, "doc_id") == key(odd_docs.collect(), "doc_id")
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[100]["n_shingles"] == by_id[101]["n_shingles"] == 0 and by_id[102]["component_id"] == 102
    kept = near_duplicates_dropped(odd_docs)
    assert kept.columns == odd_docs.columns and kept.where("doc_id = 7").count() == 1 and kept.where("doc_id is null").count() == 1
    assert jaccard_join(no_docs).count() == 0


def test_rows_that_repeat_an_id_are_decided_one_by_one(spark):
    from matchloom.llm.jaccard_join import near_duplicates_dropped

    r = random.Random(9)
    a, b, c = (" ".join(word(r) for _ in range(60)) for _ in range(3))
    near = c + " tail"
    rows = [(5, a, "x"), (5, b, "x"), (5, b, "x"), (6, a.upper(), "x"), (3, c, "x"), (5, near, "x"), (8, near, "x"), (7, None, "x"), (7, "", "x"), (7, "", "x"), (2, "own words only here now", "x"), (None, a, "x")]
    kept = near_duplicates_dropped(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()
    whole = [(5, a), (5, b), (3, c), (7, None), (7, ""), (2, "own words only here now"), (None, a)]
    assert sorted(repr((k["doc_id"], k["text"])) for k in kept) == sorted(map(repr, whole))


def test_more_sets_of_a_shingle_than_fit_beside_it():
    from matchloom.llm import jaccard_join as J

    n, part = 2**24 + 1000, 50_000
    messages = []
    for at in range(0, n, part):
        nodes = np.arange(at, min(at + part, n), dtype=np.uint64)
        messages.append({"slot": 0, "keys": J._low(np.full(len(nodes), 77, np.uint64), J.KEY), "of": np.arange(len(nodes), dtype=np.uint16).tobytes(), "nodes": J._low(nodes, J.NAME), "counts": b""})
    found = J._count_shared(1)(pa.Table.from_pylist(messages, J.ROW))
    hot = found.filter(pc.is_null(found["nodes"]))
    assert [J._wide(k.as_py(), J.KEY).tolist() for k in hot["keys"]] == [[77]]
    found = found.filter(pc.is_valid(found["nodes"]))
    assert sum(len(x.as_py()) // J.NAME for x in found["nodes"]) == n
    assert all((np.frombuffer(x.as_py(), np.uint32) == 1).all() for x in found["counts"])


@pytest.mark.parametrize("beside", [24, 1])
def test_shared_shingles_are_sent_once_and_counted_for_all(monkeypatch, beside):
    from matchloom.llm import jaccard_join as J

    monkeypatch.setattr(J, "MESSAGE", 60)
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 60, 12).astype(np.uint64) * np.uint64(2**58 + 12345)) for _ in range(40)]
    rows, most = [], 0
    for slot, keys, of, nodes, times in J._ranged(((i + 1, s) for i, s in enumerate(sets)), 1, once=True):
        if slot is None:
            rows.append({"slot": 0, "nodes": J._low(nodes, J.NAME), "counts": keys.astype(np.uint32).tobytes()})
        else:
            most = max(most, np.unique(keys, return_counts=True)[1].max())
            rows.append({"slot": 0, "keys": J._low(keys, J.KEY), "of": of.astype(np.uint16).tobytes(), "nodes": J._low(nodes, J.NAME), "counts": times.astype(np.uint32).tobytes()})
    monkeypatch.setattr(J, "BESIDE", beside)
    monkeypatch.setattr(J, "HOT", 9)
    found = J._count_shared(3)(pa.Table.from_pylist(rows, J.ROW))
    hot = np.concatenate([np.zeros(0, np.uint64), *(J._wide(k.as_py(), J.KEY) for k in found["keys"] if k.is_valid)])
    held = {}
    for s in sets:
        for x in s.tolist():
            held[x] = held.get(x, 0) + 1
    assert sorted(hot.tolist()) == sorted(x & (2**40 - 1) for x, n in held.items() if n >= 9) and len(hot) > 5
    found = J._shared_counts(found.filter(pc.is_valid(found["counts"])))
    got = dict(zip(found["name"].to_pylist(), found["shared"].to_pylist()))
    assert most == 1
    for i, s in enumerate(sets):
        assert got.get(i + 1, 0) == sum(any(k in o for j, o in enumerate(sets) if j != i) for k in s)


def test_shingles_of_one_set_that_look_alike_count_each():
    from matchloom.llm import jaccard_join as J

    alike = np.array([5, 5 + 2**41], np.uint64)  # one range, equal in the bits that travel
    rows = []
    for node, more in ((1, 70), (2, 90)):  # two partitions
        for slot, keys, of, nodes, times in J._ranged([(node, np.append(alike, np.uint64(more)))], 1, once=True):
            row = {"slot": 0, "nodes": J._low(nodes, J.NAME)}
            row |= {"counts": keys.astype(np.uint32).tobytes()} if slot is None else {"keys": J._low(keys, J.KEY), "of": of.astype(np.uint16).tobytes(), "counts": times.astype(np.uint32).tobytes()}
            rows.append(row)
    found = J._shared_counts(J._count_shared(1)(pa.Table.from_pylist(rows, J.ROW)))
    assert dict(zip(found["name"].to_pylist(), found["shared"].to_pylist())) == {1: 2, 2: 2}


def test_words_are_hashed_alike_in_slices_and_whole(monkeypatch):
    from matchloom.llm import shingles as H

    r = random.Random(2)
    texts = [" ".join(word(r) for _ in range(n)) for n in (0, 1, 4, 5, 300)] + ["x" * 700, "y " * 50 + "z" * 900 + " end of it all", "A\tB\nC d  E é ñ"]
    whole = [H.set_id(s) for s in H.shingle_sets(t.encode() for t in texts)]
    monkeypatch.setattr(H, "SLICE", 64)
    assert [H.set_id(s) for s in H.shingle_sets(t.encode() for t in texts)] == whole
    assert [len(s) for s in H.shingle_sets(t.encode() for t in texts)] == [len(shingles_of(t)) for t in texts]


# ---------------------------------------------------------------- op3, op7


@pytest.fixture(scope="module")
def vectors(spark):
    draw = np.random.default_rng(4)
    base = draw.normal(size=(12, 16))
    x = [base[i % 12] + draw.normal(size=16) * (0.12 if i % 3 else 0.4) for i in range(240)]
    rows = [(i, [float(np.float32(v)) for v in x[i]], i % 2) for i in range(240)]
    rows += [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] + [1.0] * 15, 0), (303, [None] + [1.0] * 15, 1), (304, rows[0][1], None), (305, rows[0][1], 0), (306, rows[0][1], 0), (307, [], 0), (308, [1.0, 2.0], 0), (309, [2.0, 4.0], 0)]
    rows += [(None, rows[0][1], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_vector_links_are_exact(vectors, monkeypatch):
    from matchloom.llm import vector_dedup as V

    monkeypatch.setattr(V, "BLOCK", 7)
    rows = vectors.collect()
    fit = [r for r in rows if r["vec_id"] is not None and r["label"] is not None and r["embedding"] and all(v is not None and np.isfinite(v) for v in r["embedding"]) and any(r["embedding"])]
    linked = []
    for a in fit:
        for b in fit:
            if a["vec_id"] < b["vec_id"] and a["label"] == b["label"] and len(a["embedding"]) == len(b["embedding"]):
                x, y = np.array(a["embedding"]), np.array(b["embedding"])
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.93:
                    linked.append((a["vec_id"], b["vec_id"]))
    comp = components_of([r["vec_id"] for r in rows if r["vec_id"] is not None], linked)
    n = {i: sum(i in pair for pair in linked) for i in comp}
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in V.link_vectors(vectors).collect()}
    assert len(linked) > 300 and got.pop(None) == (0, None, False)
    assert got == {i: (n[i], comp[i], comp[i] == i) for i in comp}
    assert V.link_vectors(vectors.limit(0)).count() == 0


def test_vectors_that_repeat_an_id_and_clashing_columns(spark):
    from matchloom.llm.vector_dedup import link_vectors

    east, north, mix = [1.0, 0.0], [0.0, 1.0], [0.999, 0.01]
    rows = [(1, east, 0), (1, north, 0), (2, mix, 0), (3, [0.01, 2.0], 0), (4, east, 1), (2, mix, 0)]
    table = spark.createDataFrame([(*r, "x", 7, 8) for r in rows], "vec_id long, embedding array<float>, label int, id string, n_links int, component long")
    got = sorted((r["vec_id"], r["component_id"], r["kept"]) for r in link_vectors(table).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (2, 1, False), (3, 1, False), (4, 4, True)]


def test_tiles_are_compared_as_the_whole(vectors, monkeypatch):
    from matchloom.llm import vector_dedup as V

    whole = key(V.link_vectors(vectors).collect(), "vec_id", "n_links", "component_id")
    real = V.tiles_of
    monkeypatch.setattr(V, "tiles_of", lambda v, axes: real(v, axes, 10))
    monkeypatch.setattr(V, "BOXES", 3)
    monkeypatch.setattr(V, "AXIS_ROWS", 5)
    assert key(V.link_vectors(vectors).collect(), "vec_id", "n_links", "component_id") == whole


def test_hamming_search_is_exact(spark, monkeypatch):
    from matchloom.llm import hamming_search as H

    monkeypatch.setattr(H, "SHARD", 60)
    monkeypatch.setattr(H, "QUERIES", 7)
    draw = np.random.default_rng(6)
    codes = [bytes(draw.integers(0, 256, 8, dtype=np.uint8)) for _ in range(150)]
    codes += [codes[0]] * 40 + [bytes([codes[1][0] ^ 1, *codes[1][1:]])]
    rows = list(enumerate(codes))
    table = spark.createDataFrame(rows, "vec_id long, code binary")
    asked = table.where("vec_id % 10 = 0")
    got = {}
    for r in H.top_k(table, asked, 12).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["distance"]))
    for q, code in rows[::10]:
        far = sorted(((bin(int.from_bytes(code) ^ int.from_bytes(c)).count("1"), i) for i, c in rows if i != q))[:12]
        assert sorted(got[q]) == [(n + 1, i, d) for n, (d, i) in enumerate(far)]
    assert H.top_k(table.limit(0), asked.limit(0)).count() == 0
    assert len(H.top_k(table.where("vec_id < 3"), asked.where("vec_id = 0")).collect()) == 2


def test_hamming_search_of_odd_rows(spark):
    from matchloom.llm.hamming_search import top_k

    a, b, c = bytes(8), b"\x01" + bytes(7), b"\x07" + bytes(7)
    rows = [(1, a, 9), (1, c, 9), (2, b, 9), (2, b, 9), (3, c, 9), (None, a, 9), (4, None, 9), (5, bytes(16), 9)]  # id 1 has two codes
    table = spark.createDataFrame(rows, "vec_id long, code binary, rank int")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["distance"]) for r in top_k(table, table, 5).collect()}
    assert got == {(1, 1): (2, 1), (1, 2): (3, 3), (2, 1): (1, 1), (2, 2): (3, 2), (3, 1): (2, 2), (3, 2): (1, 3)}


def test_a_bound_ends_a_search_without_losing_ties():
    from matchloom.llm.hamming_search import MultiIndex

    draw = np.random.default_rng(7)
    words = draw.integers(0, 2**63, (300, 1), dtype=np.uint64)
    index = MultiIndex(words, np.ones(300, np.int64), np.arange(300))
    for q in words[:20]:
        codes, far = index.nearest(q, 300)
        for bound in (0, 20, 27, 64):
            few, near = index.nearest(q, 300, bound)
            assert few.tolist() == codes[far <= bound].tolist() and near.tolist() == far[far <= bound].tolist()


def test_sign_codes_leave_out_what_is_no_vector(vectors):
    from matchloom.llm.hamming_search import sign_codes

    ids = {r["vec_id"] for r in sign_codes(vectors).collect()}
    assert not ids & {300, 302, 303, 307, None} and {0, 301, 304, 308} <= ids


@pytest.mark.parametrize("limit", [0, 10**9])
def test_components(spark, monkeypatch, limit):
    from matchloom.llm import components as C

    monkeypatch.setattr(C, "ONE_TASK", limit)
    r = random.Random(8)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1040)]
    got = {x["node"]: x["component"] for x in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = components_of({n for e in edges for n in e}, edges)
    assert got == {n: c for n, c in want.items() if any(n in e and e[0] != e[1] for e in edges)}


def test_settling_lets_the_driver_collect_its_garbage(spark, monkeypatch):
    """Now and then, not each time."""
    from matchloom import session
    from matchloom.llm import common

    seen = []
    monkeypatch.setattr(session.gc, "collect", lambda: seen.append(1))
    spark.sparkContext._matchloom_collected = -1e9
    for _ in range(3):
        assert common.settled(spark.range(3)).count() == 3
    assert len(seen) == 1
