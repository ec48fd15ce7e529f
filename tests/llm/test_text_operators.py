"""Operators on documents: against brute force, exact round trips, held-out labels, and odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gridlight.llm import arrow_tokens, bpe, decontaminate, language_model, near_duplicates, sharding, toxicity
from gridlight.llm.common import components, held_out

ODD = [None, "", "   \n\t", "one", "One two", "a  b\n \nc", "naïve “x” ñ 漢字 🙂 <|endoftext|> don't stop\x1c!", "word " * 3000]


def odd_docs(spark, extra=()):
    """Nulls, empty, long and repeated texts, a repeated id, and columns with clashing names."""
    rows = [(i, t, "x", i, 1.0) for i, t in enumerate([*ODD, *extra])] + [(3, "one", "x", 0, 1.0), (900, "one", "x", 0, 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, size long, score double")


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def words_of(text):
    return (text or "").encode().lower().split()


# byte-level BPE


def test_bpe_equals_the_rank_encoder_on_odd_texts():
    import tiktoken

    spec = bpe.rank_spec()
    encoder, table = bpe.Encoder.of(spec), bpe.token_bytes(spec)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    pool = ["  ", " ", "\n", "\t", "'s", "'ll", "th", "é", "漢", "🙂", "1", ".", "!!", " the", " ", " ", "\x85"]
    for text in [t or "" for t in ODD] + ["".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(2000)]:
        ids = encoder.ids(encoder.encode(text)).tolist()
        assert ids == want.encode_ordinary(text), text
        assert b"".join(table[i] for i in ids) == text.encode()
        assert "".join(bpe.decode_tokens(ids, table)) == text


def test_bpe_parts_of_pieces_and_a_full_cache(monkeypatch):
    """Pieces put together from their parts have the ids of one call on the whole text, also when the cache starts anew."""
    monkeypatch.setattr(bpe, "CACHE_PIECES", 40)
    rng = random.Random(11)
    pool = ["word", "Été", "ß", "ɏ", "ɐ", "×", "ª", "²", "½", "7", "'s", "'", "n't", ".", "...", "***", "&&&", "_", "-", "\n", "\n\n", "\t", "\r\n", " ", " ", "  ", "\u0301", "\xa0", "\x1c", "文"]
    for spec in (bpe.file_spec(), bpe.rank_spec()):
        encoder = bpe.Encoder(spec)
        for _ in range(2000):
            text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 30)))
            assert encoder.encode(text) == encoder.whole(text), text


def test_bpe_round_trip_of_frames(spark):
    df = odd_docs(spark)
    spec = bpe.rank_spec()
    back = bpe.decode(bpe.encode(df, spec), spec).collect()
    assert len(back) == len(ODD) + 2 and all(bytes(r.decoded).decode() == (r.text or "") for r in back)
    empty = next(r for r in bpe.round_trip(df, spec).collect() if r.doc_id == 1)
    assert (empty.n_tokens, empty.ids_sha256, empty.decoded_sha256) == (0, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest())
    assert bpe.round_trip(df.limit(0), spec).count() == 0


# token files


def test_token_files_against_brute_force(spark, docs, texts, tmp_path):
    spec = bpe.file_spec()
    folder = f"file://{tmp_path}/t"
    manifest = arrow_tokens.write(docs, spec, folder, length=64)
    got = {r.doc_id: r for r in arrow_tokens.read(manifest, folder).collect()}
    encoder, start, flat = bpe.Encoder.of(spec), 0, []
    for d in sorted(texts):
        ids = np.append(encoder.ids(encoder.whole(texts[d])), 0).astype("<u4")
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
        flat.append(ids)
    flat, begin = np.concatenate(flat), 0
    for f in sorted(manifest.collect(), key=lambda r: r.part):
        row = (f.n_tokens - 1) // 64
        assert np.array_equal(arrow_tokens.read_rows(f.path, folder, [row])[0], flat[begin + row * 64 : begin + f.n_tokens])
        begin += f.n_tokens


def test_token_files_of_odd_rows(spark, tmp_path):
    folder = f"file://{tmp_path}/o"
    got = arrow_tokens.read(arrow_tokens.write(odd_docs(spark), bpe.file_spec(), folder), folder).collect()
    assert len(got) == len(ODD) + 2 and sum(r.doc_id == 3 for r in got) == 2
    assert {r.n_tokens for r in got if r.doc_id in (0, 1)} == {1}
    folder = f"file://{tmp_path}/e"
    assert arrow_tokens.read(arrow_tokens.write(odd_docs(spark).limit(0), bpe.file_spec(), folder), folder).count() == 0


# shards


@pytest.mark.parametrize("copies", [1, 60])
def test_shards(spark, docs, copies):
    many = docs.select("doc_id", "text") if copies == 1 else docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "one hot text").otherwise(F.col("text")).alias("text"))
    rows = sharding.shard(many, 8, part_rows=10, least_parts=4).collect()
    assert len(rows) == docs.count()
    slots, sizes = collections.defaultdict(list), collections.Counter()
    for r in rows:
        assert (r.size, r.text_crc32) == (len(r.text.encode()) + 1, zlib.crc32(r.text.encode()))
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in rows) + 0.01 * sum(sizes.values())


def plain_shards(rows, shards):
    """Rows (id, text) cut where the sums of bytes come nearest to a shard's share, one by one in the operator's order of keys."""
    sizes = [len((t or "").encode()) + 1 for _, t in rows]
    return sum(sizes) / shards, max(sizes)


@pytest.mark.parametrize("ids", ["equal", "null", "few"])
def test_shards_of_equal_rows(spark, ids):
    """Rows that are equal in text and doc_id are cut apart: every shard's bytes are within a row and the tolerance of its share."""
    rows = [({"equal": 7, "null": None, "few": k % 3 or None}[ids], "the same text") for k in range(200)] + [(k, f"text {k} " * (k % 5)) for k in range(200)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), part_rows=10, least_parts=2).collect()
    share, longest = plain_shards(rows, 16)
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, rows))
    assert sorted(sizes) == list(range(16)) and all(abs(v - share) <= longest + 0.002 * share for v in sizes.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_in_order_against_brute_force(spark, docs):
    """Shards and slots together are the order of (hash, doc_id), cut at the rows whose sums come nearest to the shares."""
    frame = docs.select("doc_id", "text")
    order = [r.doc_id for r in frame.orderBy(F.shiftrightunsigned(F.xxhash64(F.encode("text", "UTF-8")), 4), "doc_id").collect()]
    got = {r.doc_id: r for r in sharding.shard(frame, 8, tolerance=0.0, columns=["doc_id"]).collect()}
    assert sorted(got, key=lambda i: (got[i].shard, got[i].slot)) == order
    sums = np.cumsum([got[i].size for i in order])
    for k in range(1, 8):
        cut = sum(got[i].shard < k for i in order)
        best = np.abs(np.concatenate([[0], sums]) - sums[-1] * k / 8).min()
        assert abs(([0, *sums][cut]) - sums[-1] * k / 8) == pytest.approx(best)


def test_shards_of_odd_rows(spark):
    rows = sharding.shard(odd_docs(spark).union(spark.createDataFrame([(None, "one", "x", 0, 1.0)], odd_docs(spark).schema))).collect()
    assert len(rows) == len(ODD) + 3 and next(r.size for r in rows if r.text is None) == 1
    assert sharding.shard(odd_docs(spark).limit(0)).count() == 0


# toxicity


def test_toxicity_separates_held_out_labels(spark, data):
    data = data.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.fitted(docs, labels)).join(labels.where(held_out(0)), "doc_id").select("score", "toxic").collect()
    bad, good = ([r.score for r in scored if r.toxic == t] for t in (1, 0))
    assert np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good]) > 0.8
    assert np.mean([g >= 0.5 for g in good]) < 0.03


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(8)] + [(None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fitted(odd_docs(spark), labels)
    rows = toxicity.score(odd_docs(spark), model).collect()
    assert len(rows) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not (r.text or "").strip()}) == 1
    assert 0 <= toxicity.score(odd_docs(spark), toxicity.fitted(odd_docs(spark).limit(0), labels.limit(0))).first().score <= 1


# near duplicates


def brute_components(texts, percent=85):
    sets = {}
    for d, t in texts.items():
        w = words_of(t)
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), root(d)) for d in sets}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("settings", [near_duplicates.Settings(), near_duplicates.Settings(pairs_up_to=3, block=7)])
def test_near_duplicates_against_brute_force(spark, texts, settings):
    rng = random.Random(2)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    crowd = {10_000 + k: edited(rng, base, k % 5) for k in range(60)}
    odd = {20_000 + k: t for k, t in enumerate(ODD)}
    every = {**dict(list(texts.items())[:120]), **crowd, **odd}
    df = spark.createDataFrame([(d, t, "k") for d, t in every.items()], "doc_id long, text string, keys string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(df, settings).collect()}
    assert got == brute_components(every)
    assert near_duplicates.near_duplicates(df.limit(0), settings).count() == 0


def test_block_links_equal_direct_ones():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, 50).astype(np.uint64)) for _ in range(20)]
    direct = {(i, j) for i in range(20) for j in range(i + 1, 20) if near_duplicates._linked(sets[i], sets[j], 50)}
    assert {tuple(p) for p in near_duplicates.block_links(sets, None, 50).tolist()} == direct
    assert {(i, j + 10) for i, j in near_duplicates.block_links(sets[:10], sets[10:], 50).tolist()} == {p for p in direct if p[0] < 10 <= p[1]}


def test_min_and_max_agree_with_the_similarity():
    rng = np.random.default_rng(6)
    settings = near_duplicates.Settings(bands=400, functions=1)
    a = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    b = np.concatenate([a[:270], rng.integers(0, 1 << 62, 30).astype(np.uint64)])
    ka, kb = near_duplicates.signature_bands([np.unique(a), np.unique(b)], settings)
    assert abs((ka == kb).mean() - (270 / 330) ** 2) < 0.08


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + k) for k in range(1, 40)] + [(70, 70), (None, 3), (2000, 1999)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[1000 + k] == 1000 for k in range(40))
    assert got[70] == 70 and got[2000] == 1999
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# decontamination


def brute_hits(text, items):
    fold = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = fold(text), set(), set()
    for i, t in items:
        v = fold(t)
        n = min(10, len(v))
        for k in range(len(v) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[k : k + n]:
                    found.add(str(i))
                    hit.update(range(p, p + n))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("slices", [False, True])
def test_decontamination_against_brute_force(spark, monkeypatch, slices):
    rng = random.Random(4)
    vocab = [f"v{k}" for k in range(12)]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, line(14)) for k in range(6)] + [(6, "alpha Beta"), (7, None), (8, "..."), (9, items_text := "v1 " * 14), (9, items_text)]
    docs = [(k, f"{line(8)} {rng.choice(items)[1]} {line(5)} ALPHA, beta. {line(3)}") for k in range(30)] + [(100 + k, t) for k, t in enumerate(ODD)] + [(200, "v1 " * 40)]
    if slices:
        monkeypatch.setattr(decontaminate.item_slices, "__defaults__", (200,))
    got = decontaminate.contamination(spark.createDataFrame([(*d, "b") for d in docs], "doc_id long, text string, block string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {r.doc_id: (r.n_words, decontaminate.span_words(bytes(r.spans)), list(r.items)) for r in got.collect()}
    assert got == {d: brute_hits(t, items) for d, t in docs}


@pytest.mark.parametrize("slices", [False, True])
def test_decontamination_keeps_repeated_rows(spark, monkeypatch, slices):
    """Partitions with the same rows, and rows that share a doc_id and a number of words, give a row each."""
    if slices:
        monkeypatch.setattr(decontaminate.item_slices, "__defaults__", (100,))
    items = spark.createDataFrame([(k, f"i{k} j{k} k{k}") for k in range(6)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "i0 j0 k0 x"), (1, "x i1 j1 k1"), (2, "a b"), (3, None)], "doc_id long, text string").coalesce(1)
    got = [(r.doc_id, r.n_words, decontaminate.span_words(bytes(r.spans)), list(r["items"])) for r in decontaminate.contamination(docs.union(docs), items).collect()]
    assert sorted(got) == sorted(2 * [(1, 4, 3, ["0"]), (1, 4, 3, ["1"]), (2, 2, 0, []), (3, 0, 0, [])])


def test_proximity_allows_slack(spark):
    docs = spark.createDataFrame([(1, "aa xx bb cc dd"), (2, "dd cc bb aa zz zz zz")], "doc_id long, text string")
    index = decontaminate.build_index(docs)
    find = lambda slack: {r.doc_id for r in decontaminate.search(index, [("i", b"aa bb cc dd")], 4, slack).collect() if r.items}
    assert find(0) == set() and find(1) == {1}


def test_empty_benchmark(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = decontaminate.contamination(docs, spark.createDataFrame([], "item_id long, text string")).first()
    assert (row.n_words, list(row["items"])) == (2, [])
    assert decontaminate.contamination(docs.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


# language model


def small_model(seed=3):
    s = language_model.Settings(size=4, hidden=5, classes=4, window=8, stride=5)
    rng = np.random.default_rng(seed)
    model = language_model.Attention(s, slots=rng.permutation(16).astype(np.int32))
    model.flat += rng.normal(0, 0.3, len(model.flat)).astype(np.float32)
    model.prepare()
    return model, rng


def plain_score(model, ids):
    """Log-probability of a text's ids, one after another, by loops over the definition in doubles."""
    s, p, total = model.s, {k: v.astype(float) for k, v in model.p.items()}, 0.0
    for t, wanted in enumerate(ids):
        low = t - t % s.stride - (s.window - s.stride)  # where the window that scores t begins
        seen = [ids[j - 1] if j > 0 else 0 for j in range(low, t + 1)]
        here = p["e"][seen[-1]]
        far = [np.exp(here @ p["q"] @ (p["e"][x] @ p["k"]) / s.size**0.5 + p["near"][len(seen) - 1 - j]) for j, x in enumerate(seen)]
        h = here + p["before"][seen[-2]] + sum(w * p["v"][x] for w, x in zip(far, seen)) / sum(far)
        h = h + np.maximum(h @ p["m1"] + p["mb"], 0) @ p["m2"]
        which, inner = divmod(int(model.slots[wanted]), s.classes)
        first, second = h @ p["c"] + p["cb"], h @ p["i"][which] + p["ib"][which]
        total += first[which] - np.log(np.exp(first).sum()) + second[inner] - np.log(np.exp(second).sum())
    return total


def test_gradients_are_those_of_the_loss():
    model, rng = small_model()
    lengths = np.array([1, 3, 12, 7])
    ids, wanted = language_model.windows_of(rng.integers(1, 16, 23).astype(np.int16), lengths, 8, 5)
    g, before = model.gradient(ids, wanted)[1], model.flat.copy()
    for at in rng.permutation(len(before))[:100]:
        value = []
        for e in (1e-2, -1e-2):
            model.flat[:] = before
            model.flat[at] += e
            model.prepare()
            value.append(model.gradient(ids, wanted)[0])
        assert (value[0] - value[1]) / 2e-2 == pytest.approx(float(g[at]), rel=0.03, abs=0.03)


def test_windows_score_every_id_once_and_as_the_plain_loop():
    model, rng = small_model(1)
    lengths = np.array([1, 2, 5, 6, 10, 24])
    seq = rng.integers(1, 16, int(lengths.sum())).astype(np.int16)
    seq[np.cumsum(lengths) - 1] = 0
    ids, wanted = language_model.windows_of(seq, lengths, 8, 5)
    assert wanted[wanted >= 0].tolist() == seq.tolist()
    logs, at = model.score(ids, wanted).sum(1), 0
    for n, end in zip(lengths, np.cumsum(lengths)):
        count = -(-n // 5)
        assert logs[at : at + count].sum() == pytest.approx(plain_score(model, seq[end - n : end]), abs=1e-3)
        at += count
    # all ids together have probability 1; shifted logits beyond what exp() can hold give the same
    hidden, _ = model.attend(ids[:1])
    value = [model.log_probabilities(hidden[:1], np.array([x], np.int16))[0][0] for x in range(16)]
    assert np.exp(value).sum() == pytest.approx(1, abs=1e-4)
    model.p["cb"] += 300
    assert model.log_probabilities(hidden[:1], np.array([3], np.int16))[0][0] == pytest.approx(value[3], abs=1e-3)


def test_spellings_are_unique_and_whole():
    words = [b"the", "漢字".encode(), b"don't", b"\x1c", "ß🙂".encode(), b"a" * 3000, b"the"]
    names = language_model._encoding(None)[1]
    ranks, sizes = language_model.spell(words, None)
    kept = [int(r) for r in set(ranks.tolist())][::2]
    ids, each = language_model.Ids(kept, names).of(ranks, sizes)
    text = [names[kept[i - 257]] if i > 256 else bytes([i - 1]) for i in ids.tolist()]
    ends = np.cumsum(each).tolist()
    assert [b"".join(text[e - n : e]) for e, n in zip(ends, each.tolist())] == [b" " + w for w in words]


def test_ranks_that_are_not_kept_are_spelled_in_as_few_ids_as_can_be():
    """In subwords where bytes alone took an id each; the number of ids is that of a search over all spellings."""
    names = [b"", *(bytes([x]) for x in b"abc "), b" ab", b"abc", b"bc", b"ca", b"cab", b" abcab", b"abcabcabca", b"bb", "\u00df".encode()]
    kept = [names.index(x) for x in (b" ab", b"bc", b"ca", b"cab", b"a")]
    ids, known = language_model.Ids(kept, names), {names[r] for r in kept}

    def fewest(x):
        return 0 if not x else 1 + min(fewest(x[n:]) for n in range(1, len(x) + 1) if n == 1 or x[:n] in known)

    assert ids.sizes.tolist() == [fewest(x) for x in names]
    for rank, name in enumerate(names):
        one = ids.ids[ids.starts[rank] : ids.starts[rank] + ids.sizes[rank]].tolist()
        assert b"".join(names[kept[i - 257]] if i > 256 else bytes([i - 1]) for i in one) == name
    assert ids.sizes[names.index(b" abcab")] == 2 and ids.sizes[names.index("\u00df".encode())] == 2


@pytest.mark.parametrize("rows", [1, 7, 33, 500, 5000])
def test_sums_by_id_are_those_of_a_loop(rows):
    rng = np.random.default_rng(rows)
    ids, x = np.minimum(rng.geometric(0.05, rows) - 1, 40), rng.normal(size=(rows, 3)).astype(np.float32)
    want = np.zeros((41, 3))
    np.add.at(want, ids, x.astype(float))
    found, sums = language_model.Attention._by_id(ids, x.copy())
    assert sorted(found.tolist()) == sorted(set(ids.tolist()))
    assert np.allclose(sums, want[found], atol=1e-3)


def test_weights_of_attention_that_exp_cannot_hold_are_shifted():
    model, rng = small_model(5)
    ids = rng.integers(1, 16, (3, 8)).astype(np.int16)
    model.queries *= 0  # equal logits: the weights are those of the distances alone, whatever is added to all of them
    plain = model.attend(ids)[0]
    model.queries[:], model.keys[:] = 0, 0
    model.queries[:, 0], model.keys[:, 0] = 20, 20
    assert np.allclose(model.attend(ids)[0], plain, atol=1e-4)


def test_language_model_counts_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").limit(80)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(5000 + k, t) for k, t in enumerate(ODD)] + [(5001, ""), (None, "one"), (None, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", held_out(1).alias("held"), "text").withColumn("ids", F.lit(1)).repartition(3)
    small = language_model.Settings(size=8, hidden=8, least_targets=1, block_bytes=20_000)
    found = language_model.score(df, settings=small).collect()
    got = {r.doc_id: r for r in found}
    train = [words_of(t) for d, t in rows if zlib.crc32(str("" if d is None else d).encode()) % 5 != 1]
    c = collections.Counter(w for t in train for w in t)
    n, v = sum(c.values()) + len(train), len(c) + 1
    assert sorted(str(r.doc_id) for r in found) == sorted(str(d) for d, _ in rows)
    for d, t in rows:
        w = words_of(t)
        base = sum(np.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w) + np.log10((len(train) + 0.5) / (n + 0.5 * (v + 1)))
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str("" if d is None else d).encode()) % 5 == 1, len(w) + 1, sum(c[x] > 0 for x in w) + 1, n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    assert language_model.score(df.limit(0), settings=small).count() == 0
    alone = language_model.score(df.where("doc_id = 5003").withColumn("held", F.lit(True)), settings=small).collect()
    assert [(r.n_known, r.train_tokens) for r in alone] == [(0, 0)] and np.isfinite(alone[0].score)


def test_language_model_learns_from_all_training_texts(spark):
    """An order of words that only some of many blocks have is learnt, by more rounds than one; held-out texts are not."""
    rng = random.Random(3)
    noise = [(k, k % 4 == 0, " ".join(rng.choice(["aa", "bb", "cc", "dd"]) for _ in range(60))) for k in range(20)]
    order = [(100 + k, k % 4 == 0, "aa bb cc dd " * 40) for k in range(60)]
    df = spark.createDataFrame(noise + order, "doc_id long, held boolean, text string").repartition(3)
    s = language_model.Settings(block_bytes=4000, batch=16, least_targets=40_000)
    made = language_model.blocks(df, 8, None, s)
    model = language_model.fit(made, None, s)
    listed = [t.encode().split() for _, held, t in noise + order if not held]
    assert model["tokens"] == sum(len(language_model.spell(words, None)[0]) + 1 for words in listed)
    tests = spark.createDataFrame([(1, True, "aa bb cc dd " * 5), (2, True, "dd cc bb aa " * 5)], "doc_id long, held boolean, text string")
    rows = {r.doc_id: r for r in language_model.score(df.unionByName(tests.withColumn("doc_id", F.col("doc_id") + 1000)), settings=s).collect()}
    assert rows[1001].base_score == pytest.approx(rows[1002].base_score) and rows[1001].score > rows[1002].score + 1


def test_language_model_beats_word_counts_on_held_out_texts(spark, data):
    found = language_model.op1_attention_scores(spark, data.replace("sf0.001", "sf0.01")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert found[0] > found[1]
