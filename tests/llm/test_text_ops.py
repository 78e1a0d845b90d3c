"""Operators on texts against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from spandrel.llm import bpe, counts, families, hashing, langid, line_dedup, mixing, ngram_join, sharding, token_files

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and in to a is that for it with as on be at by this from or an".split()


def make(spark, texts, sources=None, langs=None, ids=None):
    n = len(texts)
    rows = [(ids[i] if ids else i, t, langs[i] if langs else "en", sources[i] if sources else "s", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA) if n else spark.createDataFrame([], SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


def roots(n, links):
    parent = list(range(n))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return [root(k) for k in range(n)]


# --- byte-level BPE and counts ---

PARTS = [" ", "  ", "\n", "a", "the", "'s", "'", "1", "é", "漢", "\x1c", "\xa0", "　", ".", "!?", "\t", "word", "<|endoftext|>", "😀"]


def test_bpe_join_equals_whole_encoding():
    codec, rng = bpe.Codec(*bpe.tokenizer_file(bpe.RANKS), leaf=8), random.Random(1)
    for k in range(600):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(80))) if k % 5 else "ab" * rng.randrange(90) + " " * rng.randrange(90) + "x"
        ids = codec.encode(text)
        assert ids.tolist() == codec.encoding.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_bpe_query_columns(spark):
    texts = ["Hello world", None, "", "x " * 60_000, "y" * 70_000, "Hello world"]
    out = bpe.digests(bpe.decode(bpe.encode(make(spark, texts).withColumn("ids", F.lit("clash"))))).orderBy("doc_id").collect()
    enc = bpe.codec(*bpe.tokenizer_file(bpe.RANKS)).encoding
    for row, text in zip(out, texts):
        ids = np.array(enc.encode_ordinary(text or ""), "<u4")
        assert tuple(row)[1:] == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    assert bpe.decode(bpe.encode(make(spark, []))).count() == 0
    both = bpe.digests(bpe.code(make(spark, texts).withColumn("ids", F.lit("clash")))).orderBy("doc_id").collect()
    assert both == out


def test_counts_follow_edits():
    codec, rng = bpe.codec(*bpe.tokenizer_file(bpe.RANKS)), random.Random(2)
    for _ in range(150):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(120)))
        doc = counts.Counted(text, lambda x: len(codec.plain(x)), leaf=rng.choice([1, 4, 16]))
        for _ in range(6):
            a = rng.randrange(len(text) + 1)
            b, new = min(len(text), a + rng.randrange(12)), "".join(rng.choice(PARTS) for _ in range(rng.randrange(4)))
            doc.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert doc.text == text and doc.tokens == len(codec.encoding.encode_ordinary(text))


def test_edits_touch_little_of_a_long_text():
    codec = bpe.codec(*bpe.tokenizer_file(bpe.RANKS))
    doc = counts.Counted("some words here " * 20_000, lambda x: len(codec.plain(x)))
    first = doc.encoded
    doc.edit(100_000, 100_004, "other")
    assert doc.encoded - first < 5_000


def test_count_query_edges(spark):
    docs = make(spark, ["a b c", None, "", "one"]).withColumn("edits", F.expr("CASE doc_id WHEN 0 THEN array(named_struct('start', 2L, 'end', 99L, 'text', 'z')) WHEN 3 THEN array(null) END").cast(counts.EDITS))
    got = [tuple(r)[-4:-1] for r in counts.edit_counts(docs).orderBy("doc_id").collect()]
    assert got == [(3, 2, 3), (0, 0, 0), (0, 0, 0), (1, 1, 3)]


# --- token files ---


def test_words_encode_as_the_tokenizer_does():
    import public_tokenizers

    w, rng = token_files.Words(public_tokenizers.path(token_files.TOKENIZER)), random.Random(3)
    odd = [*PARTS, "The", "İ", "Σ", "ΑΣ", "é", "́", "\x00", "W.", "ß,"]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randrange(60))) for _ in range(500)]
    want = [w.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u2").tolist() for x in w.encode_all(texts)] == want
    assert [np.frombuffer(w.encode(t), "<u2").tolist() for t in texts] == want


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 5000)).astype(np.uint64)
    slots = token_files.PerfectHash.build(keys).slots(keys)
    assert sorted(slots) == list(range(len(keys)))


def test_token_files(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(token_files.TOKENIZER))
    texts, ids = ["B text", None, "", "again", "more", "null id"], [5, -3, 9, 7, 7, None]
    files = token_files.write(make(spark, texts, ids=ids), shard_ids=3)
    got = sorted(((r.start, r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in token_files.records(files).collect()), key=lambda r: r[0])
    order = [5, 1, 0, *sorted([3, 4], key=lambda k: zlib.crc32(texts[k].encode())), 2]
    want, at = [], 0
    for k in order:
        codes = t.encode(texts[k] or "", add_special_tokens=False).ids + [1]
        want.append((at, ids[k], codes))
        at += len(codes)
    assert got == want
    assert len(token_files.lookup(files, 7)) == 2 and token_files.lookup(files, 8) == []
    assert token_files.export(files, str(tmp_path / "out")) == files.count() > 1
    assert token_files.records(token_files.write(make(spark, []))).count() == 0


# --- sharding ---


def test_schedule_is_longest_processing_time():
    import heapq

    rng = random.Random(4)
    for _ in range(200):
        sizes = sorted((rng.randrange(1, 30) for _ in range(rng.randrange(200))), reverse=True)
        heap = [(0, s) for s in range(4)]
        for size in sizes:
            load, s = heap[0]
            heapq.heapreplace(heap, (load + size, s))
        firsts, owners, loads = sharding.schedule([(x, sizes.count(x)) for x in set(sizes)], 4)
        assert sorted(loads.values()) == sorted(l for l, _ in heap)
        mine = [owners[np.searchsorted(firsts, k, side="right") - 1] for k in range(len(sizes))]
        assert all(sum(s for s, o in zip(sizes, mine) if o == k) == loads[k] for k in range(4))


def test_shards(spark):
    rng = random.Random(5)
    texts = [prose(rng, rng.randrange(1, 40)) for _ in range(300)] + ["same text"] * 100 + [None, None, "", ""]
    got = sharding.shard(make(spark, texts)).collect()
    assert len(got) == len(texts) and len({r.shard for r in got if texts[r.doc_id] == "same text"}) == 1
    for k in range(16):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    assert all(r["size"] == len((texts[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) and r.law == "bytes" for r in got)
    assert sharding.shard(make(spark, [])).count() == 0


# --- mixing ---


def test_targets():
    got = mixing.targets({"a": 100, "b": 100, "c": 100})
    assert got == {"a": 187.5, "b": 75.0, "c": 37.5}
    assert mixing.targets({"a": 10, "b": 1000, None: 0}) == {"a": 30.0, "b": 980.0, None: 0.0} and mixing.targets({}) == {}


def test_mix(spark):
    rng = random.Random(6)
    texts = [prose(rng, rng.randrange(1, 30)) for _ in range(200)] + [None, "", " \n"]
    sources = [rng.choice(["hot", "hot", "b", "Z", "é", None]) for _ in texts]
    docs = make(spark, texts, sources)
    once, again = ({r.doc_id: r for r in mixing.mix(docs).collect()} for _ in range(2))
    assert {k: r.taken for k, r in once.items()} == {k: r.taken for k, r in again.items()}
    for s in set(sources):
        mine = [r for k, r in once.items() if sources[k] == s]
        assert sum(r.taken for r in mine) == round(mine[0].target) and all(0 <= r.taken <= 3 * r["size"] for r in mine)
    assert sum(r.taken for r in once.values()) == pytest.approx(sum(len((t or "").split()) for t in texts), abs=5)
    assert mixing.mix(make(spark, [])).count() == 0


def test_mix_is_repeatable_whatever_the_order(spark):
    rng = random.Random(16)
    texts = [prose(rng, rng.randrange(1, 30)) for _ in range(80)]
    rows = [(rng.choice([1, 2, 3, None, 50 + k]), t, "en", rng.choice(["a", None]), 0) for k, t in enumerate(texts)]
    taken = []
    for _ in range(2):
        rng.shuffle(rows)
        docs = spark.createDataFrame(rows, SCHEMA).repartition(rng.randrange(1, 6))
        taken.append(sorted((str(r.doc_id), r.text, r.taken) for r in mixing.mix(docs).collect()))
    assert taken[0] == taken[1]


def test_mix_with_clashing_columns(spark):
    rng = random.Random(17)
    docs = make(spark, [prose(rng, 9) for _ in range(30)])
    plain = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    names = ["target", "source_size", "taken", "size", "_key", "_pid", "_at", "row", "key", "id", "check", "_first", "_before", "_epochs", "_name", "n"]
    got = mixing.mix(docs.withColumns({n: F.lit("clash") for n in names}))
    assert {r.doc_id: r.taken for r in got.collect()} == plain
    assert got.where("_key = 'clash' AND row = 'clash' AND n = 'clash'").count() == 30 and dict(got.dtypes)["target"] == "double"


# --- language ID ---


def test_backpropagation():
    rng = np.random.default_rng(7)
    x, y = rng.integers(0, 256, (4, 32)).astype(np.uint8), np.array([0, 1, 1, 0])
    net = langid.ByteNet(["a", "b"])
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    loss = lambda: -np.log(net.forward(x)[2][np.arange(4), y]).mean()
    g = net.gradients(x, y)
    for name in g:
        at = tuple(rng.integers(0, n) for n in net.w[name].shape) if name != "e" else (int(x[0, 3]), 2)
        base = net.w[name][at]
        net.w[name][at] = base + 1e-5
        up = loss()
        net.w[name][at] = base - 1e-5
        down = loss()
        net.w[name][at] = base
        assert g[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-4), name


def test_languages(spark):
    rng = random.Random(8)
    speech = {"en": "the and thing with which", "de": "der und schön mit über", "fr": "le et été avec où"}
    langs = [rng.choice(list(speech)) for _ in range(300)]
    texts = [" ".join(rng.choice(speech[l].split()) for _ in range(rng.randrange(5, 200))) for l in langs]
    docs = make(spark, [*texts, None, "", "12 !?", "the and " * 40_000], langs=[*langs, "en", None, "en", "en"])
    net = langid.fit(docs)
    got = langid.identify(docs.withColumn("score", F.lit("clash")), net).withColumn("held", langid.remainder(F.col("doc_id")) == 2).orderBy("doc_id").collect()
    right = [r.lang_pred == langs[r.doc_id] for r in got[:300] if r.held]
    assert np.mean(right) > 0.97 and all(0 <= r.score <= 1 for r in got)
    assert [(r.lang_pred, r.score) for r in got[300:303]] == [("und", 0)] * 3 and got[303].lang_pred == "en"
    assert langid.fit(make(spark, [])) is None and langid.identify(docs, None).where("lang_pred <> 'und'").count() == 0


# --- line dedup ---


def test_lines_match_brute_force(spark):
    rng = random.Random(9)
    base = [prose(rng, rng.randrange(3, 30)) for _ in range(60)]

    def line():
        words = rng.choice(base).split()
        if rng.random() < 0.5:
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        return " ".join(words)

    texts = ["\n".join(rng.choice([line(), line(), "", "ab", "licence é"]) for _ in range(rng.randrange(1, 8))) for _ in range(80)] + [None, "", "\n\n", "z" * 50_000]
    docs = make(spark, texts)
    got = {r.doc_id: r for r in line_dedup.dedup(docs.withColumn("n_kept", F.lit("clash"))).collect()}
    flat = [(i, k, x) for i, t in enumerate(texts) if t is not None for k, x in enumerate(t.split("\n")) if x.strip()]
    sets = [set(line_dedup.shingles(x).tolist()) for _, _, x in flat]
    links = [(a, b) for a in range(len(flat)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    drop = {flat[k][:2] for k, r in enumerate(roots(len(flat), links)) if r != k}
    for i, t in enumerate(texts):
        want = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in drop)
        assert got[i].text == want, i
    assert line_dedup.dedup(make(spark, [])).count() == 0


def test_lines_with_odd_ids(spark):
    docs = make(spark, ["same line here\nown", "same line here", "same line here"], ids=[-5, 2**62, None])
    got = {r.doc_id: r.text for r in line_dedup.dedup(docs).collect()}
    assert got == {-5: "same line here\nown", 2**62: "", None: "same line here"}


def test_lines_of_texts_that_share_an_id(spark):
    texts = ["own one\nsame line here", "same line here\nown line two", "own one\nsame line here", "same line here\nof the end"]
    got = sorted((r.doc_id, r.text) for r in line_dedup.dedup(make(spark, texts, ids=[7, 7, 7, 9])).collect())
    # whichever text of id 7 comes first keeps the line they share; rows equal in id and text are one document
    first, second = [(7, "own one\nsame line here")] * 2 + [(7, "own line two")], [(7, "own one")] * 2 + [(7, "same line here\nown line two")]
    assert got in (sorted(first + [(9, "of the end")]), sorted(second + [(9, "of the end")]))


def test_lines_travel_in_blocks():
    rng = random.Random(16)
    texts = ["\n".join(prose(rng, 12) for _ in range(200)) for _ in range(20)]
    texts += texts[:2]  # of another batch: tied to the first ones, not signed again
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, b), pa.int64()), pa.array(texts[a:b])], names=["ord", "text"]) for a, b in ((0, 20), (20, 22))]
    sent = pa.Table.from_batches(list(line_dedup.signed(batches, 20, 64)))
    assert sent.num_rows <= 64 + 1  # 12 keys a line were as many rows once: 48,000
    found = np.concatenate([np.stack([b["a"].to_numpy(), b["b"].to_numpy()], 1) for b in line_dedup.met(sent.sort_by("part").to_batches(max_chunksize=10))])
    assert {(20 + d << 20 | k, d << 20 | k) for d in range(2) for k in range(200)} <= set(map(tuple, found.tolist()))
    key, node = line_dedup.entries(sent.filter(pc.invert(sent["tied"])))
    assert 0 < len(key) <= 4000 * line_dedup.BANDS and node.max() < 20 << 20
    # entries of any parts and batches come out as they went in
    part, x = np.sort(rng.choices(range(9), k=50)), np.arange(50, dtype=np.uint64)
    y = np.array([rng.getrandbits(62) for _ in range(50)])
    got = line_dedup.entries(pa.Table.from_batches([line_dedup.blocks(part, False, x, y)]))
    assert got[0].tolist() == x.tolist() and got[1].tolist() == y.tolist()


@pytest.mark.parametrize("n, shift", [(1, 0), (3, 0), (9, 1), (18, 2), (90, 10), (900, 100)])
def test_similar_lines_share_a_band(n, shift):
    rng, size, lines_ = np.random.default_rng(17), n + line_dedup.SHINGLE - 1, []
    for _ in range(600):  # two windows of a random text, with n shingles each and n - shift in common
        text = rng.integers(97, 123, size + shift).astype(np.uint32)
        lines_ += [np.append(text[:size], 10), np.append(text[shift:], 10)]
    points, end = np.concatenate(lines_).astype(np.uint32), np.arange(1, 1201) * (size + 1) - 1
    start = end - size
    keys = line_dedup.band_keys(points, start, end, line_dedup.whole(points, start, end))
    share = (keys[::2] == keys[1::2]).any(1).mean()
    assert share == 1 if not shift else share > 0.975  # similarity 0.8: 0.99 by calculation
    assert len(np.unique(keys[::2])) > 0.99 * 600 * line_dedup.BANDS


# --- n-gram join ---


def test_shingles_are_those_of_the_words():
    import pyarrow as pa

    texts = ["A b c d e", "a B C d", "a b", "a  b", None, " ", "x y z", "q\tq\nq\x0bq q q"]
    sets = hashing.word_shingles(*hashing.texts(pa.array(texts)), 4)
    assert [len(s) for s in sets] == [2, 1, 1, 1, 0, 0, 1, 1] and sets[2].tolist() == sets[3].tolist() and set(sets[1].tolist()) < set(sets[0].tolist())


def grams(text, width=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} - {()}


def test_join_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(families, "MEMBERS", 8)
    monkeypatch.setattr(ngram_join, "HOT", 25)
    rng = random.Random(10)
    passage = prose(rng, 30)
    kinds = [prose(rng, n) for n in (4, 9, 40, 60, 200, 900, 2500)]
    texts = []
    for _ in range(140):
        words = rng.choice(kinds).split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        texts.append(" ".join(words))
    texts += [prose(rng, rng.randrange(60, 90)) + " " + passage for _ in range(60)] + [kinds[3]] * 20 + ["The of", "the OF", None, "", "  ", "one"]
    docs = make(spark, texts).withColumn("n", F.lit("clash"))
    got = {r.doc_id: r for r in ngram_join.join(docs).collect()}
    sets = [grams(t) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = roots(len(texts), links)
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == [(len(sets[i]), want[i]) for i in range(len(texts))]
    assert ngram_join.join(make(spark, [])).count() == 0


def test_join_with_repeated_and_null_ids(spark):
    text = prose(random.Random(11), 50)
    got = ngram_join.join(make(spark, [text, text, text, "other"], ids=[4, 4, None, 9])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("4", "4"), ("4", "4"), ("9", "9"), ("None", "None")]


def test_point_tree_loses_no_pair():
    rng = np.random.default_rng(12)
    counts_ = rng.poisson(4, (300, ngram_join.GROUPS)).astype(np.uint16)
    counts_[100:200] = np.maximum(counts_[:100].astype(int) + rng.integers(-1, 2, (100, ngram_join.GROUPS)) * (rng.random((100, ngram_join.GROUPS)) < 0.1), 0)
    n = counts_.sum(1).astype(np.int64)
    tree = ngram_join.PointTree(n, counts_)
    found = {tuple(sorted((int(tree.order[i]), int(tree.order[j])))) for a, b in tree.survivors(np.arange(300), 85) for i, j in zip(a, b)}
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if 185 * np.minimum(counts_[i], counts_[j]).sum() >= 85 * (n[i] + n[j]) and 100 * min(n[i], n[j]) >= 85 * max(n[i], n[j])}
    assert found == want


def test_linked_parts_match_brute_force():
    rng = np.random.default_rng(13)
    for k in range(200):
        base = [rng.choice(400, rng.integers(1, 60), replace=False) for _ in range(rng.integers(1, 5))]
        sets = []
        for _ in range(rng.integers(1, 40)):
            s = base[rng.integers(len(base))].copy()
            some = rng.random(len(s)) < 0.08
            s[some] = rng.integers(400, 500, some.sum())
            sets.append(np.unique(s).astype(np.uint64))
        linked = lambda common, n, m: 100 * common >= 80 * (n + m - common)
        links = [(a, b) for a in range(len(sets)) for b in range(a) if linked(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]))]
        want, got = roots(len(sets), links), families.linked_parts(sets, linked, width=7)
        assert len({*zip(want, got.tolist())}) == len(set(want)) == len(set(got.tolist()))
        settled = np.array([w == want[0] for w in want])
        if settled.sum() > 1:
            again = families.linked_parts(sets, linked, settled)
            assert len({*zip(want, again.tolist())}) == len(set(want)) == len(set(again.tolist()))


def test_pairs_of_rare_shingles_add_up():
    rng = np.random.default_rng(3)
    for most in (1, 40, 1 << 21):
        member = np.sort(rng.choice(30 * 200, 900, replace=False))
        column, owner = member // 30, member % 30
        column = np.unique(column, return_inverse=True)[1]
        rest = np.sort(rng.choice(30, 11, replace=False))
        x = np.zeros((30, column[-1] + 1), np.int64)
        x[owner, column] = 1
        common = np.ones((11, 30), np.float32)
        families.add_pairs(common, owner, column, rest, most)
        assert (common == 1 + x[rest] @ x.T).all()


def test_parts_of_many_members_with_rare_and_frequent_shingles():
    rng = np.random.default_rng(4)
    base = rng.integers(1, 1 << 40, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(60) < 0.94], rng.integers(1 << 41, (1 << 41) + 4000, 5).astype(np.uint64)])) for _ in range(400)]
    linked = lambda common, n, m: common >= 0.8 * (n + m - common)
    links = [(a, b) for a in range(400) for b in range(a) if linked(len(np.intersect1d(sets[a], sets[b], assume_unique=True)), len(sets[a]), len(sets[b]))]
    assert 400 < len(links) < 60000
    assert roots(400, enumerate(families.linked_parts(sets, linked).tolist())) == roots(400, links)


def test_large_families_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(families, "MEMBERS", 10)
    rng = random.Random(14)
    base = "".join(rng.choice("abcdefgh ") for _ in range(120))
    texts = []
    for k in range(90):  # a chain of small changes: the anchor is linked with few of them
        base = base[:k] + rng.choice("xyz") + base[k + 1 :] if k % 3 else base
        texts.append(base)
    links = [(a, b) for a in range(90) for b in range(a) if (lambda x, y: len(x & y) >= 0.8 * len(x | y))(*(set(line_dedup.shingles(texts[k]).tolist()) for k in (a, b)))]
    want = roots(90, links)
    got = {r.doc_id: r.n_kept for r in line_dedup.dedup(make(spark, texts)).collect()}
    assert [got[k] for k in range(90)] == [int(want[k] == k) for k in range(90)]
    assert sum(b == 0 for _, b in links) < 60 and len(set(want)) < 30


def test_join_of_texts_that_share_an_id(spark):
    rng = random.Random(15)
    one, two = prose(rng, 60), prose(rng, 60)
    got = ngram_join.join(make(spark, [one, two, one, two + " end", one + " end"], ids=[4, 4, 4, 9, 7])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(4, 4), (4, 4), (4, 4), (7, 4), (9, 4)]
