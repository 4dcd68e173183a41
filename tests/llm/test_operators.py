"""The corpus operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import base64
import hashlib
import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

pytest.importorskip("tokenizers")
import public_tokenizers  # noqa: E402

from marlstone.llm import common as C  # noqa: E402
from marlstone.llm import decontaminate, fingerprint, graph, langid, minhash, ngram_bloom, oracles, packing, quotes, suffix, tokens, warc  # noqa: E402

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, value string, part int, n long, keys string"
words = re.compile(r"[^\x20\x09-\x0D]+").findall


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def frame(spark, rows):
    """Documents with extra columns of names that operators use inside."""
    return spark.createDataFrame([(i, t, "v", 1, 2, "k") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd():
    rnd = random.Random(1)
    voc = ["w%d" % i for i in range(90)] + ["Über", "naïve", "日本語", "e-mail", "don't"]
    say = lambda n: " ".join(rnd.choice(voc) for _ in range(n))
    rows = [(i, say(rnd.randint(0, 60))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, " \t\n"), (53, "Tab\there  two   spaces \n\n end "), (54, " leading"), (55, "a b　c <|endoftext|> d"), (56, say(4000)), (57, "x" * 5000), (58, say(3) + "\n"), (59, "\r\n" + say(5))]
    return rows + [(1, rows[1][1]), (60, rows[2][1])]  # a repeated row, and a copy


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


@pytest.mark.parametrize("path,leading", [(BYTES, True), (WORDS, False)])
def test_encoder_is_exact(odd, path, leading):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path)
    texts = [t or "" for _, t in odd]
    data = [t.encode() for t in texts]
    raw, offsets = np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])])
    enc = tokens.MemoEncoder(path, leading)
    enc.LIMIT = 40  # the memory is cleared again and again
    ids, before = enc.encode(raw, offsets)
    for k, t in enumerate(texts):
        assert ids[before[k] : before[k + 1]].tolist() == lib.encode(t, add_special_tokens=False).ids, t[:50]


@pytest.mark.parametrize("width", [1, 5, 16, 17, 31])
def test_bit_packing(width):
    ids = np.random.default_rng(width).integers(0, 2**width, 1001).astype(np.int32)
    assert tokens.unpack_bits(tokens.pack_bits(ids, width), 1001, width).tolist() == ids.tolist()


def test_token_files(spark, odd, empty, tmp_path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BYTES)
    files = tokens.write_tokens(frame(spark, odd), str(tmp_path / "t"), BYTES, block=64)
    got = sorted(tokens.read_tokens(spark, files).collect(), key=lambda r: r.start)
    at = 0
    for r, (i, t) in zip(got, sorted(odd, key=lambda x: (x[0], x[1] or "")), strict=True):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    f = tokens.TokenFile(files[0][1])
    assert f.document(3).tolist() == f.read(int(f.starts[3]), int(f.starts[4])).tolist()
    assert tokens.read_tokens(spark, tokens.write_tokens(empty, str(tmp_path / "e"), BYTES)).count() == 0


def test_packing(spark, odd, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORDS)
    rows = packing.pack(frame(spark, odd).coalesce(1), WORDS, window=256, with_ids=True).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length > 0
    for i, t in odd:
        if i == 1:
            continue  # given twice
        ids = [x for r in sorted(pieces[i], key=lambda r: r.start) for x in r.ids]
        assert ids == [*lib.encode(t or "", add_special_tokens=False).ids, 2]
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [sum(x.length for x in s[:k]) for k in range(len(s))]
        total = sum(r.length for r in s)
        assert total <= 256 and total.bit_count() == 1  # full, or without padding
    assert packing.pack(empty, WORDS).count() == 0


def test_sum_of_squares_chooses_the_least():
    rnd = random.Random(3)
    p = packing.SumOfSquares(20, 0)
    for _ in range(300):
        size = rnd.randint(1, 19)
        n = p.count.copy()
        p.add(0, np.zeros(size, np.int32))
        options = []
        for h in range(0, 20 - size + 1):
            if h and not n[h]:
                continue
            m = n.copy()
            m[h] -= bool(h)
            m[h + size] += h + size < 20
            options.append(int((m[1:20] ** 2).sum()))
        assert int((p.count[1:20] ** 2).sum()) == min(options)


def test_winnowing_against_windows():
    rnd = random.Random(2)
    for n in (0, 1, 5, 8, 12, 200):
        text = "".join(rnd.choice("abñ") for _ in range(n))
        hashes, places = fingerprint.winnow(text, 5, 4)
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        if n >= 5:
            h = fingerprint._rolling(codes, 5).tolist()
            windows = [range(a, a + min(4, len(h))) for a in range(max(1, len(h) - 3))]
            want = sorted({max((i for i in w if h[i] == min(h[j] for j in w))) for w in windows})
            assert places.tolist() == want and hashes.tolist() == [h[i] for i in want]
        else:
            assert len(places) == (n > 0)
    long = "".join(rnd.choice("abcdefgh") for _ in range(5000))
    whole = fingerprint.winnow(long)
    fingerprint._PIECE, old = 700, fingerprint._PIECE
    assert all((a == b).all() for a, b in zip(whole, fingerprint.winnow(long), strict=True))
    fingerprint._PIECE = old


def test_fingerprint_strings():
    for w in (41, 300):
        got = fingerprint.winnow("some text that is long enough for a few of them, " * 40, 20, w)
        assert all((a == b).all() for a, b in zip(got, fingerprint.from_string(fingerprint.to_string(*got, w), w), strict=True))


@pytest.mark.parametrize("base", [0, 2**60])
def test_fingerprints(spark, odd, empty, base):
    """Also for ids that no double holds, beside a null id."""
    rows = [(base + i, t) for i, t in odd]
    got = sorted(fingerprint.fingerprints(frame(spark, [*rows, (None, "null id " * 30)])).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    order = sorted(rows, key=lambda x: (-x[0], x[1] or "")) + [(None, "null id " * 30)]
    after = {(i, t): order[(k + 1) % len(order)][1] or "" for k, (i, t) in enumerate(order)}
    assert len(got) == len(rows) + 1
    by_text = {}
    prints = lambda x: np.unique(fingerprint.winnow(x)[0])
    for r in got:
        mine = next(t for i, t in order if i == r.doc_id)
        text = mine or ""
        assert r.n_chars == len(text) and by_text.setdefault(text, r.fingerprint) == r.fingerprint
        if r.doc_id not in (base + 1, base + 2):  # of repeated rows each has its own next
            want = fingerprint.edited(text, after[r.doc_id, mine])
            assert r.edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
            assert r.near_edited == fingerprint.likeness(prints(text), prints(want))
            assert r.near_next == fingerprint.likeness(prints(text), prints(after[r.doc_id, mine]))
    assert fingerprint.fingerprints(empty).count() == 0


@pytest.mark.parametrize("head,max_bits", [(10**6, 1 << 24), (20, 1 << 17)])
def test_language_model(spark, odd, empty, head, max_bits):
    train, every = frame(spark, odd).filter("doc_id % 3 <> 0"), frame(spark, odd)
    m = ngram_bloom.fit(train, head=head, max_bits=max_bits, tokens_per_segment=500)
    toks = lambda t: [*words(lower(t or "")), None]
    c = Counter(w for i, t in odd if i % 3 for w in toks(t))
    n, v = sum(c.values()), len(c)
    assert (m.tokens, m.vocabulary) == (n, v)
    want = defaultdict(list)
    for i, t in odd:
        want[i].append((len(toks(t)), sum(c[w] > 0 for w in toks(t)), sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks(t))))
    for r in ngram_bloom.score(every, m).collect():
        assert any((r.n_tokens, r.n_known) == x[:2] and abs(r.base_score - x[2]) < 1e-6 * abs(x[2]) for x in want[r.doc_id]), r
        assert r.score < 0
    nothing = ngram_bloom.fit(empty)
    assert nothing.tokens == 0 and ngram_bloom.score(every, nothing).count() == len(odd) and ngram_bloom.score(empty, m).count() == 0


def test_no_bigram_is_dropped_from_a_full_filter(spark, odd):
    """However many segments the entries need, scores are those of the counts of all bigrams."""
    train, every = frame(spark, odd).filter("doc_id % 3 <> 0"), frame(spark, odd)
    toks = lambda t: [None, *words(lower(t or "")), None]
    c = Counter(w for i, t in odd if i % 3 for w in toks(t)[1:])
    pairs = Counter(p for i, t in odd if i % 3 for p in zip(toks(t), toks(t)[1:], strict=False))
    n, v = sum(c.values()), len(c)
    rep = lambda x: (3 * 2 ** (x.bit_length() - 1) - 1) / 2 if x else 0
    want = defaultdict(list)
    for i, t in odd:
        own = zip(toks(t), toks(t)[1:], strict=False)
        # a bigram is at most as frequent as its words
        level = lambda a, b: min(rep(x) for x in (pairs[a, b], c[a], c[b]))
        # unigram counts are those of levels too
        want[i].append(sum(math.log10((level(a, b) + 20 * (rep(c[b]) + 0.1) / (n + 0.1 * (v + 1))) / (rep(c[a]) + 20)) for a, b in own))
    m = ngram_bloom.fit(train, max_bits=1 << 12, bits_per_item=60)
    for r in ngram_bloom.score(every, m).collect():
        assert any(abs(r.score - x) < 1e-6 * abs(x) for x in want[r.doc_id]), r


def test_language_model_leaves_no_shuffle_files(spark, odd):
    """Shuffles whose rows are stored are deleted by then: beside those of the next step they would count as disk."""
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f.name for d in folders for f in Path(d).rglob("shuffle_*.data")}
    known, setting, docs = files(), spark.conf.get(C._CLEANUP, None), frame(spark, odd)
    out = ngram_bloom.score(docs, ngram_bloom.fit(docs, tokens_per_segment=500))
    until = time.time() + 20
    while files() - known and time.time() < until:
        time.sleep(0.2)
    assert not files() - known and spark.conf.get(C._CLEANUP, None) == setting
    assert out.count() == len(odd)


def test_bloom_levels():
    keys = C.mix(np.arange(4000, dtype=np.uint64))
    level = ngram_bloom.levels(np.random.default_rng(1).zipf(1.6, 4000).clip(max=10**6))
    b = ngram_bloom.LogFrequencyBloom(ngram_bloom.segment_bits(keys, level, 18), 0, 18)
    most = np.full(4000, 63)
    assert (b.level(keys, most) >= level).all() and (b.level(keys, most) == level).mean() > 0.98
    assert (b.level(C.mix(keys + np.uint64(10**9)), most) == 0).mean() > 0.98


def brute_links(rows, shingle, num):
    sets, names = {}, defaultdict(list)
    for i, t in rows:
        w = words(lower(t or ""))
        sets[i] = frozenset(tuple(w[j : j + shingle]) for j in range(len(w) - shingle + 1)) if len(w) >= shingle else frozenset([tuple(w)] if w else [])
        for g in sets[i]:
            names[g].append(i)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_duplicates(spark, odd, empty):
    rnd = random.Random(5)
    voc = ["v%d" % i for i in range(300)]
    base, line = [rnd.choice(voc) for _ in range(120)], [rnd.choice(voc) for _ in range(60)]
    rows = []
    for i in range(60):  # near copies, some of which link only through others
        w = list(base)
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = rnd.choice(voc)
        rows.append((1000 + i, " ".join(w)))
    rows += [(2000 + i, " ".join(line + [rnd.choice(voc) for _ in range(rnd.randint(0, 12))])) for i in range(60)]  # a common passage
    rows += odd
    want = brute_links([r for r in rows if r[0] != 1], 3, 85)
    got = minhash.near_duplicates(frame(spark, [*rows, (None, "no id at all")]), shingle=3, num=85).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        elif r.doc_id != 1:
            assert (r.n_shingles, r.component_id) == want[r.doc_id], r
            assert r.kept == (r.doc_id == r.component_id)
    assert minhash.near_duplicates(empty).count() == 0


def test_near_duplicates_of_repeated_ids(spark):
    """Rows of one id are one document with several texts; copies of any number share one least id; empty ones stay by themselves."""
    say = lambda c, n=40: " ".join(f"{c}{i}" for i in range(n))
    rows = [(5, say("a")), (1, say("a")), (5, say("b")), (9, say("b", 39)), (7, say("c")), (7, say("c")), (8, None), (3, " "), (8, "")]
    rows += [(100 + i, say("d")) for i in range(500)]
    got = minhash.near_duplicates(frame(spark, rows), shingle=3, num=85).collect()
    want = {5: 1, 1: 1, 9: 1, 7: 7, 8: 8, 3: 3} | {100 + i: 100 for i in range(500)}
    assert len(got) == len(rows) and all(r.component_id == want[r.doc_id] and r.kept == (want[r.doc_id] == r.doc_id) for r in got)


def test_likely_rows_hold_all_needed(spark):
    df, need = spark.range(-3000, 3000).withColumn("t", F.lit("x")), spark.range(-5000, 5000, 7)
    for bits in (26, 10):  # ample, and far too few
        got = C.likely(df, need, "id", bits)
        assert got.join(need, "id", "left_semi").count() == df.join(need, "id", "left_semi").count()
        left = C.without(df.union(spark.createDataFrame([(None, "n")], "id long, t string")), need, "id", bits)
        assert {r.id for r in left.collect()} == {None, *range(-3000, 3000)} - set(range(-5000, 5000, 7)) and left.columns == df.columns
    assert C.likely(df, need, "id").count() < 1000 and C.likely(df, need.limit(0), "id").count() == 0


@pytest.mark.parametrize("shingle,num,more", [(3, 85, 11), (5, 80, 16)])
def test_links_to_partners_beyond_the_sketch(spark, shingle, num, more):
    """64 shingles, all in the sketch, linked to a document whose sketch lacks some of them."""
    rows = []
    for i in range(30):
        own = ["p%d_%d" % (i, j) for j in range(64 + shingle - 1 + more)]
        rows += [(2 * i, " ".join(own[: 64 + shingle - 1])), (2 * i + 1, " ".join(own))]
    want = brute_links(rows, shingle, num)
    assert all(want[2 * i + 1][1] == 2 * i for i in range(30))
    got = minhash.near_duplicates(frame(spark, rows), shingle=shingle, num=num).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_links_between_members_far_from_every_hub(spark, monkeypatch):
    """Windows over one long text link with the next window alone: long lists whose hubs reach few members."""
    rnd = random.Random(8)
    text = ["t%d" % i for i in range(600)]
    ids = rnd.sample(range(1, 1000), 90)
    rows = [(i, " ".join(text[5 * k : 5 * k + 120])) for k, i in enumerate(ids)]
    for i in range(40):  # copies with edits of their own: each is below the threshold to the others
        w = ["c%d" % j for j in range(150)]
        for j in rnd.sample(range(150), 1 if i < 12 else 7):
            w[j] = "e%d" % rnd.randrange(10**6)
        rows.append((2000 + i, " ".join(w)))
    between, seen = minhash._between, []

    def counted(*a):
        out = between(*a)
        seen.append(out[0].count())
        return out

    monkeypatch.setattr(minhash, "_between", counted)
    got = minhash.near_duplicates(frame(spark, rows), shingle=3, num=85).collect()
    want = brute_links(rows, 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert seen[0] > 0


def test_components(spark):
    rnd = random.Random(9)
    edges = [(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}


def test_decontamination(spark, empty):
    rnd = random.Random(6)
    voc = ["b%d" % i for i in range(500)]
    say = lambda n: [rnd.choice(voc) for _ in range(n)]
    items = [(k, say(rnd.randint(12, 40))) for k in range(25)] + [(90, ["short", "one"]), (91, [])]
    docs, planted = [], set()
    for i in range(80):
        body = say(rnd.randint(0, 150))
        if i % 4 == 0:
            k, text = items[rnd.randrange(25)]
            text = list(text)
            if i % 8 == 0 and len(text) > 30:
                text[-1] = "changed"
            at = rnd.randint(0, len(body))
            body[at:at] = [w.upper() + "!" for w in text] if i % 3 == 0 else text
            planted.add((i, k))
        docs.append((i, " ".join(body)))
    docs += [(200, None), (201, ""), (202, "Short, one"), (202, "Short, one")]
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in items] + [(None, "x"), (92, None)], "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in decontaminate.matches(frame(spark, docs), bench, items_per_pass=10).collect()]
    assert set(got) == planted | {(202, 90)} and len(got) == len(planted) + 2
    kept = decontaminate.clean(frame(spark, docs), bench)
    assert kept.columns == frame(spark, docs).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in got}
    assert decontaminate.matches(empty, bench).count() == 0 and decontaminate.clean(frame(spark, docs), bench.limit(0)).count() == len(docs)


def test_documents_shorter_than_the_item(spark):
    """An item without its last words is found in a document that is nothing else, as far as its similarity is enough."""
    item = ["i%d" % j for j in range(44)]  # 40 shingles of equal weight
    docs = [(cut, " ".join(item[: 44 - cut])) for cut in range(12)] + [(50, "i0 i1 i2"), (51, "other words than those of the item")]
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.matches(frame(spark, docs), bench).collect()}
    assert set(got) == set(range(9))
    for cut, r in got.items():
        assert abs(r.similarity - (40 - cut) / 40) < 1e-9 and (r.first_shingle, r.n_shingles) == (0, 40 - cut)
    assert {r.doc_id for r in decontaminate.clean(frame(spark, docs), bench).collect()} == {9, 10, 11, 50, 51}


def test_all_windows_by_brute_force(spark):
    """Every match is one that all windows show, and those at 0.80 to 0.95 are found (fingerprints may miss one in ten at most)."""
    rnd = random.Random(21)
    voc = ["w%d" % i for i in range(400)]
    items = [(k, [rnd.choice(voc) for _ in range(rnd.randint(20, 70))]) for k in range(12)]
    docs = []
    for i in range(90):
        own = list(items[i % 12][1])
        for _ in range(rnd.randint(0, 1)):
            own[rnd.randrange(len(own))] = "edit%d" % i
        cut = rnd.randint(0, len(own) // 8)
        own = own[cut:] if i % 2 else own[: len(own) - cut]
        docs.append((i, [rnd.choice(voc) for _ in range(rnd.randint(0, 40))] + own + [rnd.choice(voc) for _ in range(rnd.randint(0, 40))]))
    grams = lambda t: [tuple(t[j : j + 5]) for j in range(len(t) - 4)]
    df = Counter(g for _, t in items for g in set(grams(t)))
    want = {}
    for i, t in docs:
        g = grams(t)
        for k, u in items:
            b = Counter(grams(u))
            m = sum(b.values())
            for at in range(max(1, len(g) - m + 1)):
                a = Counter(g[at : at + m])
                if a & b:
                    w = lambda x: sum(math.log(1 + len(items) / max(1, df[y])) * n for y, n in x.items())
                    want[i, k] = max(want.get((i, k), 0), w(a & b) / w(a | b))
    want = {x: v for x, v in want.items() if v >= 0.8 - 1e-9}
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in items], "item_id long, text string")
    for passes in (1, 10, 2000):
        got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.matches(frame(spark, [(i, " ".join(t)) for i, t in docs]), bench, items_per_pass=passes).collect()}
        assert set(got) <= set(want) and all(v <= want[x] + 1e-9 for x, v in got.items())
        hard = {x for x, v in want.items() if v < 0.95}
        assert len(hard) > 20 and len(hard & set(got)) >= 0.9 * len(hard) and {x for x, v in want.items() if v >= 0.95} <= set(got)


def test_weights_do_not_depend_on_passes(spark):
    """Items with a common opening: similarities are those of counts over the whole benchmark, in however many passes."""
    rnd = random.Random(12)
    opening = ["o%d" % j for j in range(14)]
    items = [(k, opening[: rnd.randint(6, 14)] + ["i%dz%d" % (k, j) for j in range(20)]) for k in range(40)]
    docs = [(k, " ".join(["x%d" % k] + t[:-1] + ["changed"])) for k, t in items]
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in items], "item_id long, text string")
    grams = lambda t: Counter(tuple(t[j : j + 5]) for j in range(len(t) - 4))
    df = Counter(g for _, t in items for g in grams(t))
    for passes in (5, 2000):
        got = decontaminate.matches(frame(spark, docs), bench, items_per_pass=passes).collect()
        assert {(r.doc_id, r.item_id) for r in got} == {(k, k) for k, _ in items} and len(got) == len(items)
        for r in got:
            a, b = (grams(t) for t in (dict(docs)[r.doc_id].split()[r.first_shingle : r.first_shingle + r.n_shingles + 4], dict(items)[r.item_id]))
            w = {g: math.log(1 + len(items) / max(1, df[g])) for g in a | b}
            assert abs(r.similarity - sum(w[g] * n for g, n in (a & b).items()) / sum(w[g] * n for g, n in (a | b).items())) < 1e-9


def test_hamming_index_finds_all_within_the_radius():
    rng = np.random.default_rng(4)
    sets = [C.mix(rng.integers(0, 2**63, 30).astype(np.uint64)) for _ in range(40)]
    b = decontaminate.Benchmark(list(range(40)), sets, 40, np.zeros(0, np.uint64), np.zeros(0))
    for k in range(40):
        bits = np.unpackbits(b.prints[k])
        bits[rng.permutation(128)[: decontaminate.RADIUS]] ^= 1
        blocks = np.packbits(bits).view(np.uint16)
        assert any(k in b.index[j][1][b.index[j][0][blocks[j]] : b.index[j][0][int(blocks[j]) + 1]] for j in range(8))


def test_difference_cover():
    rng = np.random.default_rng(1)
    for n in [*range(30), 500]:
        for size in (1, 2, 4, 250):
            x = rng.integers(1, size + 1, n)
            b = bytes(x.astype(np.uint8))
            assert suffix.difference_cover(x).tolist() == sorted(range(n), key=lambda i: b[i:])


def test_repeats(spark, odd, empty, monkeypatch):
    rnd = random.Random(3)
    text = lambda n, k=4: "".join(rnd.choice("abé "[:k]) for _ in range(n))
    base = [text(rnd.randint(90, 260)) for _ in range(12)]
    rows = [(i, "".join(rnd.choice(base)[rnd.randint(0, 60) : rnd.randint(120, 260)] for _ in range(rnd.randint(0, 6)))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, "a" * 500), (203, "ab" * 300), (204, text(9000, 2)), (300, rows[3][1])]
    seen, want = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        want[i] = (len(b), sum(gone), sum(gone[j] and not (j and gone[j - 1]) for j in range(len(b))), bytes(x for x, g in zip(b, gone, strict=True) if not g))
    for hot, size in ((2048, 1 << 26), (10, 3000)):  # by suffix sorting, and by hashing what has too many contexts; many small files
        monkeypatch.setattr(suffix, "HOT", hot)
        monkeypatch.setattr(suffix, "FILE", size)
        for r in suffix.remove_repeats(frame(spark, rows).repartition(3)).collect():
            w = want[r.doc_id]
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (*w[:3], hashlib.sha256(w[3]).hexdigest()), r
    kept = suffix.remove_repeats(frame(spark, rows), texts=True)
    assert kept.columns == frame(spark, rows).columns
    assert {r.doc_id: r.text for r in kept.collect()} == {i: None if t is None else want[i][3].decode("utf-8", "ignore") for i, t in rows if not t or want[i][3]}
    assert suffix.remove_repeats(empty).count() == 0 and suffix.remove_repeats(empty, texts=True).count() == 0


def test_memory_of_a_bucket():
    """Sorting a bucket of the usual size holds some 70 bytes for each of its own; 180 before."""
    rng = np.random.default_rng(3)
    pool = [rng.integers(97, 105, 160).astype(np.uint8) for _ in range(200)]
    texts = [pool[i][a : a + 130] for i, a in zip(rng.integers(0, 200, 4000).tolist(), rng.integers(0, 30, 4000).tolist(), strict=True)]
    tracemalloc.start()
    try:
        suffix.bucket_repeats(texts, np.arange(4000) * 1000, 100)
        assert tracemalloc.get_traced_memory()[1] < 50e6
    finally:
        tracemalloc.stop()


def test_hashes_do_not_depend_on_stretches():
    raw = np.frombuffer(b"ab cde " * 50 + b"x" * 400 + b" end", np.uint8)
    starts, ends, _ = C.word_spans(raw, np.array([0, len(raw)]))
    for size in (1, 16, 300, 10_000):
        assert (C.spans_hashed(raw, starts, ends, size) == C.span_hashes(raw, starts, ends)).all()


def test_files_are_read_by_row_groups(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    texts, path = ["a" * i + "é" if i % 3 else None for i in range(90)], str(tmp_path / "f.parquet")
    pq.write_table(pa.table({"id": range(90), "text": texts}), path, row_group_size=7)
    assert [t.num_rows for t in suffix._groups(path)] == [7] * 12 + [6]
    data = "".join(t or "" for t in texts).encode()
    raw, offsets = suffix._texts(path, "text", len(data))
    assert raw.tobytes() == data and np.diff(offsets).tolist() == [len((t or "").encode()) for t in texts]


def test_anchors_do_not_depend_on_blocks():
    rng = np.random.default_rng(2)
    raw = rng.integers(97, 100, 20_000).astype(np.uint8)
    offsets = np.array([0, 30, 6000, 6000, 20_000])
    whole = suffix.anchors(raw, offsets, 100)
    for block in (400, 3000):
        assert all((a == b).all() for a, b in zip(whole, suffix.anchors(raw, offsets, 100, block=block), strict=True))


def test_independent_hashes_of_windows():
    """Windows that differ in one byte, of any value, differ in both halves."""
    raw = np.tile(np.arange(256, dtype=np.uint8)[:, None], (1, 100)).ravel()
    raw[50::100] = 133
    h1, h2 = suffix._window_hashes(raw, np.arange(256) * 100, 100)
    assert len(set(h1.tolist())) == len(set(h2.tolist())) == 256
    one = np.repeat(raw[None, :100], 256, 0)
    one[:, 7] = np.arange(256)
    h1, h2 = suffix._window_hashes(one.ravel(), np.arange(256) * 100, 100)
    assert len(set(h1.tolist())) == len(set(h2.tolist())) == 256
    text = np.frombuffer(b"abcabcabc", np.uint8)
    assert len(set(suffix._second(text, np.array([0, 3, 6]), np.array([3, 6, 9])).tolist())) == 1


def test_quotes_agree_with_sql(spark):
    rows = [(1, 0, "u", "Hello there\nhow are you?\n\nSecond para"), (1, 1, "a", "> Hello  THERE\n> how are you?\nFine"), (1, 2, "u", ">> hello there\n>> how are you?\n> Fine\n\nGood"), (1, 3, "a", "> Good\n > second para\nok"), (1, 4, "u", None), (None, 5, "u", "> Good"), (2, 0, "x", "> nothing known\n"), (2, 1, "y", ""), (2, None, "y", "> x"), (1, 3, "a", "> Good\nagain"), (3, 0, "u", "a"), (3, 1, "u", "> a\nb"), (3, 2, "u", "> b\nc"), (3, 3, "u", "> c\nd"), (3, 4, "u", "> d\n> a\ne\r\n  > zz"), (4, 0, "u", "one"), (4, 1, "v", "two"), (4, 2, "w", "> one\nthree"), (4, 3, "x", "> two\n" + "long " * 300_000), (4, 4, "y", "> one\nfive")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.sql("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    cols = "conv_id, turn, role, text, n_quotes, n_links, parent_turn, root_turn, depth, position"
    want = con.sql(f"select {cols} from ({quotes.SQL})").fetchall()
    out = quotes.link(df)
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in out.select(*cols.split(", ")).collect())
    assert {(r.turn, r.parent_turn, r.depth) for r in out.filter("conv_id = 3").collect()} == {(0, None, 0), (1, 0, 1), (2, 1, 2), (3, 2, 3), (4, 3, 4)}
    threads = {(r.conv_id, r.root_turn): [(m.turn, m.text[:5]) for m in r.messages] for r in quotes.conversations(out).collect()}
    assert threads[4, 0] == [(0, "one"), (2, "three"), (4, "five")] and threads[4, 1] == [(1, "two"), (3, "long ")] and [t for t, _ in threads[3, 0]] == [0, 1, 2, 3, 4]
    assert quotes.link(df.limit(0)).count() == 0
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in langid.init(3, 5).items()}
    codes, mask = langid.matrix([b"abc", b"xy", b"hello"])
    labels = np.array([0, 1, 2])
    _, g = langid.gradients(p, codes, mask, labels)
    for name in p:
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in p[name].shape)
            if name in ("xf", "xb"):
                at = (int(codes[0, 0]), at[1])
            old, eps = p[name][at], 1e-3
            p[name][at] = old + eps
            up = langid.gradients(p, codes, mask, labels)[0]
            p[name][at] = old - eps
            down = langid.gradients(p, codes, mask, labels)[0]
            p[name][at] = old
            assert abs((up - down) / (2 * eps) - g[name][at]) < 2e-4, name


def test_language_id(spark, empty):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.fit(docs)
    out = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
    held = out.filter(langid.held_out(out["doc_id"]))
    assert held.filter("lang = lang_pred").count() >= 0.9 * held.count()
    odd = frame(spark, [(1, None), (2, ""), (3, "123 !?"), (4, "日本"), (5, "the " * 200_000), (5, "the " * 200_000), (None, "the and of")])
    got = [(r.doc_id, r.lang_pred) for r in langid.predict(odd, model).collect()]
    assert [x for i, x in got if i in (1, 2, 3)] == ["und"] * 3 and all(x in model.languages for i, x in got if i not in (1, 2, 3))
    assert langid.fit(odd.withColumn("lang", odd["value"]).limit(0), label_col="lang") is None
    assert {r.lang_pred for r in langid.predict(odd, None).collect()} == {"und"}
    assert langid.keep_known(odd, model).columns == odd.columns and langid.predict(empty, model).count() == 0


def test_reading_is_a_plain_forward_pass():
    """Stretches with their margins give what the network of training gives for the same bytes, whatever is read together."""
    m = langid.Model(["a", "b", "c"], langid.init(3, 4, seed=3))
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("abcdé日 .") for _ in range(n)).encode() for n in (0, 5, 400, 511, 512, 513, 3, 1600)]
    raw, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    reader = langid.Reader(m)
    reader.together = 3
    got = reader.pool(raw, offsets)
    assert np.allclose(got, langid.Reader(m).pool(raw, offsets), atol=1e-3)
    for k, t in enumerate(texts):
        want = np.zeros(4)
        for at in range(0, len(t), langid.STRETCH):
            a, stop = max(0, at - langid.MARGIN), min(len(t), at + langid.STRETCH)
            piece = t[a : min(len(t), stop + langid.MARGIN)]
            prob, _ = langid.forward(m.params, *langid.matrix([piece]))
            for i in range(at, stop):
                if chr(t[i]).isalpha() and t[i] < 128 or t[i] >= 128:
                    want += [*prob[i - a, 0], 1]
        assert np.allclose(got[k], want, atol=1e-2), k


def test_sample_of_rows(spark):
    """Rows of one id are sampled by their texts; without labels there is no model, and nothing is rejected."""
    rows = [(3, f"the text number {i} has words", "en") for i in range(3000)] + [(3, "der immer gleiche Satz", "de")] * 3000 + [(3, "sans nom ici", "fr"), (None, "held out", "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = langid.fit(df, docs_per_language=50)
    assert m.languages == ["de", "en", "fr"]
    assert langid.fit(df, max_labels=1).languages == ["en"]
    bare = df.limit(5).select("doc_id", "text")
    assert langid.fit(bare) is None and langid.keep_known(bare, None).count() == 5
    clash = spark.createDataFrame([(1, "le texte", "A", "b"), (2, None, "c", "d")], "doc_id long, text string, Lang string, LANG string")
    assert [r.doc_id for r in langid.keep_known(clash, m, least=0.0).collect()] == [1]


def test_warc(spark, tmp_path):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(i, f"http://x/{i}\r\n", (fake * 7 + "x" * (i % 5) * 40_000) if i % 3 else None) for i in range(60)] + [(None, None, "zz"), (None, "n", None), (7, "again", "only here"), (-5, "neg", "ä")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    files = warc.write_archives(df.repartition(2), str(tmp_path / "w"))
    got = warc.read_archives(spark, files, block=3000, payloads=True).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        f = first.get(h or "")
        same = f is None or f == i
        want[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if same else "revisit", None if same else f] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert {bytes(r.payload) for r in got if r.payload is not None} == {(h or "").encode() for _, _, h in rows}
    assert {r.record_type for r in warc.read_archives(spark, warc.write_archives(df, str(tmp_path / "m"), min_bytes=10**9)).collect()} == {"response"}
    far = spark.createDataFrame([(1, "http://x/" + "u" * (3 << 20), fake), (2, "http://y/:" + "v" * (1 << 20), "b" * (5 << 20))], df.schema)
    assert sorted((r.page_id, len(r.url)) for r in warc.read_archives(spark, warc.write_archives(far, str(tmp_path / "f")), payloads=True).collect()) == [(1, 9 + (3 << 20)), (2, 10 + (1 << 20))]
    assert warc.read_archives(spark, warc.write_archives(df.limit(0), str(tmp_path / "e"))).count() == 0


@pytest.mark.parametrize("name,table,sql", [("op5_minhash", "documents", oracles.MINHASH), ("op10_warc", "pages", oracles.WARC), ("op8_quotes", "conversations", quotes.SQL)])
def test_queries_agree_with_sql(spark, name, table, sql):
    from marlstone.llm import queries

    con = duckdb.connect()
    con.sql(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    out = queries.QUERIES[name](spark, DATA)
    assert Counter(map(tuple, out.collect())) == Counter(con.sql(f"select {', '.join(out.columns)} from ({sql})").fetchall())


def removed(rows, length=100):
    """Texts (as bytes) without what a string of that length that starts earlier covers."""
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(b[p : p + length])
        out[i] = bytes(x for x, g in zip(b, gone, strict=True) if not g)
    return out


def test_pipeline_stages(spark):
    """Each stage on what the one before kept, against brute force (the language stage against the network's own answers)."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    items = spark.read.parquet(f"{DATA}/benchmark.parquet").collect()
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs, _ = C.store(stage(spark, docs, DATA), name)
        rows = sorted((r.doc_id, r.text) for r in before.collect())
        if name == "packing":
            from tokenizers import Tokenizer

            lib, pieces = Tokenizer.from_file(WORDS), defaultdict(list)
            for r in docs.collect():
                pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
            assert set(pieces) == {i for i, _ in rows}
            for i, t in rows:
                ids, at = np.array([*lib.encode(t, add_special_tokens=False).ids, 2], "<u4"), 0
                for start, length, crc, total in sorted(pieces[i]):
                    assert (start, crc, total) == (at, zlib.crc32(ids[at : at + length].tobytes()), len(ids))
                    at += length
                assert at == len(ids)
            continue
        assert docs.columns == columns and 0 < docs.count() <= before.count()
        got = {r.doc_id: r.text for r in docs.collect()}
        if name == "language":
            said = langid.predict(before, langid.fit(before)).collect()
            assert set(got) == {r.doc_id for r in said if r.lang_pred != "und" and r.score >= 0.3}
        elif name == "near_duplicates":
            assert set(got) == {i for i, (_, root) in brute_links(rows, 5, 80).items() if i == root}
        elif name == "repeats":
            assert got == {i: b.decode("utf-8", "ignore") for i, b in removed(rows).items() if b}
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        else:
            plain = lambda t: re.sub(r"[^0-9a-z\u0080-\U0010ffff]", " ", t.lower()).split()
            whole = lambda t: " " + " ".join(plain(t)) + " "
            leaks = {i for i, t in rows for x in items if whole(x.text) in whole(t)}
            assert not leaks & set(got)
            grams = lambda t: {tuple(w[j : j + 5]) for w in [plain(t)] for j in range(len(w) - 4)}
            known = set().union(*(grams(x.text) for x in items))
            assert {i for i, t in rows if not grams(t) & known} <= set(got)


def test_stages_begin_with_a_small_heap(spark):
    import corpus_pipeline

    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()  # executors are in the driver here
    count = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = count()
    corpus_pipeline.STAGES[-1][1](spark, frame(spark, [(1, "a b")]), DATA)
    assert count() > before


def test_pipeline_has_small_arrow_batches(spark):
    import corpus_pipeline

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for value, want in (("8m", "2m"), ("64MB", "2m"), ("3m", "3m")):
            spark.conf.set(name, value)
            corpus_pipeline.STAGES[-1][1](spark, frame(spark, [(1, "a b")]), DATA)
            assert spark.conf.get(name) == want
    finally:
        spark.conf.set(name, before)


def test_pipeline_on_odd_tables(spark):
    """Nulls, repeated rows and names equal but for case; no labels; nothing at all."""
    import corpus_pipeline

    text = "These are the words of a document that stands in the table more than once, with enough of them for a shingle or two. "
    rows = [(1, text, None, "s", 3), (1, text, None, "s", 3), (2, text.upper(), None, "s", 3), (None, "no id " * 9, None, None, None), (4, None, None, "s", None), (5, "", None, "s", 0), (6, "123", None, "s", 3)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, TEXT2 string, Source string, SOURCE int")
    for table in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, DATA)
            if name == "language":
                assert out.count() == table.count()
            if name != "packing":
                assert out.columns == table.columns
                table = out.toDF(*(f"c{i}" for i in range(5)))
                table = C.store(table, "odd")[0].toDF(*odd.columns)
        assert {r.doc_id for r in out.collect()} == {r.doc_id for r in table.collect()}
        if table.count():
            assert {r.doc_id for r in table.collect()} == {1, None, 4, 5, 6}
