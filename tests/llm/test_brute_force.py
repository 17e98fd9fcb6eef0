"""Operators against plain re-computations on small corpora."""

import hashlib
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import pytest
import xxhash
from fieldloom.llm import bpe, chat, common, graph, induced, media, mixing, quality_mil, simhash, substring_dedup, suffix_dedup, toxicity
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def corpus(spark):
    """Texts made of few blocks, so that long repeats, periodic stretches and near copies abound."""
    rng = random.Random(3)
    blocks = [" ".join(f"t{rng.randrange(40)}" for _ in range(rng.randrange(5, 80))) for _ in range(12)]
    rows = []
    for k in range(60):
        text = " ".join(rng.choice(blocks) for _ in range(rng.randrange(1, 5)))
        if rng.random() < 0.2:
            text += " go" * rng.randrange(30, 120)
        if rng.random() < 0.3:
            text = text.replace("t1", "T9", 1)
        rows.append((k, text, f"s{k % 4}" if k % 7 else None))
    rows += [(100 + k, rows[k][1], "s0") for k in range(8)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string, source string").repartition(5)


def brute_windows(rows, window):
    words = {d: WORD.findall(t or "") for d, t in rows}
    seen = {}
    for d, w in words.items():
        for a in range(len(w) - window + 1):
            seen.setdefault(tuple(w[a : a + window]), []).append((d, a))
    gone = {d: set() for d in words}
    for places in seen.values():
        if len(places) > 1:
            for d, a in places:
                gone[d].update(range(a, a + window))
    return {d: (len(w), len(gone[d]), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone[d]).encode()).hexdigest()) for d, w in words.items()}


@pytest.mark.parametrize("window", [3, 35])
def test_substrings(docs, corpus, window):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digest(docs, window).collect()}
    assert got == brute_windows([r[:2] for r in corpus], window)


def thue_morse(n, a="a", b="b"):
    return [(a, b)[bin(k).count("1") & 1] for k in range(n)]


def test_words_of_one_polynomial_name_stay_apart(spark):
    """Two words of 1,024 letters whose polynomial hashes modulo 2**64 agree whatever the base; sequences of words alike."""
    one, other = "".join(thue_morse(1024)), "".join(thue_morse(1024, "b", "a"))
    common = [f"w{k}" for k in range(34)]
    rows = [(1, " ".join([*common, one])), (2, " ".join([*common, other])), (3, " ".join(thue_morse(64, "p", "q"))), (4, " ".join(thue_morse(64, "q", "p"))), (5, "x" * 65 + " " + "x" * 64 + " " + "x" * 8)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_windows(rows, 35) and got[1][1] == got[2][1] == 0


@pytest.mark.parametrize("piece", [common.BLOCK_BYTES, 50])
def test_word_names_are_of_the_word_alone(monkeypatch, piece):
    monkeypatch.setattr(common, "BLOCK_BYTES", piece)
    rng = random.Random(2)
    words = ["".join(rng.choice("abé") for _ in range(rng.randrange(1, 90))) for _ in range(3000)] + ["a" * n for n in range(1, 200)] + ["a" * n + "\x00" for n in range(1, 70)]
    place = {}
    for order in (words, words[::-1]):
        text = "  ".join(order).encode()
        data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
        starts, ends, _ = common.word_bounds(data, offsets)
        names = common.word_names(data, starts, ends)
        for w, name in zip(order, names.tolist(), strict=True):
            assert place.setdefault(w, name) == name
        out, begins = common.squeezed(data, starts, ends)
        assert out.tobytes() == b"".join(w.encode() + b" " for w in order) and begins[-1] == len(out)
    assert len(set(place.values())) == len(place)


def test_removed_text_keeps_the_rest(docs, corpus):
    want = brute_windows([r[:2] for r in corpus], 35)
    for r in substring_dedup.remove_repeats(docs).collect():
        assert hashlib.sha256(" ".join(WORD.findall(r.text)).encode()).hexdigest() == want[r.doc_id][2]


def brute_bytes(rows, length):
    seen, out = set(), {}
    for d, t in sorted(rows):
        e = (t or "").encode()
        gone = np.zeros(len(e) + 1, int)
        for p in range(len(e) - length + 1):
            x = e[p : p + length]
            if x in seen:
                gone[p] += 1
                gone[p + length] -= 1
            seen.add(x)
        cut = np.cumsum(gone[:-1]) > 0
        kept = np.frombuffer(e, np.uint8)[~cut]
        out[d] = (len(e), int(cut.sum()), int((np.diff(np.concatenate([[0], cut.astype(int)])) == 1).sum()), hashlib.sha256(kept.tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("length", [10, 100])
def test_suffixes(docs, corpus, length):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digest(docs, length).collect()}
    assert got == brute_bytes([r[:2] for r in corpus], length)


def plain_order(text, cap):
    def key(p):
        out = []
        for i in range(p, len(text)):
            out.append((text[i], i if text[i] == 0 else 0))
            if text[i] == 0:
                break
        return out

    order = sorted(range(len(text)), key=key)
    common = [0]
    for a, b in zip(order, order[1:], strict=False):
        k = 0
        while k < cap and text[a + k] == text[b + k]:
            k += 1
            if text[a + k - 1] == 0:
                break
        common.append(k)
    return order, common


@pytest.mark.parametrize("limit", [1 << 20, 6])
def test_induced_sorting(tmp_path, limit):
    rng = random.Random(limit)
    for _ in range(120):
        text = []
        for _ in range(rng.randrange(1, 6)):
            one = [rng.randint(1, rng.choice([2, 3, 30])) for _ in range(rng.randrange(1, 50))] * rng.choice([1, 1, 3])
            text += (text[: text.index(0)] if text and rng.random() < 0.4 else []) + one + [0]
        cap = rng.choice([5, 100])
        order, common = induced.Sorter(cap, str(tmp_path), limit).sort(np.array(text, np.int64))
        assert (list(order), list(common)) == plain_order(text, cap)


def test_queue_merges_runs_of_runs(tmp_path, monkeypatch):
    monkeypatch.setattr(induced, "FAN_IN", 4)
    rng = np.random.default_rng(1)
    queue = induced.DiskQueue(2, 1, str(tmp_path), 50)
    rows = rng.integers(0, 40, (2, 3000)).astype(np.uint64)
    for low in range(0, 3000, 7):
        queue.push(*rows[:, low : low + 7], np.arange(low, min(low + 7, 3000)))
    got = np.concatenate(list(queue.drain()), axis=1)
    assert got.shape == (3, 3000) and sorted(got[2].tolist()) == list(range(3000))
    assert (rows[:, got[2].astype(int)] == got[:2]).all()
    assert list(map(tuple, got[:2].T)) == sorted(map(tuple, rows.T))


@pytest.mark.parametrize("limit", [1 << 18, 40])
def test_later_starts_in_blocks(tmp_path, limit):
    """Groups that go over any number of blocks: all starts of a string but the earliest."""
    rng = random.Random(limit)
    for _ in range(12):
        common = bytes(rng.choice(b"ab") for _ in range(30))
        strings = [common[rng.randrange(9) :] + bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 9))) for _ in range(25)]
        place, document = [rng.randrange(1000) for _ in strings], [rng.randrange(9) for _ in strings]
        text = induced.Vector(np.int16, str(tmp_path), limit)
        for x in strings:
            text.append(np.append(np.frombuffer(x, np.uint8).astype(np.int16) + 1, 0))
        bounds = np.concatenate([[0], np.cumsum([len(x) + 1 for x in strings])])
        got = np.concatenate(list(suffix_dedup.later_starts(text, bounds, np.array(document), np.array(place), 12, str(tmp_path), limit)) or [np.zeros(0, int)])
        seen, want = {}, []
        for k, x in enumerate(strings):
            for o in range(len(x) - 11):
                seen.setdefault(x[o : o + 12], []).append(((document[k], place[k] + o), int(bounds[k]) + o))
        for starts in seen.values():
            want += [p for at, p in starts if at != min(starts)[0]]
        assert got.tolist() == sorted(want)


def test_sorting_takes_no_memory_for_long_texts(tmp_path):
    """Peak memory of a sort of 2**22 symbols against one of 2**20, with 2**15 entries in memory."""
    code = """
import resource, sys
import numpy as np
from fieldloom.llm.induced import Sorter, Vector
rng, text = np.random.default_rng(0), Vector(np.int16, sys.argv[1], 1 << 15)
while len(text) < int(sys.argv[2]):
    part = rng.integers(1, 30, 131 * 200).astype(np.int16)
    part[130::131] = 0
    text.append(part)
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
order, lcp = Sorter(100, sys.argv[1], 1 << 15).sort(text)
assert len(order) == len(lcp) == len(text)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)
"""
    small, large = (int(subprocess.run([sys.executable, "-c", code, str(tmp_path), str(n)], capture_output=True, text=True, check=True).stdout) for n in (1 << 20, 1 << 22))
    assert large < 80 and large - small < 40


def fingerprint(text, size):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    own = [" ".join(words[k : k + size]) for k in range(len(words) - size + 1)] if len(words) >= size else [" ".join(words)] if words else []
    counts = [0] * 64
    for x in own:
        h = xxhash.xxh64(x.encode(), seed=42).intdigest()
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if own and 2 * counts[b] > len(own))


def brute_components(prints, radius):
    ids = sorted(prints)
    parent = {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: find(d) for d in ids}


def test_simhash(docs, corpus):
    prints = {d: fingerprint(t, 3) for d, t, _ in corpus}
    rows = simhash.near_classes(docs).collect()
    assert {r.doc_id: r.fp % (1 << 64) for r in rows} == prints
    assert {r.doc_id: r.component_id for r in rows} == brute_components(prints, 2)


@pytest.mark.parametrize("limit", [4096, 20])
def test_links_of_dense_fingerprints(spark, monkeypatch, limit):
    """Many prints around few centres fill buckets; a low limit sends them through the finer bands."""
    monkeypatch.setattr(simhash, "LIMIT", limit)
    rng = random.Random(9)
    centres = [rng.getrandbits(64) for _ in range(3)]
    prints = {k: rng.choice(centres) for k in range(400)}
    for k in prints:
        for _ in range(rng.randrange(0, 6)):
            prints[k] ^= 1 << rng.randrange(64)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame([(k, signed(p)) for k, p in prints.items()], "doc_id long, fp long")
    rows = simhash._classes(table, simhash.links(table.select("fp").distinct())).collect()
    assert {r.doc_id: r.component_id for r in rows} == brute_components(prints, 2)


def test_bit_sliced_distances():
    rng = np.random.default_rng(1)
    for radius in (0, 1, 2, 3, 7, 13):
        centre = rng.integers(0, 1 << 63, dtype=np.uint64)
        prints = np.array([centre ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 20)).astype(np.uint64)) for _ in range(130)], np.uint64)
        over = simhash._lanes(simhash.over_radius(simhash.bit_planes(prints), prints[:9], radius), 130)
        assert (over == (np.bitwise_count(prints[:9, None] ^ prints[None]) > radius)).all()


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(4)
    base = [[f"v{rng.randrange(900)}" for _ in range(300)] for _ in range(30)]
    rows = [(k, " ".join(w)) for k, w in enumerate(base)]
    for k in range(10):  # near copies: three words of 300 changed
        w = list(base[k])
        for _ in range(3):
            w[rng.randrange(300)] = "changed"
        rows.append((100 + k, " ".join(w)))
    kept = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(30))


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 103), (103, 101), (200, 201)] + [(300, 300 + k) for k in range(1, 50)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {103: 100, 101: 100, 201: 200} | {300 + k: 300 for k in range(1, 50)}


def test_bpe_is_the_librarys(docs, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(bpe.TOKENIZER))
    ids = bpe.encode(docs)
    back = {r.doc_id: r.text for r in bpe.decode(ids.drop("text")).collect()}
    assert back == {d: t for d, t, _ in corpus}
    for r in ids.collect():
        assert r.ids == library.encode(r.text, add_special_tokens=False).ids


def test_bpe_of_long_unsplit_text():
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(bpe.TOKENIZER))
    own, rng = bpe.Codec(bpe.TOKENIZER, leaf=32), random.Random(8)
    size = lambda k: len(own.raw[k])
    for _ in range(200):
        piece = "".join(rng.choice(rng.choice(["ab", "etaoin", "thing", "aaaa"])) for _ in range(rng.randrange(1, 400)))
        assert bpe.tree_encode(piece, own._model, size, rng.choice([1, 3, 17])) == own._model(piece)
    for text in ("a" * 9000, " " * 5000 + "x", "!" * 3000 + "<|endoftext|>" + "é日本" * 900, "ab" * 4000 + "\n\n", "'" * 5000 + "ll", "7" * 5000, " Ab" + "Ab" * 3000 + "'s", "-" * 4096 + "é" * 40):
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids
        assert own._pieces(text) == own.encode(text)
        assert own.decode(own.encode(text)) == text


def test_mixing(spark, docs, corpus):
    rows = mixing.mixed(docs).toDF("doc_id", "text", "source", "size", "source_size", "target", "copies").collect()
    total = sum(r.size for r in rows)
    by_source = {}
    for r in rows:
        by_source.setdefault(r.source, []).append(r)
    assert abs(sum(x[0].target for x in by_source.values()) - total) < 1e-6 * total
    for own in by_source.values():
        taken, target = sum(r.size * r.copies for r in own), own[0].target
        assert abs(taken - target) <= max(r.size for r in own) and max(r.copies for r in own) <= 3
        assert max(r.copies for r in own) - min(r.copies for r in own) <= 1
    again = mixing.mixed(docs.repartition(3)).toDF(*[f"x{k}" for k in range(7)]).select("x0", "x6").collect()
    assert {(r.doc_id, r.copies) for r in rows} == {(r.x0, r.x6) for r in again}


def test_ties_are_split_by_count(spark):
    """Rows that share a doc_id, or have none, and equal rows: every source ends within one document of its target."""
    same = " ".join(["w"] * 50)
    rows = [(7, same, "b")] * 400 + [(None, same, "c")] * 500 + [(k, f"{same} {k}", "a") for k in range(600)] + [(None, f"{same} {k}", "d") for k in range(300)] + [(9, "", "e")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    got = mixing.mixed(docs).toDF("doc_id", "text", "source", "size", "source_size", "target", "copies").collect()
    assert len(got) == len(rows)
    for name in "abcd":
        own = [r for r in got if r.source == name]
        assert abs(sum(r.size * r.copies for r in own) - own[0].target) <= 51
        assert max(r.copies for r in own) <= 3 and max(r.copies for r in own) - min(r.copies for r in own) <= 1
    key = lambda r: (r.source, r.doc_id if r.doc_id is not None else -1, r.text, r.copies)
    again = mixing.mixed(docs.repartition(3)).toDF("doc_id", "text", "source", "size", "source_size", "target", "copies").collect()
    assert sorted(map(key, again)) == sorted(map(key, got))


def test_targets_of_many_sources(spark, monkeypatch):
    """Ranks and sums over ranges give the same targets as the rule followed source by source."""
    rng = random.Random(3)
    sizes = {f"s{k:03d}": rng.choice([0, 1, 5, 90, 3000]) * rng.randrange(1, 9) for k in range(200)} | {None: 777}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(9)).collect()}
    names = sorted((x for x in sizes if x is not None)) + [None]
    weight = {n: (5, 2, 1)[k % 3] for k, n in enumerate(names)}
    want, open_, left = {}, set(names), sum(sizes.values())
    while True:
        share = {n: left * weight[n] / sum(weight[x] for x in open_) for n in open_}
        above = {n for n in open_ if share[n] >= 3 * sizes[n]}
        if not above:
            break
        want |= {n: 3 * sizes[n] for n in above}
        left, open_ = left - sum(3 * sizes[n] for n in above), open_ - above
        if not open_:
            break
    want |= share if open_ else {}
    assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-6 for n in want)


def test_targets_reshare(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 5), (None, 100)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got["a"] == 30 and got["c"] == 15 and got[None] == 300 and abs(got["b"] - (1115 - 345)) < 1e-9


def test_media_round_trip(docs, corpus):
    store = media.Store(docs)
    got = {r.doc_id: r for r in store.lists.select("doc_id", "n_bytes", "key").join(store.values(), "key").collect()}
    for d, t, _ in corpus:
        e = t.encode()
        payload = e + b" " * (-len(e) % 192 or (0 if e else 192))
        assert (got[d].n_bytes, got[d].payload_bytes, got[d].payload_sha256, got[d].tail_crc32) == (len(e), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


def test_stored_form_by_hand(spark):
    """Cuts by the gear hash byte by byte, digests, compression and the features, for every distinct payload."""
    import struct

    import zstandard

    rng = random.Random(12)
    long = " ".join(f"w{rng.randrange(3000)}" for _ in range(9000))
    texts = ["", None, "short", "é" * 5000, "a" * 40_000, long, long[7000:] + "tail", "x" + long[:20_000]]
    got = {r.doc_id: r for r in (lambda s: s.lists.join(s.values(), "key"))(media.Store(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    assert len(got) == len(texts)
    pack = zstandard.ZstdCompressor(level=3)
    for k, text in enumerate(texts):
        own = (text or "").encode()
        payload = own + b" " * (max(1, -(-len(own) // 192)) * 192 - len(own))
        chunks, start, h = [], 0, 0
        for i, byte in enumerate(payload):
            h = (h << 1) + int(media.GEAR[byte]) & 0xFFFFFFFF
            size = i + 1 - start
            # the hash sees 32 bytes, whatever chunk they are in; what a block holds before a payload can't reach past LEAST bytes
            if (size >= 1024 and len(payload) - start > 1024 and h >> 20 == 0) or size == 16384 or i + 1 == len(payload):
                chunks.append(payload[start : i + 1])
                start = i + 1
        names = [hashlib.sha256(c).digest() for c in chunks]
        stored = b"CDC1" + struct.pack("<QI", len(payload), len(chunks)) + b"".join(n + struct.pack("<I", len(c)) for n, c in zip(names, chunks, strict=True)) + b"".join(pack.compress(c) for c in chunks)
        data = np.frombuffer(payload, np.uint8)
        shares = ",".join(str(int(((data >> 5) == b).sum()) * 1000 // len(data)) for b in range(8))
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(own), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert list(r.digests) == [bytearray(n) for n in names]
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert r.feature == f"chunks={len(chunks)};mean={int(data.astype(int).sum()) * 1000 // len(data)};ranges={shares}"


def test_chunks_survive_a_shift():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 200_000).astype(np.uint8)

    def chunks(x):
        ends = media.cuts(x, np.array([0, len(x)]))[0]
        return {x[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)}

    one, two = chunks(data), chunks(np.concatenate([rng.integers(0, 256, 77).astype(np.uint8), data]))
    assert len(one & two) > 0.9 * len(one)
    with pytest.raises(ValueError):
        media.rebuild(b"x" * 32, [(b"y" * 32, None)])


def test_reply_trees(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 1.0), (1, 3, 1, "assistant", "good", 2.0), (1, 4, 3, "user", "more", 1.0), (1, 5, 4, "assistant", "end", 0.5), (1, 6, 2, "user", "off", 9.0)]
    rows += [(2, k, k - 1 if k else None, "assistant" if k % 2 else "user", f"m{k}", 1.0) for k in range(37)]
    rows += [(3, 1, 2, "user", "loop", 0.0), (3, 2, 1, "assistant", "loop", 0.0)]
    messages = spark.createDataFrame(rows, "conv long, id long, parent long, role string, text string, score double")
    out = {(r.conv, r.rank): [t.text for t in r.t] for r in chat.formatted(messages, 2).select("conv", "rank", chat.parsed(F.col("formatted")).alias("t")).collect()}
    assert out == {(1, 1): ["q", "bad", "off"], (1, 2): ["q", "good", "more", "end"], (2, 1): [f"m{k}" for k in range(37)]}


def _auc(y, s):
    order = np.argsort(np.argsort(s)) + 1
    return (order[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id")
    got = quality_mil.op1_quality_classifier(spark, sf).toPandas().set_index("doc_id").join(labels, how="inner")
    held = got[got.held_out]
    assert _auc(held.quality.to_numpy(), held.score.to_numpy()) > 0.9 and (held.predicted == held.quality).mean() > 0.9


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    chain = toxicity.train(docs, toxicity.table_labels(labels.where("doc_id % 4 != 2")), toxicity.CATEGORIES)
    held = labels.where("doc_id % 4 = 2")
    got = toxicity.score(docs.join(held, "doc_id", "left_semi"), chain, ["doc_id"]).toPandas().merge(held.toPandas(), on="doc_id")
    said = got.p_toxic >= 0.5
    assert (said & (got.toxic == 1)).sum() > 0.8 * got.toxic.sum() and (said & (got.toxic == 0)).mean() < 0.01


def test_chain_uses_earlier_categories():
    """The third category is 'exactly one of the first two', which no linear model of the words alone can say as well."""
    rng = np.random.default_rng(6)
    n = 600
    y = rng.integers(0, 2, (n, 2))
    rows = [np.unique(np.concatenate([rng.integers(100, 5000, 20), np.array([1] * a + [2] * b, int)])) for a, b in y]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    labels = np.column_stack([y, y[:, 0] & y[:, 1]])
    chain = toxicity.fit_chain(np.concatenate(rows), offsets, labels, np.arange(n) % 3, ["a", "b", "c"])
    p = chain.probabilities(np.concatenate(rows), offsets)
    assert [((p[:, k] > 0.5) == labels[:, k]).mean() > 0.95 for k in range(3)] == [True] * 3
    assert len(chain.models[2].chained) == 2


def test_chain_steps(monkeypatch):
    """Every model sees the out-of-fold probabilities of the earlier ones in training and the full models' in scoring."""
    rng = np.random.default_rng(2)
    n = 90
    y = rng.integers(0, 2, (n, 2))
    rows = [np.unique(np.concatenate([rng.integers(100, 900, 9), np.array([1] * a + [2] * b, int)])) for a, b in y]
    flat, offsets, fold = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])]), np.arange(n) % 3
    seen, plain = [], toxicity.fit_linear

    def noted(flat, offsets, y, extra, **more):
        seen.append((len(y), extra.copy()))
        return plain(flat, offsets, y, extra, **more)

    monkeypatch.setattr(toxicity, "fit_linear", noted)
    chain = toxicity.fit_chain(flat, offsets, y, fold, ["a", "b"])

    def one(model, k, earlier):
        z = model.bias + sum(model.weights[f] for f in rows[k]) + sum(c * e for c, e in zip(model.chained, earlier, strict=True))
        return 1 / (1 + np.exp(-z))

    by_hand = np.zeros(n)
    for f in range(3):
        keep = [k for k in range(n) if fold[k] != f]
        sizes = [len(rows[k]) for k in keep]
        part = plain(np.concatenate([rows[k] for k in keep]), np.concatenate([[0], np.cumsum(sizes)]), y[keep, 0].astype(float), np.zeros((len(keep), 0)))
        for k in np.flatnonzero(fold == f):
            by_hand[k] = one(part, k, ())
    second = next(x for m, x in seen if m == n and x.shape[1] == 1)
    assert np.allclose(second[:, 0], by_hand) and 0 <= second.min() <= second.max() <= 1
    p = chain.probabilities(flat, offsets)
    for k in range(n):
        first = one(chain.models[0], k, ())
        assert np.isclose(p[k, 0], first) and np.isclose(p[k, 1], one(chain.models[1], k, (first,)))


def test_attention_forward_and_gradients():
    """One bag after the other in plain Python, and gradients by differences."""
    rng = np.random.default_rng(4)
    net = quality_mil.Network()
    bags, target = np.array([0, 1, 4, 9]), np.array([1.0, 0.0, 1.0])
    h = rng.normal(size=(9, quality_mil.WIDTH))
    net.mean, net.scale = h.mean(axis=0), h.std(axis=0)
    p, got = net.p, net.scores(h, bags)

    def score(rows):
        e = [np.tanh(np.clip((x - net.mean) / net.scale, -6, 6) @ p["W"] + p["b"]) for x in rows]
        s = [float((np.tanh(x @ p["V"]) / (1 + np.exp(-(x @ p["U"])))) @ p["w"]) for x in e]
        a = np.exp(s) / np.exp(s).sum()
        return 1 / (1 + np.exp(-(sum(w * x for w, x in zip(a, e, strict=True)) @ p["c"] + p["d"][0])))

    assert np.allclose(got, [score(h[low:high]) for low, high in zip(bags[:-1], bags[1:], strict=True)])

    def loss():
        y = net.scores(h, bags)
        return -float((target * np.log(y) + (1 - target) * np.log(1 - y)).mean())

    for name, g in net.gradients(h, bags, target).items():
        for at in [tuple(rng.integers(0, k) for k in g.shape) for _ in range(4)]:
            keep = p[name][at]
            p[name][at] = keep + 1e-6
            up = loss()
            p[name][at] = keep - 1e-6
            down = loss()
            p[name][at] = keep
            assert np.isclose((up - down) / 2e-6, g[at], atol=1e-6)


def test_training_is_bounded_and_fixed(spark):
    """Labels that differ teach nothing, an id that many rows share brings one document, passages are never cut from one."""
    rows = [(k, f"good words here {k}" if k % 2 else f"# $ junk {k} ! !", "x") for k in range(60)]
    docs = spark.createDataFrame(rows + [(1, f"another text {j}", "x") for j in range(300)] + [(2, "long " * 2000, "x")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)] + [(5, 0, 1), (7, 1, 1)], "doc_id long, quality int, toxic int")
    own = toxicity.one_label(labels.select(F.col("doc_id").alias("_id"), "quality", "toxic"), ["quality", "toxic"])
    kept = {r._id for r in own.collect()}
    assert kept == set(range(60)) - {5, 7}
    for d in (docs, docs.repartition(5)):
        taught = {r.doc_id: r.text for r in toxicity.one_document(d, own).collect()}
        assert taught.keys() == kept
        assert taught == {r.doc_id: r.text for r in toxicity.one_document(docs, own).collect()}
    teach = labels.select("doc_id", F.col("quality").alias("y"))
    one, other = (quality_mil.train(d, teach) for d in (docs, docs.repartition(5)))
    assert all(np.array_equal(one.p[k], other.p[k]) for k in one.p)
    few = quality_mil.train(docs, teach, most=12)
    assert not np.array_equal(few.p["W"], one.p["W"])
