"""The whole pipeline against plain re-computations of every stage after the classifier's."""

import hashlib
import math
import re
from collections import Counter

import corpus_pipeline
import public_tokenizers
import tokenizers
from fieldloom.llm import mixing

from test_near_copies import brute_kept

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cut(texts, window=35):
    """Texts without the words of windows that occur twice; what stands between kept words stays."""
    places = {}
    words = {k: list(WORD.finditer(t or "")) for k, t in texts.items()}
    for k, own in words.items():
        for a in range(len(own) - window + 1):
            places.setdefault(tuple(m.group() for m in own[a : a + window]), []).append((k, a))
    gone = {k: set() for k in texts}
    for found in places.values():
        if len(found) > 1:
            for k, a in found:
                gone[k].update(range(a, a + window))
    out = {}
    for k, t in texts.items():
        if not gone[k]:
            out[k] = t
            continue
        parts = [t[m.start() : words[k][i + 1].start() if i + 1 < len(words[k]) else len(t)] for i, m in enumerate(words[k]) if i not in gone[k]]
        out[k] = "".join(parts).rstrip()
    return out


def copies(rows):
    """How often the mix takes each (doc_id, source, text)."""
    size = {k: len(WORD.findall(t or "")) for k, (_, t) in rows.items()}
    sources = sorted({s for s, _ in rows.values() if s is not None}) + ([None] if any(s is None for s, _ in rows.values()) else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    held = {s: sum(size[k] for k in rows if rows[k][0] == s) for s in sources}
    target, open_, left = {}, set(sources), sum(held.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] >= 3 * held[s]}
        if not above:
            target |= share
            break
        target |= {s: 3.0 * held[s] for s in above}
        left, open_ = left - sum(3 * held[s] for s in above), open_ - above

    def key(k):
        text = rows[k][1] or ""
        u = (int(hashlib.md5(f"{mixing.SEED}:{k}:{hashlib.md5(text.encode()).hexdigest()}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        return -math.log(u) * (1 + 10 * len(re.findall(r"[#*$%&|<>!]", text)) / max(size[k], 1))

    out = {}
    for s in sources:
        whole = math.floor(target[s] / held[s]) if held[s] else 0
        budget, prefix = max(0.0, target[s] - whole * held[s]), 0
        for k in sorted((k for k in rows if rows[k][0] == s), key=lambda k: (key(k), k, size[k])):
            out[k] = whole + (2 * prefix + size[k] < 2 * budget)
            prefix += size[k]
    return out


def test_run_is_its_stages_by_hand(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clean = {r.doc_id: r for r in corpus_pipeline.drop_toxic(spark, docs, sf_dir).collect()}
    assert 0.5 * docs.count() < len(clean) < docs.count()
    kept = brute_kept([(k, r.text or "") for k, r in clean.items()])
    texts = cut({k: clean[k].text for k in kept})
    often = copies({k: (clean[k].source, texts[k]) for k in kept})
    codec = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    codec.no_truncation()
    codec.no_padding()
    want = Counter()
    for k, n in often.items():
        ids = codec.encode(texts[k] or "", add_special_tokens=False).ids
        row = (k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(codec.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        want[row] += n
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert got == +want and len(got) > 50
