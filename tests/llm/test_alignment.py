"""Alignment of two tokenizers against tokens laid over each other one by one."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from cairn.llm import alignment


@pytest.fixture(scope="module")
def both():
    a = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_map():
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = {}, 0
    for b in range(256):
        if b in own:
            out[chr(b)] = b
        else:
            out[chr(256 + extra)] = b
            extra += 1
    return out


def spans(tokens):
    at, out = 0, []
    for t in tokens:
        out.append((at, at + len(t)))
        at += len(t)
    return out


def plain(both, rows):
    """Each document's tokens laid over each other, byte by byte; counts over all."""
    a, b = both
    to = byte_map()
    found, holders = [], defaultdict(set)
    for n, (doc_id, text) in enumerate(rows):
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        ta = [bytes(to[c] for c in a.id_to_token(i)) for i in ids_a]
        tb = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids_b)]
        if not text or not b"".join(ta) == b"".join(tb) == (" " + text).encode():
            found.append((doc_id, [], [], Counter(), ""))
            continue
        sa, sb = spans(ta), spans(tb)
        links = Counter()
        j = 0
        for i, (x, y) in enumerate(sa):
            while sb[j][1] <= x:
                j += 1
            k = j
            while k < len(sb) and sb[k][0] < y:
                links[ids_a[i], ids_b[k]] += 1
                k += 1
        ends = sorted({y for _, y in sa} & {y for _, y in sb})
        groups, i, j = [], 0, 0
        for e in ends:
            left, right = [], []
            while i < len(sa) and sa[i][1] <= e:
                left.append(str(ids_a[i]))
                i += 1
            while j < len(sb) and sb[j][1] <= e:
                right.append(str(ids_b[j]))
                j += 1
            groups.append(",".join(left) + "|" + ",".join(right))
        for p in links:
            holders[p].add(n)
        found.append((doc_id, ids_a, ids_b, links, ";".join(groups)))
    most = Counter()
    for (x, _), docs in holders.items():
        most[x] = max(most[x], len(docs))
    out = []
    for doc_id, ids_a, ids_b, links, groups in found:
        score = {p: len(holders[p]) for p in links}
        best = sum(n for p, n in links.items() if score[p] == most[p[0]])
        out.append((doc_id, len(ids_a), len(ids_b), groups.count("|") if groups else 0, sum(links.values()), best, sum(n * score[p] for p, n in links.items()), hashlib.sha256(groups.encode()).hexdigest() if groups else ""))
    return out


RNG = random.Random(3)
PARTS = ["the", " ", "  ", "   ", "\n", "\t ", " \n", "'s", "Straße", "naïve", "12", "3.14", "…", "🙂", "日本", "<|endoftext|>", "<s>", "</s>", "é", "|", "||", "x" * 30, "\x00", " ", "　", "ing", "\r\n", "\x1c", "\x85"]
TEXTS = ["", None, " ", "a", " a", "a ", "U+2581 ▁ here", "▁", "<unk>", "the of the of the"] + ["".join(RNG.choice(PARTS) for _ in range(RNG.choice([3, 20, 200]))) for _ in range(60)]


def key(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def test_alignment_equals_laying_tokens_over_each_other(spark, both):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "without an id"), (4, TEXTS[20]), (4, TEXTS[20])]
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, block string, pair int, size int").repartition(3)
    found = key(map(tuple, alignment.align(df).collect()))
    assert found == key(plain(both, rows))
    assert sum(r[1] > 0 for r in found) > 50 and sum(r[5] < r[4] for r in found) > 10


def test_small_blocks_and_long_texts_change_nothing(spark, both, monkeypatch):
    """Blocks of some documents, texts in many parts, one of them not given back, and stretches forgotten at once."""
    code = alignment.pair_index.__globals__
    for name, value in {"BLOCK_BYTES": 400, "PART_BYTES": 100, "PART_DOCS": 5, "STRETCHES": 10}.items():
        monkeypatch.setitem(code, name, value)
    monkeypatch.setattr(alignment.long_parts, "__defaults__", (100,))
    long = " ".join(RNG.choice(["the", "naïve", "Straße,", "12", "ing\nof"]) for _ in range(300))
    rows = [*enumerate(TEXTS), (100, long), (101, long + " ▁ " + long), (102, "y" * 500)]
    # Blocks are made here and not in workers, which do not see the patched sizes.
    with open(public_tokenizers.path(alignment.A_FILE), encoding="utf-8") as f, open(public_tokenizers.path(alignment.B_FILE), "rb") as g:
        known = alignment.Stretches(f.read(), g.read())
    batches, block = [], alignment.Block(known)
    for at in range(0, len(rows), 5):
        block.add([i for i, _ in rows[at : at + 5]], [t for _, t in rows[at : at + 5]])
        if block.size > 400:
            batches.append(block.batch(len(batches)))
            known.clear()
            block = alignment.Block(known)
    batches.append(block.batch(len(batches)))
    assert len(batches) > 5
    counts = Counter()
    for b in batches:
        for p, n in zip(b.column("pair").to_pylist()[:-1], b.column("size").to_pylist()[:-1], strict=True):
            counts[p] += n
    most = Counter()
    for p, n in counts.items():
        most[p >> 32] = max(most[p >> 32], n)
    found = []
    import pyarrow as pa

    for b in batches:
        own = pa.Table.from_batches([b.slice(b.num_rows - 1)])
        pairs = b.column("pair").to_pylist()[:-1][::-1]
        table = pa.table({"pair": pa.array(pairs, pa.int64()), "n_docs": pa.array([counts[p] for p in pairs], pa.int64()), "best": pa.array([counts[p] == most[p >> 32] for p in pairs], pa.bool_())})
        found += [tuple(r.values()) for r in alignment.scored(own, table).to_pylist()]
    assert key(found) == key(plain(both, rows))


def test_bitmaps_pack_and_count(both):
    import numpy as np

    rng = np.random.default_rng(1)
    pair, doc, times = rng.integers(0, 40, 4000) ** 2 << 32, rng.integers(0, 300, 4000), rng.integers(1, 9, 4000)
    b = alignment.PairBitmaps.merged(pair, doc, times)
    held = defaultdict(Counter)
    for p, d, n in zip(pair.tolist(), doc.tolist(), times.tolist(), strict=True):
        held[p][d] += n
    again = alignment.PairBitmaps.unpack(b.pack(300))
    assert again.pairs.tolist() == sorted(held) and again.sizes.tolist() == [len(held[p]) for p in sorted(held)]
    assert again.docs.tolist() == [d for p in sorted(held) for d in sorted(held[p])] and again.times.tolist() == [held[p][d] for p in sorted(held) for d in sorted(held[p])]
    assert again.links().tolist() == [sum(held[p].values()) for p in sorted(held)]
    assert len(alignment.PairBitmaps.unpack(alignment.PairBitmaps.merged(*[np.empty(0, np.int64)] * 3).pack(3)).pairs) == 0


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0
