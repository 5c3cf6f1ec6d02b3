"""Each operator against a plain version, on texts with nulls, repeats, ties and extra columns."""

import base64
import hashlib
import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from cairn.llm import bpe, decontaminate, langid, ppm, quality, simhash, substring_dedup, suffix_dedup, suffixes, token_counts, topk

RNG = random.Random(5)
WORDS = ["alpha", "Beta", "gamma", "Straße", "élan", "x", "naïve", "δέλτα", "12", "end."]
PASSAGE = " ".join(RNG.choice(WORDS) for _ in range(60))


def texts():
    out = []
    for i in range(40):
        words = [RNG.choice(WORDS) + str(RNG.randrange(40)) for _ in range(RNG.choice([0, 1, 3, 30, 200]))]
        t = " ".join(words)
        if i % 4 == 0:
            t = t[: len(t) // 2] + " " + PASSAGE + " " + t[len(t) // 2 :]
        out.append(t)
    out[7] = out[3]
    out[11] = out[8] + "\n"
    out[13] = PASSAGE + "\t" + PASSAGE
    out[15] = "ab" * 700
    out[17] = " \t\r\n\x0b\x0c "
    out[19] = None
    return out


TEXTS = texts()


@pytest.fixture(scope="module")
def docs(spark):
    """Ids out of order, columns that the operators use inside, one null id, one row twice."""
    rows = [((i * 7) % 41, t, "x", i) for i, t in enumerate(TEXTS)]
    rows += [(None, "a text without id", "y", 1), rows[5]]
    df = spark.createDataFrame(rows, "doc_id long, text string, block string, hash long")
    return df.repartition(3).cache()


def plain_docs():
    return {(i * 7) % 41: (t or "") for i, t in enumerate(TEXTS)}


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_substring_dedup(spark, docs):
    found = {r.doc_id: r for r in substring_dedup.substring_dedup(docs).collect()}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t in plain_docs().items()}
    first: dict[tuple, int] = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    assert any(r.n_removed for r in found.values())
    for i, w in words.items():
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        assert (found[i].n_words, found[i].n_removed) == (len(w), len(gone))
        assert found[i].kept_text == " ".join(x for j, x in enumerate(w) if j not in gone)
        assert sum(s.end - s.start for s in found[i].spans) == len(gone)
    assert found[None].n_words == 4 and substring_dedup.substring_dedup(empty(spark)).count() == 0


@pytest.mark.parametrize("width", [100, 64])
def test_suffix_dedup(spark, docs, width):
    rows = suffix_dedup.suffix_dedup(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]), width).collect()
    found = {r.doc_id: r for r in rows}
    seen, any_cut = set(), False
    for i, t in sorted(plain_docs().items()):
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            w = b[k : k + width]
            if w in seen:
                gone[k : k + width] = b"\1" * width
            seen.add(w)
        any_cut |= any(gone)
        assert bytes(found[i].kept) == bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert (found[i].n_bytes, found[i].n_removed) == (len(b), sum(gone))
        assert len(found[i].spans) == len(re.findall(b"\1+", bytes(gone)))
    assert any_cut and suffix_dedup.suffix_dedup(empty(spark)).count() == 0
    assert suffix_dedup.suffix_dedup(docs).count() == docs.count()


def test_suffix_ranks_and_common_prefixes():
    for trial in range(120):
        n = RNG.randint(1, 80)
        b = bytes(RNG.choice(b"ab" if trial % 2 else b"abcdef") for _ in range(n)) + b"a" * RNG.choice([0, 90])
        n = len(b)
        rank = suffixes.suffix_ranks(np.append(np.frombuffer(b, np.uint8).astype(np.int64) + 1, 0))
        order = np.empty(n + 1, np.int64)
        order[rank] = np.arange(n + 1)
        assert order.tolist() == sorted(range(n + 1), key=lambda i: b[i:])
        before = np.full(n, -1)
        before[order[2:]] = order[1:-1]
        length = suffixes.common_prefixes(np.frombuffer(b, np.uint8), before)
        for i in range(n):
            j = before[i]
            want = next((k for k in range(n) if max(i, j) + k >= n or b[i + k] != b[j + k]), n) if j >= 0 else 0
            assert length[i] == want


def test_simhash(spark, docs):
    found = simhash.simhash_dedup(docs).collect()
    assert len(found) == docs.count()

    def plain(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        s = [" ".join(w[i : i + 4]) for i in range(max(len(w) - 3, 1))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))

    prints = {i: plain(t) for i, t in plain_docs().items()}
    least = {i: i for i in prints}
    for _ in prints:
        for i in prints:
            for j in prints:
                if (prints[i] ^ prints[j]).bit_count() <= 4:
                    least[i] = least[j] = min(least[i], least[j])
    got = {r.doc_id: r for r in found if r.doc_id is not None}
    assert {i: r.component_id for i, r in got.items()} == least
    assert all(r.fingerprint & (2**64 - 1) == prints[i] for i, r in got.items())
    assert simhash.simhash_dedup(empty(spark)).count() == 0


@pytest.mark.parametrize("segments", [2, 3])
def test_simhash_links_join_all_close_fingerprints(spark, segments):
    base = [RNG.getrandbits(64) for _ in range(4)]
    prints = sorted({b ^ sum(1 << RNG.randrange(64) for _ in range(RNG.randrange(7))) & (2**64 - 1) for b in base for _ in range(40)})
    signed = lambda x: x - 2**64 if x >> 63 else x
    nodes = spark.createDataFrame([(signed(p), 1 + i % 3) for i, p in enumerate(prints)], "fp long, n long")
    pairs = {(r.u & (2**64 - 1), r.v & (2**64 - 1)) for r in simhash.links(nodes, 4, segments).collect()}
    assert all((a ^ b).bit_count() <= 4 for a, b in pairs)

    def parts(edges):
        top = {p: p for p in prints}
        for _ in prints:
            for a, b in edges:
                top[a] = top[b] = min(top[a], top[b])
        return top

    assert parts(pairs) == parts([(a, b) for a in prints for b in prints if (a ^ b).bit_count() <= 4])


@pytest.fixture(scope="module")
def tokenizer():
    path = public_tokenizers.path(bpe.VOCABULARY)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, docs, tokenizer):
    for r in bpe.bpe(docs.filter("doc_id is not null")).collect():
        t = plain_docs()[r.doc_id]
        assert r.ids == tokenizer.encode_ordinary(t) and bytes(r.decoded) == t.encode()
    own = bpe.Encoder(bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY)))
    pieces = ["a", " the", "  ", "\n", "é", "漢字", "🙂", "123", "!!", "'s", "\x1c", "\x85", "​", "zzzzzzz", "ſ", "Ⅷ", "<|endoftext|>"]
    for _ in range(1500):
        t = "".join(RNG.choice(pieces) for _ in range(RNG.randint(0, 25)))
        assert own.encode(t).tolist() == tokenizer.encode_ordinary(t)
    assert bpe.bpe(empty(spark)).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(700, 12))
    vectors[300:320] = vectors[5]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(900, None), (901, [1.0, None]), (902, [float("nan")] * 12), (None, [0.0] * 12), (7, [float(x) for x in vectors[7]])]
    v = topk.integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = defaultdict(list)
    for r in topk.top_k(v, v.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    whole = np.floor(1024 * vectors).astype(np.int64)
    for q in range(0, 700, 50):
        scores = whole @ whole[q]
        assert found[q] == [(i, scores[i]) for i in sorted((i for i in range(700) if i != q), key=lambda i: (-scores[i], i))[:10]]
    assert set(found) == set(range(0, 700, 50)) and topk.top_k(v.limit(0), v.limit(0)).count() == 0


def test_token_counts(spark, docs):
    rows, want = [], set()
    for f in range(5):
        sizes = [RNG.choice([0, 1, 5, 60]) for _ in range(RNG.randrange(6))]
        tail = RNG.choice([0, 4])
        rows.append((f, np.array([t for n in sizes for t in [1] * n + [token_counts.END]] + [2] * tail, "<u2").tobytes()))
        want |= {(f, i, n) for i, n in enumerate(sizes + [tail] * (tail > 0))}
    files = spark.createDataFrame(rows, "file long, content binary")
    for size in (2, 6, 1 << 20):
        assert {tuple(r) for r in token_counts.token_counts(token_counts.token_file_blocks(files, size)).collect()} == want


def test_language_network_learns_and_its_gradients_are_right(spark):
    rng = np.random.default_rng(0)
    net = langid.Network.fresh(["a", "b"], rng, hidden=3)
    net = langid.Network(net.languages, [w.astype(np.float64) for w in net.weights])
    x, y, inside = rng.integers(0, 5, (6, 4)).astype(np.uint8), np.array([0, 1, 1, 0]), np.ones((6, 4))
    _, grads = net.gradients(x, y, inside)
    for w, g in zip(net.weights, grads, strict=True):
        at = tuple(rng.integers(0, min(s, 5)) for s in w.shape)
        old = w[at]
        w[at] = old + 1e-5
        up = net.gradients(x, y, inside)[0]
        w[at] = old - 1e-5
        down = net.gradients(x, y, inside)[0]
        w[at] = old
        assert abs((up - down) / 2e-5 - g[at]) < 1e-6
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = langid.fit(table.filter(langid.fold(4) != 2), per_label=120)
    held = table.filter(langid.fold(4) == 2)
    right = langid.identify(held, net).join(held.select("doc_id", "lang"), "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?")], "doc_id long, text string")
    assert {tuple(r) for r in langid.identify(odd, net).collect()} == {(i, "und", 0.0) for i in (1, 2, 3)}


def test_quality_ranks_held_out_labels(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    learn = langid.fold(5) != 0
    model = quality.fit(table.filter(learn), labels.filter(learn & (F.col("quality") == 1)), per_kind=800)
    assert 0.7 < model.prior < 0.95
    held = table.filter(~learn).join(labels.select("doc_id", "quality"), "doc_id")
    rows = quality.quality(held, model).join(labels.select("doc_id", "quality"), "doc_id").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert quality.quality(empty(spark), model).count() == 0
    assert quality.fit(table, labels.filter("quality = 9")) is None


def test_ppm_equals_counting_by_hand(spark, docs):
    learn = [t for i, t in plain_docs().items() if i % 3]
    table = docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).withColumn("held_out", F.col("doc_id") % 3 == 0)
    counts = [defaultdict(Counter) for _ in range(ppm.ORDER + 1)]
    for t in learn:
        d = bytes(ppm.ORDER) + t.encode().lower() + b"\0"
        for i in range(ppm.ORDER, len(d)):
            for k in range(ppm.ORDER + 1):
                counts[k][d[i - k : i]][d[i]] += 1
    words = Counter(w for t in learn for w in [*t.encode().lower().split(), b""])
    total, kinds = sum(words.values()), len(words)
    for r in ppm.lm_scores(table).collect():
        t = plain_docs()[r.doc_id].encode().lower()
        own = [*t.split(), b""]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(w in words for w in own), total)
        assert math.isclose(r.base_score, sum(math.log10((words[w] + 1) / (total + kinds + 1)) for w in own))
        d, score = bytes(ppm.ORDER) + t + b"\0", 0.0
        for i in range(ppm.ORDER, len(d)):
            out: set[int] = set()
            for k in range(ppm.ORDER, -1, -1):
                left = {s: n for s, n in counts[k].get(d[i - k : i], {}).items() if s not in out}
                if not left:
                    continue
                whole = sum(left.values()) + len(left)
                if d[i] in left:
                    score += math.log10(left[d[i]] / whole)
                    break
                score += math.log10(len(left) / whole)
                out |= set(left)
            else:
                score -= math.log10(256 - len(out))
        assert math.isclose(r.score, score, rel_tol=1e-4, abs_tol=1e-3)


def test_ppm_keeps_rare_counts_of_a_large_corpus(spark):
    """Over 10 MB of training text, what one text alone has counts as it should."""
    own = random.Random(9)
    common = [" ".join(own.choice(WORDS) + str(own.randrange(30)) for _ in range(700)) for _ in range(4)]
    rare = " ".join("".join(own.choice("bcdfghjkqwz") for _ in range(7)) for _ in range(60))
    weights = {t: 520 for t in common} | {rare: 1}
    rows = [(i * 520 + k, t, False) for i, t in enumerate(common) for k in range(520)] + [(9000, rare, False), (9001, rare[40:200], True)]
    assert sum(len(t.encode()) for _, t, _ in rows) > 10 << 20
    counts = [defaultdict(Counter) for _ in range(ppm.ORDER + 1)]
    for t, n in weights.items():
        d = bytes(ppm.ORDER) + t.encode().lower() + b"\0"
        for i in range(ppm.ORDER, len(d)):
            for k in range(ppm.ORDER + 1):
                counts[k][d[i - k : i]][d[i]] += n
    found = ppm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")).filter("doc_id >= 9000 or doc_id = 0").collect()
    assert len(found) == 3
    for r in found:
        d, score = bytes(ppm.ORDER) + {i: t for i, t, _ in rows}[r.doc_id].encode().lower() + b"\0", 0.0
        for i in range(ppm.ORDER, len(d)):
            out: set[int] = set()
            for k in range(ppm.ORDER, -1, -1):
                left = {s: n for s, n in counts[k].get(d[i - k : i], {}).items() if s not in out}
                whole = sum(left.values()) + len(left)
                if d[i] in left:
                    score += math.log10(left[d[i]] / whole)
                    break
                if left:
                    score += math.log10(len(left) / whole)
                    out |= set(left)
            else:
                score -= math.log10(256 - len(out))
        assert math.isclose(r.score, score, rel_tol=1e-4, abs_tol=1e-3)


def edited(t: str, n: int) -> str:
    for _ in range(n):
        k = RNG.randrange(len(t))
        t = RNG.choice([t[:k] + t[k + 1 :], t[:k] + "q" + t[k:], t[:k] + "z" + t[k + 1 :]])
    return t


def test_decontamination(spark):
    item = lambda: " ".join("".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 9))) for _ in range(35))
    items = [item() for _ in range(12)]
    hosts = [" ".join(item() for _ in range(4)) for _ in range(60)]
    rows = [(i, hosts[i]) for i in range(30)]
    rows += [(100 + i, hosts[30 + i][:300] + " " + edited(items[i % 12], i % 8).upper() + "\n" + hosts[30 + i][300:]) for i in range(30)]
    rows += [(None, items[0]), (500, None), (501, "")]
    bench = spark.createDataFrame([*enumerate(items), (50, None), (51, "tiny")], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.distance for r in decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert set(found) == {(100 + i, i % 12) for i in range(30)} | {(None, 0)}
    assert all(found[100 + i, i % 12] <= i % 8 for i in range(30))
    left = decontaminate.clean(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    assert sorted(r.doc_id for r in left.collect()) == [*range(30), 500, 501]


@pytest.mark.parametrize("length", [100, 250, 500, 1000, 3000, 5000])
@pytest.mark.parametrize("even", [True, False])
def test_decontamination_finds_all_copies_at_the_edit_limit(length, even):
    own = random.Random(length)
    text = lambda n: " ".join("".join(own.choice("abcdefghijklmnop") for _ in range(own.randint(2, 9))) for _ in range(n // 3))[:n]
    items = [text(length - 1) + "x" for _ in range(25)]
    hosts = []
    for t in items:
        b, n = list(t), length // 10
        for k in range(5, length, 10) if even else own.sample(range(length), n):
            b[k] = "Z"
        hosts.append(text(200) + " " + "".join(b) + " " + text(200))
    found = decontaminate.Index([(i, t.encode()) for i, t in enumerate(items)]).leaks([h.encode() for h in hosts])
    assert [(d, i) for d, i, _ in found] == [(i, i) for i in range(25)] and all(x <= length // 10 for _, _, x in found)


def test_edit_distance_to_substrings():
    def slow(a, t):
        row = [0] * (len(t) + 1)
        for x in a:
            new = [row[0] + 1]
            for j, y in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return min(row)

    for _ in range(300):
        a, t = (bytes(RNG.choice(b"abc") for _ in range(RNG.randint(lo, 10))) for lo in (1, 0))
        assert decontaminate.edit_distance(a, t) == slow(a, t)


def test_pipeline_stages_on_a_fixture(spark, tmp_path):
    import corpus_pipeline

    base = "/root/testdata/sf0.001"
    found = corpus_pipeline.run(spark, base)
    source = {r.doc_id: r for r in spark.read.parquet(f"{base}/documents.parquet").collect()}
    assert found.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    assert 0.5 * len(source) < found.count() <= len(source)
    tokens = bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY))
    for r in found.limit(20).collect():
        kept = b"".join(tokens[i] for i in r.ids)
        assert hashlib.sha256(kept).hexdigest() == r.decoded_sha256 and len(kept) <= len(source[r.doc_id].text.encode())
    bench = [decontaminate.plain(r.text.encode()) for r in spark.read.parquet(f"{base}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in found.collect()}
    assert not any(i in kept for i, r in source.items() if any(b in decontaminate.plain(r.text.encode()) for b in bench))


def test_pipeline_drops_near_copies_from_similarity_of_four_fifths(spark):
    import corpus_pipeline

    own = random.Random(4)
    words = lambda n: [f"w{own.randrange(10**6)}" for _ in range(n)]
    rows, want = [], set()
    for i in range(30):
        w = words(300)
        rows.append((10 * i, " ".join(w)))
        # New words at the end: 296 of 296 + n shingles are shared, so that n = 75 is just under 0.8.
        want |= {10 * i, 10 * i + 4}
        for k, n in ((1, 15), (2, 40), (3, 74), (4, 75)):
            rows.append((10 * i + k, " ".join(w + words(n))))
    rows += [(900, rows[0][1]), (900, "one text that no other row has"), (901, "two words")]
    found = {r.doc_id: r.text for r in corpus_pipeline.one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "").collect()}
    assert set(found) == want | {900, 901} and found[900].startswith("one text")


@pytest.mark.parametrize("batch", [1, 400, 5000])
def test_large_anchors_split_without_loss(monkeypatch, batch):
    """Windows found do not depend on the size of a batch."""
    body = "".join(RNG.choice("abcdefgh ") for _ in range(400))
    own = [("".join(RNG.choice("xyzuvw ") for _ in range(RNG.randrange(120))) + body[RNG.randrange(80) :] + "".join(RNG.choice("ijkl ") for _ in range(RNG.randrange(120)))).encode() for _ in range(25)]
    own += ["lo ".encode() * 90, "xx lo ".encode() + "lo ".encode() * 80]
    h, doc, first, last, at = suffix_dedup.ranges(own, 100)
    found: dict[bytes, tuple] = {}
    places = []
    for k in range(len(h)):
        t = own[doc[k]][first[k] : last[k] + 100]
        if t not in found:
            found[t] = (len(found), int(h[k]), int(at[k]))
            places.append((int(doc[k]), int(first[k])))
    place = np.array([sorted(places).index(p) for p in places])
    monkeypatch.setattr(suffix_dedup, "BATCH", batch)
    runs = suffix_dedup.shared_windows(list(found), [x[1] for x in found.values()], [x[2] for x in found.values()], place, 100)
    lost = {(n, w) for n, a, z in runs for w in range(a, z)}
    least: dict[bytes, int] = {}
    windows = [(n, w, t[w : w + 100]) for t, (n, _, _) in found.items() for w in range(len(t) - 99)]
    for n, _, x in windows:
        least[x] = min(place[n], least.get(x, 1 << 30))
    assert lost == {(n, w) for n, w, x in windows if place[n] > least[x]} and lost


def test_decontamination_of_short_items_and_long_texts(spark, monkeypatch):
    """Items of any length at a tenth of edits, against the least distance to any substring; texts longer than a chunk."""
    own = random.Random(12)
    item = lambda n: "".join(own.choice("abcdefghij") for _ in range(n))
    items = [(n, item(n)) for n in (4, 7, 9, 10, 11, 15, 16, 20, 23, 29, 30, 31, 39, 40, 55, 70)]
    hosts = []
    for _ in range(6):
        for n, t in items:
            b = list(t)
            for k in own.sample(range(n), n // 10):
                b[k] = own.choice(["Z", "", b[k] + "Z"])
            hosts.append("zz " * own.randrange(40) + "".join(b) + " yy" * own.randrange(40))
    want = {(d, n) for d, h in enumerate(hosts) for n, t in items if decontaminate.edit_distance(t.encode(), h.lower().encode()) <= n // 10}
    assert len(want) >= len(hosts)
    index = decontaminate.Index([(n, t.encode()) for n, t in items])
    assert {(d, i) for d, i, _ in index.leaks([h.encode() for h in hosts])} == want
    monkeypatch.setattr(decontaminate, "CHUNK", 300)
    whole = " ".join(hosts).encode()
    assert {i for _, i, _ in index.leaks([b"", whole])} == {n for n, _ in items}
    none = decontaminate.contamination(empty(spark), spark.createDataFrame([(1, "some item")], "item_id long, text string"))
    assert none.count() == 0
    docs = spark.createDataFrame([(1, "some item", 7), (1, "some item", 7), (None, "Some  item here", 8)], "doc_id long, text string, item_id int")
    assert decontaminate.contamination(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    bench = spark.createDataFrame([(1, "some item", 0), (1, "some item", 1), (1, "other", 2), (2, " ", 3), (None, "here", 4)], "item_id long, text string, doc_id int")
    found = [tuple(r) for r in decontaminate.contamination(docs, bench).collect()]
    assert sorted(found, key=str) == [(1, 1, 0), (1, 1, 0), (None, 1, 0)]
    assert decontaminate.clean(docs, bench).count() == 0


def test_top_k_keeps_repeated_ids_and_empty_vectors(spark):
    rng = np.random.default_rng(8)
    ids = [int(x) for x in rng.integers(0, 30, 90)]
    vectors = [[float(y) for y in rng.normal(size=rng.choice([0, 3, 5]))] for _ in ids]
    vectors[1], ids[1] = vectors[0], ids[0]
    rows = [(i, v, k, "x") for k, (i, v) in enumerate(zip(ids, vectors, strict=True))]
    v = topk.integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>, row long, part string").repartition(3))
    found = defaultdict(list)
    for r in topk.top_k(v, v.filter("vec_id % 4 = 0")).collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    whole = [[math.floor(1024 * y) for y in x] for x in vectors]
    want = defaultdict(list)
    for q in range(len(ids)):
        if ids[q] % 4 == 0:
            scores = sorted((-sum(a * b for a, b in zip(whole[q], whole[c], strict=False)), ids[c]) for c in range(len(ids)) if c != q)
            want[ids[q]] += [(n + 1, i, -s) for n, (s, i) in enumerate(scores[:10])]
    assert {q: sorted(x) for q, x in found.items()} == {q: sorted(x) for q, x in want.items()}
    lone = topk.integers(spark.createDataFrame([(1, []), (2, [])], "vec_id long, embedding array<double>"))
    assert sorted(tuple(r) for r in topk.top_k(lone, lone).collect()) == [(1, 1, 2, 0), (2, 1, 1, 0)]


def plain_suffix_dedup(rows, width):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            w = b[k : k + width]
            if w in seen:
                gone[k : k + width] = b"\1" * width
            seen.add(w)
        out[i] = bytes(x for x, g in zip(b, gone, strict=True) if not g)
    return out


@pytest.mark.parametrize("hot", [2, 256])
def test_suffix_dedup_of_a_passage_in_most_documents(spark, monkeypatch, hot):
    """Anchors of very many places are cut into parts and spread over the shards; texts are in blocks of their own."""
    from cairn.llm import blocks

    own = random.Random(31)
    text = lambda n: "".join(own.choice("abcdefghijkl ") for _ in range(n))
    passage = text(420)
    rows = []
    for i in range(300):
        a = own.randrange(200)
        rows.append((i, text(own.randrange(260)) + passage[a : a + own.randrange(400)] + text(own.randrange(260))))
    rows += [(400, rows[7][1]), (401, "ab" * 400), (402, passage * 2), (403, "é" * 300)]
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 1 << 14)
    real = blocks.in_blocks
    monkeypatch.setattr(suffix_dedup, "in_blocks", lambda docs, total, **more: real(docs, total, 1 << 13, **more))
    found = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()
    assert {r.doc_id: bytes(r.kept) for r in found} == plain_suffix_dedup(rows, 100)


def test_rows_without_id_and_of_one_id_are_spread_over_blocks(spark):
    from cairn.llm import blocks

    table = spark.range(900).selectExpr("case when id % 2 = 0 then null else 5 end as doc_id", "repeat(cast(id as string), 10) as text")
    sizes = [r["count"] for r in blocks.in_blocks(table, 30 << 10, 1 << 10).groupBy("block").count().collect()]
    assert len(sizes) == 30 and max(sizes) < 70


def test_near_copies_equal_all_pairs_by_brute_force(spark, monkeypatch):
    """Chains and bundles of copies at many similarities; buckets dealt over several tasks."""
    from cairn.llm import near_copies

    own = random.Random(77)
    words = lambda n: [f"w{own.randrange(10**6)}" for _ in range(n)]
    rows = []
    for _ in range(12):
        w = words(own.choice([4, 5, 40, 200]))
        for _ in range(14):
            rows.append(" ".join(w))
            for _ in range(own.choice([0, 1, 2])):
                k = own.randrange(len(w))
                w = w[:k] + words(own.choice([0, 1, 3])) + w[k + own.choice([0, 1]) :]
    rows += ["", " \n", None, rows[3].upper()]
    monkeypatch.setattr(near_copies, "FAN", 3)
    table = spark.createDataFrame([(i if i % 5 else None, t, i, "x") for i, t in enumerate(rows)], "doc_id long, text string, key long, node string")
    found = near_copies.near_copies(table.repartition(5)).collect()
    assert len(found) == len(rows) and near_copies.near_copies(empty(spark)).count() == 0
    sets = [frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := (t or "").lower().split()) else frozenset() for t in rows]
    top = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j in range(i):
                if a == sets[j] or len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                    top[i] = top[j] = min(top[i], top[j])
    hashed = {h: t for t, h in zip(rows, (r.h for r in table.orderBy("key").selectExpr("xxhash64(text) as h").collect()), strict=True)}
    groups = defaultdict(set)
    for r in found:
        groups[r.component].add(hashed[r.row])
    want = defaultdict(set)
    for t, k in zip(rows, top, strict=True):
        want[k].add(t)
    assert sorted(map(sorted, ([str(x) for x in g] for g in groups.values()))) == sorted(map(sorted, ([str(x) for x in g] for g in want.values())))


def test_pipeline_stages_keep_rows_of_one_id_apart(spark):
    import corpus_pipeline

    long = "".join(RNG.choice("abcdefgh ") for _ in range(300))
    rows = [(5, "x", "one " + long, 0, 9), (5, "y", "two", 0, 9), (None, "z", "three " + long, 0, 9), (6, None, None, 0, 9)]
    table = spark.createDataFrame(rows, "doc_id int, `rest` string, text string, n_chars int, `block` int")
    left = corpus_pipeline.without_repeats(spark, table, "")
    assert left.schema == table.schema
    found = {(r.doc_id, r["rest"]): (r.text, r.n_chars, r.block) for r in left.collect()}
    assert set(found) == {(5, "x"), (5, "y"), (None, "z"), (6, None)}
    assert found[5, "x"] == ("one " + long, 304, 9) and found[None, "z"][0] in ("three", "thre", "three ") and found[6, None] == ("", 0, 9)


def test_a_label_of_one_id_is_not_lost(spark):
    rows = [(1, f"the text {i}", "en") for i in range(2000)] + [(2, f"il testo {i}", "it") for i in range(2000)] + [(i, f"le texte {i}", "fr") for i in range(3, 400)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, label string")
    found = Counter(r["label"] for r in langid.sample(labelled))
    assert set(found) == {"en", "it", "fr"} and min(found.values()) > 200 and max(found.values()) <= langid.SAMPLE


def test_pipeline_keeps_columns_of_any_name(spark, tmp_path):
    """Names that the stages use for columns of their own."""
    import corpus_pipeline

    names = ["row", "letters", "kept", "spans", "n_bytes", "n_removed", "rest", "block", "node", "component", "place", "key", "s"]
    rows = [(i, f"{i} " + " ".join(RNG.choice(WORDS) for _ in range(40)), *(f"{n}{i}" for n in names)) for i in range(30)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"{n} string" for n in names)]))
    spark.createDataFrame([(1, "an item that no document holds at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {r[0]: r[2:] for r in rows}
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", *names]
        found = {r[0]: tuple(r)[2:] for r in docs.collect()}
        assert found and all(want[i] == v for i, v in found.items())
    labelled = docs.withColumn("lang", F.lit("en"))
    assert langid.accepted(docs, langid.fit(labelled)).columns == docs.columns


def test_fine_sketches_keep_pairs_at_the_limit_and_refuse_lesser_ones():
    from cairn.llm import near_copies

    own = np.random.default_rng(31)

    def far(a, b):
        words = len(a) // near_copies.FINE
        bits = (a ^ b).view(np.uint64)
        return int(np.bitwise_count(bits[:words] | bits[words:]).sum())

    for size in (9, 45, 400, 3000):
        most = near_copies.allowed(size, 0.8)
        for similar in (0.8, 0.6):
            both = round(2 * size * similar / (1 + similar))
            over = 0
            for _ in range(200):
                members = own.permutation(own.integers(0, 1 << 63, 2 * size - both, dtype=np.uint64))
                a, b = np.sort(members[:size]), np.sort(np.concatenate((members[:both], members[size:])))
                over += far(near_copies.fine_sketch(a), near_copies.fine_sketch(b)) > most
            assert over <= 1 if similar == 0.8 else over >= (198 if size > 9 else 0)
    assert not near_copies.fine_sketch(np.empty(0, np.uint64)).any()


def test_fingerprints_lead_to_near_copies(spark):
    """Pairs that op6 links are found among the nodes; what is far apart is not verified by them."""
    from cairn.llm.near_copies import fingerprinted, signed

    base = [" ".join(f"w{(n * n * 7 + k * 13) % 997}" for n in range(k, k + 120)) for k in range(6)]
    rows = [(k, t) for k, t in enumerate(base)] + [(10, base[0] + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    named = {r.node: r.doc_id for r in signed(docs, 5, 0.8).select("node", "doc_id").collect()}
    pairs = fingerprinted(docs, signed(docs, 5, 0.8).select("node", "place"), 5)
    assert {frozenset((named[r.u], named[r.v])) for r in pairs.collect()} == {frozenset((0, 10))}


def test_a_search_for_benchmark_items_takes_little_memory():
    """Texts of 4 MB are searched in parts, so that the arrays of a worker stay small beside its executor."""
    rng = np.random.default_rng(3)
    words = [bytes(rng.integers(97, 123, 6, np.uint8)) for _ in range(2000)]
    texts = [b" ".join(words[k] for k in rng.integers(0, 2000, 300)) for _ in range(2000)]
    held = decontaminate.Index([(i, texts[i][:200]) for i in range(20)])
    tracemalloc.start()
    try:
        found = held.leaks(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert {(d, i) for d, i, x in found if x == 0} >= {(i, i) for i in range(20)}
    assert peak < 24 << 20


@pytest.mark.parametrize("tile", [1 << 12, 4 << 20])
def test_pairs_just_under_the_limit_are_no_rows(spark, monkeypatch, tile):
    """Ten bundles of copies alike at 0.88, those of different bundles at 0.78: what is sent to be verified grows with the texts, not with their pairs."""
    from cairn.llm import near_copies

    own, asked, plain = random.Random(8), [], near_copies.alike
    words = lambda n: [f"w{own.randrange(10**6)}" for _ in range(n)]
    base = words(150)
    rows = [(i, " ".join(base[: (at := 5 + 14 * (i % 10))] + words(5) + base[at + 5 :])) for i in range(240)]
    monkeypatch.setattr(near_copies, "TILE_BYTES", tile, raising=False)
    monkeypatch.setattr(near_copies, "alike", lambda pairs, *rest: asked.append(pairs.count()) or plain(pairs, *rest))
    found = defaultdict(set)
    for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found[r.component].add(r.doc_id)
    assert sorted(map(sorted, found.values())) == [list(range(k, 240, 10)) for k in range(10)]
    assert sum(asked) <= 4 * len(rows)
