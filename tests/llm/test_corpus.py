"""The corpus operators against brute force, and their defined results for odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from test_near_copies import kept_plain

from listingwatch.llm import bpe, common, embedding_dedup, langid, mixing, quality, queries, simhash, suffix_dedup, token_counts, toxicity, url_filter

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, doc long, row long, size long"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def odd_texts():
    rng = random.Random(5)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "Ünder", "x" * 40, "42", "it's", "\n\n", "  ", "日本語"]) for _ in range(9000))
    return [None, "", " ", "\n", "a", "▁", " ▁ a", "a  b\n\n\tc", "don't <s> </s> <|endoftext|>", "é" * 3000, "日本" * 2000, "x" * 5000, " " * 4000, long, long, "\x00\x1c\x85\u00a0z", "😀 ok"]


def odd_docs(spark):
    rows = [(i, t, None if i % 3 else "en", None if i % 2 else "s", None, 1.0, 7, 8, 9) for i, t in enumerate(odd_texts())]
    rows += [rows[7], (None, "no id", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOC)


def collect(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# 1 -- byte-level BPE


def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def bpe_expected(text, lib):
    ids = lib.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("chunk, overlap", [(bpe.CHUNK, bpe.OVERLAP), (700, 60)])
def test_bpe_equals_library(spark, chunk, overlap):
    lib = library()
    docs = odd_docs(spark)
    out = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap).collect()
    expected = Counter((r.doc_id, *bpe_expected(r.text, lib)) for r in docs.collect())
    assert Counter(tuple(r) for r in out) == expected


def test_bpe_documents_and_decode(spark):
    lib, docs = library(), documents(spark)
    out = collect(bpe.encode(docs, RANKS, public_tokenizers.PATTERN, keep_ids=True, chunk=2000, overlap=100))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {k: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for k, r in out.items()} == {k: bpe_expected(t, lib) for k, t in texts.items()}
    ids = spark.createDataFrame([(k, r.ids) for k, r in out.items()], "doc_id long, ids binary")
    assert {r.doc_id: bytes(r.bytes).decode() for r in bpe.decode(ids, RANKS).collect()} == texts


def test_bpe_letter_runs_and_empty(spark):
    lib = library()
    docs = spark.createDataFrame([(1, "x" * 3000), (1, "x" * 3000), (2, "a b " + "é" * 2600 + " c"), (None, "z" * 800)], "doc_id long, text string")
    out = bpe.encode(docs.withColumn("ids", F.lit("own")), RANKS, public_tokenizers.PATTERN, chunk=500, overlap=40, carry=("ids",))
    assert Counter((r.doc_id, *r[1:4]) for r in out.collect()) == Counter((r.doc_id, *bpe_expected(r.text, lib)) for r in docs.collect())
    assert {r.ids for r in out.collect()} == {"own"}
    assert bpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


# 2 -- SimHash


def simhash_plain(text, shingle=4):
    words = [w for w in WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))]
    if not words:
        return 0
    parts = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, linked):
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def test_simhash_documents(spark):
    rows = documents(spark).select("doc_id", "text").collect()
    fp = {r.doc_id: simhash_plain(r.text) for r in rows}
    ids = sorted(fp)
    low = plain_components(ids, [(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 4])
    out = simhash.near_duplicates(documents(spark)).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in out} == {i: (f"{fp[i]:016x}", low[i]) for i in ids}


@pytest.mark.parametrize("block", [simhash.BLOCK, 40])
def test_simhash_links_of_random_fingerprints(spark, block):
    rng = random.Random(3)
    fps = {0, 2**64 - 1}
    for centre in [rng.getrandbits(64) for _ in range(30)]:
        for _ in range(12):
            fps.add(centre)
            for _ in range(rng.randint(1, 5)):
                centre ^= 1 << rng.randrange(64)
            fps.add(centre)
    crowd = rng.getrandbits(64)
    fps |= {crowd ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.link_fingerprints(spark.createDataFrame([(x,) for x in signed], "fp long"), block=block)
    found = plain_components(signed, [(r.u, r.v) for r in links.collect()])
    near = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    assert found == plain_components(signed, near)
    spread = {r.node: r.root for r in common.components(links).collect()}
    assert {x: spread.get(x, x) for x in signed} == found


@pytest.mark.parametrize("gram", [1, 2, 3, 4])
def test_simhash_choices_miss_no_minimum(gram):
    for within in range(gram, 9):
        chosen = [set(c) for c in simhash.choices(gram, within)]
        assert all(any(c <= set(shared) for c in chosen) for shared in combinations(range(8), within))
    a, b = np.array([0x0102030405060708, -1]), np.array([0x0102FF0405060709, 255])
    assert simhash.shared_bytes(a, b).tolist() == [6, 1]


def test_simhash_odd(spark):
    docs = odd_docs(spark)
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == docs.count()
    assert {r.fingerprint for r in out if r.doc_id in (0, 1, 2, 3)} == {"0" * 16}
    assert {r.component_id for r in out if r.doc_id in (0, 1, 2, 3)} == {0}
    assert {r.component_id for r in out if r.doc_id in (13, 14)} == {13}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


# 3 -- embeddings


def cosine_links(rows):
    ok = []
    for i, (_, e, label) in enumerate(rows):
        if label is not None and e and None not in e and np.isfinite(e).all() and np.any(e):
            ok.append(i)
    return [(a, b) for a in ok for b in ok if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]) and np.dot(rows[a][1], rows[b][1]) / np.sqrt(np.dot(rows[a][1], rows[a][1])) / np.sqrt(np.dot(rows[b][1], rows[b][1])) >= 0.98]


@pytest.mark.parametrize("block", [embedding_dedup.BLOCK, 16])
def test_embeddings(spark, block):
    rng = np.random.default_rng(1)
    rows = []
    for c in range(12):
        centre = rng.standard_normal(24)
        for k in range(20):
            rows.append((len(rows), (centre + rng.standard_normal(24) * (0.02 + 0.01 * k)).astype(np.float32).tolist(), c % 3))
    rows += [(len(rows) + i, rows[0][1], 0) for i in range(30)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 24, [nan] + [1.0] * 23, [inf] + [1.0] * 23, [None] + [1.0] * 23, [1.0, 2.0]]
    rows += [(len(rows) + i, e, 0) for i, e in enumerate(odd)] + [(900, rows[0][1], None), (901, None, None), (902, [1.0, 2.0], 0)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "vec_id long, embedding array<float>, label int, weight string")
    links = cosine_links([(i, None if e is None else [None if x is None else float(np.float32(x)) for x in e], label) for i, e, label in rows])
    ids = [r[0] for r in rows]
    low = plain_components(ids, [(ids[a], ids[b]) for a, b in links])
    n = Counter(ids[x] for pair in links for x in pair)
    out = embedding_dedup.near_duplicates(df, block=block).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out} == {i: (n[i], low[i], low[i] == i) for i in ids}
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_null_and_repeated_ids(spark):
    near = [[1.0, 0.0, 0.01 * i] for i in range(5)]
    rows = [(None, near[0], 1), (None, near[1], 1), (7, near[2], 1), (7, near[2], 1), (9, near[3], 1), (None, [0.0, 1.0, 0.0], 1), (None, [0.0, 1.0, 0.01], 1), (3, [0.0, 0.0, 1.0], 1)]
    out = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")).collect()
    assert Counter(map(tuple, out)) == Counter([(None, 4, 7, False)] * 2 + [(7, 4, 7, True)] * 2 + [(9, 4, 7, False)] + [(None, 1, None, False)] * 2 + [(3, 0, 3, True)])


def test_embeddings_labels_of_any_type(spark):
    near = [[1.0, 0.0, 0.01 * i] for i in range(6)]
    labels = ["a", "a", "b", "b", None, "1"]
    out = collect(embedding_dedup.near_duplicates(spark.createDataFrame([(i, e, label) for i, (e, label) in enumerate(zip(near, labels, strict=True))], "vec_id long, embedding array<double>, label string")), "vec_id")
    assert {i: (r.n_links, r.component_id) for i, r in out.items()} == {0: (1, 0), 1: (1, 0), 2: (1, 2), 3: (1, 2), 4: (0, 4), 5: (0, 5)}


# 4 -- token counts


def test_token_counts_equal_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    machine = token_counts.Transducer(MODEL)
    texts = [t or "" for t in odd_texts()] + [r.text for r in documents(spark).collect()]
    rng = random.Random(4)
    letters = ["a", "e", "t", "h", "in", "ing", " ", "  ", "\u2581", "\n", "é", "日", "本", "の", "😀", "x" * 30, " " * 9, "0", "1234", "_", "--", "==", "...", "ß", "\u00a0", "<s>", "и"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for text in texts:
        n = len(lib.encode(text, num_threads=1))
        assert machine.count(text) == n
        for chunk in (7, 301):
            marked = token_counts.marked(text)
            maps = [machine.state_map(marked[i : i + chunk]) for i in range(0, len(marked), chunk)] if text else []
            while len(maps) > 1:  # any order of composing gives the same
                maps = [machine.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
            assert not text or machine.total(maps[0]) == n
    docs = odd_docs(spark)
    expected = Counter((r.doc_id, len((r.text or "").encode()), k := len(lib.encode(r.text or "", num_threads=1)), k > 4096) for r in docs.collect())
    for chunk, fan in ((token_counts.CHUNK, token_counts.FAN), (900, 3)):
        out = token_counts.count_tokens(docs, MODEL, chunk=chunk, fan=fan).collect()
        assert Counter(map(tuple, out)) == expected
    assert token_counts.count_tokens(docs.limit(0), MODEL).count() == 0


def test_transducer_forgets_and_goes_in_circles(monkeypatch):
    machine = token_counts.Transducer(MODEL)
    n = machine.count("x" * 50_000)
    assert len(machine.states) < 200
    monkeypatch.setattr(token_counts, "REMEMBERED", 20)
    words = [f"word{i} other{i * 7}" for i in range(200)]
    assert [machine.count(w) for w in words] == [token_counts.Transducer(MODEL).count(w) for w in words]
    assert machine.count("x" * 50_000) == n


# 5 -- mixing


def test_mixing(spark):
    docs = documents(spark)
    out = mixing.mix(docs).collect()
    size, taken, target = Counter(), Counter(), {}
    source = {r.doc_id: r.source for r in docs.collect()}
    for r in out:
        assert r.taken <= 3 * r["size"]
        s = source[r.doc_id]
        size[s] += r["size"]
        taken[s] += r.taken
        target[s] = r.target
    total = sum(size.values())
    assert sum(target.values()) == pytest.approx(total)
    for s in size:
        assert target[s] <= 3 * size[s] + 1e-6
        assert abs(taken[s] - target[s]) <= max(r["size"] for r in out if source[r.doc_id] == s)
    assert Counter(map(tuple, mixing.mix(docs).collect())) == Counter(map(tuple, out))


def test_mixing_targets_of_many_tokens(spark):
    """A weight times all tokens is more than an int holds, and so is a capped source's size times the weights."""
    of = lambda *sizes: [r.target for r in mixing.source_targets(spark.createDataFrame(list(zip("abc", sizes, strict=True)), "source string, source_size long")).orderBy("source").collect()]
    assert of(500_000_000, 500_000_000, 500_000_000) == [937_500_000, 375_000_000, 187_500_000]
    assert of(200_000_000, 800_000_000, 900_000_000) == [600_000_000, 1_300_000_000 * 2 / 3, 1_300_000_000 / 3]


def test_mixing_positions_follow_schedules(spark):
    rows = [(i, " ".join(["w"] * 10), s) for i, s in enumerate(["a", "b", "c"] * 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(docs, weights=(1, 1, 1), columns=["source"])
    order = [r.source for r in mixing.training_order(mixed).collect()]
    assert len(order) == 1200
    early = Counter(order[:400])
    assert early["b"] < early["a"] < early["c"]
    first = spark.range(1).select(mixing.position(F.lit(0.375), F.lit(1), ((1.0, 1.0), (0.5, 1.5))).alias("p")).first().p
    assert first == pytest.approx(0.5)


def test_mixing_equals_brute_force(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, *range(200)]), " ".join(["w"] * rng.randint(0, 30)) if rng.random() < 0.9 else None, rng.choice("abcde") if rng.random() < 0.9 else None) for _ in range(500)]
    rows += rows[:40]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7), columns=["source"]).collect()
    size = Counter()
    for _, text, source in rows:
        size[source] += len((text or "").split())
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size, key=lambda s: (s is None, s)))}
    target, free = {}, set(size)
    while True:
        rest, shared = sum(size.values()) - sum(target.values()), sum(weight[s] for s in free)
        over = {s for s in free if 3 * size[s] <= weight[s] * rest / shared}
        if not over:
            break
        target |= {s: 3.0 * size[s] for s in over}
        free -= over
    target |= {s: weight[s] * rest / shared for s in free}
    # the order within a source, and from it each row's stretch, its copies and the time at which the integral meets it
    keyed = sorted((hashlib.md5(f"{'' if d is None else d}:{t or ''}".encode()).hexdigest(), d or 0, len((t or "").split()), s or "", d, s) for d, t, s in rows)
    run, expected = Counter(), []
    for _, _, n, _, doc_id, source in keyed:
        middle = run[source] + n / 2
        run[source] += n
        full = target[source] // size[source] if size[source] else 0
        repeats = int(full + (middle < target[source] - full * size[source]))
        share = min(1.0, middle / target[source]) if target[source] else 0.0
        start, end = mixing.SCHEDULES[sorted(size, key=lambda s: (s is None, s)).index(source) % 3]
        low, high = 0.0, 1.0
        for _ in range(60):  # bisection: the weight's integral up to x is start x + (end - start) x^2 / 2
            x = (low + high) / 2
            low, high = (x, high) if start * x + (end - start) * x * x / 2 < share else (low, x)
        expected.append((doc_id, source, n, n * repeats, round(high, 6) if repeats else None))
    found = [(r.doc_id, r.source, r["size"], r.taken, None if r.position is None else round(r.position, 6)) for r in out]
    assert Counter(found) == Counter(expected)
    assert {r.source: r.target for r in out} == pytest.approx(target)


def test_mixing_query_is_range_sorted(spark):
    rows = [r.position for r in queries.op5_mixing(spark, SF).collect()]
    taken = [p for p in rows if p is not None]
    assert taken == sorted(taken) and rows[: len(taken)] == taken


def test_mixing_odd(spark):
    docs = odd_docs(spark)
    out = mixing.mix(docs, columns=["text", "size"]).collect()
    assert len(out) == docs.count()
    assert mixing.mix(docs.limit(0)).count() == 0
    assert {r.taken for r in mixing.mix(docs.where("text is null")).collect()} == {0}


# 6 -- URLs


def test_url_rules(spark):
    urls = [None, "", "no host", "http://A.Example.ORG/es/x", "http://example.org/en/17?q#f", "https://b.com/fr/", "https://b.com/de", "x://com/de/1", "http://notorg/es/", "http://h.net", "://org/", "http://a.org://x.com/de/", "http://é.ORG/Ä", "http://x.org?u=/es/"]
    df = spark.createDataFrame([(i, u, "e") for i, u in enumerate(urls)], "page_id long, url string, host string")
    out = collect(url_filter.judge(df), "page_id")
    assert [(out[i].host, out[i].path, out[i].rule) for i in range(len(urls))] == [
        ("", "", None), ("", "", None), ("", "", None), ("a.example.org", "/es/x", "example.org/es/"), ("example.org", "/en/17", "example.org/en/1"),
        ("b.com", "/fr/", "com/fr/"), ("b.com", "/de", None), ("com", "/de/1", "com/de/"), ("notorg", "/es/", None), ("h.net", "", None), ("org", "/", "org/"),
        ("a.org:", "//x.com/de/", None), ("é.org", "/Ä", "org/"), ("x.org", "", None),
    ]
    assert {r.verdict for r in out.values() if r.rule and "es" in r.rule} == {"block"}
    assert url_filter.judge(df.limit(0)).count() == 0
    alone = url_filter.judge(df.where("page_id in (0, 9)"))
    assert {r.verdict for r in alone.collect()} == {"allow"}


def test_url_templates_learn_from_labels(spark):
    rows = [f"http://s{i % 7}.com/de/{i}" for i in range(60)] + [f"http://s{i % 7}.com/fr/{i}" for i in range(60)]
    rows += ["http://s.net/de/9", "http://s.net/fr/9", "http://s1.com/x/de"]
    out = collect(url_filter.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")), "page_id")
    assert (out[120].verdict, out[121].verdict) == ("block", "allow")


def url_tree_plain(pages):
    """Verdicts by growing each tree node by node, as deep as it goes."""
    split = lambda path: tuple("*" if re.search(url_filter.VARIABLE, x) else x for x in path.split("/") if x)

    def differ(n1, b1, n2, b2):
        mean = (b1 + b2 + 1) / (n1 + n2 + 2)
        return abs((b1 + 1) / (n1 + 2) - (b2 + 1) / (n2 + 2)) > url_filter.APART * (mean * (1 - mean) * (1 / (n1 + 1) + 1 / (n2 + 1))) ** 0.5

    def leaves(paths, depth):
        """paths: segments -> (n, b); lists of paths that share a template."""
        if len(paths) < 2 or not sum(n for n, _ in paths.values()):
            return [list(paths)]
        branches = {}
        for p, (n, b) in paths.items():
            old = branches.get(p[depth : depth + 1], (0, 0))
            branches[p[depth : depth + 1]] = (old[0] + n, old[1] + b)
        n_all, b_all = (sum(x) for x in zip(*branches.values(), strict=True))
        strong = sorted(((b + 1) / (n + 2), n, b, s) for s, (n, b) in branches.items() if s and n and differ(n, b, n_all - n, b_all - b))
        groups = {s: "weak" if s else "end" for s in branches}
        for i, (_, n, b, s) in enumerate(strong):
            groups[s] = groups[strong[i - 1][3]] if i and not differ(n, b, *strong[i - 1][1:3]) else s
        out = []
        for g in set(groups.values()):
            inside = {p: x for p, x in paths.items() if groups[p[depth : depth + 1]] == g}
            out += [list(inside)] if g == "end" else leaves(inside, depth + 1)
        return out

    hosts = {}
    for host, path, said in pages:
        at = hosts.setdefault(host, {}).setdefault(split(path), [0, 0])
        at[0] += said is not None
        at[1] += said == "block"
    wide = {}
    for paths in hosts.values():
        for p, (n, b) in paths.items():
            old = wide.get(p, (0, 0))
            wide[p] = (old[0] + n, old[1] + b)
    total = [sum(x) for x in zip(*wide.values(), strict=True)]
    prior = (total[1] + 1) / (total[0] + 2)

    def shares(paths, towards):
        out = {}
        for leaf in leaves(dict(paths), 0):
            n, b = (sum(paths[p][i] for p in leaf) for i in (0, 1))
            out |= {p: (b + 4.0 * towards(p)) / (n + 4.0) for p in leaf}
        return out

    all_shares = shares(wide, lambda p: prior)
    own = {host: shares(paths, all_shares.get) for host, paths in hosts.items()}
    return [own[host][split(path)] for host, path, _ in pages]


def test_url_tree_equals_brute_force(spark):
    rng = random.Random(9)
    names = ["de", "fr", "es", "news", "shop", "x7", "a", "b", "2041"]
    weights = [9, 9, 1, 3, 2, 1, 1, 1, 4]
    urls = []
    for _ in range(700):
        depth = rng.choice([0, 1, 2, 3, 6])
        urls.append(f"http://s{rng.randint(0, 5)}.{rng.choice(['com', 'org', 'net'])}/" + "/".join(rng.choices(names, weights, k=depth)))
    urls += urls[:100] + [f"http://s1.com/fr/deep/er/and/er/{'y' if i % 2 else 'z'}/{'de' if i % 3 else 'fr'}" for i in range(40)]
    # labels that follow deep segments
    rules = (("com", "/fr/deep/er/and/er/y", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("org", "/news/de", "block"), ("org", "/news/", "allow"))
    out = collect(url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=rules), "page_id")
    assert len(out) == len(urls)
    pages = [(out[i].host, out[i].path, out[i].verdict if out[i].rule else None) for i in range(len(urls))]
    assert [out[i].p_block for i in range(len(urls))] == pytest.approx(url_tree_plain(pages))
    assert len({out[i].template for i in range(len(urls)) if "/deep/er/and/er/" in urls[i]}) > 1


# 7 -- language


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = collect(langid.identify(docs))
    rows = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(out[r.doc_id].held_out for r in rows)
    assert sum(out[r.doc_id].lang_pred == r.lang for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 for r in out.values())


def test_language_equals_kernel_ridge():
    texts = {"en": ["the cat and the hat", "then that other thing", "with this and that"], "de": ["der hund und die katze", "nicht das andere ding"], "fr": ["le chat et le chien", "pas cette autre chose là"]}
    rows = [(lang, t) for lang, ts in texts.items() for t in ts]
    grams = [set(langid.presence(t).tolist()) for _, t in rows]
    pack = lambda g: np.packbits(np.bincount(sorted(g), minlength=langid.GRAMS) > 0).tobytes()
    languages, matrix = langid.fit([(lang, pack(g)) for (lang, _), g in zip(rows, grams, strict=True)], landmarks=len(rows))
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5 + 1  # presence cosine; 1 for the constant
    k = np.array([[kernel(a, b) for b in grams] for a in grams])
    weight = np.array([1 / len(texts[lang]) for lang, _ in rows])
    y = np.array([[1.0 if lang == own else -1.0 for lang in languages] for own, _ in rows])
    alpha = np.linalg.solve(k + langid.RIDGE / len(languages) * np.diag(1 / weight), y)
    new = ["that was the thing", "das ist nicht der hund", "cette chose et le chat", "xyz"]
    expected = np.array([[kernel(set(langid.presence(t).tolist()), g) for g in grams] for t in new]) @ alpha
    best, score = langid.predict(new, languages, matrix)
    assert best == [languages[i] for i in expected.argmax(1)]
    assert score == pytest.approx(np.clip((expected.max(1) + 1) / 2, 0, 1), abs=2e-3)


def test_language_learns_every_language(spark):
    letters = "abcdefghijklmnopqrst"
    rows = [(3 * i + j, " ".join(f"{x}{y}{x}{z}" for z in letters[:9]), f"l{x}{y}") for i, (x, y) in enumerate((x, y) for x in letters for y in letters[:10]) for j in range(3)]
    rows = [(d, t, lang) for d, t, lang in rows if zlib.crc32(str(d).encode()) % 4 != 2]
    docs = spark.createDataFrame(rows + [(10_000 + i, *rows[0][1:]) for i in range(500)], "doc_id long, text string, lang string")
    out = collect(langid.identify(docs, most_rows=100))
    assert sum(out[d].lang_pred == lang for d, _, lang in rows) / len(rows) > 0.95


def test_language_refuses_what_no_languages_are(spark):
    docs = spark.createDataFrame([(i, f"text {i}", f"l{i}") for i in range(40)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="no languages"):
        langid.identify(docs, most_languages=9)
    assert langid.identify(docs, most_languages=40).count() == 40


def test_language_odd(spark):
    docs = odd_docs(spark)
    out = langid.identify(docs).collect()
    assert len(out) == docs.count()
    assert {r.lang_pred for r in out if r.doc_id in (0, 1, 2, 3, 5, 12)} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# 8 -- quality


def quality_plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_quality_counts(spark):
    texts = odd_texts() + ["a b c a b c", "a a a a", "x\nx\n \n\nx", "a b c"] + [r.text for r in documents(spark).collect()]
    for text in texts:
        assert quality.measure(text)[:5] == quality_plain(text)


def test_quality_em_and_verdicts(spark):
    rng = np.random.default_rng(0)
    good = rng.random(4000) < 0.7
    # rules as they are meant to be: they rarely blame a good document and each see some bad ones
    votes = (rng.random((4000, 5)) >= np.where(good, 0.005, 0.5)[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.02] = quality.ABSTAIN
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    assert ((quality.fit(patterns, counts.astype(float))[at.ravel()] > 0.5) == good).mean() > 0.95
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    out = collect(quality.judge(docs))
    assert all(not r.kept for r in out.values() if r.base_failed)
    judged = [(out[k].kept, q) for k, q in labels.items() if k in out and not out[k].base_failed]
    assert sum(k for k, q in judged if q) / sum(q for _, q in judged) > 0.99
    assert sum(not k for k, q in judged if not q) / sum(not q for _, q in judged) > 0.6


@pytest.mark.parametrize("share", [0.3, 0.5, 0.9])
def test_quality_em_comes_near_the_bayes_rule(share):
    """Seven independent rules of known accuracy: however many documents are good, EM decides as if it knew."""
    rng = np.random.default_rng(1)
    good = rng.random(100_000) < share
    seen, blamed = np.linspace(0.2, 0.6, 7), 0.01
    votes = (rng.random((len(good), 7)) >= np.where(good[:, None], blamed, seen)).astype(int)
    votes[rng.random(votes.shape) < 0.05] = quality.ABSTAIN
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    kept = quality.fit(patterns, counts.astype(float))[at.ravel()] >= 0.5
    said = lambda p: np.where(votes == 0, np.log(p), np.where(votes == 1, np.log(1 - p), 0)).sum(1)
    best = said(np.full(7, blamed)) + np.log(share) >= said(seen) + np.log(1 - share)
    assert abs((kept & good).sum() - (best & good).sum()) <= 0.03 * good.sum()
    assert abs((~kept & ~good).sum() - (~best & ~good).sum()) <= 0.03 * (~good).sum()


def test_quality_em_equals_brute_force():
    rng = np.random.default_rng(4)
    votes = rng.choice([0, 1, 2], (300, 3), p=[0.1, 0.8, 0.1])
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    fast = quality.fit(patterns, counts.astype(float), rounds=7)[at.ravel()]
    chance, share = [[list(quality.BELIEF[c]) for _ in range(3)] for c in (0, 1)], quality.PRIOR_GOOD
    weights = quality.PRIOR_WEIGHT
    for _ in range(7):  # document by document
        good = []
        for row in votes:
            p = [1 - share, share]
            for c in (0, 1):
                for rule, v in enumerate(row):
                    p[c] *= chance[c][rule][v]
            good.append(p[1] / sum(p))
        for c, weight in enumerate(weights):
            for rule in range(3):
                said = [sum((g if c else 1 - g) for g, row in zip(good, votes, strict=True) if row[rule] == v) + weight * quality.BELIEF[c][v] for v in (0, 1, 2)]
                chance[c][rule] = [x / sum(said) for x in said]
        share = (sum(good) + quality.PRIOR_SHARE * quality.PRIOR_GOOD) / (len(votes) + quality.PRIOR_SHARE)
    assert fast == pytest.approx(good)


def test_quality_second_rule_changes_the_verdict():
    names = list(quality.RULES)
    first, second = names.index("symbols"), names.index("dup_lines")

    def posterior(together, alone):
        """Where `second` blames `together` documents with `first` and `alone` without it, while `first` alone blames 300."""
        clean = [1] * len(names)
        both, one, other = clean.copy(), clean.copy(), clean.copy()
        both[first] = both[second] = one[first] = other[second] = 0
        patterns = np.array([clean, one, both, other])
        return quality.fit(patterns, np.array([10_000.0, 300, together, alone]))

    agreeing, unrelated = posterior(400, 40), posterior(45, 3000)
    assert agreeing[1] < 0.5 < unrelated[1]
    assert agreeing[2] < 0.01 and unrelated[2] < 0.5
    assert agreeing[0] > 0.95 and unrelated[0] > 0.8


def test_quality_odd(spark):
    docs = odd_docs(spark)
    assert quality.judge(docs).count() == docs.count()
    assert quality.judge(docs.limit(0)).count() == 0


# 9 -- suffix array


def suffix_plain(rows, length=100):
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        raw = text.encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                gone[p : p + length] = True
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[doc_id] = (len(raw), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def passages(seed):
    rng = random.Random(seed)
    letters = "abé \n" if seed % 2 else "abcdefgh ijkl"
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [make(rng.randint(90, 300)) for _ in range(4)] + ["x" * 250, "ab" * 130]
    rows = []
    for i in range(60):
        parts = [make(rng.randint(0, 150)) if rng.random() < 0.5 else (s := rng.choice(shared))[rng.randint(0, 20) : len(s) - rng.randint(0, 20)] for _ in range(rng.randint(0, 6))]
        rows.append((i, "".join(parts)))
    return rows + [(60 + i, t) for i, (_, t) in enumerate(rows[:5])]


@pytest.mark.parametrize("seed, crowd, sampled", [(1, 2048, 64), (2, 2048, 64), (3, 3, 64), (4, 3, 64), (5, 3, 1), (6, 2, 1)])
def test_suffix_random(spark, seed, crowd, sampled):
    rows = passages(seed)
    out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), crowd=crowd, sampled=sampled).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == suffix_plain(rows)


def test_suffix_odd(spark):
    docs = odd_docs(spark)
    out = suffix_dedup.remove_repeats(docs).collect()
    assert len(out) == docs.count()
    assert [r.n_removed for r in out if r.doc_id == 7] == [0, 0]
    by_id = {r.doc_id: r for r in out}
    assert by_id[14].n_removed == by_id[14].n_bytes > 0
    assert by_id[0].n_bytes == 0
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


# 10 -- toxicity


@pytest.mark.parametrize("scale, least_found, most_blamed", [("0.01", 0.7, 0.02), ("0.1", 0.9, 0.01)])
def test_toxicity_held_out(spark, scale, least_found, most_blamed):
    sf = f"/root/testdata/sf{scale}"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = collect(toxicity.classify(docs.join(labels.select("doc_id"), "doc_id"), labels).drop("text"))
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    held = [k for k in toxic if k in out and zlib.crc32(str(k).encode()) % 3 == 1]
    assert all(out[k].held_out for k in held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out.values())
    hit = [out[k].predicted for k in held if toxic[k]]
    wrong = [out[k].predicted for k in held if not toxic[k]]
    assert sum(hit) / len(hit) > least_found
    assert sum(wrong) / len(wrong) < most_blamed


def test_trees_split_where_brute_force_does():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 6, (60, 3)).astype(float)
    y = (x[:, 1] + rng.random(60) * 3 > 4).astype(float)
    tree = toxicity.Trees(trees=1, depth=1, rate=1.0).fit(x, y)
    p = y.mean()
    gain = lambda inside: (y[inside] - p).sum() ** 2 / ((p * (1 - p)) * inside.sum() + 1)
    best = max((gain(x[:, f] <= e) + gain(x[:, f] > e), -f, -e) for f in range(3) for e in range(5))
    assert (tree.feature[0][0][0], tree.edge[0][0][0]) == (-best[1], -best[2])
    left = x[:, -best[1]] <= -best[2]
    step = [(y[inside] - p).sum() / ((p * (1 - p)) * inside.sum() + 1) for inside in (left, ~left)]
    assert tree.predict(x) == pytest.approx(np.log(p / (1 - p)) + np.where(left, *step))


def test_lexicon_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(8)) + (" wretch" if toxic and rng.random() < 0.8 else ""), int(toxic)) for toxic in [True] * 20 + [False] * 80]
    found = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    bad = sum("wretch" in t for t, _ in rows)
    weight = min(6.0, np.log((bad + 0.5) / 21) - np.log(0.5 / 81))
    assert set(found) == {"wretch", "wret~", "wretc~"}
    assert all(w == pytest.approx(weight, abs=1e-6) for w in found.values())


def test_toxicity_odd(spark):
    docs = odd_docs(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.classify(docs, none).count() == docs.count()
    labels = spark.createDataFrame([(i, i % 2) for i in range(17)] + [(None, 1), (3, None), (3, 0)], "doc_id long, toxic int")
    out = toxicity.classify(docs, labels)
    assert out.count() == docs.count()
    assert toxicity.classify(docs.limit(0), labels).count() == 0


def test_toxicity_fits_on_a_bounded_number_of_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(0, f"you wretch {i}") for i in range(50)] + [(1, f"a calm day {i}") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")
    fitted = []
    fit = toxicity.Trees.fit
    monkeypatch.setattr(toxicity.Trees, "fit", lambda self, x, y: fitted.append(len(x)) or fit(self, x, y))
    toxicity.learn(docs, labels, fit_rows=20)
    assert max(fitted) == 20
    toxicity.learn(docs, labels)
    assert max(fitted) == 100


def test_isotonic_is_monotone():
    rng = np.random.default_rng(2)
    x = rng.random(500)
    points, p = toxicity.isotonic(x, (rng.random(500) < x).astype(float))
    assert (np.diff(points) > 0).all() and (np.diff(p) >= 0).all()
    x = rng.integers(0, 12, 40).astype(float)
    y = (rng.random(40) * 12 < x).astype(float)
    at, ones, rows = np.unique(x), np.array([y[x == v].sum() for v in np.unique(x)]), np.array([(x == v).sum() for v in np.unique(x)])
    brute = [max(min(ones[j : k + 1].sum() / rows[j : k + 1].sum() for k in range(i, len(at))) for j in range(i + 1)) for i in range(len(at))]
    assert np.interp(at, *toxicity.isotonic(x, y)) == pytest.approx(brute)


# pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs = documents(spark)
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(common.cut(stage(spark, kept[-1], SF), "test"))
        assert kept[-1].columns == corpus_pipeline.COLUMNS
    texts = {r.doc_id: r.text for r in kept[1].collect()}
    assert {r.doc_id for r in kept[2].collect()} == kept_plain(texts)
    texts = {r.doc_id: r.text for r in kept[2].collect()}
    plain = suffix_plain(texts.items())
    assert {r.doc_id: len(r.text.encode()) for r in kept[3].collect() if r.text.isascii()} == {k: n - gone for k, (n, gone, *_) in plain.items() if n - gone and k in {r.doc_id for r in kept[3].collect() if r.text.isascii()}}
    order = mixing.training_order(mixing.mix(kept[3])).select("doc_id", "position", "copy").collect()
    assert Counter(r.doc_id for r in kept[4].collect()) == Counter(r.doc_id for r in order)
    lib = library()
    final = corpus_pipeline.STAGES[-1][1](spark, kept[4], SF).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in final) == Counter((r.doc_id, *bpe_expected(r.text, lib)[:2]) for r in kept[4].collect())
    assert [r.doc_id for r in sorted(final, key=lambda r: (r.file, r.row))] == [r.doc_id for r in sorted(order, key=lambda r: (r.position, r.doc_id, r.copy))]
    odd = odd_docs(spark)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SF).count() <= 3 * odd.count()
        assert stage(spark, odd.limit(0), SF).count() == 0


def test_a_stage_deletes_its_own_run_only(spark):
    import corpus_pipeline

    docs = documents(spark)
    mixed = mixing.mix(docs).select("doc_id", "taken")  # lazy, and reads tables between steps
    first, last = corpus_pipeline.STAGES[1][1], corpus_pipeline.STAGES[3][1]
    removed = first(spark, docs, "a folder")
    kept = common.cut(removed, "test")
    other = corpus_pipeline.STAGES[2][1](spark, docs, "another folder")
    last(spark, kept, "a folder")
    assert mixed.count() == docs.count()
    assert other.count() > 0 and kept.count() > 0
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|PATH_NOT_FOUND"):
        removed.count()


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(common, "HUB", 5)
    rng = random.Random(2)
    pairs = [(0, i) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(59, 139)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)]
    low = plain_components({x for p in pairs for x in p}, pairs)
    found = {r.node: r.root for r in common.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert {x: found.get(x, x) for x in low} == low
