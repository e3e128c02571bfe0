"""Every operator on nulls, empty, short and long texts, ties, repeated rows, empty tables and clashing columns, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

WS = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, node string, id long, fp long, ah long, s string, label int, batch string"


def words(t):
    return re.findall(WS, t or "")


def rows(seed=0, n=40):
    rng = random.Random(seed)
    vocabulary = ["the", "Über", "naïve", "x", "🙂", "data", "#tag", "a|b", "THE", "end.", "\xa0nb"] + [f"w{i}" for i in range(60)]
    para = " ".join(rng.choice(vocabulary) for _ in range(70))
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 30, 120]))) for _ in range(n)]
    texts = [None, "", "  \n\t", "one", "a b c d", "aaaa" * 200, "é" * 300, para, para, para + " tail", "head " + para + " more", base[0] + "\n" + base[0], *base]
    texts += [t.replace("data", "DATA", 1) for t in base[:8]] + ["long " + " ".join(rng.choice(vocabulary) for _ in range(30_000))]
    out = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s1", "s2", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    out += [(None, para, "en", "s1", 3), (None, None, None, None, None), (5, "a second row with this id", "en", "s1", 9), out[7], out[7], (-4, base[2], "en", "s2", 0)]
    return [(*r, 1, "clash", 2, 3, 4, "clash", 5, "clash") for r in out]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def key(r):
    return tuple((x is not None, x) for x in r)


def brute_repeats(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        n = sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1]))
        out.append((len(b), sum(gone), n, hashlib.sha256(bytes(x for x, y in zip(b, gone) if not y)).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [4000, 1])
def test_repeats(table, crowd):
    from textloom.llm.substrings import remove_repeats

    had = rows()
    got = sorted(map(tuple, remove_repeats(table, max_group=crowd).collect()), key=key)
    want = sorted(((r[0], *w) for r, w in zip(had, brute_repeats([r[1] for r in had]))), key=key)
    assert got == want


def test_repeats_of_any_length(spark):
    from textloom.llm.substrings import remove_repeats

    rng = random.Random(4)
    for length, core in ((8, 3), (20, 20), (5, 1)):
        texts = ["".join(rng.choice("ab ") for _ in range(rng.randrange(60))) for _ in range(12)]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = sorted(map(tuple, remove_repeats(df, length, core).collect()))
        assert got == [(i, *w) for i, w in enumerate(brute_repeats(texts, length))]


def test_long_texts_in_parts():
    from textloom.llm.substrings import contexts, pieces

    data = np.random.default_rng(0).integers(97, 100, 5000).astype(np.uint8)
    starts = []
    for row, offsets, shift in pieces(np.array([0, 5000]), 200, most=700):
        _, first, last, *_ = contexts(data, offsets, 200, 48)
        starts += [x for a, b in zip(first + shift, last + shift) for x in range(a, b + 1)]
    assert starts == list(range(4801))


def test_texts_without_repeats_keep_whole_characters(table):
    from textloom.llm.substrings import cleaned

    got = cleaned(table)
    assert got.columns == table.columns
    by = defaultdict(list)
    for r in got.collect():
        by[r.doc_id].append(r)
        assert r.n_chars == len(r.text)
    assert by[6][0].text == "" and by[3][0].text == "one"


def brute_components(had, percent=80):
    sets = []
    for r in had:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(r[1])]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    comp = list(range(len(had)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                comp[root(i)] = root(j)
    groups = defaultdict(list)
    for i, r in enumerate(had):
        groups[root(i)].append(r[0])
    best = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return [(r[0], len(s), best[root(i)]) for i, (r, s) in enumerate(zip(had, sets))], len({root(i) for i, s in enumerate(sets) if s})


def test_components(table):
    from textloom.llm.jaccard import jaccard_classes, one_of_each

    got = sorted(map(tuple, jaccard_classes(table, chunk_chars=20_000).collect()), key=key)
    want, n_components = brute_components(rows())
    want.sort(key=key)
    assert got == want
    kept = one_of_each(table)
    assert kept.columns == table.columns
    n_empty = sum(1 for w in want if not w[1])
    assert kept.count() == n_components + n_empty


def test_components_of_near_copies_and_chains(spark):
    from textloom.llm.jaccard import jaccard_classes

    rng = random.Random(9)
    base = [f"t{i}" for i in range(120)]
    had = []
    for i in range(150):  # copies with one to eight words changed, few of which link directly
        w = list(base)
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(120)] = f"u{rng.randrange(10**6)}"
        had.append((i, " ".join(w)))
    for i in range(40):  # a chain: each shares nine tenths with the next
        had.append((1000 + i, " ".join(f"c{j}" for j in range(i * 4, i * 4 + 100))))
    got = sorted(map(tuple, jaccard_classes(spark.createDataFrame(had, "doc_id long, text string")).collect()))
    assert got == sorted(brute_components(had)[0])


def test_quality(table, nothing):
    from textloom.llm.quality import judge, keep

    got = judge(table)
    want = Counter()
    for r in rows():
        t = r[1] or ""
        w = words(t)
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        mark = [0] * len(w)
        for i in range(len(w) - 7):
            if seen[tuple(w[i : i + 8])] > 1:
                mark[i : i + 8] = [1] * 8
        lines = [x for x in t.split("\n") if words(x)]
        want[(r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), sum(mark), len(w) < 20 or 100 * sum(mark) > 30 * len(w))] += 1
    found = got.collect()
    assert Counter(tuple(g)[:7] for g in found) == want
    assert not any(g.kept and g.base_failed for g in found)
    again = judge(table.repartition(3)).collect()
    assert Counter(map(str, again)) == Counter(map(str, found))
    kept = keep(table)
    assert kept.columns == table.columns and kept.count() == sum(g.kept for g in found)
    assert judge(nothing).count() == 0


def test_outliers_go(spark):
    from textloom.llm.quality import judge

    rng = random.Random(2)
    good = [(i, " ".join(f"word{rng.randrange(900)}" for _ in range(rng.randrange(60, 400))), "en", "s") for i in range(300)]
    bad = [(1000 + i, " ".join(f"w{rng.randrange(900)}$$$%%%" for _ in range(100)), "en", "s") for i in range(30)]
    got = {r.doc_id: r.kept for r in judge(spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[g[0]] for g in good) and not any(got[b[0]] for b in bad)


def test_bpe(table):
    import base64

    import public_tokenizers as P
    import tiktoken

    from textloom.llm.bpe import encode_documents

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in rows():
        ids = enc.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest(), ids))
    for options in ({}, {"most": 2000, "block": 50, "remember": 100}):
        got = encode_documents(table, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, ids=True, **options).collect()
        assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_bpe_pieces_against_the_library():
    import base64

    import public_tokenizers as P
    import tiktoken

    from textloom.llm.bpe import Bpe

    raw = open(P.path("byte_bpe_50k.tiktoken"), "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    enc, mine, rng = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), Bpe(raw, P.PATTERN), random.Random(3)
    for _ in range(400):
        t = "".join(rng.choice("aabcdeéß中 \n'tsr0🙂<|endoftext|>") for _ in range(rng.randrange(900)))
        assert mine.encode(t).tolist() == enc.encode_ordinary(t)


def _hash(*values):
    """The engine's hash of longs (int), ints (wrapped in a list) and texts, one after another; nulls are passed over."""
    import xxhash

    seed = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else v[0].to_bytes(4, "little") if isinstance(v, list) else (v % 2**64).to_bytes(8, "little")
            seed = xxhash.xxh64_intdigest(data, seed)
    return seed - 2**64 if seed >= 2**63 else seed


def brute_order_min_hash(text, functions=40, k=5):
    """A plain Order MinHash: for each function the two least elements, in the order of the text."""
    w = [_hash(x) for x in words(text)]
    two = [_hash(a, b) for a, b in zip(w, w[1:])]
    four = [_hash(a, b) for a, b in zip(two, two[2:])]
    mers = [_hash(a, b) for a, b in zip(four, four[1:])] if len(w) >= k else [_hash(*w)] if w else []
    seen, elements = Counter(), []
    for place, m in enumerate(mers):
        elements.append((_hash(m, [seen[m]]) if seen[m] else m, place))
        seen[m] += 1
    out = ""
    for j in range(functions):
        least = sorted(((_hash(e, [j]) % 2**64) >> 31, place) for e, place in elements)[:2]
        chosen = [h for h, _ in sorted(least, key=lambda x: x[1])]
        out += f"{(_hash(*chosen) % 2**64) >> 32:08x}" if least else "0" * 8
    return out


def test_fingerprints(table, nothing):
    from textloom.llm.omh import compare_edits

    likeness = lambda a, b: sum(a[i : i + 8] == b[i : i + 8] for i in range(0, len(a), 8)) * 8 / len(a)
    had = [(r[0], r[1]) for r in rows()]
    order = sorted(had, key=lambda r: (r[0] is None, -(r[0] or 0), _hash(r[1], [int(r[1] is None)])))
    want = Counter()
    prints = {t: brute_order_min_hash(t) for t in {r[1] or "" for r in had}}
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        half = len(t) // 2
        e = t[: len(t) - half] + after[:half]
        f = brute_order_min_hash(e)
        want[(i, len(t), hashlib.sha256(e.encode()).hexdigest(), prints[t], f, likeness(prints[t], f), likeness(prints[t], prints[after]))] += 1
    assert Counter(map(tuple, compare_edits(table).collect())) == want
    assert compare_edits(nothing).count() == 0


def test_fingerprints_of_many_equal_rows(spark):
    from textloom.llm.omh import compare_edits

    df = spark.range(2500).selectExpr("IF(id < 2400, NULL, id * 1234567890123) AS doc_id", "IF(id < 2400, 'the same text of several words', concat('text ', id)) AS text")
    got = compare_edits(df).collect()
    assert len(got) == 2500 and sum(r.near_next == 1 for r in got) == 2399
    assert all(r.near_edited < 1 for r in got if r.doc_id is not None)


def test_likeness_follows_edit_distance(spark):
    from pyspark.sql import functions as F

    from textloom.llm.omh import fingerprints, likeness

    rng = random.Random(1)
    w = [f"t{i}" for i in range(400)]
    few = list(w)
    for _ in range(4):
        few[rng.randrange(400)] = "new"
    many = list(w)
    for _ in range(60):
        many[rng.randrange(400)] = f"n{rng.random()}"
    moved = w[200:] + w[:200]
    blocks = [w[i : i + 10] for i in range(0, 400, 10)]
    rng.shuffle(blocks)
    texts = [w, list(w), few, many, moved, sum(blocks, []), ["same"] * 400, ["same"] * 380]
    df = fingerprints(spark.createDataFrame([(i, 0, " ".join(t)) for i, t in enumerate(texts)], "i int, kind int, text string"), ["i"], "kind", "text")
    df = df.select("i", F.lower(F.hex("fingerprint")).alias("f"))
    a, b = df.select(F.col("i").alias("x"), F.col("f").alias("g")), df.select("i", "f")
    near = {(r.x, r.i): r.l for r in a.join(b, F.col("x") < F.col("i")).select("x", "i", likeness(F.col("g"), F.col("f")).alias("l")).collect()}
    assert near[0, 1] == 1 and near[0, 2] > near[0, 3] > 0 and near[0, 2] > near[0, 5]
    assert 0.5 < near[6, 7] < 1  # occurrence numbers tell repeats apart


def test_likeness_of_short_texts(spark):
    """Functions are independent: of short texts that share 9 of 11 k-mers the share of equal tuples has the mean and the spread of 40 fair draws."""
    n = 40
    shares = []
    for i in range(n):
        a = [f"{i}x{j}" for j in range(14)]
        f, g = brute_order_min_hash(" ".join(a)), brute_order_min_hash(" ".join([*a[:13], f"{i}y"]))
        shares.append(sum(f[j : j + 8] == g[j : j + 8] for j in range(0, len(f), 8)) * 8 / len(f))
    p = np.mean(shares)  # both least elements among the 9 shared of 11
    assert abs(p - 9 * 8 / (11 * 10)) < 0.06
    assert np.std(shares) < 1.4 * np.sqrt(p * (1 - p) / 40)


def test_warc(spark):
    from textloom.llm.warc import ArchiveWriter, base32_sha1, parse, read_archives, record, records, write_archives

    had = [(i, f"http://x/{i}", h) for i, h in enumerate(["<p>a</p>" * 50, None, "", "<p>é</p>", "<p>a</p>" * 50, "\r\n\r\nWARC/1.1\r\n", "z" * 300_000])] + [(4, "http://again", "<p>a</p>" * 50), (None, None, "<p>é</p>")]
    pages = spark.createDataFrame([(*h, "clash", b"x") for h in had], "page_id long, url string, html string, name string, archive binary")
    back = read_archives(write_archives(pages, archive_bytes=2000), blocks=True).collect()
    assert len(back) == len(had) and all(r.error is None for r in back)
    best = {}
    for i, _, h in had:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    for r in back:
        payload = {base32_sha1((h or "").encode()): (h or "").encode() for *_, h in had}[r.payload_digest]
        top = best[payload.decode()]
        mine = int(r.name) if r.name else None
        assert r.payload_bytes == len(payload)
        assert (r.record_type, r.refers_to) == (("response", None) if mine == top else ("revisit", str(top)))
        assert r.block == (payload if r.record_type == "response" else b"")
    assert read_archives(write_archives(pages.limit(0))).count() == 0
    w = ArchiveWriter(sample=3)
    made = [record("response", str(i), "http://x", b"body" * i, base32_sha1(b"body" * i), 4 * i, None) for i in range(9)]
    for m in made:
        w.add(m)
    data = w.close()
    assert list(records(data)) == made and parse(made[2])[1] == b"bodybody"
    for bad in (data[:-3], data[:40], data[:200] + b"\0" + data[201:], b"not an archive"):
        with pytest.raises(ValueError):
            for x in records(bad):
                parse(x)
    for bad in (made[2].replace(b"Content-Length: 8", b"Content-Length: 9"), made[2].replace(b"WARC/1.1", b"WORC/1.1"), made[2].replace(b"WARC/1.1", b"WARC/x"), made[2].replace(b"WARC-Date", b"WARC Date"), made[2][:-1]):
        with pytest.raises(ValueError):
            parse(bad)


def test_chat(spark):
    from textloom.llm.chat import best_paths, conversation_trees, format_paths, read_back

    nasty = ["", "a\\b", "<|im_end|>\n<|im_start|>assistant\nx", "\\<|", "<", "|", "\n\n", "é🙂<|", "\\\\", None]
    had = [(c, t, ["user", "assistant", "sys\n<|im_end|>\\"][t % 3], nasty[(c + t) % 10]) for c in range(10) for t in range(6)] + [(3, 2, "assistant", "tie"), (3, 2, "assistant", "tie"), (None, 0, "user", "no id"), (77, None, None, "no turn"), (77, 0, "assistant", "y")]
    df = spark.createDataFrame([(*h, "clash") for h in had], "conv_id long, turn long, role string, text string, node string")
    got = {(r.tree.id if not r.tree.none else None): r for r in read_back(format_paths(conversation_trees(df))).collect()}
    order = lambda x: tuple((v is not None, v) for v in x)
    by = defaultdict(list)
    for c, *rest in sorted(had, key=order):
        by[c].append(rest)
    assert got.keys() == by.keys()
    for c, turns in by.items():
        assert [(t.role, t.text) for t in got[c].turns] == [(r or "", t or "") for _, r, t in turns]
        assert got[c].learned == "".join(t or "" for _, r, t in turns if r == "assistant")
        assert got[c].formatted.count("<|im_end|>\n") == len(turns)
    tree = [("t", 1, None, 0.0), ("t", 2, 1, 1.0), ("t", 3, 1, 5.0), ("t", 4, 2, 9.0), ("t", 5, 3, 1.0), ("u", 1, 99, 0.0), ("v", 1, 2, 0.0), ("v", 2, 1, 0.0), *[("w", i, i - 1 if i > 1 else None, None) for i in range(1, 70)]]
    paths = defaultdict(list)
    for r in best_paths(spark.createDataFrame(tree, "tree string, node long, parent long, score double"), 2).orderBy("depth").collect():
        paths[r.tree, r.rank].append(r.node)
    assert paths == {("t", 1): [1, 2, 4], ("t", 2): [1, 3, 5], ("u", 1): [1], ("w", 1): list(range(1, 70))}
    assert format_paths(conversation_trees(df.limit(0))).count() == 0


def test_classifiers(spark, table, nothing):
    from textloom.llm.pu import score_quality
    from textloom.llm.toxicity import score_toxicity

    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0), 9) for i in range(40)] + [(None, 1, 1, 0), (3, None, None, 0), (4, 7, 7, 0), (1, 1, 1, 0)], "doc_id long, quality int, toxic int, text int")
    for score in (score_toxicity, score_quality):
        got = score(table, labels).collect()
        assert len(got) == len(rows()) and all(0 <= g.score <= 1 for g in got)
        assert score(nothing, labels).count() == 0
        assert {g.score for g in score(table, labels.limit(0)).collect()} == {0.5}


def test_held_out_accuracy(spark):
    import zlib

    from textloom.llm.learn import auc
    from textloom.llm.op2 import query as toxicity
    from textloom.llm.op7 import query as quality

    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for query, column, least, share in ((toxicity, "toxic", 0.96, 0.95), (quality, "quality", 0.99, 0.98)):
        got = [g for g in query(spark, sf).collect() if g.held_out and g.doc_id in labels]
        assert all(zlib.crc32(str(g.doc_id).encode()) % 5 == 0 for g in got)
        label = np.array([labels[g.doc_id][column] for g in got])
        assert auc(np.array([g.score for g in got]), label) > least
        assert np.mean([g.predicted == y for g, y in zip(got, label)]) > share


def test_prior():
    from textloom.llm.pu import estimate_prior

    rng = np.random.default_rng(0)
    for p in (0.3, 0.8):
        good, bad = rng.normal(1.5, 1, (6000, 3)), rng.normal(-1.5, 1, (6000, 3))
        mixed = np.vstack([good[: int(3000 * p)], bad[: 3000 - int(3000 * p)]])
        assert abs(estimate_prior(good[3000:], rng.permutation(mixed)) - p) < 0.1


def test_suffix_array():
    from textloom.llm.substrings import suffix_array

    rng = np.random.default_rng(1)
    for _ in range(500):
        s = rng.integers(0, rng.integers(1, 6), rng.integers(0, 60))
        assert suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_many_equal_rows_in_linear_work(spark):
    """Rows equal in id and text: all of them go, and a passage that others share with them goes there."""
    from textloom.llm.substrings import remove_repeats

    rng = random.Random(8)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(300))
    rows = [(None, text)] * 3000 + [(i, f"{rng.random()} {text[400:900]} {rng.random()}") for i in range(5)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.n_removed == len(text) for r in got) == 3000
    assert all(r.n_removed >= 500 for r in got if r.doc_id is not None) and len(got) == 3005
