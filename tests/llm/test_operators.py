"""Operators against brute force on small tables with nulls, empty and repeated texts, and extra columns."""

import functools
import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tessera.llm import byte_repeats, decontaminate, frames, jaccard, kernel, mixing, queries, runs, secret_scan, sketch, substrings, suffix_groups, token_files, toxicity, url_lists

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(LETTERS, LETTERS.lower())


def corpus(n=60, seed=5, words=90):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randrange(2, 7))) for _ in range(300)]
    prose = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    shared = prose(70)
    texts = [None, "", " \n\t", "one", "One two three", prose(1500)]
    while len(texts) < n:
        kind = r.randrange(6)
        if kind == 0 and texts[-1]:
            texts.append(texts[-1])
        elif kind == 1 and texts[-1]:
            w = texts[-1].split()
            if len(w) > 30:
                w[r.randrange(len(w))] = "edit"
            texts.append(" ".join(w))
        elif kind == 2:
            texts.append(f"{prose(20)} {shared} {prose(15)}")
        else:
            texts.append(prose(r.randrange(1, words)).capitalize())
    return list(enumerate(texts))


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", 7, "x") for i, t in rows], "doc_id long, text string, lang string, source string, hash long, key string")


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, text or "")


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return docs_of(spark, rows)


def test_kernel_words_and_minima():
    texts = ["Ab  c", "", None, "déjà-vu", "x" * 5]
    got = []
    for part in kernel.slices(pa.array(texts), 4):
        w = kernel.Words(part, kernel.NONSPACE, lower=True)
        got += [w.join(w.first[i], w.first[i + 1]).decode() for i in range(part.n)]
    assert got == ["ab c", "", "", "déjà-vu", "xxxxx"]
    v = np.array([5, 3, 3, 9, 1, 1, 8, 2], np.uint64)
    for w in range(1, 9):
        expected = [max(j for j in range(i, i + w) if v[j] == v[i : i + w].min()) for i in range(len(v) - w + 1)]
        assert kernel.sliding_min_pos(v, w).tolist() == expected


def thue_morse(n):
    """Two words of 2**n bytes that polynomials modulo 2**64 give one hash."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_no_hash_takes_two_words_for_one(spark):
    from tokenizers import Tokenizer

    tokenizer, rows = Tokenizer.from_file(queries.tokenizer_path()), []
    for n in (3, 5, 6, 10, 12):
        a, b = thue_morse(n)
        rows += [(10 * n + 1, f"{a} one two three four"), (10 * n + 2, f"{b} one two three four"), (10 * n + 3, a), (10 * n + 4, b)]
        texts = next(kernel.slices(pa.array([a, b])))
        assert len(set(kernel.bytes_hash(texts.data, texts.offsets[:-1], texts.offsets[1:]).tolist())) == 2
    ids, first = token_files.Encoder(queries.tokenizer_path()).encode(next(kernel.slices(pa.array([t for _, t in rows]))))
    assert [ids[first[i] : first[i + 1]].tolist() for i in range(len(rows))] == [tokenizer.encode(t, add_special_tokens=False).ids for _, t in rows]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(docs_of(spark, rows), 4, 85).collect()} == brute_groups(rows, 4, 85)
    a, b = thue_morse(10)
    kept = substrings.remove_repeats([docs_of(spark, [(1, " ".join([a] * 40)), (2, " ".join([b] * 3 + [a] * 30 + [b] * 3))])], with_text=True).collect()
    assert {r.doc_id: r.n_removed for r in kept} == {1: 40, 2: 0}


def test_encoder_compares_bytes_where_hashes_agree(monkeypatch):
    monkeypatch.setattr(kernel, "bytes_hash", lambda data, starts, ends: np.minimum(ends - starts, 3).astype(np.uint64) << np.uint64(60))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    texts = ["alpha beta gamma alpha delta", "be ta alpha " + "x" * 90, "gamma gamma " + "y" * 90]
    encoder = token_files.Encoder(queries.tokenizer_path())
    for _ in range(2):
        ids, first = encoder.encode(next(kernel.slices(pa.array(texts))))
        assert [ids[first[i] : first[i + 1]].tolist() for i in range(3)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoder_matches_tokenizer():
    path = queries.tokenizer_path()
    encoder = token_files.Encoder(path, remember=300)
    r = random.Random(1)
    symbols = [*"ab'sé× \n\t.,!?12 ’ 　\xa0中́\x1c", "<|endoftext|>", "'re", " the", "don't"]
    texts = ["".join(r.choice(symbols) for _ in range(r.randrange(60))) for _ in range(800)] + ["", None, " ", "\n\n x"]
    for part in kernel.slices(pa.array(texts), 5000):
        ids, first = encoder.encode(part)
        for i in range(part.n):
            assert ids[first[i] : first[i + 1]].tolist() == encoder.tokenizer.encode(texts[part.first + i] or "", add_special_tokens=False).ids


def test_token_files_round_trip(spark, rows):
    docs = docs_of(spark, [*rows, (3, "one"), (None, "no id")])
    folder = frames.scratch(spark, "tokens")
    token_files.write_tokens(docs, folder, queries.tokenizer_path(), 2, shard_bytes=1000)
    tokenizer = token_files.Encoder(queries.tokenizer_path()).tokenizer
    encode = lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
    got = token_files.read_tokens(spark, folder).orderBy("start").collect()
    assert len(got) == len(rows) + 2 and got[0].doc_id is None
    assert [r.doc_id for r in got[1:]] == sorted([i for i, _ in rows] + [3])
    by_id = dict(rows)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
        assert r.ids == encode("no id" if r.doc_id is None else by_id[r.doc_id])
    some = token_files.read_tokens(spark, folder, wanted=[5, 7], digest=True).collect()
    assert sorted(r.doc_id for r in some) == [5, 7]
    assert all(r.ids_crc32 == zlib.crc32(np.array(encode(by_id[r.doc_id]), "<u4").tobytes()) for r in some)


def test_shards_are_looked_up_among_many_cuts(spark):
    cuts = np.arange(-50_000, 50_000) * 7
    ids = pa.array([None, -10**6, -350_000, -1, 0, 6, 7, 8, 10**6], pa.int64())
    assert token_files.shards_of(ids, cuts).tolist() == [0, 0, 1, 50_000, 50_001, 50_001, 50_002, 50_002, 100_000]
    docs = docs_of(spark, [(1, "a")]).select("doc_id", "text")
    plan = docs.mapInArrow(token_files._encode(queries.tokenizer_path(), 2, 3, cuts), token_files.ENCODED)
    assert len(plan._jdf.queryExecution().optimizedPlan().toString()) < 5000  # the plan doesn't grow with the cuts


def test_token_files_find_damage(spark, rows, tmp_path):
    folder = f"file://{tmp_path}/t"
    manifest = token_files.write_tokens(docs_of(spark, rows), folder, queries.tokenizer_path(), 2).collect()
    path = tmp_path / "t" / manifest[0].path
    raw = bytearray(path.read_bytes())
    raw[12] ^= 0xFF
    path.write_bytes(raw)
    with open(path, "rb") as f:
        file = pa.PythonFile(f, "r")
        with pytest.raises(Exception):
            token_files.TokenFile(file).ids(0)


def test_decontamination_matches_brute_force(spark, rows):
    r = random.Random(2)
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    long = [w for _, t in rows if t and len(t.split()) > 40 for w in [t.split()]]
    items = [(1, " ".join(long[0][3:30])), (2, " ".join(long[1][5:18])), (10, "ONE, two; three"), (4, None), (5, ""), (6, " ".join(long[2][:12])), (None, "one"), (1, "one")]
    extra = [(1000 + k, f"Intro {items[k % 2][1].upper()}! and {r.random()}") for k in range(5)]
    docs = docs_of(spark, [*rows, *extra, extra[0]])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((x.doc_id, x.n_words, x.n_hit, ",".join(x["items"])) for x in decontaminate.decontaminate(docs, bench).collect())
    windows = {}
    for i, t in items:
        w = re.findall(pattern, (t or "").translate(LOWER))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n and i is not None else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    want = Counter()
    for i, t in [*rows, *extra, extra[0]]:
        w = re.findall(pattern, (t or "").translate(LOWER))
        hit, found = set(), set()
        for n in range(1, 14):
            for k in range(len(w) - n + 1):
                if (ids := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= ids
        want[i, len(w), len(hit), ",".join(sorted(found))] += 1
    assert got == want
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    flagged = {i for (i, n, h, _) in want if h and 20 * h >= n}
    assert {x.doc_id for x in kept.collect()} == {i for i, _ in [*rows, *extra]} - flagged


def test_decontamination_finds_items_of_every_length(spark):
    item = [f"w{i}x" for i in range(1, 14)]
    bench = spark.createDataFrame([(n, " ".join(f"{w}{n}" for w in item[:n])) for n in range(1, 14)], "item_id long, text string")
    texts = [(n, "before it " + " ".join(f"{w}{n}" for w in item[:n]) + " and after") for n in range(1, 14)]
    texts += [(20, " ".join(f"{w}13" for w in item[:12])), (21, " ".join(f"{w}7" for w in item[:6]))]
    got = {x.doc_id: (x.n_words, x.n_hit, x["items"]) for x in decontaminate.decontaminate(docs_of(spark, texts), bench).collect()}
    assert got == {n: (n + 4, n, [str(n)]) for n in range(1, 14)} | {20: (12, 0, []), 21: (6, 0, [])}


def brute_groups(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = words((t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard_joins_a_large_group_of_near_copies(spark, monkeypatch):
    """Two thousand edits of one text, and others that share half of it; blocks are so small that lists are dealt to many."""
    monkeypatch.setattr(jaccard, "BLOCK", 64)
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(120)]
    rows = [(i, " ".join(w if r.random() > 0.002 else word() for w in base)) for i in range(2000)]
    rows += [(3000 + i, " ".join([*base[:60], *(word() for _ in range(60))])) for i in range(150)]
    got = {x.doc_id: x.component_id for x in jaccard.jaccard_groups(docs_of(spark, rows), 4, 85).collect()}
    sets = {i: frozenset(tuple(t.split()[k : k + 4]) for k in range(117)) for i, t in rows}
    near = lambda a, b: 100 * len(a & b) >= 85 * len(a | b)
    group = {0}
    todo = [0]
    while todo:
        x = sets[todo.pop()]
        new = [i for i, s in sets.items() if i not in group and near(x, s)]
        group.update(new)
        todo += new[:40]
    assert len(group) > 1500 and {i for i, c in got.items() if c == 0} >= group
    assert all(got[i] == i for i in range(3000, 3150))


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_jaccard_matches_brute_force(spark, n, percent):
    rows = corpus(120, seed=n)
    base = rows[5][1].split()
    rows += [(500 + k, " ".join(w if (j + k) % 97 else "z" for j, w in enumerate(base[:300]))) for k in range(25)]
    rows.append((200, rows[7][1]))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(docs_of(spark, rows), n, percent).collect()}
    assert got == brute_groups(rows, n, percent)


def test_jaccard_allocations_are_sufficient():
    for percent in (80, 85):
        for band in jaccard.bands(3000, percent, {}):
            assert band.plain - band.slack + 2 * band.near > band.differ
            for s in range(band.low, band.high + 1, max(1, (band.high - band.low) // 7)):
                t = s * 100 // percent
                assert s + t - 2 * -(-percent * (s + t) // (100 + percent)) <= band.differ


def test_representatives(spark, rows):
    docs = docs_of(spark, [*rows, (rows[9][0], rows[9][1]), (None, "alone"), (None, "alone")])
    kept = jaccard.representatives(docs)
    groups = brute_groups(rows, 5, 80)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x)) == [*sorted(i for i, (_, c) in groups.items() if i == c), None, None]


def test_toxicity_learns_and_holds_out(spark):
    r = random.Random(3)
    plain = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(60)]
    bad = ["grumblock", "snarfwit"]
    rows, labels = [], []
    for i in range(500):
        w = [r.choice(plain) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            w[5:7] = r.choices(bad, k=2)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs = docs_of(spark, [*rows, (1000, None), (1001, "")])
    got = {x.doc_id: x.score for x in toxicity.score(docs, toxicity.train(docs, spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int"))).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    right = [(got[i] >= 0.3) == (i % 4 == 0) for i in held]
    assert sum(right) / len(right) > 0.95
    assert 0 <= got[1000] <= 1 and got[1000] == got[1001]
    model = toxicity.fit(pa.array([t for _, t in rows]), np.array([y for _, y in labels]))
    score = lambda t: float(model.scores(next(kernel.slices(pa.array([t]))))[0])
    base = " ".join(plain[:38])
    assert score(f"{base} grumblockk snarfwiit") > score(base)
    assert all(score(f"{base} {w}") > score(base) for w in ("grumbl0ck", "gr0mblock", "snarfw1t", "5narfwit"))
    kept = toxicity.drop_toxic(docs, model, 0.5)
    assert kept.columns == docs.columns and kept.count() < docs.count()


def test_toxicity_trains_rare_words():
    """Forty words in five of a thousand texts each, and more than 8,192 buckets."""
    r = random.Random(8)
    word = lambda letters: "".join(r.choice(letters) for _ in range(8))
    plain, bad = [word("abcdefghijklmnop") for _ in range(60)], [word("qrstuvwxyz") for _ in range(40)]
    texts = [" ".join([*r.choices(plain, k=40), *([bad[i % 40]] if i < 200 else [])]) for i in range(1000)]
    model = toxicity.fit(pa.array(texts), np.arange(1000) < 200)
    base = [" ".join(r.choices(plain, k=40)) for _ in range(40)]
    got = model.scores(next(kernel.slices(pa.array([*base, *(f"{t} {w}" for t in base for w in bad)]))))
    assert (got[:40] < 0.3).mean() > 0.9 and (got[40:] >= 0.3).mean() > 0.9
    many = " ".join(word("abcdefghijklmnop") for _ in range(1500))
    assert np.count_nonzero(toxicity.fit(pa.array([many, f"{many} {bad[0]}"] * 2), np.array([0, 1, 0, 1]), rounds=2).weight) > 8192


def test_toxicity_with_one_class_or_no_labels(spark, docs):
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(x.score < 0.01 for x in toxicity.score(docs, none).collect())


def test_word_repeats_match_brute_force(spark):
    rows = corpus(70, seed=9)
    base = rows[5][1].split()
    rows += [(100, " ".join(base[100:150] + ["x"] + base[100:150])), (101, " ".join(base[200:236])), (102, " ".join(base[300:334])), (100, rows[5][1])]
    docs = docs_of(spark, rows)
    half = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    out = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(list(half)).collect())
    count = Counter(tuple(w[k : k + 35]) for _, t in rows for w in [words(t)] for k in range(len(w) - 34))
    want = Counter()
    for i, t in rows:
        w = words(t)
        gone = {j for k in range(len(w) - 34) if count[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        want[i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()] += 1
    assert out == want


def test_index_compacts_and_stays_right(spark):
    rows = corpus(60, seed=11)
    docs = docs_of(spark, rows)
    parts = [docs.where(f"doc_id % 5 = {k}") for k in range(5)]
    folder = frames.scratch(spark, "index")
    substrings.remove_repeats(parts[:3], folder=folder, fanout=2).count()
    again = runs.Index(spark, folder)
    assert len(again.paths("run")) == 1 and len(again.paths("files")) == 3
    many = substrings.remove_repeats(parts[3:], with_text=True, folder=folder, fanout=3)  # another process would go on like this
    assert len(runs.Index(spark, folder).paths("run")) == 1
    one = substrings.remove_repeats([docs], with_text=True)
    assert Counter(map(tuple, many.collect())) == Counter(map(tuple, one.collect()))


def test_columns_of_any_name_stay(spark, rows):
    names = ["_id", "_n", "_many", "_mark", "id", "key", "hash", "node", "list", "score"]
    docs = spark.createDataFrame([(i, t, *range(10)) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    bench = spark.createDataFrame([(1, " ".join(rows[5][1].split()[:20]), 5)], "item_id long, text string, _id int")
    for df in (jaccard.representatives(docs), decontaminate.drop_contaminated(docs, bench), toxicity.drop_toxic(docs, toxicity.fit(pa.array(["a"]), np.array([0])), 2.0)):
        got = df.collect()
        assert df.columns == docs.columns and got and all(tuple(r)[2:] == tuple(range(10)) for r in got)


def test_components(spark):
    from tessera.llm import graph

    links = spark.createDataFrame([(5, 3), (3, 1), (9, 8), (8, 9), (7, 7), (20, 19), (19, 18), (18, 17), (17, 16)], "a long, b long")
    assert {(r.node, r.root) for r in graph.components(links).collect()} == {(1, 1), (3, 1), (5, 1), (8, 8), (9, 8), *((i, 16) for i in range(16, 21))}
    assert graph.components(links.limit(0)).count() == 0


def test_buckets_beyond_one_shuffle_are_worked_off_in_passes(spark, monkeypatch):
    rows = corpus(50, seed=15)
    docs = docs_of(spark, rows)
    runs_of = [lambda: substrings.remove_repeats([docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")], with_text=True, fanout=2), lambda: byte_repeats.remove_repeats(docs).drop("kept"), lambda: jaccard.jaccard_groups(docs)]
    want = [Counter(map(tuple, f().collect())) for f in runs_of]
    monkeypatch.setattr(frames, "PARTITIONS", 30)
    assert [Counter(map(tuple, f().collect())) for f in runs_of] == want


def test_numbers_of_buckets():
    class Sized:
        def __init__(self, size):
            self.size = size

    size_of, frames.plan_bytes = frames.plan_bytes, lambda df: df.size
    try:
        for size in (0, 1 << 20, 1 << 30, 1 << 36, 1 << 40, 100 << 40):
            n = frames.buckets_for(Sized(size), 1 << 20)
            assert n >= 64 and -(-size // n) <= 64 << 20 and (n <= 1 << 16 or size > 4 << 40)
    finally:
        frames.plan_bytes = size_of


def test_suffix_arrays_match_sorting():
    r = random.Random(3)
    for _ in range(60):
        strings = [[r.randrange(1, r.choice([2, 3, 5, 30]) + 1) for _ in range(r.randrange(40))] + [0] for _ in range(r.randrange(1, 20))]
        offsets = np.concatenate(([0], np.cumsum([len(s) for s in strings])))
        want = np.concatenate([offsets[q] + np.array(sorted(range(len(s)), key=lambda i: s[i:])) for q, s in enumerate(strings)])
        assert (suffix_groups.suffix_arrays(np.array(sum(strings, [])), offsets) == want).all()
    assert len(suffix_groups.suffix_arrays(np.zeros(0, int), np.zeros(1, int))) == 0


@pytest.mark.parametrize("span,k,longest", [(50, 24, 1 << 9), (50, 24, 60), (200, 24, 1 << 12), (50, 50, 1 << 9)])
def test_byte_repeats_match_brute_force(spark, span, k, longest, monkeypatch):
    """Equal contexts, near copies and overlaps; with strings of suffix arrays so short that anchors are split."""
    rows = corpus(60, seed=13)
    monkeypatch.setattr(byte_repeats, "LONGEST", longest)
    rows += [(200, rows[5][1]), (5, rows[5][1][300:900]), (201, "ab" * 100), (202, "xab" + "ab" * 60)]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in byte_repeats.remove_repeats(docs_of(spark, [*rows, (None, rows[5][1])]), span, k).collect())
    first = {}
    for i, t in sorted(rows, key=lambda x: x[0]):
        b = (t or "").encode()
        for j in range(len(b) - span + 1):
            first.setdefault(b[j : j + span], i)
    want = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = sorted({j for x in range(len(b) - span + 1) if first[b[x : x + span]] < i for j in range(x, x + span)})
        kept = bytes(x for j, x in enumerate(b) if j not in set(gone))
        want[i, len(b), len(gone), sum(1 for n, j in enumerate(gone) if n == 0 or gone[n - 1] != j - 1), hashlib.sha256(kept).hexdigest()] += 1
    b = rows[5][1].encode()
    want[None, len(b), 0, 0, hashlib.sha256(b).hexdigest()] += 1
    assert got == want


def test_windows_are_decided_by_bytes_where_hashes_agree(monkeypatch):
    monkeypatch.setattr(kernel, "bytes_hash", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    texts = [b"one string of bytes", b"two string of bytes", b"one string of bytes"]
    data, size = np.frombuffer(b"".join(texts), np.uint8), np.array([19, 19, 19])
    number, one = byte_repeats.distinct(data, np.array([0, 19, 38]), size, np.zeros(3, np.int64))
    assert number[0] == number[2] != number[1] and len(one) == 2
    gone = byte_repeats.decided(np.zeros(3, np.int64), np.array([4, 5, 6]), size, data, 10)
    want = [texts[1][i : i + 10] in texts[0] for i in range(10)]
    assert gone.tolist() == [False] * 10 + want + [True] * 10


def test_sketches(spark, rows):
    docs = docs_of(spark, rows).repartition(3)
    got = {r.doc_id: r for r in sketch.fingerprints(docs, buckets=128).collect()}
    ids = sorted(got)
    texts = {i: t or "" for i, t in rows}
    for k, i in enumerate(ids):
        t, n = texts[i], texts[ids[(k + 1) % len(ids)]]
        half = len(t) // 2
        assert got[i].n_chars == len(t) and got[i].edited == t[: len(t) - half] + n[:half]
        assert got[i].next_sketch == got[ids[(k + 1) % len(ids)]].sketch
        assert got[i].sketch.low == [h for h in shingle_hashes(t) if h < -(1 << 62)] and got[i].edited_sketch.low == [h for h in shingle_hashes(got[i].edited) if h < -(1 << 62)]
        assert got[i].sketch.all == (shingle_hashes(t) if len(words(t)) <= 68 else None)
    pair = spark.createDataFrame([(" ".join(str(k) for k in range(3000)), " ".join(str(k) for k in range(1000)))], "a string, b string")
    from pyspark.sql import functions as F

    s = sketch.with_sketch(sketch.with_sketch(pair, "a", "x"), "b", "y").select(sketch.containment(F.col("y"), F.col("x")).alias("in"), sketch.resemblance(F.col("x"), F.col("y")).alias("like"), F.size(sketch.merged(F.col("x"), F.col("y"))["low"]).alias("m"), F.size("x.low").alias("n")).first()
    assert s["in"] == 1.0 and abs(s["like"] - 1 / 3) < 0.08 and s["m"] == s["n"]


def shingle_hashes(text):
    """The hashes as the sketch takes them: xxhash64 of five words' xxhash64, each seeding the next."""
    fold = lambda h, w: xxhash.xxh64_intdigest(struct.pack("<Q", xxhash.xxh64_intdigest(w.encode(), seed=42)), seed=h)
    w = words(text)
    hashes = {functools.reduce(fold, w[i : i + 5], 42) for i in range(max(1, len(w) - 4))} if w else set()
    return sorted(h - (1 << 64) if h >> 63 else h for h in hashes)


def test_likeness_matches_brute_force(spark, rows):
    got = {r.doc_id: r for r in queries.sketch.fingerprints(docs_of(spark, rows)).collect()}
    ids = sorted(got)
    lows = lambda t: {h for h in shingle_hashes(t) if h < -(1 << 62)}

    def near(a, b):
        x, y = (set(shingle_hashes(t)) if len(words(t)) <= 68 else None for t in (a, b))
        if x is None or y is None:
            x, y = lows(a), lows(b)
            return len(x & y) / len(x | y) if x | y else None
        return len(x & y) / len(x | y) if x | y else 1.0

    from pyspark.sql import functions as F

    like = {r.doc_id: (r.e, r.n) for r in sketch.fingerprints(docs_of(spark, rows)).select("doc_id", sketch.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("e"), sketch.resemblance(F.col("sketch"), F.col("next_sketch")).alias("n")).collect()}
    texts = {i: t or "" for i, t in rows}
    for k, i in enumerate(ids):
        assert like[i] == (near(texts[i], got[i].edited), near(texts[i], texts[ids[(k + 1) % len(ids)]]))


def test_small_texts_are_found_inside_large_ones(spark):
    from pyspark.sql import functions as F

    r = random.Random(6)
    large = [f"w{r.randrange(10**6)}" for _ in range(2000)]
    rows = [(k, " ".join(large[k * 9 : k * 9 + 6]), " ".join(large)) for k in range(60)]
    df = sketch.with_sketch(sketch.with_sketch(spark.createDataFrame(rows, "i int, a string, b string"), "a", "x"), "b", "y")
    got = [r.c for r in df.select(sketch.containment(F.col("x"), F.col("y")).alias("c")).collect()]
    assert set(got) <= {1.0, None} and got.count(1.0) > 15


def test_order_keys_at_the_ends_of_their_range(spark):
    rows = [(-(1 << 63), "a b c d e"), ((1 << 63) - 1, "f g h i j"), (0, "k l m n o"), (None, "p q r s t"), (0, "k l m n o")]
    got = [(r.doc_id, r.edited) for r in sketch.fingerprints(docs_of(spark, rows)).collect()]
    order = [rows[3], rows[0], rows[2], rows[4], rows[1]]
    assert Counter(got) == Counter((i, t[:5] + order[(k + 1) % 5][1][:4]) for k, (i, t) in enumerate(order))


def test_mixing_rates(spark):
    docs = docs_of(spark, [(i, f"t{i}") for i in range(6000)])
    out = mixing.mixed(docs, {"src0": 3.0, "src1": 1.0, "src2": 0.0})
    assert set(docs.columns) < set(out.columns)
    n = Counter(r.source for r in out.collect())
    assert set(n) == {"src0", "src1"} and abs(n["src0"] / n["src1"] - 3) < 0.3 and abs(sum(n.values()) - 4000) < 250
    again = mixing.mixed(docs.repartition(7), {"src0": 3.0, "src1": 1.0})
    assert Counter(r.doc_id for r in again.collect()) == Counter(r.doc_id for r in out.collect())
    assert mixing.mixed(docs.limit(0)).count() == 0
    first, cuts = mixing.poisson_cuts(2.5)
    assert first == 0 and abs(cuts[0] - np.exp(-2.5)) < 1e-12 and cuts == sorted(cuts)


def test_poisson_cuts_of_any_mean():
    for mean in (0.01, 1.0, 50.0, 699.0, 746.0, 800.0, 5000.0, 1e6):
        first, cuts = mixing.poisson_cuts(mean)
        u = (np.arange(4000) + 0.5) / 4000
        n = first + np.searchsorted(cuts, u, "right")
        assert abs(n.mean() - mean) < 0.02 * mean + 0.01 and abs(n.var() - mean) < 0.1 * mean + 0.02, mean
    assert mixing.poisson_cuts(0.0) == (0, []) and mixing.poisson_cuts(-1.0) == (0, [])


def test_mixing_keeps_columns_and_null_sources(spark):
    rows = [(i, f"t{i}", None if i % 3 == 0 else "a", 1, 2, 3) for i in range(900)] + [(None, "x", "a", 1, 2, 3), (5, "t5", "a", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _u int, _n int, many int")
    out = mixing.mixed(docs)
    assert out.columns == [*docs.columns, "copy", "shuffle_key"]
    n = Counter(r.source for r in out.collect())
    assert n[None] > 200 and n["a"] > 400
    only = mixing.mixed(docs, {None: 1.0, "gone": 5.0}, rows=1000.0).collect()
    assert {r.source for r in only} == {None} and abs(len(only) - 1000) < 120
    high = mixing.mixed(docs.where("doc_id < 30"), {None: 1.0}, rows=8000.0).collect()
    assert abs(len(high) - 8000) < 600


def test_url_lists(spark):
    entries = spark.createDataFrame([("bad.example.com", "block", "2024-02-01"), ("bad.example.com", "allow", "2024-03-01"), ("example.com", "block", "2024-01-15"), (None, "block", "2024-01-01")], "host string, action string, listed string")
    captures = spark.createDataFrame([(1, "https://bad.example.com/x", "2024-01-10"), (2, "http://u@BAD.example.com:80/", "2024-02-10"), (3, "https://a.bad.example.com", "2024-03-01"), (4, "https://www.example.com/", "2024-01-20"), (5, None, "2024-01-20"), (6, "nonsense", "2024-01-20"), (7, "https://example.com", None), (2, "http://u@BAD.example.com:80/", "2024-02-10")], "page_id long, url string, fetched string")
    got = Counter((r.page_id, r.action, r.matched) for r in url_lists.judged(captures, entries).collect())
    assert got == Counter([(1, None, None), (2, "block", "bad.example.com"), (2, "block", "bad.example.com"), (3, "allow", "bad.example.com"), (4, "block", "example.com"), (5, None, None), (6, None, None), (7, None, None)])


def test_url_lists_know_parents_of_any_depth(spark):
    deep = ".".join(f"l{i}" for i in range(12)) + ".example.zip"
    entries = spark.createDataFrame([("zip", "block", 1), (deep.split(".", 1)[1], "allow", 1)], "host string, action string, listed int")
    captures = spark.createDataFrame([(1, f"http://{deep}/", 2), (2, "http://other.zip/", 2), (3, "http://zip/", 2), (4, "http://a.gzip/", 2)], "page_id int, url string, fetched int")
    got = {x.page_id: (x.action, x.matched) for x in url_lists.judged(captures, entries).collect()}
    assert got == {1: ("allow", deep.split(".", 1)[1]), 2: ("block", "zip"), 3: ("block", "zip"), 4: (None, None)}


def test_url_lists_as_of_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(url_lists, "SHARE", 5)  # so that names are dealt to several places
    r = random.Random(9)
    hosts = [".".join(r.choice(["a", "b", "c"]) for _ in range(r.randrange(1, 5))) + r.choice([".com", ".org"]) for _ in range(40)]
    entries = [(r.choice([*hosts, "com", "org", "A.com"]), r.choice(["block", "allow"]), r.randrange(50)) for _ in range(120)] + [(None, "block", 1), ("com", None, 1), ("com", "block", None)]
    captures = [(i, f"http://{r.choice(hosts)}/", r.randrange(60), "x", "y") for i in range(200)] + [(None, None, 3, "x", "y"), (900, "http://a.com", None, "x", "y"), (901, "", 3, "x", "y")]
    got = Counter(tuple(x) for x in url_lists.judged(spark.createDataFrame(captures, "page_id int, url string, fetched int, name string, place string"), spark.createDataFrame(entries, "host string, action string, listed int")).select("page_id", "action", "matched", "valid_from", "name", "place").collect())
    want = Counter()
    for i, url, t, name, place in captures:
        host = url[7:].rstrip("/") if url else ""
        best = None
        for h, action, listed in entries:
            if None not in (h, action, listed, t) and host and listed <= t and (host == h.lower() or host.endswith("." + h.lower())):
                best = max(filter(None, (best, (len(h), listed, action, h.lower()))))
        want[(i, best and best[2], best and best[3], best and best[1], name, place)] += 1
    assert got == want
    empty = url_lists.judged(spark.createDataFrame([], "page_id int, url string, fetched int"), spark.createDataFrame([], "host string, action string, listed int"))
    assert empty.count() == 0


def test_secret_scan(spark):
    found = secret_scan.made_findings(1200, seed=1)
    forest = secret_scan.fit(found)
    held = secret_scan.made_findings(400, seed=2)
    x = np.array([secret_scan.features(v.encode(), b.encode()[-48:], a.encode()[:48]) for v, b, a, _ in held])
    right = (forest.probability(x) >= 0.5) == np.array([y == 1 for *_, y in held])
    assert right.mean() > 0.95
    key = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"
    docs = docs_of(spark, [(1, f'é token = "{key}" end'), (2, None), (3, ""), (4, "see /usr/lib/module/file12345 here"), (5, "a1" * 300), (1, f'é token = "{key}" end')])
    got = secret_scan.scan(docs, forest).collect()
    hits = [r for r in got if r.probability >= 0.5]
    assert [(r.doc_id, r.start, r.n_chars) for r in hits] == [(1, 11, 40)] * 2
    assert hits[0].value_sha256 == hashlib.sha256(key.encode()).hexdigest() and 5 in {r.doc_id for r in got}


def test_secret_candidates_of_any_length_and_kind():
    texts = ["password = 'correcthorse' end", "x=" + "a1" * 400 + "== tail", "token=abc123def456ghij7890 z", "secret: ", "hunter2", "api_key: \"K!9$#x\"", "PASSWORD", "= notassigned here", None, ""]
    part = next(kernel.slices(pa.array(texts)))
    got = [(int(i), part.data[a:b].tobytes().decode()) for i, a, b in zip(*secret_scan.candidates(part), strict=True)]
    assert got == [(0, "correcthorse"), (1, "a1" * 400 + "=="), (2, "abc123def456ghij7890"), (5, "K!9$#x")]


def test_secret_candidates_do_not_hang_on_neighbours():
    texts = ["my password:", "token=hunter2xyz more", "password=abcdefgh", "", None, "  ", "= \"quoted77\"", "api_key: ", "secret", " := 'a b c d e f g'", "pwd='x" + "é" * 9 + "'", "see token", "\n", ":=zzzzzzzz", "a1" * 20, "a1" * 20, "key_" + "9" * 14]
    found = lambda some: [(int(i), part.data[a:b].tobytes()) for part in kernel.slices(pa.array(some, pa.string())) for i, a, b in zip(*secret_scan.candidates(part), strict=True)]
    alone = {i: [v for _, v in found([t])] for i, t in enumerate(texts)}
    assert alone[1] == [b"hunter2xyz"] and alone[2] == [b"abcdefgh"]
    for i, t in enumerate(texts):
        for j, u in enumerate(texts):
            assert found([t, u]) == [(0, v) for v in alone[i]] + [(1, v) for v in alone[j]]
    assert found(texts) == [(i, v) for i in alone for v in alone[i]]


def test_secret_scan_is_the_same_for_any_partitioning(spark):
    r = random.Random(9)
    parts = ["my password:", "token=hunter2xyz more", "password=abcdefgh", "", "= \"quoted77\"", "commit 0123456789abcdef0123456789abcdef", "api_key"]
    docs = docs_of(spark, [(i, r.choice(parts)) for i in range(300)])
    forest = secret_scan.fit(secret_scan.made_findings(400))
    one, many = (sorted(map(tuple, secret_scan.scan(docs.repartition(n), forest).collect())) for n in (1, 64))
    assert one == many and len(one) > 100


def test_object_stores_are_read_by_their_own_names():
    from tessera.llm import text_files

    for uri in ("s3a://bucket/some/where", "s3n://bucket/some/where"):
        store, root = text_files.store(f"{uri}?region=eu-west-1")
        assert store.type_name == "s3" and root == "bucket/some/where"
    assert "FileSystem.from_uri" not in open(token_files.__file__).read()


def test_secret_scan_learns_from_documents(spark):
    r = random.Random(4)
    key = lambda: "".join(r.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, f"some words {'token = ' if i % 2 else 'commit '}{chr(34) if i % 2 else ''}{key()}{chr(34) if i % 2 else ''} and more") for i in range(200)]
    docs = docs_of(spark, rows)
    found = secret_scan.labelled(docs)
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert len(found) == 200 - len(held) and {y for *_, y in found} == {0, 1}
    hits = {x.doc_id for x in secret_scan.scan(docs, secret_scan.fit(found)).collect() if x.probability >= 0.5}
    assert hits & held == {i for i in held if i % 2}
    assert secret_scan.scan(docs, secret_scan.fit([])).where("probability > 0").count() == 0


@pytest.mark.parametrize("run", [
    lambda s, d: token_files.read_tokens(s, (f := frames.scratch(s, "none"), token_files.write_tokens(d, f, queries.tokenizer_path(), 2))[0]),
    lambda s, d: decontaminate.decontaminate(d, s.createDataFrame([], "item_id long, text string")),
    lambda s, d: jaccard.jaccard_groups(d), lambda s, d: substrings.remove_repeats([d]), lambda s, d: byte_repeats.remove_repeats(d),
    lambda s, d: sketch.fingerprints(d), lambda s, d: secret_scan.scan(d, secret_scan.Forest([])),
])
def test_empty_tables(spark, run):
    assert run(spark, docs_of(spark, []).where("doc_id IS NOT NULL")).count() == 0
