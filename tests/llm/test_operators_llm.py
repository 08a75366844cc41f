"""The training-data operators against brute force, on small inputs with every awkward case."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import bpe, fixity, kneser_ney, mixing, quality, secrets, sharding, simhash, tokencount, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("fp", "component_id", "size", "n_words", "n_symbols", "spans", "position", "nth", "blob", "shard", "slot", "target", "ids", "perplexity", "key", "bin", "rules", "group", "mark", "mix_id", "identity", "lists", "found_blob")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts() -> list:
    rnd = random.Random(11)
    words = ["alpha", "Beta", "gamma,", "déjà", "漢字", "it's", "x1", "the", "of", "a", "password:", "token", "=", "***", "<|endoftext|>"]
    base = " ".join(rnd.choice(words) for _ in range(400))
    near = base.split(" ")
    out = [None, "", " \n\t ", "one", "two words", "AB ab aB", "x" * 30000, base, base, base + " tail", " ".join(near[:-1]), "\n".join(["same line"] * 40)]
    out += ["a b c d e f g h i j k l m n o p " * 200, "no-break space is a word char", "é \U0001f600 " * 50, "\x1c\x85 odd", " " * 5000 + "x"]
    out += ['password = "hunter22" token:abc token : a.b-c_d', "AKIA" + "A1" * 8 + " AKIASHORT " + "0f" * 12 + "g" + "0f" * 11, "Secret=" + "z" * 50 + " éé api_key='12345678'", "tokentoken=token:abcdefg"]
    out += [" ".join(rnd.choice(words) + str(rnd.randrange(30)) for _ in range(rnd.randrange(1, 300))) for _ in range(60)]
    out += [out[-1]] * 9 + [out[-2]]
    return out


@pytest.fixture(scope="module")
def rows():
    langs, sources = ["en", "de", None], ["s0", "s1", "s2", "S", None, "s0", "s0"]
    made = [(i, t, langs[i % 3], sources[i % 7], len(t or "")) for i, t in enumerate(texts())]
    return made + [made[8]]  # a repeated row


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit(f"clash {c}") for c in CLASHES})


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def got(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(low)
    if not w:
        return 0
    parts = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, rows, none):
    fps = [fingerprint(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    want = sorted(((r[0], fps[i], least[find(i)]) for i, r in enumerate(rows)), key=str)
    found = simhash.near_duplicates(docs)
    assert sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in found.collect()), key=str) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == set(least.values())
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_links_in_crowded_fields(spark):
    rnd = random.Random(4)
    codes = set()
    for _ in range(3):
        centre = rnd.getrandbits(64)
        for _ in range(1500):
            x = centre
            for b in rnd.sample(range(64), rnd.randrange(9)):
                x ^= 1 << b
            codes.add(x)
    codes = np.array(sorted(codes), np.uint64)
    edges = simhash.links(spark.createDataFrame([(int(x),) for x in codes.view(np.int64)], "fp long")).distinct().collect()
    place = {int(x): i for i, x in enumerate(codes.view(np.int64))}

    def components(pairs):
        parent = list(range(len(codes)))

        def find(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for a, b in pairs:
            parent[find(a)] = find(b)
        groups = {}
        for i in range(len(codes)):
            groups.setdefault(find(i), []).append(i)
        return sorted(map(tuple, groups.values()))

    real = [(i, int(j) + i + 1) for i in range(len(codes)) for j in np.nonzero(np.bitwise_count(codes[i] ^ codes[i + 1 :]) <= 2)[0]]
    assert components([(place[e["u"]], place[e["v"]]) for e in edges]) == components(real)


def test_simhash_tree_prunes_and_loses_nothing():
    """The tree against all pairs, in narrow and wide codes; most node pairs go above the codes."""
    rnd = np.random.default_rng(1)
    for words, radius, flips in ((1, 2, 4), (4, 72, 60)):
        made = []
        for centre in rnd.integers(0, 2**63, (6, words)).astype(np.uint64):
            for _ in range(200):
                x = centre.copy()
                for bit in rnd.integers(0, 64 * words, rnd.integers(0, flips)):
                    x[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
                made.append(x)
        codes, fields = np.array(made), rnd.integers(0, 3, len(made))
        order = np.lexsort((simhash.gray_rank(codes[:, 0]), fields))
        codes, fields = codes[order], fields[order]
        tree, visits, found = simhash.Tree(fields, codes), [], {}
        for x, y, apart in simhash.descend(tree, tree, radius, visits):
            found |= dict(zip(zip(x.tolist(), y.tolist(), strict=True), apart.tolist(), strict=True))
        apart = np.bitwise_count(codes[:, None] ^ codes[None]).sum(2)
        near = np.triu((apart <= radius) & (fields[:, None] == fields[None]), 1)
        assert found == {(int(i), int(j)): int(apart[i, j]) for i, j in zip(*np.nonzero(near), strict=True)}
        above_codes = sum(dropped for _, dropped in visits[:-1])
        everything = sum(n * (n - 1) // 2 for n in Counter(fields.tolist()).values())
        assert above_codes > 0 and visits[-1][0] < everything
        one, other = (simhash.Tree(np.zeros(len(c), np.int64), c) for c in (codes[:500], codes[500:]))
        across = {(i, j) for x, y, _ in simhash.descend(one, other, radius) for i, j in zip(x.tolist(), y.tolist(), strict=True)}
        assert across == set(zip(*(z.tolist() for z in np.nonzero(apart[:500, 500:] <= radius)), strict=True))


@pytest.mark.parametrize("branch", [5, 1 << 14])
def test_simhash_index_over_tasks(spark, monkeypatch, branch):
    """Fields cut into branches and spread over tasks, wide codes, equal codes of different ids."""
    monkeypatch.setattr(simhash, "BRANCH", branch)
    monkeypatch.setattr(simhash, "UP", 1)
    rnd = random.Random(8)
    rows = []
    for centre in (rnd.getrandbits(128) for _ in range(8)):
        for _ in range(25):
            x = centre
            for bit in rnd.sample(range(128), rnd.randrange(25)):
                x ^= 1 << bit
            rows += [(f, x) for f in rnd.sample(range(4), 2)] if rnd.random() < 0.9 else [(9, x), (9, x)]
    rows = [(f, i // 2, x) for i, (f, x) in enumerate(rows)]
    packed = [(f, i, bytearray(x.to_bytes(16, "little"))) for f, i, x in rows]
    df = spark.createDataFrame(packed, "field long, id long, code binary").withColumn("rank", F.conv(F.hex(F.reverse(F.substring("code", 1, 1))), 16, 10).cast("long")).repartition(3)
    got_pairs = {(r["u"], r["v"]) for r in simhash.index_links(df, 2, 12).collect()}
    near = {tuple(sorted((i, j))) for f, i, x in rows for g, j, y in rows if f == g and i != j and (x ^ y).bit_count() <= 12}

    def components(pairs):
        top = {i: i for _, i, _ in rows}

        def find(i):
            while top[i] != i:
                i = top[i]
            return i

        for a, b in pairs:
            a, b = sorted((find(a), find(b)))
            top[b] = a
        return {i: find(i) for i in top}

    assert components(got_pairs) == components(near)


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))


@pytest.mark.parametrize("chunk", [bpe.CHUNK, (4, 16, 64)])
def test_bpe(docs, rows, none, library, chunk):
    found = bpe.encode(docs, chunk=chunk)
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got(found, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)
    assert got(bpe.decode(found), "doc_id", "text") == sorted(((r[0], r[1] or "") for r in rows), key=str)
    assert bpe.encode(none).count() == 0


def test_bpe_with_a_full_bitmap(docs, rows):
    """All chunks taken for shared: the other path alone gives the same."""
    assert got(bpe.encode(docs, bits=64), "doc_id", "ids_sha256") == got(bpe.encode(docs), "doc_id", "ids_sha256")


def test_bpe_join_at_any_place(library):
    rnd = random.Random(9)
    path = __import__("public_tokenizers").path(bpe.VOCABULARY)
    more = ["漢字、仮名。文字，" * 300, "字" * 3000, "0123456789abcdef" * 300, "a\n\n b \t c  " * 300, "don't 'twas <|endoftext|> x<|endof" * 50, "\u3000\u00a0x \x85y" * 100]
    for text in [*filter(None, texts()), *more]:
        text = text[:3000]
        for n in (1, 5, 60):
            at = sorted({0, len(text), *(rnd.randrange(len(text) + 1) for _ in range(n))})
            parts = [bpe.encode_text(path, text[a:b]) for a, b in zip(at, at[1:], strict=False)]
            assert bpe.join(path, parts) == library.encode(text, add_special_tokens=False).ids


def test_bpe_join_is_linear():
    """Twice the text takes about twice the time, and little more than encoding it."""
    import time

    path = __import__("public_tokenizers").path(bpe.VOCABULARY)
    rnd = random.Random(3)
    text = " ".join("".join(rnd.choice("etaoinshr") for _ in range(rnd.randrange(2, 9))) for _ in range(500000))
    raw = text.encode()
    parts, begin = [], 0
    for end in bpe.cuts(raw):
        parts.append(bpe.encode_text(path, raw[begin:end].decode()))
        begin = end
    began = time.process_time()
    whole = bpe.encode_text(path, text)
    direct = time.process_time() - began
    began = time.process_time()
    assert bpe.join(path, parts) == whole
    assert len(parts) > 1000 and time.process_time() - began < 3 * direct + 0.5


def test_sharding(docs, rows, none):
    found = sharding.shard(docs).collect()
    assert len(found) == len(rows)
    size = {r[0]: len((r[1] or "").encode()) + 1 for r in rows}
    text = {r[0]: r[1] or "" for r in rows}
    where, sums, slots = {}, Counter(), {}
    for r in found:
        assert r["size"] == size[r["doc_id"]] and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode())
        assert where.setdefault(text[r["doc_id"]], r["shard"]) == r["shard"]  # equal texts stay together
        sums[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(sums) <= set(range(8)) and sum(sums.values()) == sum(size[r[0]] for r in rows)
    assert sharding.shard(none).count() == 0


def test_differencing_places_what_it_sums():
    rnd = np.random.default_rng(0)
    sizes = rnd.integers(1, 1000, 300)
    parts = np.zeros((300, 8), np.int64)
    parts[:, 0] = sizes
    sums, place = sharding.difference(parts)
    assert (np.bincount(place[:, 0], sizes, 8) == sums).all()
    assert sums.max() - sums.min() <= 2
    assert (np.sort(place, axis=1) == np.arange(8)).all()


@pytest.mark.parametrize("n, fan_in, levels", [(700, 1000, 1), (700, 200, 2), (700, 20, 3), (700, 10, 3), (5000, 16, 4)])
def test_sharding_in_levels(spark, monkeypatch, n, fan_in, levels):
    """However many levels: each unit once, and shards within 1 % of each other."""
    calls = []
    monkeypatch.setattr(sharding, "staged", lambda df, label, held=sharding.staged: calls.append(label) or held(df, label))
    rnd = random.Random(1)
    units = [(hashlib.sha256(str(i).encode()).digest(), rnd.randrange(1, 5000)) for i in range(n)]
    df = spark.createDataFrame([(bytearray(u), s) for u, s in units], "unit binary, size long").repartition(2)
    rows = sharding.balance(df, fan_in=fan_in).collect()
    found = {bytes(r["unit"]): r["shard"] for r in rows}
    sums = Counter()
    for u, s in units:
        sums[found[u]] += s
    assert calls.count("shard-level") == levels
    assert len(rows) == len(found) == n and max(sums.values()) - min(sums.values()) <= 0.01 * sum(sums.values()) / 8


def test_sharding_over_levels_with_hot_groups(spark, monkeypatch):
    """``shard`` itself over several levels and salts: a row each, equal texts together, even shards, gapless slots."""
    monkeypatch.setattr(sharding, "SALT", 10)
    monkeypatch.setattr(sharding, "SLOT_ROWS", 7)
    monkeypatch.setattr(sharding, "SLOT_BINS", 3)
    monkeypatch.setattr(sharding.balance, "__defaults__", (8, 20))
    rnd = random.Random(4)
    made = [(i, "hot" if i % 3 == 0 else "x" * rnd.randrange(200) + str(i)) for i in range(600)] + [(0, "hot"), (None, "hot"), (None, None)]
    found = sharding.shard(spark.createDataFrame(made, "doc_id long, text string").repartition(4)).collect()
    assert len(found) == len(made)
    sums, slots, where = Counter(), {}, {}
    for r in found:
        sums[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert where.setdefault(bytes(r["group"]), r["shard"]) == r["shard"]
    assert sum(sums.values()) == sum(len(t or "") + 1 for _, t in made)
    assert max(sums.values()) - min(sums.values()) <= 200  # one ordinary group
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def water(sizes: dict) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    while True:
        rest = total - sum(target.values())
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        target |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over


def test_mixing(docs, rows, none):
    n = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += n[r[0]]
    want = water(sizes)
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    taken = Counter()
    for r in found:
        assert r["size"] == n[r["doc_id"]] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9)
        assert 0 <= r["copies"] <= 3 and sorted(r["positions"]) == r["positions"] and all(0 <= p <= 1 for p in r["positions"])
        taken[r["source"]] += r["copies"] * r["size"]
    longest = max(n.values())
    assert all(abs(taken[s] - want[s]) <= longest for s in sizes)
    order = mixing.training_order(docs)
    assert order.columns == docs.columns
    assert sorted(Counter(r["doc_id"] for r in order.collect()).items()) == sorted(Counter({k: v for k, v in sum((Counter({r["doc_id"]: r["copies"]}) for r in found), Counter()).items() if v}).items())
    assert got(mixing.mix(docs.repartition(7)), "doc_id", "copies") == got(mixing.mix(docs), "doc_id", "copies")
    assert mixing.mix(none).count() == 0 and mixing.training_order(none).count() == 0


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_quality_measures_and_rules(spark, docs, rows, none):
    for r in rows:
        assert quality.measure(r[1])[:5] == measures(r[1])
    rnd = random.Random(2)
    good = [(1000 + i, " ".join(f"w{rnd.randrange(5000)}" for _ in range(60)), "en", "s", 0) for i in range(300)]
    bad = [(2000 + i, " ".join(f"w{rnd.randrange(5000)}###" for _ in range(60)), "en", "s", 0) for i in range(100)]
    more = spark.createDataFrame(good + bad, SCHEMA)
    marks = [(r[0], 1, 0) for r in good] + [(r[0], 0, 0) for r in bad] + [(None, 0, 0), (999999, 0, 0), (1, None, None)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    rules = quality.train(more, labels)
    assert rules and all(rule.precision >= quality.LEAST_PRECISION for rule in rules)
    kept = {r["doc_id"] for r in quality.keep_good(more, labels).collect()}
    assert {r[0] for r in good} <= kept and len([i for i in kept if i >= 2000]) <= 5
    judged = quality.keep_good(docs, labels)
    assert judged.columns == docs.columns
    want = {r[0] for r in rows if not (measures(r[1])[0] < 10 or 100 * measures(r[1])[4] > 20 * measures(r[1])[0])}
    assert {r["doc_id"] for r in quality.keep_good(docs, labels.limit(0)).collect()} == want
    assert quality.keep_good(none, labels).count() == 0


def test_quality_windows_over_large_vocabularies():
    rnd = random.Random(0)
    words = [f"v{i}" for i in range(7000)]
    words += words[100:107] + [rnd.choice(words) for _ in range(50)]
    assert quality.repeated_words(words) == measures(" ".join(words))[4]


def test_viterbi_counts(docs, rows, none):
    import public_tokenizers
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces, unknown = tokencount.vocabulary(public_tokenizers.path(tokencount.VOCABULARY))
    library = Tokenizer(models.Unigram(pieces, unknown, False))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids) if t else 0
    assert got(tokencount.token_counts(docs), "doc_id", "n_tokens") == sorted(((r[0], count(r[1])) for r in rows), key=str)
    rnd = random.Random(7)
    mine, letters = tokencount.counter(public_tokenizers.path(tokencount.VOCABULARY)), [*"abcdeé ñ\n\t漢字▁ <0x41>", "the", "ing", "<unk>", "<s>", "\U0001f600"]
    for _ in range(1500):
        t = "".join(rnd.choice(letters) for _ in range(rnd.randrange(40)))
        assert mine(t) == count(t), t
    assert tokencount.token_counts(none).count() == 0


def test_merkle_audit(spark, tmp_path):
    pages = [(i, f"http://h/{i}", "é" * (i % 50) + "<p>") for i in range(3000)] + [(None, None, None), (5, "http://h/5", "dup"), (5, "http://h/5", "dup")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("offset", F.lit("clash"))
    records = df.select("page_id", fixity.record(df).alias("record"))
    cut = fixity.layout(records, fixity.damaged(records))
    a, b = fixity.leaves(records, cut), fixity.leaves(fixity.damaged(records), cut)
    found, roots = fixity.audit(a, b)
    one, two = ({(r["segment"], r["part"], r["slot"]): r["hash"] for r in x.collect()} for x in (a, b))
    assert {(r["segment"], r["part"], r["slot"]) for r in found.collect()} == {k for k in one.keys() | two.keys() if one.get(k) != two.get(k)}
    assert 0 < found.count() < 3000
    same, _ = fixity.audit(a, a)
    assert same.count() == 0
    lost, _ = fixity.audit(a, a.where("not (segment = 1 and slot = 7)"))
    assert got(lost, "segment", "part", "slot") == [(1, 0, 7)]
    offsets = sorted((r["segment"], r["part"], r["slot"], r["offset"], r["length"]) for r in a.collect())
    assert all(x[3] + x[4] == y[3] for x, y in zip(offsets, offsets[1:], strict=False) if x[:2] == y[:2])
    empty = records.limit(0)
    assert fixity.audit(fixity.leaves(empty), fixity.leaves(empty))[0].count() == 0
    fixity.write_warc(df, str(tmp_path / "warc"), 500)
    back = fixity.read_warc(spark, str(tmp_path / "warc"))
    assert sorted((r["uri"], r["payload"].decode()) for r in back.where("error is null").collect()) == sorted((u or "", h or "") for _, u, h in pages)


def test_merkle_audit_of_crowded_ids(spark, monkeypatch):
    """Null ids and one repeated id: several parts, more levels, the same verdicts as record by record."""
    monkeypatch.setattr(fixity, "SEGMENT", 64)
    monkeypatch.setattr(fixity, "FAN_OUT", 4)
    rows = [(None, f"u{i}", f"null {i}") for i in range(900)] + [(7, f"u{i}", f"seven {i}") for i in range(600)] + [(i, "u", f"{i}") for i in range(100, 400)] + [(8, "u", "same")] * 130
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    records = df.select("page_id", fixity.record(df).alias("record"))
    cut = fixity.layout(records)
    assert got(cut, "range", "parts") == [(-1, 15), (0, 12)]
    a = fixity.leaves(records, cut)
    bad = records.withColumn("record", F.when(F.col("record").contains("null 17\r") | F.col("record").contains("seven 3\r"), F.lit("gone")).otherwise(F.col("record")))
    b = fixity.leaves(bad, cut)
    one, two = ({(r["segment"], r["part"], r["slot"]): r["hash"] for r in x.collect()} for x in (a, b))
    assert len(one) == len(set(rows)) and max(k[2] for k in one) > 64
    assert {(r["copies"], r["length"] % 130) for r in a.where("page_id = 8").collect()} == {(130, 0)}
    found, roots = fixity.audit(a, b)
    assert {(r["segment"], r["part"], r["slot"]) for r in found.collect()} == {k for k in one.keys() | two.keys() if one.get(k) != two.get(k)}
    assert 2 <= roots.where("not (root_a <=> root_b)").count() <= 4  # the parts that hold them, before or after
    assert roots.count() > 25 and fixity.height(a, b) == 4


def test_warc_records_that_do_not_parse(spark, tmp_path):
    import gzip

    def rec(head: str, body: bytes) -> bytes:
        return f"WARC/1.0\r\n{head}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    info, odd, cut = rec("WARC-Type: warcinfo\r\n", b"x: y"), rec("WARC-Type: response\r\nWARC-Target-URI: http://a/\r\n", b"\xff\x00\r\n\r\n"), rec("WARC-Target-URI: http://b/\r\n", b"whole")
    (tmp_path / "a.warc").write_bytes(info + odd + cut[:-6])
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(odd) + gzip.compress(cut)[:-12])
    (tmp_path / "c.warc").write_bytes(odd + b"noise")
    (tmp_path / "d.warc").write_bytes(b"")
    found = {}
    for r in fixity.read_warc(spark, str(tmp_path)).orderBy("file", "offset").collect():
        found.setdefault(r["file"][-len("x.warc") :] if r["file"].endswith("warc") else "gz", []).append((r["type"], r["uri"], bytes(r["payload"]), r["error"]))
    good = [("warcinfo", None, b"x: y", None), ("response", "http://a/", b"\xff\x00\r\n\r\n", None)]
    assert found["a.warc"][:2] == good and found["a.warc"][2] == (None, "http://b/", b"who", "truncated: 3 of 5 bytes")
    assert found["gz"][:2] == good
    assert found["c.warc"] == [good[1], (None, None, b"noise", "no record header")] and "d.warc" not in found


def test_top_inner_products(spark):
    rnd = np.random.default_rng(3)
    base = rnd.normal(size=(2600, 12)) * rnd.random((2600, 1))
    base[100:140] = base[100]  # ties
    vecs = [(int(i), [float(x) for x in v]) for i, v in enumerate(base)]
    vecs += [(5000, None), (5050, [1.0, None] + [0.0] * 10), (5100, [math.nan] * 12), (5150, [math.inf] + [0.0] * 11), (None, [1.0] * 12), (5200, [1.0, 2.0]), (5250, [])]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>").withColumns({"rank": F.lit(1), "score": F.lit("x")}).repartition(3)
    whole = topk.integers(df)
    found = topk.top_inner_products(whole, whole.where("vec_id % 50 = 0"), head=4)
    ids = [*range(2600), 5200, 5250]
    x = np.zeros((len(ids), 12), np.int64)
    x[:2600] = np.floor(256 * base)
    x[2600, :2] = [256, 512]
    want = []
    for q, i in enumerate(ids):
        if i % 50 == 0:
            s = x @ x[q]
            order = sorted((-int(s[j]), ids[j]) for j in range(len(ids)) if j != q)[:5]
            want += [(i, k, j, -t) for k, (t, j) in enumerate(order, 1)]
    assert got(found, "query_id", "rank", "vec_id", "score") == sorted(want, key=str)
    none = topk.integers(df.limit(0))
    assert topk.top_inner_products(none, none).count() == 0
    few = topk.integers(df.where("vec_id in (0, 1, 2)").withColumns({"block": F.lit(1), "stripe": F.lit(2), "v": F.lit("x"), "norm2": F.lit("y")}))
    assert topk.top_inner_products(few, few.where("vec_id = 0")).count() == 2


def test_top_inner_products_skips_short_blocks():
    """On skewed lengths whole blocks go, the best stay; ties to the smaller id."""
    rnd = np.random.default_rng(5)
    x = np.floor(256 * rnd.normal(size=(3000, 8)) * (1.0 / (1 + np.arange(3000)))[:, None]).astype(np.int64)
    x[40:60] = x[40]
    ids = rnd.permutation(3000).astype(np.int64)
    turned = x.astype(float)
    block = topk.QueryBlock(ids[:50], x[:50], turned[:50], np.full(50, -np.inf), 3, 5)
    order = np.argsort(-(turned**2).sum(1), kind="stable")
    for at in range(0, 3000, 100):
        part = order[at : at + 100]
        block.meet(float(np.sqrt((turned[part] ** 2).sum(1)).max()), ids[part], x[part], turned[part])
    assert block.skipped > 10 and 0 < block.scored < 50 * 3000 / 4
    for i in range(50):
        s = x @ x[i]
        want = sorted((-int(s[j]), int(ids[j])) for j in range(3000) if j != i)[:5]
        assert list(zip((-block.scores[i]).tolist(), block.found[i].tolist(), strict=True)) == want


BASE = [
    ("assign", re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile("[0-9a-f]+"), 0, 24),
]


def base_spans(text):
    found = [(m.start(), i, m.end(), kind) for i, (kind, p, g, least) in enumerate(BASE) for m in p.finditer(text or "") if len(m[g]) >= least]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


def test_secrets(spark, docs, rows, none):
    ledger = secrets.Ledger(spark)
    found, name = secrets.with_spans(docs, ledger=ledger)
    assert name == "spans_"
    for r in found.collect():
        spans = [f"{s['kind']}:{s['first']}:{s['last']}" for s in r[name] or [] if s["place"] < 3]
        assert spans == base_spans(r["text"]), r["text"][:80]
    blobs = ledger.seen().count()
    assert blobs == len({r[1] or "" for r in rows})
    secrets.scan(docs, ledger)
    assert ledger.seen().count() == blobs  # nothing is scanned twice
    newer = (*secrets.RULES[:-1], secrets.Rule("jwt", 3, "eyJ[a-z]+"))
    secrets.scan(docs, ledger, newer)
    assert ledger.seen().count() == 2 * blobs
    assert {tuple(r["rules"]) for r in ledger.seen().collect()} == {tuple(r.key for r in secrets.RULES), ("jwt@3",)}
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns
    text = {r[0]: r[1] for r in rows}
    for r in clean.collect():
        before = text[r["doc_id"]]
        if before is None:
            assert r["text"] is None
            continue
        want = list(before)
        for s in base_spans(before):
            _, a, b = s.split(":")
            want[int(a) : int(b)] = "*" * (int(b) - int(a))
        assert len(r["text"]) == len(before) and (r["text"] == "".join(want) or "eyJ" in before)
    assert secrets.scan(none, secrets.Ledger(spark)).count() == 0


def test_secrets_in_hostile_runs(spark):
    """Long runs that begin like a token and never end as one take time in proportion to their length."""
    import time

    took = []
    for n in (50_000, 200_000):
        hostile = ["eyJ" * n, "eyJ" * 300 + "." + "a" * n, "-----BEGIN " + "A " * n, "password" * (n // 4), "ghp_" * n, "0f" * 11 * (n // 22) + "g"]
        df = spark.createDataFrame([(i, t) for i, t in enumerate(hostile)], "doc_id long, text string")
        began = time.time()
        secrets.scan(df, secrets.Ledger(spark)).count()
        took.append(time.time() - began)
    assert took[1] < 30, took


def test_secrets_by_the_second_scan(spark, monkeypatch):
    """The second scan of the same texts runs no rule; a new text and its copy are scanned once."""
    calls = []
    held = secrets._scan
    monkeypatch.setattr(secrets, "_scan", lambda texts, rules: calls.append(sorted(r["text"] for r in texts.select("text").collect())) or held(texts, rules))
    ledger = secrets.Ledger(spark)
    schema = "doc_id long, text string"
    first = spark.createDataFrame([(1, "token: abcdefg"), (2, "token: abcdefg"), (None, "x"), (3, None)], schema)
    one = sorted(map(str, secrets.scan(first, ledger).collect()))
    assert sorted(map(str, secrets.scan(first, ledger).collect())) == one and len(one) == 1
    more = spark.createDataFrame([(1, "token: abcdefg"), (1, "AKIA" + "B2" * 8), (7, "AKIA" + "B2" * 8)], schema)
    assert secrets.scan(more, ledger).count() == 2
    assert calls == [["", "token: abcdefg", "x"], ["AKIA" + "B2" * 8]]


class BruteKneserNey:
    """Interpolated modified Kneser-Ney by dictionaries, straight from the formula."""

    def __init__(self, texts: list, order: int):
        self.order = order
        self.levels = {order: Counter(g for t in texts for g in self.grams(t))}
        for k in range(order, 1, -1):
            self.levels[k - 1] = Counter(g[1:] for g in self.levels[k])
        self.given = {}
        for k, level in self.levels.items():
            n = Counter(level.values())
            y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
            d = tuple(i - (i + 1) * y * n[i + 1] / n[i] for i in (1, 2, 3)) if n[1] and n[2] and n[3] else kneser_ney.DISCOUNTS
            self.given[k] = d if all(0 < x < i + 1 for i, x in enumerate(d)) else kneser_ney.DISCOUNTS

    def grams(self, text):
        t = chr(kneser_ney.EDGE) * (self.order - 1) + (text or "") + chr(kneser_ney.EDGE)
        return [t[i : i + self.order] for i in range(len(t) - self.order + 1)]

    def p(self, gram):
        if not gram:
            return kneser_ney.UNIFORM
        level, d = self.levels[len(gram)], self.given[len(gram)]
        same = [c for g, c in level.items() if g[:-1] == gram[:-1]]
        if not same:
            return self.p(gram[1:])
        lost = lambda c: d[min(c, 3) - 1] if c else 0
        return (level[gram] - lost(level[gram])) / sum(same) + sum(map(lost, same)) / sum(same) * self.p(gram[1:])

    def measures(self, text):
        logs = [math.log(self.p(g)) for g in self.grams(text)]
        units, begin = [], 0
        for i, c in enumerate([*(text or ""), " "]):
            if c in " \t\n\v\f\r":
                units.append(logs[begin : i + 1])
                begin = i + 1
        passages = [sum(units[i : i + 8], []) for i in range(0, len(units), 8)]
        worst = lambda parts, least: max((-sum(x) / len(x) for x in parts if len(x) >= least), default=None)
        return -sum(logs) / len(logs), worst(passages, 20), worst(units, 5)


@pytest.mark.parametrize("cache, slots", [(1 << 19, 1 << 20), (7, 1 << 20), (200, 64), (0, 64)])
def test_kneser_ney_by_the_formula(spark, monkeypatch, cache, slots):
    """Counts, probabilities and measures against dictionaries, whatever share of the n-grams the cache holds."""
    monkeypatch.setattr(kneser_ney, "HELD", 50)
    monkeypatch.setattr(kneser_ney, "STEP", 300)
    rnd = random.Random(2)
    words = ["ab", "ba", "abba", "漢字", "漢", "é\U0001f600", "c"]
    fitted = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 12))) for _ in range(12)]
    others = [None, "", " \n", "zz zz zzzz", "字漢 abab\tab", " ".join(rnd.choice([*words, "漢字漢字漢字", "xyzzyx"]) for _ in range(40)), fitted[0]]
    rows = [(i, t, True) for i, t in enumerate(fitted)] + [(100 + i, t, False) for i, t in enumerate(others)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fits boolean").repartition(3)
    brute = BruteKneserNey(fitted, kneser_ney.ORDER)
    grams = kneser_ney.counts(docs)
    assert {r["gram"]: r["c"] for r in grams.where("c > 0").collect()} == dict(brute.levels[kneser_ney.ORDER])
    assert {r["gram"]: r["seen"] for r in grams.collect()} == dict(Counter(g for _, t, _ in rows for g in brute.grams(t)))
    model = kneser_ney.fit(grams.where("c > 0").select("gram", "c"))
    lps = kneser_ney.log_probabilities(grams, model)
    found = {r["gram"]: r["lp"] for r in lps.collect()}
    assert found == pytest.approx({g: math.log(brute.p(g)) for g in found})
    held = sorted(found)[:cache]
    table_ = kneser_ney.Cache(held, np.array([found[g] for g in held]), slots)
    for r in kneser_ney.measured(docs, lps, table_).collect():
        want = brute.measures({i: t for i, t, _ in rows}[r["doc_id"]])
        for name, value in zip(kneser_ney.MEASURES, want, strict=True):
            assert r[name] == (None if value is None else pytest.approx(value)), (r, name)
    letters = {g[-1] for g in found} | {"q"}
    for context in ("", "ab", " ab漢"[-kneser_ney.ORDER + 1 :], "qqqq"[-kneser_ney.ORDER + 1 :]):
        total = sum(brute.p(context + c) for c in letters)
        unseen = (0x110000 - len(letters)) * brute.p(context + "\u1234")
        assert total + unseen == pytest.approx(1)


def test_kneser_ney(spark, docs, rows, none):
    rnd = random.Random(6)
    syllables = ["ba", "ko", "ti", "lu", "re", "mo"]
    clean = lambda n: " ".join("".join(rnd.choice(syllables) for _ in range(3)) for _ in range(n)) + "."
    good = [(1000 + i, clean(60), "en" if i % 2 else None, "s", 0) for i in range(200)]
    bad = [(3000 + i, "".join(rnd.choice("qxz#$%&|QXZ 0123") for _ in range(300)), "en", "s", 0) for i in range(40)]
    planted = [(5000 + i, clean(30) + " you stupid clown " + clean(30), "en", "s", 0) for i in range(20)]  # fluent but for two words
    more = spark.createDataFrame(good + bad + planted, SCHEMA)
    labels = spark.createDataFrame([(r[0], 1, 0) for r in good[:150]] + [(r[0], 0, 0) for r in bad[:20]] + [(None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r["kept"] for r in kneser_ney.classify(more, labels).collect()}
    assert np.mean([found[r[0]] for r in good[150:]]) >= 0.95 and not any(found[r[0]] for r in bad + planted)
    few = kneser_ney.classify(docs, labels)
    assert few.count() == len(rows) and all(r["perplexity"] > 0 for r in few.collect())
    assert all(r["kept"] for r in kneser_ney.classify(docs, labels.limit(0)).collect())
    assert kneser_ney.classify(none, labels).count() == 0
