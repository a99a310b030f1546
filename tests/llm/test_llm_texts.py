"""Text operators against brute force, on small tables with nulls, ties, repeats and odd columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SMALL
from riskboard.llm import binary, bpe, copies, decontaminate, langid, pretokens, quality, simhash, suffix

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint"
RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def words(seed, n, vocabulary=400):
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, copies, near copies, repeated rows."""
    base, long_ = words(1, 300), words(2, 20_000)
    near = base.split()
    near[150] = "changed"
    rows = [(1, base, "en", "a", 1), (2, base, "en", "a", 1), (2, base, "en", "a", 1), (3, " ".join(near), None, "b", 2),
            (4, None, "en", None, None), (5, "", "fr", "b", 0), (6, "  \n\t ", None, "b", 3), (None, base.upper(), "en", "c", 4),
            (7, long_, "de", "c", 5), (8, "x" + long_[5000:60_000], "de", "c", 5), (9, "one two", "fr", "d", 7),
            (10, "!" * 3000, "fr", "d", 3000), (11, "One  TWO", "es", "d", 8), (12, "日本語の文 12 \U0001f600", "ja", "d", 9),
            (13, words(3, 50), "es", "e", 1), (None, None, None, None, None), (14, "a\u0000b\\ 'quote' <tag>", "en", "e", 2)]
    return spark.createDataFrame(rows, DDL).withColumn("fp", F.lit("clash")).withColumn("score", F.lit(1)).cache()


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


# --- near copies


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    own = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not own:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(own[i:i + 3]).encode(), 42) for i in range(max(1, len(own) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    """Smallest id reachable over links of three bits or fewer; ids may be null."""
    left, out = set(range(len(prints))), {}
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            k = todo.pop()
            group.add(k)
            near = {j for j in left if bin(prints[k][1] ^ prints[j][1]).count("1") <= 3}
            left -= near
            todo.extend(near)
        ids = [prints[k][0] for k in group if prints[k][0] is not None]
        out.update({k: min(ids, default=None) for k in group})
    return out


@pytest.mark.parametrize("tile", [2, 4096])
def test_simhash_equals_brute_force(odd, rows, tile):
    prints = [(r["doc_id"], plain_fingerprint(r["text"])) for r in odd.collect()]
    groups = plain_groups(prints)
    want = sorted(((d, f"{f:016x}", groups[k]) for k, (d, f) in enumerate(prints)), key=repr)
    assert rows(simhash.near_copies(odd, tile=tile)) == want


def test_simhash_on_the_table(spark, rows):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    prints = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.collect()]
    groups = plain_groups(prints)
    assert rows(simhash.near_copies(docs), "doc_id", "component_id") == sorted(
        ((d, groups[k]) for k, (d, _) in enumerate(prints)), key=repr)
    kept = [r["doc_id"] for r in simhash.keep_one(docs).collect()]
    assert sorted(kept) == sorted(set(groups.values()))


def test_large_groups_of_links_stay_small():
    rng = np.random.default_rng(3)
    prints = np.unique(np.bitwise_xor(rng.integers(0, 1 << 62, 3000, dtype=np.uint64) & np.uint64(7), np.uint64(1 << 40)))
    prints = np.concatenate([prints, prints ^ np.uint64(1 << 50)])
    a, b = simhash.tile_links(prints, prints, True)
    assert len(a) <= 2 * len(prints)
    many = np.arange(2000, dtype=np.uint64) % np.uint64(2) + np.arange(2000, dtype=np.uint64) * np.uint64(0)
    a, b = simhash.tile_links(many, many, True)
    assert 0 < len(a) <= 2 * len(many)


def test_keep_one_keeps_columns_and_one_of_each_group(odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(2) == 0 and ids.count(1) == 1 and ids.count(3) == 0 and len(ids) == len(set(ids))


def plain_kept(data):
    """Smallest id of each component over all pairs at 0.8 or more of their 5-word shingles."""
    sets = []
    for _, text in data:
        own = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(own[i:i + 5]) for i in range(max(1, len(own) - 4))} if own else set())
    left, out = set(range(len(data))), []
    while left:
        todo, group = [left.pop()], []
        while todo:
            k = todo.pop()
            group.append(data[k][0])
            near = {j for j in left if 10 * len(sets[k] & sets[j]) >= 8 * len(sets[k] | sets[j])}
            left -= near
            todo.extend(near)
        out.append(min((d for d in group if d is not None), default=None))
    return sorted(out, key=repr)


def test_copies_of_the_pipeline_meet_by_simhash_first(spark, odd, monkeypatch):
    """Of the pairs that are compared first, all are inside the SimHash radius of five-word
    fingerprints, and they join what all pairs inside it join; links of 0.8 come out of these."""
    seen, inside = [], copies._inside
    monkeypatch.setattr(copies, "_inside", lambda pairs, nodes: seen.append((pairs, nodes)) or inside(pairs, nodes))
    base = [f"w{i}" for i in range(400)]
    near = [(k, " ".join(base[:k] + ["new"] + base[k + 1:])) for k in range(0, 400, 40)]
    docs = spark.createDataFrame([*near, (900, None), (901, "a b"), (902, "other words only")], "doc_id long, text string")
    assert copies.keep_one(docs).count() == 4
    pairs, nodes = seen[0]
    fp = {r["id"]: np.uint64(r["fp"] & (2**64 - 1)) for r in nodes.collect()}
    texts = {r["id"]: r["key"].split(":")[0] for r in nodes.collect()}
    body = {str(k): t for k, t in docs.collect()}
    assert all(int(fp[i]) == simhash.fingerprint(body[d], copies.SHINGLE) % 2**64 for i, d in texts.items())
    close = lambda a, b: int(np.bitwise_count(fp[a] ^ fp[b])) <= simhash.RADIUS
    got = {(r["left"], r["right"]) for r in pairs.collect()}
    want = {(a, b) for a in fp for b in fp if a < b and close(a, b)}
    assert got and got <= want
    root = lambda edges: _joined(sorted(fp), edges)
    assert root(got) == root(want)


def _joined(nodes, edges):
    part = {x: x for x in nodes}
    for _ in nodes:
        for a, b in edges:
            part[a] = part[b] = min(part[a], part[b])
    return part


def test_copies_of_the_pipeline_equal_brute_force(spark, odd, monkeypatch):
    import corpus_pipeline
    rnd, texts = random.Random(12), []
    base = words(20, 300, 4000).split()
    for _ in range(25):  # a family too far apart, with a copy of each at 0.8 or more
        own = list(base)
        for at in rnd.sample(range(0, 300, 10), 8):
            own[at] = f"v{rnd.randrange(10**9)}"
        near = list(own)
        for at in rnd.sample(range(5, 300, 10), rnd.choice([1, 4, 6])):
            near[at] = f"n{rnd.randrange(10**9)}"
        texts += [own, near]
    rnd.shuffle(texts)
    more = spark.createDataFrame([(100 + k, " ".join(t), "en", "f", 1) for k, t in enumerate(texts)], DDL)
    table = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 1000).select(*more.columns)
    docs = odd.select(*more.columns).unionByName(more).unionByName(table).cache()
    want = plain_kept([(r["doc_id"], r["text"]) for r in docs.collect()])
    for common in (copies.COMMON, 0):  # the order of the shingles decides nothing
        monkeypatch.setattr(copies, "COMMON", common)
        got = corpus_pipeline.near_copies(spark, docs, SMALL)
        assert got.columns == docs.columns
        assert sorted((r["doc_id"] for r in got.collect()), key=repr) == want
    assert corpus_pipeline.near_copies(spark, docs.limit(0), SMALL).count() == 0


# --- repeated passages


def plain_removed(texts, least):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(raw[i:i + least] for raw in raws for i in range(len(raw) - least + 1))
    out = []
    for raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - least + 1):
            if seen[raw[i:i + least]] > 1:
                gone[i:i + least] = b"\1" * least
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("group", [1, 200_000])
def test_suffix_equals_brute_force(odd, rows, group):
    data = odd.select("doc_id", "text").collect()
    want = [(r["doc_id"], *w) for r, w in zip(data, plain_removed([r["text"] for r in data], 200))]
    assert rows(suffix.removed(odd, group)) == sorted(want, key=repr)


@pytest.mark.parametrize("group", [1, 200_000])
def test_suffix_on_passages(spark, rows, group):
    """Passages at borders, overlapping, periodic, shared by many, and one byte too short."""
    rnd = random.Random(5)
    text = lambda n: "".join(rnd.choice("abcdefgé ") for _ in range(n))
    p, q, r = text(200), text(199), text(450)
    texts = [p + text(80), text(33) + p, p, text(10) + q, q + text(10), r[:300] + text(9), text(5) + r[100:], "ab" * 400,
             text(50) + "ba" * 300, "z" * 199, "z" * 205, text(100) + p + text(100) + p, r, None, ""]
    texts += [text(120) + p + text(120) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = [(k, *w) for k, w in enumerate(plain_removed(texts, 200))]
    assert rows(suffix.removed(df, group)) == sorted(want, key=repr)


def test_suffix_survives_hash_collisions(monkeypatch):
    """With a hash that always collides the proof fails and the bytes decide."""
    rnd = random.Random(1)
    slices = [bytes(rnd.choices(b"ab", k=240)) for _ in range(40)]
    slices += [s[:20] + slices[0][20:] for s in slices[1:5]]
    left, right = np.full(44, 40), np.full(44, 200)
    group, n = np.repeat([0, 1], 22), np.ones(44)
    good = [f.tolist() for f in suffix.repeated(slices, left, right, group, n)]
    monkeypatch.setattr(suffix.Hashes, "of", lambda self, at, size: np.zeros(len(at), np.uint64))
    assert [f.tolist() for f in suffix.repeated(slices, left, right, group, n)] == good
    windows = Counter((g, s[o:o + 200]) for g, s in zip(group.tolist(), slices) for o in range(41))
    assert good == [[o for o in range(41) if windows[g, s[o:o + 200]] > 1] for g, s in zip(group.tolist(), slices)]


def test_suffix_sort_orders_suffixes():
    rnd = random.Random(2)
    raw = np.frombuffer(bytes(rnd.choices(b"ab", k=500)), np.uint8)
    at = np.arange(0, 400, 3)
    size = np.minimum(100, len(raw) - at)
    order, same = suffix.suffix_sort(raw, at, size, np.zeros(len(at), np.int64), False)
    cut = [raw[a:a + s].tobytes() for a, s in zip(at, size)]
    assert [cut[k] for k in order] == sorted(cut)
    assert suffix.proven(raw, at, size, np.zeros(len(at), np.int64), False, order, same)


def test_without_repeats_keeps_columns(odd):
    out = suffix.without_repeats(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[1] == "" and texts[4] is None and texts[9] == "one two"


# --- byte-level BPE


def test_bpe_equals_the_library(spark, odd, rows):
    told = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(RANKS), special_tokens={})
    docs = odd.select("doc_id", "text").unionByName(
        spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text"))
    want = []
    for r in docs.collect():
        text = r["text"] or ""
        ids = np.array(told.encode_ordinary(text), "<u4")
        want.append((r["doc_id"], len(ids), hashlib.sha256(ids.tobytes()).hexdigest(),
                     hashlib.sha256(text.encode()).hexdigest()))
    assert rows(bpe.digests(docs, RANKS, public_tokenizers.PATTERN)) == sorted(want, key=repr)
    coded = bpe.encoded(odd, RANKS, public_tokenizers.PATTERN).select("doc_id", F.decode("decoded", "utf-8"))
    assert rows(coded) == rows(odd.select("doc_id", F.coalesce("text", F.lit(""))))


def test_bpe_of_long_and_random_pretokens():
    told = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=dict(RANKS), special_tokens={})
    rnd = random.Random(4)
    texts = ["a" * 5001, "ab" * 700, "é" * 999] + ["".join(rnd.choices("abcdeinrst ", k=rnd.randrange(1, 200))) for _ in range(300)]
    merger = bpe.Merger(RANKS)
    ids, starts, sizes = merger.many([t.encode() for t in texts])
    for text, a, n in zip(texts, starts, sizes):
        want = told.encode_ordinary(text)
        assert ids[a:a + n].tolist() == want == merger.single(text.encode())


def test_merges_that_open_a_lower_rank():
    """Ranks in which joining opens a pair of lower rank than its own, in one pre-token and
    in a row of equal pairs."""
    table = [(bytes((b,)), b + 1000) for b in range(256)] + [(b"ab", 500), (b"aba", 300), (b"abab", 200), (b"bc", 600)]
    told = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=dict(table), special_tokens={})
    merger = bpe.Merger(table)
    texts = ["ababab", "abababab", "abcabab", "babababc", "aabbaabab", "c"]
    ids, starts, sizes = merger.many([t.encode() for t in texts])
    for text, a, n in zip(texts, starts, sizes):
        assert ids[a:a + n].tolist() == told.encode_ordinary(text) == merger.single(text.encode()), text


def test_bitmap_finds_the_first():
    rnd, marks, model = random.Random(6), bpe.Bitmap(50_257), set()
    for _ in range(4000):
        b = rnd.choice([0, 63, 64, 4095, 4096, 50_256, rnd.randrange(50_257)])
        if rnd.random() < 0.5:
            marks.add(b)
            model.add(b)
        else:
            marks.drop(b)
            model.discard(b)
        assert marks.first() == min(model, default=-1)


def test_encoder_starts_afresh_when_full(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 3)
    encoder = bpe.Encoder(public_tokenizers.PATTERN, bpe.Merger(RANKS).many)
    for text in ("one two three four", "one two", "five six one"):
        assert [x.tolist() for x in encoder.encode([text.encode(), b""])][1] == []
    assert len(encoder.known) < 8


def test_pretokens_equal_the_pattern():
    import regex
    find, rnd = regex.compile(public_tokenizers.PATTERN).findall, random.Random(7)
    letters = ["'"] * 6 + list("strevmldabZ ") + [" ", " ", "\n", "\t", "1", "½", "é", "日", "!", "\U0001f600", "\u3000", "’", "\u00a0"]
    for _ in range(2000):
        texts = ["".join(rnd.choices(letters, k=rnd.randrange(25))) for _ in range(4)]
        whole, bounds = "".join(texts), np.append(0, np.cumsum([len(t) for t in texts]))
        at = pretokens.starts(np.frombuffer(whole.encode("utf-32-le"), np.uint32), bounds).tolist() if whole else []
        assert [whole[a:b] for a, b in zip(at, [*at[1:], len(whole)])] == [w for t in texts for w in find(t)]


@pytest.mark.parametrize("broken", ["within", "between"])
def test_encoder_survives_hash_collisions(monkeypatch, broken):
    told = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(RANKS), special_tokens={})
    real = pretokens.hashed

    def hashed(texts):
        code, place, first, second, counts = real(texts)
        return (None if broken == "within" else code), place, np.arange(len(first), dtype=np.uint64), second, counts
    monkeypatch.setattr(pretokens, "hashed", hashed)
    encoder = bpe.Encoder(public_tokenizers.PATTERN, bpe.Merger(RANKS).many)
    for texts in (["one two  three", "", "it's"], ["other words in here", "one two"]):
        assert [x.tolist() for x in encoder.encode([t.encode() for t in texts])] == [told.encode_ordinary(t) for t in texts]


# --- binary files


def test_packing_round_trips():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 239, 240, 241, binary.BLOCK, binary.BLOCK + 1, 30_000):
        for top in (1, 2, 200, 50_257, 1 << 33, 1 << 60):
            values = rng.integers(0, top, n, dtype=np.uint64)
            values[n // 3:n // 2] = 0
            packed, blocks = binary.pack(values)
            assert (binary.unpack(packed, n, blocks) == values).all()
    few = np.full(60_000, 3, np.uint64)
    assert len(binary.pack(few)[0]) <= 2100


def test_file_with_escapes():
    ids = [np.array([1, 2, 3]), np.array([2**61, 5, 0]), np.array([], np.int64)]
    docs, sizes, values = binary.read_file(binary.write_file(np.array([4, 5, -6]), ids))
    assert docs.tolist() == [4, 5, -6] and sizes.tolist() == [3, 3, 0] and values.tolist() == [1, 2, 3, 2**61, 5, 0]
    with pytest.raises(ValueError):
        binary.read_file(b"none" + bytes(40))


def test_binary_equals_the_library(odd, rows):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        vocabulary = file.read()
    told = Tokenizer.from_str(vocabulary)
    told.encode_special_tokens = True
    docs = odd.withColumn("text", F.concat("text", F.lit(" <|endoftext|>'s\n"), F.coalesce("text", F.lit(""))))
    data = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (
        r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, (r["text"] or "").encode()))
    want, start = [], 0
    for r in data:
        ids = np.array(told.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = binary.read(binary.write(docs, vocabulary, public_tokenizers.PATTERN, 2))
    assert rows(got) == sorted(want, key=repr)


# --- decontamination


def plain_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return min(row)


def test_edit_matching_equals_brute_force(spark, rows):
    rnd = random.Random(8)
    items = [(k, words(100 + k, rnd.randrange(5, 25), 60).capitalize() + ".") for k in range(12)]
    items += [(12, "w1 w2"), (13, None), (14, " ?! "), (0, items[0][1]), (15, items[1][1])]

    def edited(text, n):
        chars = list(text)
        for _ in range(n):
            k = rnd.randrange(len(chars))
            chars[k:k + 1] = rnd.choice([[], ["q"], [chars[k], "z"]])
        return "".join(chars)
    texts = [None, "", "W1, w2!", "w0 w1 w2 w3", " ".join(words(k, 30, 60) for k in range(3))]
    for name, text in items[:12]:
        for n in (0, 1, 3, 6, 15):
            texts.append(f"{words(rnd.random(), 20, 60)} {edited(text, n).upper()} {words(rnd.random(), 9, 60)}")
    df = spark.createDataFrame(list(enumerate(texts)) + [(5, texts[5])], "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want, drops = [], set()
    for k, text in [*enumerate(texts), (5, texts[5])]:
        line, best = decontaminate.plain(text), {}
        for name, item in items:
            item = decontaminate.plain(item)
            short = item and item.count(" ") - 1 < 5
            if short:
                near, most = 0 if line and item in line else 1, 0
                if line == item:
                    drops.add(k)
            else:
                near, most = (plain_distance(item, line) if item and line else 9**9), decontaminate.budget(item)
            if near <= most:
                best[name] = min(near, best.get(name, near))
                if not short:
                    drops.add(k)
        want += [(k, name, near) for name, near in best.items()]
    assert len(want) > 35
    for block in (10_000, 4):
        assert rows(decontaminate.found(df, bench, block=block)) == sorted(want, key=repr)
        clean = decontaminate.without_leaks(df, bench, block=block)
        assert {r["doc_id"] for r in clean.collect()} == set(range(len(texts))) - drops
    assert {w[0] for w in want} - drops  # short items are found, and drop only what is made of them


# --- language


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told = langid.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(told) > 200
    assert sum(r["lang_pred"] == r["lang"] for r in told) >= 0.98 * len(told)
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in told)
    hidden = docs.withColumn("lang", F.when(langid.fold(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    again = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(hidden).collect()}
    assert all(again[r["doc_id"]] == (r["lang_pred"], r["score"]) for r in told)


def test_mixtures_show_their_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    one = {r["lang"]: r["t"] for r in docs.filter("n_chars > 3000").groupBy("lang").agg(F.first("text").alias("t")).collect()}
    mixed = spark.createDataFrame([(1, one["en"][:1000] + " " + one["de"][:2000]), (2, one["fr"][:2000])],
                                  "doc_id bigint, text string")
    told = {r["doc_id"]: r for r in langid.with_language(mixed, docs).collect()}
    assert told[1]["_langs"][:2] == ["de", "en"] and 0.5 < told[1]["_share"] < 0.85
    assert told[2]["_langs"] == ["fr"] and told[2]["_share"] > 0.99


def test_language_of_odd_rows(odd):
    told = {r["doc_id"]: r for r in langid.predict(odd).collect()}
    assert len(told) == 15
    assert {d for d, r in told.items() if r["lang_pred"] == "und"} >= {4, 5, 6, 10}
    assert all(0 <= r["score"] <= 1 for r in told.values())
    nothing = langid.predict(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in nothing} == {("und", 0.0)}
    assert langid.keep_known(odd).columns == odd.columns


# --- quality


def test_quality_of_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    told = quality.scored(docs, labels)
    held = told.filter("held_out").join(labels, "doc_id").collect()
    assert len(held) > 600 and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    good = [r["score"] for r in held if r["quality"] == 1]
    bad = [r["score"] for r in held if r["quality"] == 0]
    assert sum(g > b for g in good for b in bad) >= 0.97 * len(good) * len(bad)
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.96 * len(held)
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in held)
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(
        F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in quality.scored(docs, flipped).collect()}
    assert all(again[r["doc_id"]] == r["score"] for r in held)


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, None), (None, 1), (9, 0), (99, 1)], "doc_id bigint, quality int")
    told = quality.scored(odd, labels).collect()
    assert len(told) == odd.count() and all(0 <= r["score"] <= 1 for r in told)
    empty = {r["score"] for r in told if r["doc_id"] in (4, 5, 6)}
    assert len(empty) == 1
    assert {r["score"] for r in quality.scored(odd, labels.limit(0)).collect()} == {0.5}


def test_scores_are_sparse_products():
    rng = np.random.default_rng(2)
    weights = rng.standard_normal(quality.SPACE + 1).astype("<f4")
    data = [b"one two  two", b"", b"three!", "é 12".encode()]
    place, n = quality.features(data)
    assert n.tolist() == [5, 0, 3, 3]
    at = 0
    for k, size in enumerate(n.tolist()):
        x = sum(float(weights[p]) for p in place[at:at + size]) * quality.SCALE / max(1, size) + float(weights[-1])
        assert abs(quality.scores(data, weights)[k] - 1 / (1 + np.exp(-np.clip(x, -35, 35)))) < 1e-6
        at += size


# --- empty tables


def test_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    bench = spark.createDataFrame([], "item_id bigint, text string")
    made = [quality.scored(none, labels), decontaminate.found(none, bench), decontaminate.without_leaks(none, bench),
            bpe.digests(none, RANKS, public_tokenizers.PATTERN), simhash.near_copies(none), simhash.keep_one(none),
            suffix.removed(none), suffix.without_repeats(none), langid.predict(none), langid.keep_known(none)]
    assert [df.count() for df in made] == [0] * len(made)
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        assert binary.read(binary.write(none, file.read(), public_tokenizers.PATTERN, 2)).count() == 0
