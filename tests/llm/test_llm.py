"""The training-data operators against brute force, and on odd tables."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import common, decontaminate, near_duplicates, packing, pii, quality, sharding, simhash, suffix_dedup, token_counts, token_files, tokens, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD, BYTE = (public_tokenizers.path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))
PROSE = "the quick brown fox jumps over the lazy dog near the old stone bridge while rain falls on the quiet town."
LONG = " ".join(f"{w}{i}" for i in range(4000) for w in ("alpha", "beta,"))
ODD = [(1, PROSE), (2, PROSE), (2, PROSE), (3, None), (4, ""), (None, "Null id. " + PROSE), (5, "x" * 5000), (6, LONG), (7, "a  b\n\nc "), (8, PROSE + " more words here")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(d, t, "clash", 7, "h", 1.5) for d, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, slot string, n_words int, text_hash string, score double")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, slot string")


def test_quality_counts(spark, odd, none):
    got = {(r.doc_id, r.n_words): r for r in quality.score(odd).collect()}
    assert not got[3, 0].kept and got[3, 0].base_failed and got[4, 0].base_failed
    assert quality.score(odd).count() == len(ODD) and quality.score(none).count() == 0
    words = b"a b c d e f a b c d e x".split()
    assert quality.repeated_words(words) == 10
    for text in ("a b a b a b a b a b", "q w e r t y q w e r t", "same\nsame\n \nsame"):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
        assert quality.counts_of(text)[0] == len(w) and quality.counts_of(text)[4] == len(hit)
    assert quality.counts_of("same\nsame\n \nsame")[3] == 2
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns


def test_simhash_components(spark, odd, none):
    got = simhash.cluster(odd).collect()
    assert len(got) == len(ODD) and simhash.cluster(none).count() == 0
    fp = {t: simhash.majority(simhash.shingle_hashes(t, 3)) for _, t in ODD}
    for r in got:
        texts = {t for d, t in ODD if d == r.doc_id}
        assert r.fingerprint in {format(fp[t], "016x") for t in texts}
    assert {r.fingerprint for r in got if r.doc_id in (3, 4)} == {"0" * 16} and {r.component_id for r in got if r.doc_id in (3, 4)} == {3}


def test_simhash_links_by_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = base[:150] ^ (np.uint64(1) << rng.integers(0, 62, 150, dtype=np.uint64))
    fps = np.unique(np.concatenate([base, near, near ^ np.uint64(4)])).view(np.int64)
    found = common.components(simhash.links(spark.createDataFrame([(int(x),) for x in fps], "fp long"), 2, tile=40))
    forest = simhash.Forest(len(fps))
    for i, j in itertools.combinations(range(len(fps)), 2):
        if bin((int(fps[i]) ^ int(fps[j])) & (2**64 - 1)).count("1") <= 2:
            forest.join(i, j)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(forest.find(i), set()).add(int(fps[i]))
    want = {frozenset(g) for g in groups.values() if len(g) > 1}
    have = {}
    for r in found.collect():
        have.setdefault(r.root, set()).add(r.node)
    assert {frozenset(g) for g in have.values()} == want


def test_near_dedup_keeps_one(spark, odd, none):
    words = [f"w{i}" for i in range(200)]
    near = words[:100] + ["other"] + words[101:]
    df = spark.createDataFrame([(10, " ".join(words)), (11, " ".join(near)), (12, " ".join(words[:60])), (13, " ".join(words))], "doc_id long, text string")
    assert sorted(r.doc_id for r in near_duplicates.keep_first(df).collect()) == [10, 12]
    kept = near_duplicates.keep_first(odd)  # PROSE with two or three more words still shares 17 of 20 shingles
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 6, 7]
    assert near_duplicates.keep_first(none).count() == 0


def test_near_dedup_passes_columns_and_finds_chains(spark):
    """Chains of edits, a family of many near copies, passages shared by texts that are not similar, equal rows."""
    rng = np.random.default_rng(11)
    word = lambda: "w" + str(rng.integers(0, 1 << 40))
    docs, shared = [], [word() for _ in range(30)]
    base = [word() for _ in range(120)]
    for k in range(60):  # each one edit further than the one before
        base = [*base]
        base[rng.integers(0, 120)] = word()
        docs.append(" ".join(base))
    family = [word() for _ in range(200)]
    for k in range(150):
        own = [*family]
        for _ in range(1 + k % 4):
            own[rng.integers(0, 200)] = word()
        docs.append(" ".join(own))
    docs += [" ".join([*shared, *(word() for _ in range(int(n)))]) for n in rng.integers(1, 60, 120)] + [docs[3]] * 3 + ["", " ", "one two", "two one", "a b c d e f g h"]
    df = spark.createDataFrame([(i % 330, t, i, "x") for i, t in enumerate(docs)], "doc_id long, text string, text_hash_of_row int, root string").repartition(7)
    got = near_duplicates.keep_first(df)
    assert got.columns == df.columns
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.split()) else set() for t in docs]
    forest = simhash.Forest(len(docs))
    for i, j in itertools.combinations(range(len(docs)), 2):
        if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            forest.join(i, j)
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(forest.find(i), set()).add((i % 330, docs[i]))
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert len(kept) == len(groups)
    for g in groups.values():
        assert sum(k in g for k in kept) == 1 and min(d for d, _ in g) in {d for d, t in kept if (d, t) in g}


def test_near_dedup_loses_no_pair():
    """Pairs at the very threshold, of which fingerprints within fixed radii lost some."""
    rng = np.random.default_rng(5)
    for common_part, own_a, own_b in ((12, 3, 0), (12, 2, 1), (6, 1, 0), (80, 10, 10), (800, 200, 0)):
        for _ in range(4000 if common_part < 100 else 50):
            h = np.unique(rng.integers(0, 1 << 63, common_part + own_a + own_b, dtype=np.uint64))
            a, b = h[: common_part + own_a], np.append(h[:common_part], h[common_part + own_a :])
            ma, mb = near_duplicates._maps([near_duplicates.parity_map(a)], [near_duplicates.parity_map(b)])
            assert len(near_duplicates._similar(ma, mb, np.array([len(a)]), np.array([len(b)]), 0.8, False)[0]) == 1


def test_near_dedup_joins_a_pair_of_distant_fingerprints(spark):
    """Similarity 0.8, but fingerprints beyond the radii of 22 and 34 bits that were in use."""
    rng = np.random.default_rng(7)
    mix = lambda h: (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    while True:
        words = [f"w{x}" for x in rng.integers(0, 1 << 40, 19)]
        a, b = " ".join(words), " ".join(words[:16])
        ha, hb = (np.unique(simhash.shingle_hashes(t, 5)) for t in (a, b))
        d = (simhash.majority(ha) ^ simhash.majority(hb)).bit_count()
        if d > 22 or d + (simhash.majority(mix(ha)) ^ simhash.majority(mix(hb))).bit_count() > 34:
            break
    assert (len(ha), len(hb)) == (15, 12)
    df = spark.createDataFrame([(1, a), (2, b), (3, "some other text of a few more words than five")], "doc_id long, text string")
    assert sorted(r.doc_id for r in near_duplicates.keep_first(df).collect()) == [1, 3]


def test_shards(spark, odd, none):
    got = sharding.shard(odd, 3).collect()
    assert len(got) == len(ODD) and sharding.shard(none).count() == 0
    for k in range(3):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    assert all(r.grown_shard in (r.shard, 3) for r in got)
    assert sorted(r.text_crc32 for r in got) == sorted(zlib.crc32((t or "").encode()) for _, t in ODD)


def jump_by_definition(key, shards):
    """Lamping and Veach's loop, one key at a time."""
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_shards_row_by_row(spark):
    """Every row of a table with 10,000 rows of one id, with nulls and repeated rows, in many buckets."""
    rows = [(5, f"text {i % 4000} é") for i in range(10_000)] + [(None, None)] * 300 + [(i, None if i % 7 == 0 else "y" * (i % 50)) for i in range(100, 1100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    written = sharding.write_shards(df, common.fresh_path(spark, "test-shards"), 5, 7, 20_000)
    got = sharding.digest(written).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(d), 8 + len((t or "").encode()), zlib.crc32((t or "").encode())) for d, t in rows)
    keys = {r.doc_id: r.k for r in df.select("doc_id", F.xxhash64(F.lit(7), F.coalesce(F.col("doc_id").cast("string"), F.lit("\x00"))).alias("k")).distinct().collect()}
    for r in got:
        k = keys[r.doc_id] % 2**64
        assert (r.law, r.shard, r.grown_shard) == ("key", jump_by_definition(k, 5), jump_by_definition(k, 6))
    for k in range(5):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    again = sharding.digest(sharding.write_shards(df.repartition(7), common.fresh_path(spark, "test-shards"), 5, 7, 20_000)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))  # neither rows' places nor partitions take part
    by_slot = [r.doc_id or 0 for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert by_slot != sorted(by_slot) and by_slot[:50] != [r.doc_id or 0 for r in sorted(got, key=lambda r: (r.shard, r.doc_id or 0))][:50]


def test_toxicity_learns_subwords(spark, odd):
    texts = [PROSE + f" you idiot {i}" for i in range(30)] + [PROSE + f" thank you {i}" for i in range(30)]
    model = toxicity.train(texts, [1] * 30 + [0] * 30, least=3)
    assert model.score(PROSE + " such idiots") > 0.5 > model.score(PROSE + " and friends")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(odd, labels).collect()} == {0.0}


def test_suffix_sort():
    rng = np.random.default_rng(1)
    for n, k in ((1, 2), (7, 1), (300, 2), (500, 3), (900, 200)):
        t = rng.integers(0, k, n).astype(np.uint8)
        raw = t.tobytes()
        order = suffix_dedup.suffix_order(t, 100, 64)
        keys = [raw[i : i + 100] for i in order]
        assert keys == sorted(keys) and sorted(order.tolist()) == list(range(n))


def brute_repeats(docs, length=100):
    seen, out = set(), {}
    for d, t in sorted(docs):
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if raw[i : i + length] in seen:
                gone[i : i + length] = True
            seen.add(raw[i : i + length])
        out[d] = (int(gone.sum()), hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest())
    return out


def test_suffixes_are_compared_where_windows_start(monkeypatch):
    """Suffixes that no window of a fragment starts at are sorted with the others, but not compared byte by byte."""
    seen, real = [], suffix_dedup.prefixes_reach
    monkeypatch.setattr(suffix_dedup, "prefixes_reach", lambda t, order, depth: (seen.append(len(order)), real(t, order, depth))[1])
    assert suffix_dedup.repeated_windows([b"xabcdey", b"abcdez", b"short"[:3]], 5) == [(1, 0, 5)]
    assert seen == [3 + 2]


def test_ranks_of_reduced_strings():
    rng = np.random.default_rng(4)
    for _ in range(300):
        names = np.unique(rng.integers(0, 4, rng.integers(1, 60)), return_inverse=True)[1]
        depth = int(rng.integers(2, 40))
        ranks, n = suffix_dedup._ranks(names, depth).tolist(), -(-depth // 2)  # a name is two bytes or more
        suffixes = [names[i : i + n].tolist() for i in range(len(names))]
        assert all(ranks[i] < ranks[j] for i in range(len(names)) for j in range(len(names)) if suffixes[i] < suffixes[j])


def test_suffix_dedup(spark, odd, none):
    docs = [(1, "a" * 500), (2, "a" * 300 + "b" * 300), (4, ""), (5, "x" * 99), (6, "x" * 99), (7, "ab" * 200), (8, "é" * 120), (9, "Q" + "é" * 120), (10, PROSE * 3), (11, "so " + PROSE * 2)]
    want = brute_repeats(docs)
    for r in suffix_dedup.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        assert (r.n_removed, r.kept_sha256) == want[r.doc_id]
    assert suffix_dedup.deduplicate(odd).count() == len(ODD) and suffix_dedup.deduplicate(none).count() == 0


def test_suffix_dedup_splits_an_anchor_beyond_a_shard(spark, monkeypatch):
    """One passage in all documents, with surroundings that differ or repeat in part: no sort may exceed two shards."""
    rng = np.random.default_rng(2)
    some = ["".join(chr(97 + x) for x in rng.integers(0, 26, 60)) for _ in range(12)]
    fresh = lambda: "".join(chr(65 + x) for x in rng.integers(0, 26, 60))
    passage = "one very common passage of some sixty bytes, in all the texts."
    docs = [(i, fresh() + some[rng.integers(12)] + passage + (some[rng.integers(12)] if i % 2 else fresh()) + fresh()) for i in range(300)]
    want, real = brute_repeats(docs), suffix_dedup.repeated_windows

    def bounded(fragments, length):
        if sum(map(len, fragments)) > 8000:
            raise MemoryError("a group beyond two shards is sorted in one piece")
        return real(fragments, length)

    monkeypatch.setattr(suffix_dedup, "repeated_windows", bounded)
    got = suffix_dedup.deduplicate(spark.createDataFrame(docs, "doc_id long, text string"), shard=4000).collect()
    assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in got} == want and sum(n for n, _ in want.values()) > 10_000


@pytest.mark.parametrize("path,drop", [(WORD, True), (BYTE, False)])
def test_encoders_are_exact(path, drop):
    enc = tokens.PieceEncoder(path, drop)
    chunked = tokens.Chunked(enc.tokenizer, 300, 30)
    for t in ["", " ", "x<|endoftext|>y z <|endoftext|> w", "don't I'll 'S É́ Σ", "tab\t here\r\n x y", "!" * 50 + " " * 30, "x" * 900, PROSE * 9, LONG[:5000], "Ünïcode. ŁÓDŹ, straße 12 34"]:
        want = enc.tokenizer.encode(t, add_special_tokens=False).ids
        assert enc.ids(t).tolist() == want and chunked.ids(t).tolist() == want


def test_token_counts_and_files(spark, odd, none):
    enc = tokens.load(WORD)
    count = lambda t: len(enc.encode(t or "", add_special_tokens=False).ids)
    got = token_counts.count_tokens(odd, WORD, True).collect()
    assert sorted(r.n_tokens for r in got) == sorted(count(t) for _, t in ODD)
    files = token_files.token_files(odd, WORD, True, 2).orderBy("start").collect()
    assert [r.doc_id for r in files] == [None, 1, 2, 2, 3, 4, 5, 6, 7, 8]
    start = 0
    for r in files:
        assert r.start == start
        start += r.n_tokens
    one = next(r for r in files if r.doc_id == 8)
    assert one.ids_crc32 == zlib.crc32(np.array([*enc.encode(ODD[-1][1], add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert token_files.token_files(none, WORD, True, 2).count() == 0 and token_counts.count_tokens(none, WORD, True).count() == 0


def test_packing(spark, odd, none):
    rows = packing.pack(odd, BYTE, False, 2, 64).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in itertools.pairwise(parts)) and parts[0][0] == 0 and sum(n for _, n in parts) <= 64
    enc = tokens.load(BYTE)
    assert sum(r.length for r in rows) == sum(len(enc.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ODD)
    assert packing.pack(none, BYTE, False, 2).count() == 0


def test_packing_stops_where_rounds_do_not_help(spark, monkeypatch):
    """20,000 items over half a sequence: no round brings all bins to one task."""
    monkeypatch.setattr(packing, "AT_ONCE", 2000)
    word = packing.pack(spark.range(1).selectExpr("1L as doc_id", "'a' as text"), BYTE, False, 2).first().length - 1
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.expr(f"repeat('a ', cast({600 // word} + id % 3 as int))").alias("text"))
    rows = packing.pack(docs, BYTE, False, 2)
    assert rows.select("sequence_id").distinct().count() == rows.count() == 20_000


def test_packing_of_tiny_and_huge(spark):
    """Bins of very many members; every round keeps all pieces, with gapless offsets."""
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.expr("CASE WHEN id % 500 = 0 THEN repeat('word ', 3000) WHEN id % 3 = 0 THEN '' ELSE repeat('b ', cast(id % 90 as int)) END").alias("text"))
    got = packing.pack(docs.repartition(40), BYTE, False, 2).toPandas().sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all() and got.groupby("sequence_id").length.sum().max() <= 1024
    assert got.doc_id.nunique() == 5000 and got.sequence_id.nunique() <= -(-got.length.sum() // 1024) + 4


def test_pii(spark, odd, none):
    text = "Call +1 (017) 555-7713 or 017-555-7713, mail A.b@mail7.example.com and a.b@mail7.example.com, 10.2.3.4, 4111 1111 1111 1111. Mrs. Anna Smith and Mr Smith."
    out = pii.redact(spark.createDataFrame([(1, text, 0)], "doc_id long, text string, sur int"), count_column="n").first()
    assert out.n == 8 and out.sur == 0
    for gone in ("555-7713", "mail7", "10.2.3.4", "4111", "Smith", "Anna"):
        assert gone not in out.text
    a, b = re.findall(r"\S+@\S+?com", out.text)
    assert a.lower() == b and a != b
    p, q = re.search(r"\+1 \((\d{3})\) (\d{3}-\d{4}) or (\d{3}-\d{3}-\d{4})", out.text).group(0).split(" or ")
    assert re.sub(r"\D", "", p)[1:] == re.sub(r"\D", "", q)
    digits = [int(c) for c in re.search(r"(\d{4} ){3}\d{4}", out.text).group(0) if c != " "]
    assert sum(digits[1::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[::2]) in range(0, 200, 10)
    clean = pii.redact(odd)
    assert clean.columns == odd.columns and sorted(map(str, clean.collect())) == sorted(map(str, odd.collect())) and pii.redact(none).count() == 0


def test_pii_collisions_are_redrawn(spark):
    mentions = spark.range(3000).select(F.lit("ip").alias("kind"), F.concat(F.lit("10.0."), (F.col("id") / 250).cast("int"), F.lit("."), F.col("id") % 250).alias("canon"))
    got = pii.dictionary(mentions, "k")
    assert got.select("sur").distinct().count() == got.count() == mentions.distinct().count()


def test_pii_of_other_shapes(spark):
    found = [
        "+44 20 7946 0958", "+44 (0)20 7946 0958", "+33 6 12 34 56 78", "+49 151 23456789", "+34 612 345 678", "0033 6 12 34 56 78", "06 12 34 56 78", "020 7946 0958", "0151 23456789",
        "612 345 678", "2125550100", "(212) 555-0100", "378282246310005", "3782 822463 10005", "6011000990139424", "4222222222222", "2001:db8:85a3:0:0:8a2e:370:7334", "2001:db8:85a3::8a2e:370:7334", "fe80::1ff:fe23:4567:890a",
    ]
    kept = ["at 12:30:45", "std::vector", "378282246310006", "in 1990-1991, 3.1415926535", "1,234,567,890", "a ratio of 16:9", "on 05.06.2024 12:30"]
    docs = [(i, f"see {t} there") for i, t in enumerate(found + kept)] + [(100, "Mr. Smith met John Smith; Smithson saw Mrs. Anna Jones and ANNA, then Anna. Jones left.")]
    got = {r.doc_id: r for r in pii.redact(spark.createDataFrame(docs, "doc_id long, text string"), count_column="n").collect()}
    for i, t in enumerate(found):
        new = got[i].text
        assert got[i].n == 1 and new.startswith("see ") and new.endswith(" there") and t not in new, (t, new)
        left = re.sub(r"\D", "", t)[-6:]
        assert ":" in t or left not in re.sub(r"\D", "", new), (t, new)
    for i, t in enumerate(kept, len(found)):
        assert (got[i].n, got[i].text) == (0, f"see {t} there")
    national = lambda i, n: re.sub(r"\D", "", got[i].text)[-n:]
    assert national(0, 10) == national(1, 10) == national(7, 10) and national(2, 9) == national(5, 9) == national(6, 9) and national(3, 11) == national(8, 11) and national(4, 9) == national(9, 9)
    assert national(10, 10) == national(11, 10) and national(12, 15) == national(13, 15) and got[16].text == got[17].text
    m = re.fullmatch(r"Mr\. (\w+) met John (\w+); Smithson saw Mrs\. (\w+) (\w+) and ANNA, then (\w+)\. (\w+) left\.", got[100].text)
    assert m and m[1] == m[2] != "Smith" and m[3] == m[5] != "Anna" and m[4] == m[6] != "Jones" and got[100].n == 5


def test_pii_keeps_countries_apart(spark):
    docs = [(1, "+1 212 555 0199"), (2, "+44 212 555 0199"), (3, "0212 555 0199"), (4, "212-555-0199"), (5, "0044 2125550199")]
    out = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(docs, "doc_id long, text string"), "key").collect()}
    digits = {d: re.sub(r"\D", "", t)[-10:] for d, t in out.items()}
    assert digits[1] == digits[4] != digits[2] == digits[5] and digits[3] == digits[1] and out[1].startswith("+1 ") and out[2].startswith("+44 ")
    assert "212" not in digits[1][:3] and len(set(digits.values())) == 2


def test_pii_names_and_scripts(spark):
    text = "Mr. John Smith came. Smith left; John Smith said so. Dr. Alice Brown met Prof. Otto and Mr O'Neil-Jones; Brown left. г-жа Анна Иванова и г-н Иванов. Mme Curie."
    out = pii.redact(spark.createDataFrame([(1, text)], "doc_id long, text string"), "key", "n").first()
    for gone in ("John", "Smith", "Alice", "Brown", "Otto", "Neil", "Jones", "Анна", "Иванов", "Curie"):
        assert gone not in out.text, (gone, out.text)
    m = re.fullmatch(r"Mr\. (\w+) (\w+) came\. (\w+) left; (\w+) (\w+) said so\. Dr\. (\w+) (\w+) met Prof\. (\w+) and Mr (\w+); (\w+) left\. г-жа (\w+) (\w+) и г-н (\w+)\. Mme (\w+)\.", out.text)
    assert m and m[1] == m[4] and m[2] == m[3] == m[5] and m[7] == m[10] and out.n == 11  # 7 titled ones, and 4 words
    assert m[1].endswith("n") and m[6].endswith("l") and re.fullmatch("[А-Я][а-я]+на", m[11])  # given names go by gender
    assert re.fullmatch("[А-Яа-я]+", m[12] + m[13]) and re.fullmatch("[A-Za-z]+", m[9])


def test_pii_checks_and_secrets(spark):
    iban, bad = "DE89 3704 0044 0532 0130 00", "DE88 3704 0044 0532 0130 00"
    secret = "sk-abcdefghijklmnop1234"
    docs = [(1, f"pay to {iban} now"), (2, f"pay to {bad} now"), (3, f"key {secret} and {'0123456789abcdef' * 4} end"), (4, "GB29NWBK60161331926819 is mine")]
    out = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(docs, "doc_id long, text string")).collect()}

    def rest(text):
        raw = text.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in raw[4:] + raw[:4])) % 97

    new = out[1][7:-4]
    assert rest(iban) == 1 == rest(new) and new != iban and new[:2] == "DE" and [i for i, c in enumerate(new) if c == " "] == [i for i, c in enumerate(iban) if c == " "]
    assert out[2] != docs[1][1] and rest(out[4][:-8]) == 1 and out[4][:2] == "GB"
    assert secret not in out[3] and re.fullmatch(r"key sk-\w{21} and [0-9a-f]{64} end|key sk-\w+ and [0-9a-f]{64} end", out[3])


def test_pii_leaves_clashing_columns_alone(spark):
    names = ("entity_spans", "moved_surrogates", "lookup_id", "lookup_hash", "name_words", "entity_gaps", "kind", "canon", "text_hash", "row")
    rows = [(i, f"{chr(97 + i % 26)}@{chr(97 + i // 26)}.com wrote to Mr Smith {i}", *range(len(names))) for i in range(676)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    got = pii.redact(df)
    assert got.columns == df.columns
    for r in got.collect():
        assert tuple(r)[2:] == tuple(range(len(names))) and "Smith" not in r.text
    assert got.select("text").distinct().count() == 676


def test_pii_key_is_needed_to_draw_again(spark):
    df = spark.createDataFrame([(1, "mail a.b@example.com")], "doc_id long, text string")
    one, same, other = (pii.redact(df, k).first().text for k in ("k1", "k1", "k2"))
    assert one == same != other and pii.redact(df).first().text not in (one, other)
    spark.conf.unset("pairloom.pii.key")


def test_pii_redraws_end_where_surrogates_are_fewer_than_entities(spark):
    """676 surrogates of the shape a@b.com and 10,000 of four digits at attempt 0, for more entities than that."""
    mails = spark.range(676).select(F.lit("email").alias("kind"), F.expr("concat(chr(97 + id div 26), '@', chr(97 + id % 26), '.com')").alias("canon"))
    phones = spark.range(9000).select(F.lit("phone").alias("kind"), F.expr("lpad(id, 4, '0')").alias("canon"))
    names = spark.range(300_000).select(F.lit("name").alias("kind"), F.expr("concat('m:', translate(id, '0123456789', 'qwxyzhjcvb'))").alias("canon"))
    for mentions in (mails.union(phones), names):
        got = common.written(pii.dictionary(mentions, "k"), "test-surrogates")
        assert got.count() == got.select("kind", "sur").distinct().count() == mentions.count()
        assert got.join(mentions.select("kind", F.col("canon").alias("sur")), ["kind", "sur"], "left_semi").count() == 0
    docs = spark.createDataFrame([(i, f"{chr(97 + i // 26)}@{chr(97 + i % 26)}.com wrote") for i in range(676)], "doc_id long, text string")
    out = [r.text for r in pii.redact(docs).collect()]
    assert len(set(out)) == 676 and all(re.fullmatch(r"[a-z]+@[a-z]\.com wrote", t) for t in out)


def test_decontamination(spark, odd, none):
    item = " ".join(f"item{i}" for i in range(20))
    docs = spark.createDataFrame([(1, LONG + " " + item.upper() + "! " + LONG), (2, " ".join(item.split()[:12])), (3, "tiny test"), (4, None), (None, "so: " + item)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, "tiny test"), (3, ""), (4, None)], "item_id long, text string")
    assert sorted((str(r.doc_id), r.item_id, r.containment) for r in decontaminate.leaks(docs, items).collect()) == [("1", 1, 1.0), ("3", 2, 1.0), ("None", 1, 1.0)]
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(docs, items).collect()) == [2, 4]
    assert decontaminate.leaks(none, items).count() == 0 and decontaminate.leaks(docs, items.limit(0)).count() == 0
    assert decontaminate.drop_leaks(odd, items).columns == odd.columns


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.written(stage(spark, docs, "/root/testdata/sf0.001"), name)
        assert after.columns == docs.columns and 0 < after.count() <= docs.count()
        docs = after
