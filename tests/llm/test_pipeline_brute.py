"""The pipeline, stage by stage, against brute force over one table."""

import itertools
import re
import zlib

import pytest

from pairloom.llm import common, pii, quality, simhash, tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


def shingles(words, width):
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


@pytest.fixture(scope="module")
def stages(spark):
    """Every stage's input and output rows."""
    import corpus_pipeline

    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = common.written(stage(spark, docs, SF), name)
        out[name] = (docs.collect(), after.collect())
        docs = after
    return out


def test_quality_stage(stages):
    before, after = stages["quality_rules"]
    counts = {r.doc_id: quality.counts_of(r.text) for r in before}
    pattern = {r.doc_id: quality.pattern_of(quality.votes_of(r.text, counts[r.doc_id])) for r in before}
    tally = {}
    for p in pattern.values():
        tally[p] = tally.get(p, 0) + 1
    good = quality.fit(tally)
    want = {d for d, c in counts.items() if c[0] >= 10 and 100 * c[4] <= 20 * c[0] and good[pattern[d]] >= 0.5}
    assert {r.doc_id for r in after} == want and 0 < len(want) < len(before)


def test_near_dedup_stage(stages):
    before, after = stages["near_dedup"]
    sets = {r.doc_id: shingles(r.text.encode().lower().split(), 5) for r in before}
    ids = sorted(sets)
    forest = simhash.Forest(len(ids))
    for (i, a), (j, b) in itertools.combinations(enumerate(ids), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            forest.join(i, j)
    assert sorted(r.doc_id for r in after) == [ids[i] for i in range(len(ids)) if forest.find(i) == i]


def test_decontamination_stage(spark, stages):
    before, after = stages["decontamination"]
    words = lambda t: [w for w in re.sub(r"[\W_]+", " ", (t or "").lower()).split(" ") if w]
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = set()
    for r in before:
        own = words(r.text)
        for item in filter(None, items):
            held = shingles(item, 5)
            if len(held & shingles(own, min(5, len(item)))) >= 0.8 * len(held) - 1e-9:
                want.add(r.doc_id)
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == want and want


def test_pii_stage(stages):
    import regex

    before, after = stages["pii_surrogates"]
    new = {r.doc_id: r.text for r in after}
    assert len(new) == len(before)
    pattern, seen = regex.compile(pii.PATTERN), {}
    for r in before:
        old, got = [m.group(0) for m in pattern.finditer(r.text)], new[r.doc_id]
        if not old:
            assert got == r.text
            continue
        # Everything around the mentions stays, and each mention became another of its length or kind.
        at, spans, parts = 0, [], [r.text[a:b] for a, b in itertools.pairwise([0, *itertools.chain(*(m.span() for m in pattern.finditer(r.text))), len(r.text)])][::2]
        for k, part in enumerate(parts):
            found = got.find(part, at) if k < len(parts) - 1 else len(got) - len(part)
            assert found >= at and got[found : found + len(part)] == part and (k or found == 0)
            if k:
                spans.append(got[at:found])
            at = found + len(part)
        for e, s in zip(old, spans, strict=True):
            assert e != s and seen.setdefault(e, s) == s
    assert seen and len(set(seen.values())) == len(seen)


def test_packing_stage(stages):
    before, after = stages["best_fit_packing"]
    enc, texts = tokens.load(public_tokenizers.path("byte_bpe_50k.json")), {r.doc_id: r.text for r in before}
    by, bins = {}, {}
    for r in after:
        by.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert by.keys() == texts.keys()
    for d, rows in by.items():
        ids, at = [*enc.encode(texts[d], add_special_tokens=False).ids, 2], 0
        for k, r in enumerate(sorted(rows, key=lambda r: r.piece)):
            raw = b"".join(i.to_bytes(4, "little") for i in ids[at : at + r.length])
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(raw)) and (k == 0 or r.length == 1024)
            at += r.length
        assert at == len(ids) and (len(rows) == 1 or len(ids) > 1024)
    for parts in bins.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(parts)) and sum(n for _, n in parts) <= 1024
    assert len(bins) <= 1.02 * -(-sum(r.length for r in after) // 1024) + 1
