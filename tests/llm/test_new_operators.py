"""Sharding, token alignment and ranked search against plain versions, with nulls, empty, long, tied and repeated texts, empty tables and clashing names."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quarterdeck.llm import op11_kd_shards, op12_token_alignment, op13_ranked_search, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "  two  blanks  ", "one", "The quick brown fox.", "The quick brown fox.", "the THE The tHe", "naïve Über 漢字 🙂 é", "tab\tand\nline\r\n\n  x", "a▁b", "<s> </s> <unk> <|endoftext|>",
         "x" * 5000, " x" * 20_000, "a\x00b\x1c\x7f", "　wide\xa0nbsp", "don't can't 12.5e-3 $%^&*()_+", "▁▁ start", "trail ", "\n", "ﬁ ligature Å", "İstanbul ẞ ǅ"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    rows = [*TEXTS, *["".join(rng.choice(["the ", "of ", "and ", "ab", " ", "  ", "é", "漢", "\n", ".", "12", "Thing "]) for _ in range(rng.randint(0, 60))) for _ in range(80)]]
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), -5, "kept") for i, t in enumerate(rows)] + [(3, TEXTS[5], None, None, None, 1, "kept"), (None, "lost id", None, "s0", 7, 1, "kept")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_a long, _node string")


# ---- sharding ---------------------------------------------------------------------------------------------------
def test_shards_are_whole_and_near_equal(spark, docs):
    got = op11_kd_shards.assign(docs, shards=5).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in got) == sorted((r["doc_id"] is None, r["doc_id"] or 0, 1 + len((r["text"] or "").encode())) for r in docs.collect())
    assert all(r["_node"] == "kept" and r["n_a"] in (-5, 1) for r in got)
    for shard in range(5):
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))
    assert op11_kd_shards.assign(docs.limit(0), shards=5).collect() == [] and {r["shard"] for r in op11_kd_shards.assign(docs, shards=1).collect()} == {0}


def test_shards_of_a_hot_group(spark):
    # a third of the rows are one text with the same metadata; other copies come in pairs
    rows = [(i, "same text " * 5 if i % 3 == 0 else f"pair {i // 6} " * 6, "s", i % 4) for i in range(6000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = op11_kd_shards.assign(frame, shards=16, keep_text=True).collect()
    sums = Counter()
    for r in got:
        sums[r["shard"]] += r["size"]
    assert len(sums) == 16 and max(sums.values()) - min(sums.values()) <= 4 * 130
    places = {}
    for r in got:
        places.setdefault(r["text"], set()).add(r["shard"])
    assert len(places.pop("same text " * 5)) > 4 and all(len(p) == 1 for p in places.values())


def test_tree_against_sorting(spark):
    """Every cut is the weighted median along the widest dimension of its node."""
    rng = random.Random(3)
    rows = [(i, "x" * rng.randint(0, 50), rng.choice([1, 5, 5, 9]), rng.choice([0.5, 2.25, -3.0, None]), None) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, a int, b double, c string")
    placed = op11_kd_shards.placed(frame, ["a", "b", "c"], "text", 8)
    tree = op11_kd_shards.grow(placed, 3, 8)
    nodes, spans = {0: placed.collect()}, None
    for cuts in tree.levels:
        for cut in cuts:
            held = nodes.pop(cut.node)
            width = [float(max(r["_place"][d] for r in held)) - float(min(r["_place"][d] for r in held)) for d in range(3)]
            spans = spans or [max(1.0, w) for w in width]
            assert cut.dim == max(range(3), key=lambda d: (width[d] / spans[d], -d))
            held.sort(key=lambda r: (r["_place"][cut.dim], r["_h"], r["_r"]))
            left = [r for r in held if (r["_place"][cut.dim], r["_h"], r["_r"]) <= (cut.c, cut.h, cut.r)]
            assert held[: len(left)] == left
            total, ends = sum(r["_w"] for r in held), [sum(r["_w"] for r in held[:k]) for k in range(len(held) + 1)]
            own = {(r["_place"][cut.dim], r["_h"], r["_r"]) for r in held}
            assert abs(ends[len(left)] - total / 2) <= max(sum(r["_w"] for r in held if (r["_place"][cut.dim], r["_h"], r["_r"]) == p) for p in own)
            nodes[cut.left], nodes[cut.right] = left, held[len(left) :]
    assert sorted(nodes) == list(range(-8, 0))


def test_shards_by_target_and_files(spark, docs, tmp_path):
    total = sum(1 + len((r["text"] or "").encode()) for r in docs.collect())
    got = op11_kd_shards.assign(docs, target_bytes=total // 3 + 1, keep_text=True)
    assert {r["shard"] for r in got.select("shard").distinct().collect()} == {0, 1, 2}
    op11_kd_shards.write_shards(got, str(tmp_path / "out"))
    read = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, (r["text"] for r in read.collect()))) == sorted(map(str, (r["text"] for r in docs.collect())))


def test_shard_query(spark):
    source = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = queries.op11(spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {i: (1 + len(t.encode()), zlib.crc32(t.encode())) for i, t in source.items()}
    assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None} and {r["shard"] for r in rows} == set(range(16))


# ---- alignment --------------------------------------------------------------------------------------------------
def plain_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_model.encode_special_tokens = True
    held = op12_token_alignment.byte_characters()
    byte = {c: b for b, c in enumerate(held)}
    rows, counts = [], Counter()
    for text in texts:
        whole, row = (" " + text).encode() if text else b"", None
        if text:
            a, b = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
            ab = [bytes(byte[c] for c in a_model.id_to_token(i)) for i in a]
            bb = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(ab) == b"".join(bb) == whole:
                spans = []
                for parts in (ab, bb):
                    ends = np.cumsum([len(p) for p in parts]).tolist()
                    spans.append(list(zip([0, *ends[:-1]], ends)))
                row = a, b, spans
        rows.append(row)
        if row:
            at = {end: i for i, (_, end) in enumerate(row[2][0])}
            counts.update((row[0][at[end]], row[1][j]) for j, (_, end) in enumerate(row[2][1]) if end in at)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for row in rows:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, "", "", [], []))
            continue
        a, b, (sa, sb) = row
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        ga, gb = [[next(k for k, c in enumerate(cuts) if e <= c) for _, e in s] for s in (sa, sb)]
        said = ";".join(",".join(str(x) for x, g in zip(a, ga) if g == k) + "|" + ",".join(str(x) for x, g in zip(b, gb) if g == k) for k in range(len(cuts)))
        links = [(a[i], b[j]) for i, (_, e) in enumerate(sa) for j, (_, f) in enumerate(sb) if e == f]
        over = [(i, j, min(e, h) - max(d, g)) for i, (d, e) in enumerate(sa) for j, (g, h) in enumerate(sb) if min(e, h) > max(d, g)]
        shared = [(i, j) for i, g in enumerate(ga) for j, h in enumerate(gb) if g == h]
        out.append((len(a), len(b), len(cuts), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(said.encode()).hexdigest(), said, over, shared))
    return out


def test_alignment_against_plain_loops(spark, docs):
    small = docs.filter("text is null or length(text) < 3000")
    texts = {i: r["text"] for i, r in enumerate(small.collect())}
    want = plain_alignment(texts.values())
    got = op12_token_alignment.alignment(small, A, B).collect()
    key = lambda x: (x is None, str(x))
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted([tuple(r[c] for c in names) for r in got]) == sorted(w[:7] for w in want)
    assert all(r["_node"] == "kept" for r in got) and sorted((r["doc_id"] for r in got), key=key) == sorted((r["doc_id"] for r in small.collect()), key=key)
    full = op12_token_alignment.align(small.select("text"), A, B, links=True).collect()
    for r, w in zip(sorted(full, key=lambda r: key(r["text"])), [w for _, w in sorted(zip(texts.values(), want), key=lambda x: key(x[0]))], strict=True):
        assert r["groups"] == w[7] and list(zip(r["overlap_a"], r["overlap_b"], r["overlap_bytes"])) == w[8] and list(zip(r["shared_a"], r["shared_b"])) == w[9]
    assert op12_token_alignment.alignment(docs.limit(0), A, B).collect() == []


def test_alignment_in_blocks(spark, docs):
    aligned = op12_token_alignment.align(docs.select("doc_id", "text"), A, B)
    counts = op12_token_alignment.pair_counts(aligned, 32_000)
    one, many = [op12_token_alignment.with_counts(aligned, counts, block=n).select("doc_id", "n_best", "count_sum") for n in (10**6, 30)]
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_gustavson():
    rng = np.random.default_rng(5)
    for _ in range(40):
        left, right = rng.random((7, 9)) < 0.3, rng.random((9, 6)) < 0.4
        rows = lambda m: (np.concatenate([[0], np.cumsum(m.sum(1))]), np.nonzero(m)[1])
        i, j, n = op12_token_alignment.product(rows(left), rows(right))
        out = np.zeros((7, 6), int)
        out[i, j] = n
        assert (out == left.astype(int) @ right.astype(int)).all() and list(zip(i, j)) == sorted(zip(i, j))
        indptr, indices = op12_token_alignment.transposed(*rows(left), 9)
        assert [indices[indptr[k] : indptr[k + 1]].tolist() for k in range(9)] == [np.flatnonzero(left[:, k]).tolist() for k in range(9)]


def test_pieces_alone_are_those_of_the_text():
    rng, model = random.Random(8), op12_token_alignment.Pieces(B)
    marks = ["a", "The", " ", "  ", "\n", "\t", "é", "漢字", "🙂", "'s", "123", "　", "\xa0", "\x00", "​", "ing", "<s>", "é", "﻿", "ﬁ"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(1, 30))) for _ in range(4000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in model.ids([t.encode() for t in texts])] == model.model.encode(texts)


# ---- ranked search ----------------------------------------------------------------------------------------------
def plain_search(docs, items, k):
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    held = [(i, Counter(word.findall((t or "").translate(lower)))) for i, t in docs]
    held = [(i, c, c.total()) for i, c in held if c]
    count, length = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in held:
            m = 100 - 50 + (50 * n * count) // length
            s = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(word.findall((text or "").translate(lower))) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("slice_postings", "block"), [(2_000_000, 500_000), (60, 500_000), (300, 4)])
def test_search_against_scoring_all(spark, docs, slice_postings, block):
    rng = random.Random(2)
    words = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(4000)]
    more = [(1000 + i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(250)] + [(2000 + i, "tie tie w1") for i in range(80)]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + more
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("rank", F.lit(0))
    items = [(1, "the quick FOX"), (2, None), (3, ""), (4, "nowhere1"), (5, "tie"), (5, "tie w1 w2"), (6, " ".join(words[:60])), (7, "漢字 naïve"), (8, "w1 w2 w3 w4 w5 w6"), (9, "x")]
    found = op13_ranked_search.search(table, spark.createDataFrame(items, "item_id long, text string"), k=20, slice_postings=slice_postings, block_terms=block).collect()
    assert sorted([(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found], key=str) == plain_search(rows, items, 20)


def test_search_of_empty_tables(spark, docs):
    items = spark.createDataFrame([(1, "the quick fox")], "item_id long, text string")
    assert op13_ranked_search.search(docs.limit(0), items).collect() == [] and op13_ranked_search.search(docs, items.limit(0)).collect() == []
    assert op13_ranked_search.search(docs.filter("text is null or text = ''"), items).collect() == []


def test_search_stops_early():
    """Reading ends before the lists do, strictly below the k-th score, so documents that tie with it are met."""
    n = 4000
    terms, times = [np.array([0, 1], np.int64)] * n, [np.array([1 + (k * 7919) % 50, 1 + (k * 104729) % 40], np.int64) for k in range(n)]
    lists = op13_ranked_search.Lists(np.arange(n), np.full(n, 30), terms, times, (n, 30 * n), 2)
    reads = []
    real = np.unique
    op13_ranked_search.np.unique = lambda x, *a, **k: reads.append(len(x)) or real(x, *a, **k)
    try:
        docs, scores = lists.best(np.array([0, 1]), np.array([700, 300]), 10)
    finally:
        op13_ranked_search.np.unique = real
    exact = np.array([sum(w * (1_000_000_000 * int(t) // (1000 * int(t) + 20 * 100)) for w, t in zip((700, 300), x)) for x in times])
    order = np.lexsort((np.arange(n), -exact))[:10]
    assert docs.tolist() == order.tolist() and scores.tolist() == exact[order].tolist() and sum(reads) < n
