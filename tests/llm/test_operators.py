"""Every operator against plain versions, on invented rows with nulls, empty, long, tied and repeated texts, and on the smallest table."""
import random
import textwrap

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarterdeck.llm import (op1_quality_rules, op2_jaccard_join, op3_token_store, op4_chat_format, op5_language_id, op6_quality_classifier, op7_decontamination, op8_pii,
                             op9_byte_bpe, op10_license_scan, queries)
from quarterdeck.llm.components import components
from quarterdeck.llm.pieces import PieceCache

SMALL = "/root/testdata/sf0.001"
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def texts() -> list[tuple[int, str | None]]:
    rng = random.Random(4)
    words = ["the", "of", "Über", "naïve", "x", "12", "don't", "a_b", "**", "漢字", "🙂", "end."]
    base = [rng.choice(words) + str(rng.randint(0, 400)) for _ in range(400)]
    near = [[w if rng.random() > 0.002 * k else "new" for w in base] for k in range(12)]
    rows = [None, "", "   \n\t ", "one", "Two words", "a a a a a", "line\nline\n\nline", " x" * 30_000, "  lead\ttail \n", "a\x1cb c", "<s>[INST] </s> ~ ~~ [/INST]",
            "mail a.b@c.de.f_g@h.ij 1.2.3.4.5 300.1.1.1 +1 (499) 555-6503 4111 1111 1111 1111, 4111-1111-1111-1112 +12", " ".join(base), " ".join(base), *[" ".join(n) for n in near],
            *["".join(rng.choice("ab \n\t.'s9é漢=") for _ in range(rng.randint(0, 80))) for _ in range(60)]]
    return list(enumerate(rows))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", -1, "kept") for i, t in texts()], "doc_id long, text string, lang string, source string, n_words int, hit_from string")


def test_rules(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(3, None, 0)], "doc_id long, quality int, toxic int")
    judged, _ = op1_quality_rules.judge(docs, labels, carry=["doc_id"])
    got = {r["doc_id"]: tuple(r[c] for c in [*op1_quality_rules.BASE, "base_failed"]) for r in judged.collect()}
    assert got == {i: brute.op1(t) for i, t in texts()}
    assert not op1_quality_rules.judge(docs, labels.limit(0), carry=["doc_id"])[1].rules


def test_rules_find_the_junk(spark):
    rows = [(i, " ".join(f"w{i}x{k}" + ("###" if i % 5 == 0 else "") for k in range(60))) for i in range(300)]
    labels = spark.createDataFrame([(i, 0 if i % 5 == 0 else 1) for i, _ in rows], "doc_id long, quality int")
    judged, rules = op1_quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert rules.rules and all(r["kept"] == (r["doc_id"] % 5 > 0) for r in judged.collect())


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_join(docs, size, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op2_jaccard_join.join(docs, size=size, percent=percent).collect()}
    assert got == brute.op2(texts(), percent, size)


def test_words_of_two_letters_differ(spark):
    """Words whose polynomials agree in every odd base modulo 2^64."""
    first = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    second = first.translate(str.maketrans("ab", "ba"))
    rows = [(i, " ".join(f"{w}x{k}" for k in range(40))) for i, w in enumerate((first, second))] + [(2, first), (3, second)]
    got = op2_jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), size=4, percent=85).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(k, k) for k in range(4)}


def test_join_of_a_large_group(spark):
    rng = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(260):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(120)] = f"n{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(own)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op2_jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), size=4, percent=85).collect()}
    assert got == brute.op2(rows)


def test_divide_skip():
    rng = random.Random(2)
    block = [np.unique(np.array(rng.sample(range(60), 30), np.uint64)) for _ in range(40)]
    query = rng.sample(range(60), 30)
    found = op2_jaccard_join.DivideSkip(block).overlaps(query, [16] * 40)
    assert found == {k: c for k, b in enumerate(block) if (c := len(set(query) & set(b.tolist()))) >= 16}


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(100, 101), (101, 102), (5, 5), (None, 3)], "a long, b long")
    assert {r["node"]: r["root"] for r in components(links).collect()} == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100, 102: 100}
    assert components(links.limit(0)).count() == 0


def test_store(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATHS[0])
    folder = op3_token_store.store_path(spark)
    odd = [(900, "hello <|endoftext|> world"), (901, "<|endoftext|>"), (902, " lead of <|endoftext|x")]
    op3_token_store.write_store(docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string")), folder, PATHS[0], block_ids=500)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["c"]) for r in op3_token_store.read_store(spark, folder).withColumn("c", F.crc32("ids")).collect()}
    assert got == brute.op3(texts() + odd, lambda t: tokenizer.encode(t, add_special_tokens=False).ids) and 50256 in tokenizer.encode(odd[0][1]).ids
    empty = op3_token_store.store_path(spark)
    op3_token_store.write_store(docs.limit(0), empty, PATHS[0])
    assert op3_token_store.read_store(spark, empty).count() == 0


def test_cached_pieces_are_the_librarys():
    rng, cache = random.Random(6), op3_token_store.library(PATHS[0])
    marks = ["a", "The", " the", " ", "  ", "\n", "é", " Über", "漢", "'s", " don't", "12", " 3", ".", "!?", "\t", "the", "ing", "\xa0", "_"]
    rows = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 25))) for _ in range(6000)]
    for most in (450_000, 20):
        cache.most = most
        assert [np.frombuffer(x, "<u4").tolist() for k in range(0, 6000, 500) for x in cache.texts([t.encode() for t in rows[k : k + 500]])] == [e.ids for e in cache.tokenizer.encode_batch(rows, add_special_tokens=False)]
    cache.most = 450_000


def test_new_pieces_are_merged_by_the_run():
    class Counted:
        def __init__(self, model):
            self.held, self.calls = model, 0

        def __getattr__(self, name):
            self.calls += 1
            return getattr(self.held, name)

    from tokenizers import Tokenizer

    rng, tokenizer = random.Random(7), Tokenizer.from_file(PATHS[0])
    cache = PieceCache(tokenizer, op3_token_store.BYTE_LEVEL)
    cache.model = Counted(cache.model)
    ends = ["", ".", ",'", "s' ", "\nÀb", "7", "漢", "\xff", "ɏ", "\t", "$$$", "é_"]
    rows = [" ".join("".join(rng.choices("abcdeéß", k=rng.randint(1, 9))) + rng.choice(ends) for _ in range(20)).encode() for _ in range(500)] + [None, b"", b" ", b"a ", b" \xe2\x82 b\xff", b"  a"]
    wanted = [e.ids for e in tokenizer.encode_batch([(t or b"").decode("utf-8", "replace") for t in rows], add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in cache.texts(rows)] == wanted and cache.model.calls <= 4
    for name, value in (("run", 7), ("complete", False)):
        again = PieceCache(tokenizer, op3_token_store.BYTE_LEVEL, most=50)
        setattr(again, name, value)
        assert [np.frombuffer(x, "<u4").tolist() for k in range(0, 506, 100) for x in again.texts(rows[k : k + 100])] == wanted
    assert cache.texts([]) == []


def test_code_lengths():
    ranks = np.array([0, 255, 256, 65535, 65536, 1 << 24, 4_000_000_000], "<u4")
    control, data = op3_token_store.pack(ranks)
    assert len(data) == 1 + 1 + 2 + 2 + 3 + 4 + 4 and (op3_token_store.unpack(control, data, len(ranks)) == ranks).all()


def test_chat_folds_the_log(spark):
    log = spark.createDataFrame([
        (1, 1, 1, "delta", "user", "he"), (1, 2, 1, "delta", "user", "llo"), (1, 3, 2, "delta", "assistant", "bad"), (1, 4, 2, "regenerate", "assistant", None),
        (1, 5, 2, "delta", "assistant", "go"), (1, 6, 2, "delta", "assistant", "od</s>"), (1, 7, 3, "delta", "user", "void"), (1, 8, 1, "edit", "user", "hi ~</s>"),
        (1, 9, 2, "delta", "assistant", "new [INST]"), (2, 1, 1, "delta", None, None)], "conv_id long, seq long, turn long, kind string, role string, text string")
    got = {r["conv_id"]: r for r in op4_chat_format.parse(op4_chat_format.render(op4_chat_format.messages(log))).collect()}
    assert (got[1]["roles"], got[1]["texts"], got[1]["learned"]) == (["user", "assistant"], ["hi ~</s>", "new [INST]"], ["", "new [INST]"])
    assert (got[2]["roles"], got[2]["texts"]) == ([""], [""])


def test_chat_round_trip(spark):
    rows = [(7, i, ("user", "assistant", None)[i % 3], t) for i, t in texts()] + [(8, 1, "assistant", "</s>[INST] ok [/INST]")] * 2
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in op4_chat_format.parse(op4_chat_format.render(op4_chat_format.messages(op4_chat_format.as_log(table)))).collect()}
    assert got[7]["texts"] == [t or "" for _, t in texts()] and got[7]["roles"] == [("user", "assistant", "")[i % 3] for i, _ in texts()]
    assert got[8]["learned"] == ["</s>[INST] ok [/INST]"] * 2
    assert "".join(got[7]["learned"]) == "".join(t or "" for i, t in texts() if i % 3 == 1)


def test_language(spark):
    rows = queries.op5(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.95 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)


def test_language_without_letters(spark, docs):
    model = op5_language_id.learn(docs.limit(0))
    assert {r["lang_pred"] for r in op5_language_id.predict(docs, model).collect()} == {"und"}
    one = op5_language_id.predict(spark.createDataFrame([(1, None), (2, "12 !"), (3, "ab")], "doc_id long, text string"), op5_language_id.learn(docs))
    assert [r["lang_pred"] for r in one.orderBy("doc_id").collect()] == ["und", "und", "en"]


def test_quality(spark, docs):
    rows = queries.op6(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out").collect()
    right = [[r["predicted"] == r["quality"] for r in rows if r["quality"] == q] for q in (0, 1)]
    assert all(sum(x) >= 0.9 * len(x) for x in right)
    featured = op6_quality_classifier.with_features(docs)
    assert {r["predicted"] for r in op6_quality_classifier.predict(featured, op6_quality_classifier.learn(featured.limit(0).withColumn("good", F.lit(True)))).collect()} == {1}


@pytest.mark.parametrize("block", [500_000, 9])
def test_windows(spark, docs, block):
    long = texts()[12][1].split()
    items = [(5, " ".join(long[10:60])), (5, " ".join(long[10:60])), (40, "one"), (41, None), (42, " ,"), (43, "Two words"), (7, " ".join(long[100:114])), (8, " ".join(long[100:113]))]
    found = op7_decontamination.search(docs, spark.createDataFrame(items, "item_id long, text string"), block_windows=block)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], len(r["items"]), brute.sha(",".join(r["items"])), r["contaminated"]) for r in found.collect()}
    assert got == {i: brute.op7(t, items) for i, t in texts()}


def test_personal_data(spark, docs):
    rows = op8_pii.find(docs, carry=["doc_id", "text"]).withColumn("new", op8_pii.redacted(F.col("text"))).withColumn("listed", op8_pii.listed(op8_pii.KINDS)).collect()
    for r in rows:
        want = brute.op8(dict(texts())[r["doc_id"]])
        assert (*(len(r[k]) for k in op8_pii.KINDS), r["listed"]) == (*want[:4], want[5])
    assert next(r["new"] for r in rows if r["doc_id"] == 11).startswith("mail [EMAIL][EMAIL] [IP].5 ")


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"w{i} account number 41111111111111{11 if i < 20 else 12} and a{i} total of 123456{i}") for i in range(24)]
    rows = [(i, t.replace("4111111111111111", f"a{i}@b.com") if i < 20 else t) for i, t in rows]
    found = {r["doc_id"]: r["context"] for r in op8_pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(len(found[i]) == (i >= 20) for i in range(24))


def test_store_looks_up_a_batch_at_once(spark, monkeypatch):
    rng = random.Random(9)
    given = [" ".join("".join(rng.choices("abcdefghij", k=9)) for _ in range(330)) for _ in range(1000)]
    starts, calls, cache = [], [], op3_token_store.library(PATHS[0])
    monkeypatch.setattr("quarterdeck.llm.staging.mapped", lambda df, schema, start: starts.append(start))
    monkeypatch.setattr(cache, "merged", lambda stream, sizes: calls.append(len(sizes)) or PieceCache.merged(cache, stream, sizes))
    op3_token_store.encoded(spark.createDataFrame([("",)], "text string"), PATHS[0])
    made = list(starts[0]()(pa.RecordBatch.from_pydict({"text": given[:250]})))
    assert len(made) == 1 and len(calls) == 2 and calls[0] > 80_000
    plain = Tokenizer.from_file(PATHS[0]).encode_batch_fast(given[:250], add_special_tokens=False)
    assert [np.frombuffer(x, "<u4").tolist() for x in made[0].column(1).to_pylist()] == [[*p.ids, 2] for p in plain]
    assert len(list(starts[0]()(pa.RecordBatch.from_pydict({"text": given})))) == 1  # 3.3 MB


def test_graph_tables_are_few_files(spark, monkeypatch):
    rows = [(i, f"w{i} account number 41111111111111{11 if i < 20 else 12} and a{i} total of 12345{i}6 b{i}@c.de by {i}5551234 {i}") for i in range(200)]
    files, staged = {}, op8_pii.staged

    def counted(df, name, *most):
        files[name] = max(files.get(name, 0), len((out := staged(df, name, *most)).inputFiles()))
        return out

    monkeypatch.setattr(op8_pii, "staged", counted)
    set_to = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in set_to}
    for name, value in set_to.items():
        spark.conf.set(name, value)
    try:
        found = op8_pii.find(spark.createDataFrame(rows, "doc_id long, text string"))
        parts = found.rdd.getNumPartitions()
        assert {r["doc_id"]: bool(r["email"]) for r in found.collect()} == {i: True for i in range(200)}
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert len(files) == 8 and max(files.values()) <= spark.sparkContext.defaultParallelism >= parts, files


def test_encoding(spark, docs):
    import tiktoken

    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=op9_byte_bpe.ranks_of(PATHS[1]), special_tokens={})
    rows = op9_byte_bpe.decode(op9_byte_bpe.encode(docs, PATHS[1], public_tokenizers.PATTERN, offsets=True), PATHS[1]).collect()
    for r in rows:
        text = r["text"] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == plain.encode_ordinary(text) and bytes(r["decoded"]).decode() == text
        assert np.frombuffer(r["char_from"], "<u8").tolist() == (plain.decode_with_offsets(plain.encode_ordinary(text))[1] if text else [])


def test_licences(spark):
    rows = [(1, None), (2, ""), (3, "x\nReleased under the MIT License.\ny"), (4, "licensed under the APACHE license version 2.0"), (5, "Released under the license of nobody at all"), (3, "y")]
    got = [(r["doc_id"], r["licenses"], r["match_lines"]) for r in op10_license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert got == [(1, [], []), (2, [], []), (3, ["MIT"], [2]), (4, ["Apache-2.0"], [1]), (5, [], []), (3, [], [])]


def test_licences_wrapped_embedded_and_whole(spark):
    held, wrap = op10_license_scan.TEMPLATES, lambda t, n: "\n".join(textwrap.wrap(t, n))
    mit, rng = held["MIT"][-1], random.Random(3)
    gpl = "/* " + wrap(next(t for t in held["GPL-3.0"] if "FITNESS" in t and len(t) < 1000), 50).replace("\n", "\n * ") + "\n */\nint main;"
    rows = [None, "", "\n\n", "MIT", "Copyright 2020 Jane Doe. Released under the MIT License.", "some words\nbefore this program was Released\nunder the MIT\nLicense. And after it", gpl,
            f"Copyright (c) 2020 Jane Doe\n\n{mit}", f"{'invented words here ' * 300}\n{mit}\nLicensed under the Apache License, Version 2.0.\n{'more of it ' * 200}",
            *[f"Copyright x\n{held[n][-1]}" for n in ("BSD-2-Clause", "BSD-3-Clause", "ISC")]]
    notices = [t for ts in op10_license_scan.NOTICES.values() for t in ts]
    for _ in range(60):
        own = " ".join(rng.choice([rng.choice(notices), *["other words"] * 2, "the GNU General Public License"]) for _ in range(rng.randint(1, 5))).split()
        rows.append("".join(rng.choice(["", x, "new"] if rng.random() < 0.04 else [x]) + rng.choice([" ", " ", " ", "\n"]) for x in own))
    got = op10_license_scan.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    found = {r["doc_id"]: list(zip(r["match_lines"], r["match_names"], r["match_dice"], strict=True)) for r in got}
    assert found == {i: brute.op10(t, held) for i, t in enumerate(rows)}
    assert [r["licenses"] for r in sorted(got, key=lambda r: r["doc_id"])][4:12] == [["MIT"], ["MIT"], ["GPL-3.0"], ["MIT"], ["Apache-2.0", "MIT"], ["BSD-2-Clause"], ["BSD-3-Clause"], ["ISC"]]
    scanner = op10_license_scan.Scanner(held, 0.85)
    assert all({m[1] for m in scanner.scan(f"x y\n{ts[-1]}".encode())} == {name} for name, ts in held.items())


def test_contexts_reach_over_tokens_and_starts(spark):
    rows = [(1, "Tel +49301234567 Acct 123456789"), (2, "a@b.de"), (3, "x" * 200 + " is" + " " * 150 + "987654321"), (4, "no: 7654321, 7654322"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__text", F.coalesce("text", F.lit("")))
    found = docs.withColumns({k: op8_pii.spans(F.col("__text"), k) for k in op8_pii.KINDS}).withColumn("__base", F.concat(*op8_pii.KINDS)).withColumn("__starts", F.col("__base.start"))
    got = {r["doc_id"]: [(o["token"], o["left"], o["seed"]) for o in r["o"]] for r in found.select("doc_id", op8_pii.occurrences(op8_pii.parts(F.col("__text")), F.col("__starts"), F.col("__base")).alias("o")).collect()}
    assert got == {1: [("+49301234567", "^ tel", True), ("123456789", "# acct", False)], 2: [("a@b.de", "^ ^", True)], 3: [("987654321", "x" * 200 + " is", False)],
                   4: [("7654321,", "^ no", False), ("7654322", "no #", False)], 5: []}


def test_contexts_score_against_the_corpus(spark):
    rng = random.Random(5)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(39)) + "7" for _ in range(30)]
    rows = [(i, f'w{i} about x{chr(97 + i % 26)}q token = "{h}" then y{chr(97 + i % 26)}z') for i, h in enumerate(hexes)]
    numbers = [str(n) for n in range(4000000000000000, 4000000000000200)]
    cards, others = ([n for n in numbers if brute.op8(n)[2] == k][:10] for k in (1, 0))
    rows += [(60 + i, f"v{chr(97 + i)} {n} k{chr(97 + i)}") for i, n in enumerate(cards + others)]
    rows += [(100 + i, f"{'the sum of things ' * 20} mail of person.{i}@mail.example.com and the sum of 7654{i:03d} things") for i in range(30)]
    find = lambda given: {r["doc_id"]: [(s["start"], s["end"]) for s in r["context"]] for r in op8_pii.find(spark.createDataFrame(given, "doc_id long, text string")).collect()}
    found = find(rows)
    assert {i: [dict(rows)[i][a:b] for a, b in s] for i, s in found.items()} == {i: [f'"{hexes[i]}"'] if i < 30 else [] for i, _ in rows}
    assert found == dict(zip(dict(rows), brute.op8_contexts(list(dict(rows).values())), strict=True))
    bare = rows[:50]  # without e-mails no seed has such a shape, and the codes are nothing to it
    assert not any(find(bare).values()) and not any(brute.op8_contexts([t for _, t in bare]))


def test_contexts_against_plain_rounds(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()] + [(9000 + i, t) for i, t in texts()]
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["context"]] for r in op8_pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(zip(dict(rows), brute.op8_contexts([t for _, t in rows]), strict=True)) and sum(map(len, got.values())) >= 13


def test_more_patterns_than_are_broadcast(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("text").unionByName(spark.createDataFrame([(t,) for _, t in texts()], "text string")).withColumnRenamed("text", "__text").fillna("")
    wanted = spark.createDataFrame([("word", "the"), ("pair", "of the"), ("mark", "end."), ("next", "the"), ("word", "nowhere"), ("word", "#")], "form string, key string")
    wanted = wanted.withColumn("h", op8_pii.counted(F.col("form"), F.col("key")))
    one = {(r["h"], r["total"]) for r in op8_pii.frequencies(docs, wanted).collect()}
    monkeypatch.setattr(op8_pii, "HELD", 2)
    assert one == {(r["h"], r["total"]) for r in op8_pii.frequencies(docs, wanted).collect()} and len(one) >= 3


def test_join_of_three_texts_under_one_id(spark):
    rows = [(1, "one a b c d"), (2, "two e f g h"), (3, "three i j k l"), (9, "one a b c d"), (9, "two e f g h"), (9, "three i j k l"), (10, "other m n o p")]
    got = op2_jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), size=4, percent=85).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (2, 1), (3, 1), (9, 1), (10, 10)}
