"""Each operator against a plain version on hard small tables: nulls, empty and very long texts, ties, repeated rows,
empty tables, extra columns with clashing names."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tierstats.llm import chat, decontam, license, lines, mixing, pii, rules, simhash, substrings, toxicity
from tierstats.operators.graph import connected_components

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, tid string, h string, size string, fp string, key string, words string"


def corpus():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 7)))
    say = lambda n: " ".join(word() for _ in range(n))
    passage, common = say(60), "  The Same LINE\t"
    texts = [None, "", "", " \n\t ", "one", "ÄÖ é x 日本 語", "a " * 120, say(200) + "\n" + passage, passage + " " + say(40), say(30) + "\x0b" + passage.replace(" ", "\n") + say(3)]
    texts += [f"{say(12)}\n{common}\n{say(5)}" for _ in range(9)] + [f"the same line\n\n{say(4)}"]
    long = say(30_000)
    texts += [long, long, long.upper(), say(80)]
    base = say(90).split()
    for _ in range(6):  # near copies
        w = list(base)
        w[rnd.randrange(90)] = word()
        texts.append(" ".join(w))
    return list(enumerate(texts)) + [(100, "twice twice"), (100, "twice twice"), (None, "no id " + passage), (101, "x" * 5000)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if n % 5 == 0 else f"s{n % 3}", len(t or ""), "x", "x", "x", "x", "x", "x", "x") for n, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_substring_dedup(docs, nothing):
    assert got(substrings.strip_repeats(docs, with_text=False).drop("kept", "factors")) == brute.strip_repeats(ROWS)
    kept = {r.doc_id: r.kept for r in substrings.strip_repeats(docs).collect()}
    assert kept[4] == "one" and kept[0] == ""
    assert substrings.strip_repeats(nothing).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_substring_dedup_with_few_words(spark, seed):
    """A vocabulary of two words: windows repeat at every distance, also inside one text."""
    rnd = random.Random(seed)
    rows = [(i, " ".join(rnd.choice("ab") if rnd.random() < 0.1 else "a" for _ in range(rnd.choice((34, 35, 36, 90, 300))))) for i in range(12)]
    assert got(substrings.strip_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=False).drop("kept", "factors")) == brute.strip_repeats(rows)


def test_line_dedup(docs, nothing):
    marked = lines.apply_bitmaps(docs, lines.keep_bitmaps(docs))
    rows = marked.select("id", F.size("lines").cast("long"), "n_dropped", F.sha2(F.array_join("kept", "\n"), 256))
    assert got(rows) == brute.line_dedup(ROWS)
    out = lines.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert {r.doc_id: r.text for r in out.collect()}[0] is None
    assert lines.dedup_lines(nothing).count() == 0


def test_line_order_is_consumed(spark):
    """The window streams over the range partitions: one sort and one exchange below it, both by hash, document and position."""
    rows = spark.range(3000).select(F.col("id").alias("pos"), F.xxhash64(F.col("id") % 7).alias("h"), F.hash(F.col("id") % 7).alias("g"), (F.col("id") % 100).alias("id"))
    firsts = lines.first_occurrences(rows)
    plan = firsts._jdf.queryExecution().executedPlan().toString()
    assert "Window [row_number()" in plan and plan.count("Sort [h") == 1 and plan.count("Exchange rangepartitioning(h") == 1 and plan.count("Exchange") == 1
    assert firsts.count() == rows.select("h", "g", "id").distinct().count()


def test_line_dedup_with_any_column_names(spark):
    names = "id row rk text_ mark_id mark_rk words n lines kept n_dropped dense".split()
    d = spark.createDataFrame([(i, f"same\nown {i}", *["x"] * len(names)) for i in range(10)], ["doc_id", "text", *names])
    out = lines.dedup_lines(d)
    assert out.columns == d.columns and {(r.doc_id, r.text, r.row) for r in out.collect()} == {(i, f"own {i}", "x") for i in range(10)}


def test_line_bitmaps_over_many_words(spark):
    """Dropped lines far apart: the sparse bitmap has gaps of whole words."""
    rows = [(i, "\n".join("same" if n in (0, 64, 700) else f"{i} {n}" for n in range(701 + i))) for i in range(10)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    bits = lines.keep_bitmaps(d)
    assert all([w.word for w in r.words] == [0, 1, 10] for r in bits.collect())
    assert {r.doc_id: r.text for r in lines.dedup_lines(d).collect()} == {i: "\n".join(x for x in t.split("\n") if x != "same") for i, t in rows}


@pytest.mark.parametrize("tile", [2, 2048])
def test_simhash(docs, nothing, tile):
    rows = [(i, t) for i, t in ROWS if i is not None]
    prints = {i: brute.fingerprint(t) for i, t in rows}
    want = brute.components(prints)
    found = simhash.near_duplicates(docs.where("doc_id is not null"), tile=tile).collect()
    assert len(found) == len(rows)
    assert all(r.fp % (1 << 64) == prints[r.doc_id] and r.component_id == want[r.doc_id] for r in found)
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.near_duplicates(docs).count() == len(ROWS)


@pytest.mark.parametrize("radius", [4, 8])
@pytest.mark.parametrize("n", [10, 1 << 25, 1 << 33, 1 << 50])
def test_masks_lose_no_pair(n, radius):
    """Any ``radius`` differing bits leave one mask untouched."""
    rnd = random.Random(n)
    masks = simhash.block_masks(n, radius, 2048)
    assert len(masks) <= 64
    for _ in range(3000):
        d = sum({1 << rnd.randrange(64) for _ in range(radius)})
        assert any(d & m == 0 for m in masks)


def test_large_groups_by_tiles(spark):
    """Many fingerprints that share a block, in chains, with small tiles."""
    rnd = random.Random(1)
    fps = {rnd.getrandbits(12) for _ in range(400)}
    d = spark.createDataFrame([(f,) for f in fps], "fp long")
    root = {r.node: r.root for r in simhash.fingerprint_components(d, tile=16).collect()}
    assert {f: root.get(f, f) for f in fps} == brute.components({f: f for f in fps})


@pytest.mark.parametrize("tile", [8, 40])
def test_large_groups_with_a_rest(spark, tile):
    """One large component and many small ones in the same groups: what is outside the large one still meets everything."""
    rnd = random.Random(tile)
    bases = [rnd.getrandbits(30) for _ in range(40)]
    fps = {b ^ (1 << rnd.randrange(30)) ^ (1 << rnd.randrange(30)) for b in [bases[0]] * 150 + bases * 3}
    root = {r.node: r.root for r in simhash.fingerprint_components(spark.createDataFrame([(f,) for f in fps], "fp long"), tile=tile).collect()}
    want = brute.components({f: f for f in fps})
    assert {f: root.get(f, f) for f in fps} == want and len(set(want.values())) > 10


def test_components_of_a_long_chain(spark):
    d = spark.range(500).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in connected_components(d).collect()} == {0}
    assert connected_components(d.limit(0)).count() == 0


def test_personal_data(spark, nothing):
    rnd = random.Random(3)
    parts = ["a.b+c@x-y.co.uk", "@", "a@b", "a@b.c@d.e", "1.2.3.4", "256.1.1.1", "001.2.3.04.5", "4111 1111-1111 1111", "4111111111111112", "+1 (743) 555-3824", "+12", "5" * 40, "x" * 30, ".", " ", "\n", "é", "日", "+", "-", "9" * 300 + ".1.1.1"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))) for i in range(300)] + [(300, None), (301, ""), (301, "")]
    out = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.joined("base").alias("b"), "spans", "base").collect()
    assert sorted((r.doc_id, r.b) for r in out) == sorted((i, brute.base_spans(t or "")) for i, t in rows)
    assert all(set(r.base) <= set(r.spans) for r in out)
    assert pii.find_personal_data(nothing).count() == 0


def test_personal_data_beyond_the_base(spark):
    texts = [f"please call phone (212) 555-0{n:03d} or mail bob{n}@host{n}.com today" for n in range(40)] + [f"release version 212-555-0{n:03d}x of the part" for n in range(20)] + ["nothing here"] * 20
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: [s.kind for s in r.spans] for r in pii.find_personal_data(d).collect()}
    assert all(spans[i] == ["phone_local", "email"] for i in range(40)) and not any(spans[i] for i in range(40, 80))


def test_chat_round_trip(spark):
    says = ["", "\\", "<|im_end|>", "<\\|im_start|>", "a<", "|b", "\\\\<|", "x\n<|im_start|>user\ny", "<|im_end|><|im_start|>assistant ok"]
    rows = [(1, i, role, t) for i, (t, role) in enumerate((t, r) for t in says for r in ("user", "assistant", "a<|b\nc\\"))] + [(2, 0, None, None), (2, 0, None, None), (None, 1, "user", "x"), (3, None, "assistant", "y")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(chat.canonical_turns(chat.conversation_records(d), "conv_id", "turn", "record"))
    back = chats.select("id", "formatted", chat.parse_chat(F.col("formatted")).alias("t"), F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat.unescape(s["text"])).alias("loss")).collect()
    for r in back:
        want = [(role or "", t or "") for c, n, role, t in sorted(rows, key=lambda x: (x[0] or 0, x[1] or 0)) if c == r.id]
        assert sorted((x.role, x.text) for x in r.t) == sorted(want) and [x[1] for x in want if x[0] == "assistant"] == r.loss
        assert len(re.findall(r"<\|im_start\|>", r.formatted)) == len(want)


def test_chat_layouts(spark):
    records = ['{"prompt":"p","response":"r","extra":[1]}', '{"instruction":"i","output":"o"}', '{"output":"o","input":"x","instruction":"i"}', '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":null}]}', '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"z"}],"id":3}', '{"other":1}', "[]"]
    d = spark.createDataFrame(list(enumerate(records)), "id long, r string").select("id", F.lit(0).alias("o"), F.parse_json("r").alias("v"))
    turns = got(chat.canonical_turns(d, "id", "o", "v").select("id", "layout", "role", "text"))
    assert turns == sorted([(0, "prompt_response", "user", "p"), (0, "prompt_response", "assistant", "r"), (1, "instruction", "user", "i"), (1, "instruction", "assistant", "o"), (2, "instruction_input", "system", "i"), (2, "instruction_input", "user", "x"), (2, "instruction_input", "assistant", "o"), (3, "messages", "user", "a"), (3, "messages", "assistant", ""), (4, "conversations", "user", "q"), (4, "conversations", "assistant", "z"), (5, None, None, None), (6, None, None, None)], key=str)


def test_leaks(spark, docs):
    items = ["Anna has 5 apples and gives 5 apples to Bob on a sunny day in June", "the quick brown fox jumps over a lazy dog near the river bank today", "only four words here", "no no"]
    bench = spark.createDataFrame(list(enumerate(items)) + [(9, None), (10, "")], "item_id long, text string")
    texts = ["x y z " + items[0] + " and more", "So EMMA has 7 apples and gives 7 apples to Tom on a sunny day in June!", "Emma has 7 apples and gives 9 apples to Tom on a sunny day in June", "a text of " + items[1].upper(), "well: only four words here.", "no no no", None, "", items[0] + " " + items[0], "The quick brown fox jumps over nothing"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r.doc_id, r.item_id, r.exact) for r in decontam.find_leaks(d, bench).collect()}
    assert found == {(0, 0, True), (1, 0, False), (3, 1, True), (4, 2, True), (8, 0, True)}
    assert decontam.find_leaks(d.limit(0), bench).count() == 0 and decontam.find_leaks(d, bench.limit(0)).count() == 0
    assert decontam.find_leaks(docs, bench).count() == 0


def test_leaks_without_sending_the_benchmark(spark, monkeypatch):
    items = spark.createDataFrame([(0, "one two three alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id long, text string")
    d = spark.createDataFrame([(i, f"{i} " + "four five six alpha beta gamma delta epsilon zeta eta theta iota kappa" * (i % 2)) for i in range(6)], "doc_id long, text string")
    small = got(decontam.find_leaks(d, items))
    monkeypatch.setattr(decontam, "MAX_SENT", 0)
    assert got(decontam.find_leaks(d, items)) == small and {r[0] for r in small} == {1, 3, 5}


def test_rules(docs, nothing):
    r = {x.doc_id: x for x in rules.apply_policy(rules.ledger(docs)).collect() if x.doc_id is not None}
    assert r[0].n_words == 0 and not r[0].kept and r[6].n_repeat_words == 120 and r[6].n_words == 120
    assert rules.ledger(nothing).count() == 0
    led = rules.ledger(docs)
    a = {x.rule: (x.n_failed, x.n_only) for x in rules.ablations(led).collect()}
    bits = [x.fail_bits for x in led.collect()]
    for name, (bit, _) in rules.rules().items():
        assert a[name] == (sum(b >> bit & 1 for b in bits), sum(b == 1 << bit for b in bits))


def test_licenses(spark, nothing):
    texts = ["Under the MIT License; under the mit-license", "Apache License, Version 2.0", "cc by nc cc-by-nc", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "permission is hereby granted to all", "mit", None, "", "under the É mit license", "GNU Lesser General Public License v3"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    r = {x.doc_id: tuple(x)[1:] for x in license.scan_licenses(d).collect()}
    assert r[0][:6] == (8, 2, 0, 4, "mit", "mit") and r[0][6] == 1.0
    assert r[1][1:6] == (1, 0, 0, "apache-2", "apache-2") and r[2][:4] == (6, 2, 0, 3)
    assert r[3][1] == 0 and r[3][5] == "mit" and r[3][6] > 0.9
    assert r[4][5] == "" and r[5][5] == "" and r[6] == r[7] == (0, 0, None, None, "", "", 0.0) and r[8][1] == 0 and r[9][5] == "lgpl"
    assert license.scan_licenses(nothing).count() == 0


def test_mixing(spark, docs, nothing):
    rnd = random.Random(2)
    rows = [(i, " ".join("w" * rnd.randint(0, 30)), rnd.choice(["a", "a", "a", "b", "c", None, "d"])) for i in range(3000)] + [(9000, "", "empty")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_sources(d)
    seen = out.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"), F.max("source_size").alias("z"), F.max("size").alias("m")).collect()
    assert all(abs(r.t - r.g) <= r.m and r.g <= 3 * r.z + 1e-6 for r in seen)
    assert sum(r.g for r in seen) == pytest.approx(sum(r.z for r in seen))
    assert got(out) == got(mixing.mix_sources(d.repartition(5)))
    assert all(r.taken <= 3 * r.size for r in out.collect())
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == [*docs.columns, "n_copies"]
    assert mixing.mix_sources(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0
    assert mixing.mix_sources(docs).count() == len(ROWS)


def test_toxicity_on_held_out_rows(spark, nothing):
    rnd = random.Random(4)
    bad = ["vile", "nasty", "rotten", "awful", "foul"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        w = ["".join(rnd.choice("abcde") for _ in range(5)) for _ in range(rnd.randint(20, 80))]
        for _ in range(rnd.randint(1, 6) if toxic else 0):
            w.insert(rnd.randrange(len(w)), rnd.choice(bad))
        rows.append((i, " ".join(w)))
        if i < 400:
            labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (1001, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(1, None), (0, 1), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(d, lab)
    assert model.thresholds[0] < model.thresholds[1]
    r = {x.doc_id: x for x in toxicity.score_toxicity(d, model).collect()}
    held = [(r[i].p_toxic >= 0.5, i % 5 == 0) for i in range(400, 600)]
    assert sum(a == b for a, b in held) >= 195
    assert r[1000].p_toxic < 0.5 and 0 <= r[0].severity <= 2
    none = toxicity.train(d, lab.where("toxic = 0"))
    assert max(x.p_toxic for x in toxicity.score_toxicity(d, none).collect()) < 0.01
    assert toxicity.score_toxicity(nothing, model).count() == 0 and toxicity.train(nothing, lab).weights == {}
