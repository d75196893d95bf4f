"""Cases of the round's review."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tierstats.llm import chat, decontam, license, mixing, pii, substrings, toxicity

from . import brute


def test_whole_numbers_are_one_slot(spark):
    items = [
        "A farmer sold 1,200 melons at $3.5 each and paid twenty-five workers for two hundred and six days",
        "the grey river runs past seven old mills and then through a long green valley where 3 apples and 5 pears hang over the stone wall of the abbey",
        "a box of 9 pens costs 9 coins in the little shop beside the church on the hill where the road turns north",
    ]
    texts = [
        "x A farmer sold 950 melons at $4 each and paid 31 workers for 12 days",
        items[1].replace("3 apples and 5", "4 apples and 4"),
        items[2].replace("9 coins", "8 coins"),
        "A farmer sold 950 melons and went home",
    ]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r.doc_id, r.item_id, r.exact) for r in decontam.find_leaks(d, bench).collect()} == {(0, 0, False), (1, 1, False), (2, 2, False)}


def test_number_tokens():
    tokens, forms = decontam.canonical("1,200 3.5kg 1.200,50 twenty-five two hundred and six one two and three 5 million men")
    assert tokens == ["1,200", "3.5kg", "1.200,50", "twenty five", "two hundred and six", "one", "two", "and", "three", "5 million", "men"]
    assert [f == "\x01num" for f in forms] == [True] * 7 + [False, True, True, False]


def test_spelled_emails_and_hyphenated_names_are_candidates():
    kinds = lambda t: [(t[s:e], k) for s, e, k in pii.more_candidates(t, [])]
    assert kinds("write to john.doe (AT) example (DOT) com") == [("john.doe (AT) example (DOT) com", "email_spelled")]
    assert kinds("signed Jean-Pierre Martin") == [("Pierre Martin", "name")]


def test_toxicity_gathers_one_row_an_id(spark):
    """One labelled id with very many rows: the model sees one of its texts."""
    rows = [(i, ("vile rotten " if i % 3 == 0 else "") + f"good day number{i} in the park") for i in range(60)] + [(3, f"vile rotten thing {i}") for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.train(d, labels)
    others = toxicity.train(d.where("doc_id <> 3").unionByName(d.where("doc_id = 3").limit(1)), labels)
    assert model.weights.keys() == others.weights.keys() and "vile" in model.weights


def test_toxicity_takes_grades_and_any_column_names(spark):
    rows = [(i, " ".join(["calm", "words", "here"] + ["vile"] * (i % 3))) for i in range(90)]
    d = spark.createDataFrame([(*r, "kept", "x", "old") for r in rows], "doc_id long, text string, _t string, row string, severity string")
    model = toxicity.train(d, spark.createDataFrame([(i, i % 3) for i in range(90)], "doc_id long, toxic int"))
    out = toxicity.score_toxicity(d, model)
    assert out.columns == ["doc_id", "text", "_t", "row", "severity", "p_toxic"]
    mean = {g: sum(r.severity for r in out.collect() if r.doc_id % 3 == g) / 30 for g in range(3)}
    assert mean[0] < 0.5 < mean[1] < mean[2] and {r._t for r in out.collect()} == {"kept"}


def test_stems_mark_new_words(spark):
    """Compounds that no labelled text has are found by their first letters."""
    rows = [(i, f"an ordinary line about thing{i} " + (f"grumph{'abcdefghij'[i % 10]}{'klmno'[i % 5]} grumph{'pqrst'[i % 5]}" if i % 4 == 0 else "")) for i in range(200)]
    rows += [(1000, "an ordinary line about grumphzz and grumphyy"), (1001, "an ordinary line about nothing at all")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(d, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int"))
    p = {r.doc_id: r.p_toxic for r in toxicity.score_toxicity(d, model).collect()}
    assert p[1000] > 0.5 > p[1001]


def test_license_labels_do_not_depend_on_other_documents(spark):
    grant = "Permission is hereby granted, free of charge, to any person {} a copy of this software"
    texts = [grant.format("getting"), "obtaining a copy", grant.format("obtaining").replace("charge", "cost"), grant.format("obtaining"), None, "", "All rights reserved " + "word " * 50_000 + grant.format("obtaining"), grant.format("obtaining")]
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, rid string, w string")
    together = {r.doc_id: tuple(r)[1:] for r in license.scan_licenses(d).collect()}
    for i in (0, 2, 3):
        assert together[i][5] == "mit" and together[i][6] > 0.85
        assert tuple(license.scan_licenses(d.where(F.col("doc_id") == i)).first())[1:] == together[i]
    assert together[3][6] == 1.0 and together[7] == together[3] and together[1][5] == "" and together[6][5] == "all-rights-reserved,mit"


def test_reliabilities_are_those_of_plain_expectation_maximisation():
    rnd = random.Random(6)
    patterns = sorted({(rnd.choice(pii.KINDS), "".join(rnd.choice("-0+") for _ in pii.LABELERS) + "3210", rnd.randint(1, 400)) for _ in range(60)})
    patterns = [x for i, x in enumerate(patterns) if x[:2] not in [y[:2] for y in patterns[:i]]]
    _, _, post = pii.reliabilities(patterns)
    assert post.tolist() == pytest.approx(brute.em(patterns, len(pii.LABELERS)), abs=1e-9)


def test_planted_secrets_are_found_and_clean_texts_left_alone(spark):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9)))
    hexes = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    plant = [lambda: f'token = "{hexes(40)}"', lambda: f"api key: ghp_{hexes(36)}", lambda: f"card 4111111111111111 {rnd.randint(100, 999)}", lambda: "mail jo.doe (AT) example (DOT) com"]
    decoys = [lambda: f"commit {hexes(40)}", lambda: f"sha256 {hexes(64)}", lambda: "x" * 45, lambda: f"see http://example.com/a/{hexes(30)}/b"]
    rows = []
    for i in range(600):
        w = [word() for _ in range(30)]
        if i % 3 < 2:
            w.insert(rnd.randrange(31), (plant if i % 3 == 0 else decoys)[i // 3 % 4]())
        rows.append((i, " ".join(w), "x", "y"))
    d = spark.createDataFrame(rows, "doc_id long, text string, spans string, id string")
    found = {r.doc_id: sum(s.kind not in pii.BASE_KINDS for s in r.spans) for r in pii.find_personal_data(d).collect()}
    assert sum(found[i] > 0 for i in range(0, 600, 3)) >= 0.95 * 200
    assert not any(found[i] for i in range(600) if i % 3)


def test_many_spans_in_one_text_take_linear_time():
    text = " ".join(f"a{i}@b{i}.com 212-555-{i % 10000:04d}" for i in range(40_000))
    began = time.time()
    base = pii.base_spans(text)
    assert len(base) == len(pii.more_candidates(text, base)) == 40_000 and time.time() - began < 20


@pytest.mark.parametrize("sent", [10**6, 0])
def test_leaks_are_those_of_the_plain_version(spark, monkeypatch, sent):
    """Items planted whole, in part, with other numbers and names, in runs that are too short, and beside clean texts."""
    monkeypatch.setattr(decontam, "MAX_SENT", sent)
    rnd = random.Random(11)
    some = "river mill stone valley bread horse candle window garden winter apple copper".split()
    word = lambda: rnd.choice([*some, *some, str(rnd.randint(1, 9)), "Anna", "Zorbla", "kg", "twenty", "is"])
    items = [(i, " ".join(word() for _ in range(rnd.choice((2, 3, 6, 12, 25))))) for i in range(25)] + [(100, None), (101, ""), (102, "1 2 3 4 5 6 7 8 9 10 11 12 13"), (103, "Yes")]
    change = {"Anna": "Karla", "Zorbla": "Quimby", "kg": "miles", "twenty": "forty", **{str(i): str(i + 20) for i in range(10)}}
    docs = []
    for i in range(120):
        own = (rnd.choice(items)[1] or "").split()
        if i % 3 == 1:
            own = [change.get(w, w) for w in own]
        if i % 4 == 1 and own:
            own[rnd.randrange(len(own))] = "other"
        extra = [word() for _ in range(rnd.choice((0, 5, 20)))]
        docs.append((i, " ".join(extra[: len(extra) // 2] + own + extra[len(extra) // 2 :])))
    docs += [(None, docs[0][1]), (None, docs[1][1]), (0, docs[0][1]), (500, None), (501, "30 31 32 33 34 35 36 37 38 39 40 41 42")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame([(*r, "x", "y", "z") for r in docs], "doc_id long, text string, row string, item string, start string").repartition(3)
    got = sorted(((r.doc_id, r.item_id, r.doc_start, r.exact) for r in decontam.find_leaks(d, bench).collect()), key=str)
    want = sorted((x for n, (i, t) in enumerate(docs) for x in [(i, *y[1:]) for y in brute.leaks([(n, t)], items)]), key=str)
    assert got == want and len({x[1] for x in want}) > 15 and any(not x[3] for x in want)


def test_windows_must_be_consecutive(spark):
    """Runs of 9, 8 and 10 words with changed words between them are no leak, and rows without id are judged one by one."""
    item = " ".join(f"w{i}x" for i in range(29)).replace("0x", "ax")
    w = [f"q{c}" for c in "abcdefghijklmnopqrstuvwxyzABC"]
    text = list(w)
    text[9] = text[18] = "other"
    bench = spark.createDataFrame([(0, " ".join(w)), (1, item)], "item_id long, text string")
    rows = [(1, " ".join(text)), (None, " ".join(w[:10])), (None, " ".join(w[10:20])), (2, " ".join(w))]
    found = decontam.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert [(r.doc_id, r.item_id) for r in found] == [(2, 0)]


def test_factors_are_copies_of_their_reference(spark):
    """Every factor's words stand at its reference place, a passage of a long text is one factor, any window length works."""
    rnd = random.Random(12)
    say = lambda n: [f"w{rnd.randrange(5000)}" for _ in range(n)]
    passage, other = say(400), say(90)
    texts = [say(50) + passage + say(40), passage[100:300] + say(20) + other, say(10) + other + say(5) + passage[:200], other + other, say(100)]
    texts += [texts[4], say(3)]
    d = spark.createDataFrame([(i, " ".join(t), "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, t1 string, factors string")
    keys = {r.doc_id: r.k for r in d.select("doc_id", F.xxhash64(F.lit(0), "text").alias("k")).collect()}
    by_key = {keys[i]: texts[i] for i in range(len(texts))}
    got = {r.doc_id: r.factors for r in substrings.strip_repeats(d).collect()}
    for i, factors in got.items():
        for f in factors:
            if f.ref_start >= 0:
                assert texts[i][f.start : f.end] == by_key[f.ref][f.ref_start : f.ref_start + f.end - f.start]
                assert (f.ref, f.ref_start) != (keys[i], f.start) or i in (4, 5)
    assert max(f.end - f.start for f in got[1]) >= 170 and not got[6] and sum(f.end - f.start for f in got[4]) >= 100
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    for window in (5, 12, 90):
        out = substrings.strip_repeats(d, window=window, with_text=False).drop("kept", "factors")
        assert sorted(map(tuple, out.collect()), key=str) == brute.strip_repeats(rows, window)


def test_items_without_ids_and_with_one_id(spark):
    """Items with a null id, and two texts under one id, are found like others; repeated items once."""
    say = lambda k: " ".join(f"{w}{k}" for w in "abcdefghijklmnopqrst")
    items = [(None, say("x")), (7, say("y")), (7, say("z")), (8, say("w")), (8, say("w"))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame([(n, "before " + t + " after") for n, (_, t) in enumerate(items)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.exact, r.n_items) for r in decontam.find_leaks(d, bench).collect()), key=str)
    assert got == [(0, None, True, 1), (1, 7, True, 1), (2, 7, True, 1), (3, 8, True, 1), (4, 8, True, 1)]


def test_a_common_template_is_joined_once(spark, monkeypatch):
    """300 items and 300 documents of one template: a row a document, and the item whose text it has."""
    say = lambda a, b: f"a farmer in the valley sold {a} melons and then bought {b} sheep at the old market by the river"
    bench = spark.createDataFrame([(i, say(1000 + i, 5000 + i)) for i in range(300)], "item_id long, text string")
    d = spark.createDataFrame([(i, say(9000 + i, 7000 + i)) for i in range(300)] + [(1000 + i, say(1000 + i, 5000 + i)) for i in range(300)] + [(5000, say(4, 4))], "doc_id long, text string")
    for sent in (decontam.MAX_SENT, 0):
        monkeypatch.setattr(decontam, "MAX_SENT", sent)
        found = {r.doc_id: (r.item_id, r.exact, r.n_items) for r in decontam.find_leaks(d, bench).collect()}
        assert found == {i: (0, False, 300) for i in range(300)} | {1000 + i: (i, True, 300) for i in range(300)}


def test_paths_and_hosts_are_no_secrets(spark):
    texts = [f"see src/main/java/com/acme{n}/widgets/Foo.java and src/main/java/com/acme{n}/widgets/Foo" for n in range(60)] + [f"ask abcdefghij{n}1234567890klm.example.com or abcdefghij{n}1234567890klm@mail" for n in range(60)]
    secret = [f"token = abcdefghij{n}1234567890klm." for n in range(20)]
    d = spark.createDataFrame(list(enumerate(texts + secret)), "doc_id long, text string")
    found = {r.doc_id: [s.kind for s in r.spans] for r in pii.find_personal_data(d).collect()}
    assert not any("secret" in found[i] for i in range(120)) and all(found[120 + n] == ["secret"] for n in range(20))


def test_records_with_paths_of_several_layouts(spark):
    """The layout with the most paths that are all there; what none fits is counted."""
    says = [
        '{"prompt":"p","response":"r","role":"x"}', '{"messages":[{"role":"user","content":"m"}],"prompt":"p"}', '{"messages":[]}', '{"instruction":"i","input":"n","output":"o","text":"t"}', '{"other":1}', '{"prompt":"p"}', None,
        '{"prompt":"p","response":null}',
    ]
    d = spark.createDataFrame([(i // 2, i, x) for i, x in enumerate(says)], "id long, ord long, j string").select("id", "ord", F.parse_json("j").alias("r"))
    turns = chat.canonical_turns(d, "id", "ord", "r")
    by = {}
    for r in turns.orderBy("ord", "pos").collect():
        by.setdefault(r.ord, (r.layout, []))[1].append((r.role, r.text))
    assert by == {
        0: ("prompt_response", [("user", "p"), ("assistant", "r")]), 1: ("messages", [("user", "m")]), 2: ("messages", [(None, None)]), 3: ("instruction_input", [("system", "i"), ("user", "n"), ("assistant", "o")]),
        4: (None, [(None, None)]), 5: (None, [(None, None)]), 6: (None, [(None, None)]), 7: ("prompt_response", [("user", "p"), ("assistant", "")]),
    }
    assert {r.id: (len(r.segments) // 3, r.n_unmapped) for r in chat.format_chats(turns).collect()} == {0: (3, 0), 1: (3, 0), 2: (0, 2), 3: (2, 1)}


@pytest.mark.parametrize("tied_rows", [100_000, 7])
def test_equal_rows_meet_the_target(spark, monkeypatch, tied_rows):
    """A source of equal rows is taken as near its target as its rows allow; so are its documents."""
    monkeypatch.setattr(mixing, "TIED_ROWS", tied_rows)
    rows = [(1, "one two three", "a")] * 400 + [(i, "w " * (i % 9), "b") for i in range(300)] + [(None, None, None)] * 5 + [(2, "x y", None)] * 50
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = mixing.mix_sources(d).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("most")).collect()
    assert {r.source for r in out} == {"a", "b", None} and all(abs(r.taken - r.target) <= r.most / 2 + 1e-6 for r in out)
    kept = mixing.mixed_documents(d).where("text is not null").selectExpr("source", "n_copies").groupBy("source").agg(F.sum("n_copies").alias("n")).collect()
    assert {r.source: r.n * {"a": 3, None: 2}[r.source] for r in kept if r.source != "b"} == {r.source: r.taken for r in out if r.source != "b"}


def test_anchors_decide_what_is_looked_up(spark):
    """A phrase whose anchor is elsewhere is not seen; the anchor is the key word that the fewest rows have."""
    d = spark.createDataFrame([(0, "Released under the MIT License."), (1, "the license, a license"), (2, "under the MIT license")], "doc_id long, text string")
    postings = license.posting_list()
    seen = {"license": 3, "mit": 2, "under": 2, "the": 3}
    anchors = license.anchors_of(postings, seen)
    assert anchors["base:under the mit license"].word in ("mit", "under") and anchors["released under the mit license"].word == "mit"
    rows = license.staged(d.select(F.col("doc_id").alias("id"), license.words_of(F.col("text")).alias("w")).withColumn("n_words", F.size("w").cast("long")), "words")
    names = lambda a: {(r.id, p.template) for r in license._matched(rows, postings, a).collect() for p in r.places}
    right = names(anchors)
    assert {(0, "base:under the mit license"), (2, "base:under the mit license"), (0, "released under the mit license")} <= right
    wrong = anchors | {t: p._replace(word="elsewhere") for t, p in anchors.items() if t == "base:under the mit license"}
    assert names(wrong) == {x for x in right if x[1] != "base:under the mit license"}
    shifted = anchors | {t: p._replace(place=p.place + 1) for t, p in anchors.items() if t == "released under the mit license"}
    assert (0, "released under the mit license") not in names(shifted)
