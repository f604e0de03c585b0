import random
import re

import numpy as np
import pytest

from tabwise.llm import decontaminate as D
from tabwise.llm.decontaminate import COST, clean, leaks


def words(t):
    t = re.sub(r"[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x26\x28-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t)


def smith_waterman(item, text):
    best, above = 0.0, [0.0] * (len(text) + 1)
    for a in item:
        now = [0.0]
        for j, b in enumerate(text, 1):
            now.append(max(0.0, above[j - 1] + (1 if a == b else -COST), above[j] - COST, now[-1] - COST))
        best, above = max(best, *now), now
    return best


def brute(documents, items, least=0.55, least_words=5):
    out = {}
    for d, text in documents:
        for i, item in items:
            w = words(item)
            score = smith_waterman(w, words(text)) if w else 0
            if w and score >= max(least * len(w), least_words) - 1e-9:
                out[d, i] = round(score / len(w), 9)
    return out


@pytest.fixture(scope="module")
def tables():
    rnd = random.Random(9)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 7))) for _ in range(400)] + ["the", "of", "and"] * 40
    say = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(rnd.randrange(6, 50)))) for i in range(25)]
    documents = []
    for d in range(120):
        body = say(rnd.randrange(0, 150))
        if d % 2:
            item = rnd.choice(items)[1].split()
            for _ in range(rnd.randrange(0, len(item) // 3)):  # edits
                at = rnd.randrange(len(item))
                item[at:at + 1] = rnd.choice([[], say(1), say(1), [item[at], *say(1)]])
                item = item or say(1)
            at = rnd.randrange(len(body) + 1)
            body[at:at] = [w.capitalize() + rnd.choice(["", ",", "."]) for w in item]
        documents.append((d, " ".join(body)))
    return documents, items


def test_against_brute_force(spark, tables):
    documents, items = tables
    d = spark.createDataFrame(documents, "doc_id long, text string").repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(documents, items)
    got = {(r["key"], r["item"]): r for r in leaks(d, b).collect()}
    assert set(got) == set(want)
    assert all(abs(r["similarity"] - want[k]) < 1e-9 for k, r in got.items())
    assert {r["doc_id"] for r in clean(d, b).collect()} == {i for i, _ in documents} - {k for k, _ in got}


def test_words_put_in_after_every_second_word(spark):
    item = [f"w{i}" for i in range(20)]
    broken = [x for i, w in enumerate(item) for x in ([w, f"n{i}"] if i % 2 and i < 19 else [w])]
    d = spark.createDataFrame([(1, " ".join(broken)), (2, "so " + " ".join(item[:10]))], "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert [tuple(r)[:3] for r in leaks(d, b).collect()] == [(1, 1, 0.775)]


@pytest.mark.parametrize("kind", ["replaced", "left out", "put in", "mixed"])
def test_nothing_is_lost_at_any_rate_of_edits(spark, kind):
    rnd = random.Random(kind)
    common = ["which", "of", "the", "following", "is"]
    items = [(i, " ".join(common + [f"i{i}w{k % 11}" for k in range(rnd.randrange(1, 25))])) for i in range(12)]
    rows = []
    for k in range(240):
        w = rnd.choice(items)[1].split()
        for _ in range(rnd.randrange(len(w))):
            at, how = rnd.randrange(len(w)), kind if kind != "mixed" else rnd.choice(["replaced", "left out", "put in"])
            w[at:at + 1] = {"replaced": ["x"], "left out": [], "put in": [w[at], "x"]}[how]
            w = w or ["x"]
        rows.append((k, " ".join([rnd.choice(common) for _ in range(rnd.randrange(9))] + w)))
    d, b = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["key"], r["item"]): round(r["similarity"], 9) for r in leaks(d, b).collect()}
    assert got == brute(rows, items) and got


def test_items_that_share_a_run_are_not_touched_by_it(spark):
    """A document that holds only what all items share leads to none of them."""
    shared = "which of the following"
    words_ = [D._words(np.frombuffer(f"{shared} a{i} b{i} c{i} d{i} e{i} f{i}".encode(), np.uint8), np.array([0, len(f"{shared} a{i} b{i} c{i} d{i} e{i} f{i}")]))[0]
              for i in range(500)]
    items = D.Items(list(range(500)), words_, 0.55, 5)
    counts = np.ones(len(items.vocabulary), np.int64)
    counts[np.searchsorted(items.vocabulary, words_[0][:4])] = 10_000
    items.choose_seeds(counts)
    at = np.searchsorted(items.vocabulary, words_[0][:4])
    assert (items.seed_of[at + 1] == items.seed_of[at]).all()


def test_spans_lie_on_the_copy(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    text = "Éé one two, ALPHA beta gamma; delta EPSILON zeta eta theta. three"
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    b = spark.createDataFrame([(4, item)], "item_id long, text string")
    r = leaks(d, b).first()
    assert text.encode()[r["first_byte"]:r["end_byte"]].decode() == "ALPHA beta gamma; delta EPSILON zeta eta theta"
    assert r["similarity"] == 1.0


def test_a_passage_in_most_documents_is_still_found(spark):
    item = "all these words stand in nearly every one of the documents here"
    rows = [(i, f"x{i} {item} y{i}" if i % 3 else f"other {i} text without it") for i in range(90)]
    d, b = spark.createDataFrame(rows, "doc_id long, text string").repartition(6), spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r["key"] for r in leaks(d, b).collect()} == {i for i in range(90) if i % 3}


def test_blocks_of_items(spark, tables, monkeypatch):
    documents, items = tables
    d = spark.createDataFrame(documents, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    whole = {tuple(r) for r in leaks(d, b).collect()}
    monkeypatch.setattr(D, "BLOCK_WORDS", 200)
    assert {tuple(r) for r in leaks(d, b).collect()} == whole
    assert clean(d, b).count() == len(documents) - len({r[0] for r in whole})


def test_defined_cases(spark):
    item = "one two three four five six seven eight"
    d = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, item, 1), (3, item, 1), (3, item, 1), (4, "one two three", 1)], "doc_id long, text string, item long")
    b = spark.createDataFrame([(1, item), (1, item), (None, item), (2, None), (3, "one two three"), (4, "")], "item_id long, text string")
    got = sorted(((r["key"], r["item"]) for r in leaks(d, b).collect()), key=str)
    assert got == sorted([(k, i) for k in (None, 3, 3) for i in (1, 1, None)], key=str)
    assert sorted(r["doc_id"] for r in clean(d, b).collect()) == [1, 2, 4]
    assert leaks(d, b.limit(0)).collect() == [] and leaks(d.limit(0), b).collect() == []
    assert clean(d, b.limit(0)).count() == 6 and clean(d.limit(0), b).count() == 0


def test_an_edited_copy_of_an_item_that_leaked_often(spark):
    """One whole run is left in four, none of them the first of its stretch."""
    item = [f"w{i}" for i in range(16)]
    edited = [f"other{i}" if i % 4 == 2 else w for i, w in enumerate(item)]
    rows = [(i, " ".join(item)) for i in range(300)] + [(300, "before " + " ".join(edited) + " after")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    b = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r["key"]: r["similarity"] for r in leaks(d, b).collect()}
    assert sorted(got) == list(range(301)) and got[300] == 0.625
    assert clean(d, b).count() == 0


def test_frequent_items_lose_no_copy(spark):
    rnd = random.Random(3)
    items = [(i, " ".join(f"i{i}w{k}" for k in range(15))) for i in range(4)]
    rows = [(k, items[k % 4][1]) for k in range(480)]
    for k in range(480, 900):
        w = items[k % 4][1].split()
        for at in rnd.sample(range(15), rnd.randrange(2, 5)):
            w[at] = f"x{rnd.randrange(50)}"
        rows.append((k, " ".join(w)))
    d, b = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["key"], r["item"]) for r in leaks(d, b).collect()}
    assert got == set(brute(rows, items))


def test_short_items_are_sought_whole(spark, tables):
    documents, items = tables
    more = [(1000, "Who wrote Hamlet?"), (1001, "who wrote hamlet"), (1002, "法国的首都是哪里"), (1003, "capital"), (1004, "one two three four"), (1005, "..."), (1006, None)]
    rows = documents + [(2000, "x é who, WROTE Hamlet y who wrote hamlet"), (2001, "who wrote the Hamlet"), (2002, "问：法国的首都是哪里?"),
                        (2003, "a 法国的首都是哪里? b"), (2004, "one two three five four"), (2005, "capital one two three four"), (2006, "who wrote"), (2007, "hamlet who wrote")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    b = spark.createDataFrame(items + more, "item_id long, text string")
    got = {(r["key"], r["item"]): r for r in leaks(d, b, short=True).collect()}
    short = {k for k in got if k[1] >= 1000}
    assert short == {(2000, 1000), (2000, 1001), (2003, 1002), (2005, 1003), (2005, 1004)}
    assert {k for k in got if k[1] < 1000} == {(r["key"], r["item"]) for r in leaks(d, b).collect()}
    r = got[2000, 1000]
    assert rows[-8][1].encode()[r["first_byte"]:r["end_byte"]].decode() == "who, WROTE Hamlet" and r["similarity"] == 1.0
    assert {r["doc_id"] for r in clean(d, b, short=True).collect()} == {i for i, _ in rows} - {k for k, _ in got}
    only = spark.createDataFrame(more, "item_id long, text string")
    assert {(r["key"], r["item"]) for r in leaks(d, only, short=True).collect()} == short
