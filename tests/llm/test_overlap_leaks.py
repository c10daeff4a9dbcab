"""Problems 1 and 2 against brute force."""

import random
import re
import time
from collections import Counter

from skein.llm import p01_overlap as P1
from skein.llm import p02_leaks as P2
from skein.llm.tables import expand

SFT = "example_id bigint, split string, source string, family string, prompt string, completion string, built_at timestamp"


def match(a, b, least):
    number = lambda t: sorted(re.findall(r"\d+", re.sub(r"(?<=\d)[,\u202f](?=\d{3}(?!\d))", "", t)))
    word = lambda t: Counter(re.findall(r"[^\W\d_]+", t.lower()))
    x, y = word(a), word(b)
    size = min(sum(w.values()) + len(number(t)) for w, t in ((x, a), (y, b)))
    return size >= least and number(a) == number(b) and 4 * sum((x & y).values()) >= 3 * sum((x | y).values())


def test_overlap_equals_brute_force(spark):
    r = random.Random(5)
    words = "add the red box to nine small hens and count every egg near old town gate".split()
    rows = []
    for i in range(260):
        base = [r.choice(words) for _ in range(r.randint(1, 30))] + [r.choice(["7", "1,234", "1234", "1\u202f234", ""]) for _ in range(r.randint(0, 2))]
        prompt = " ".join(base)
        if rows and r.random() < 0.6:
            prompt = r.choice(rows)[4] or ""
            parts = prompt.split(" ")
            if parts and r.random() < 0.7:
                parts[r.randrange(len(parts))] = r.choice(words)
            prompt = " ".join(parts)
        rows.append((i, r.choice(["train", " Train", "TEST", "validation "]), "s", "f", r.choice([prompt, None, "", prompt, prompt]), r.choice([prompt, " ".join(base), None]), None))
    rows += [rows[3], (999, None, "s", "f", rows[0][4], "x", None), (None, "train", "s", "f", "add 7", "x", None), (1000, "train", "s", "f", "12 + 13 =", None, None), (1001, "test", "s", "f", "12 + 13 =", None, None)]
    want = set()
    for a in rows:
        for b in rows:
            if a[0] is not None and b[0] is not None and a[1] and b[1] and a[0] < b[0] and (a[1].strip().lower() == "train") != (b[1].strip().lower() == "train"):
                if (a[4] and b[4] and match(a[4], b[4], 1)) or (a[5] and b[5] and match(a[5], b[5], 25)):
                    want.add((a[0], b[0]))
    df = spark.createDataFrame(rows, SFT)
    got = {(min(r["eval_id"], r["train_id"]), max(r["eval_id"], r["train_id"])) for r in P1.overlap_pairs(df.withColumnRenamed("source", "key")).collect()}
    assert got == want and len(want) > 20
    counts = Counter(r["eval_id"] for r in P1.overlap_pairs(df).collect())
    assert {r["eval_id"]: r["pairs"] for r in P1.pair_counts(df).collect()} == counts
    assert P1.overlap_pairs(df.limit(0)).count() == 0 and P1.pair_counts(df.limit(0)).count() == 0


def test_records_on_both_sides_count_for_others_only(spark):
    rows = [(1, "train", "s", "f", "add 7 hens", None, None), (1, "test", "s", "f", "add 7 hens", "x", None), (2, "train", "s", "f", "add 7 hens", None, None), (3, "test", "s", "f", "add 7 hens", None, None), (4, "test", "s", "f", "other 9", None, None)]
    df = spark.createDataFrame(rows, SFT)
    assert {r["eval_id"]: r["pairs"] for r in P1.pair_counts(df).collect()} == {1: 1, 3: 2}


def test_hot_class_is_expanded_whole(spark):
    rows = [(i, "train" if i % 10 else "test", "s", "f", "Show that the sum is even", None, None) for i in range(300)]
    assert P1.overlap_pairs(spark.createDataFrame(rows, SFT)).count() == 270 * 30


def test_classes_are_expanded_in_blocks(spark):
    links = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "a bigint, b bigint")
    members = [(1, k) for k in range(50)] + [(2, 100 + k) for k in range(7)] + [(3, 200)]
    left, right = spark.createDataFrame(members, "a bigint, x bigint"), spark.createDataFrame(members, "b bigint, y bigint")
    want = {(a, b, x, y) for a, b in ((1, 2), (1, 3), (2, 3)) for c, x in members if c == a for d, y in members if d == b}
    for split in (3, 1000):
        got = [tuple(r) for r in expand(links, left, right, split).collect()]
        assert set(got) == want and len(got) == len(want)


def test_long_texts_of_few_words(spark):
    long = " ".join(f"w{'abc'[k % 3]}" for k in range(60_000))
    rows = [(1, "train", "s", "f", long, None, None), (2, "test", "s", "f", long + " wa wd", None, None), (3, "test", "s", "f", "wa wb wc", None, None)]
    assert [tuple(r) for r in P1.overlap_pairs(spark.createDataFrame(rows, SFT)).collect()] == [(2, 1)]


def pairs(documents, items):
    return {(r["doc_id"], r["item_id"]) for r in P2.containment(documents, items).collect()}


def test_leaks(spark):
    prompt = "A tank behind the dairy of Lorbury holds 33991 litres of maroon water and then some more of it"
    words = prompt.split()
    items = [(1, prompt), (2, "Compute 59819 + 2346 and then double it."), (3, None), (4, ""), (5, prompt)]
    docs = {
        10: "x " + prompt.upper() + " y", 11: "start " + " ".join(words[3:16]) + " end", 12: "start " + " ".join(words[3:15]) + " end", 13: "<p>" + "<br/>".join(words) + "</p>", 14: "&#32;".join(words), 15: "A tank be-\nhind the dai\u00ad\nry of Lor‐\nbury holds ３３９９１ litres of maroon water and",
        16: "compute 59819 2346, and then **double** it", 17: "compute 59819 2346 and then double", 18: None, 19: "", 20: "\u200b".join(["A tank", " behind the dairy of Lorbury holds 33991 litres of maroon water"]), 21: "[A](http://x.org/p) tank behind the dairy of Lorbury holds [33991](u) litres of maroon water",
    }
    d = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, prompt string")
    got = pairs(d.unionAll(d), i)
    assert got == {(k, n) for k in (10, 11, 13, 14, 15, 20, 21) for n in (1, 5)} | {(16, 2)}
    assert P2.containment(d, i.limit(0)).count() == 0 and P2.containment(d.limit(0), i).count() == 0


def test_leaks_between_comparison_signs(spark):
    plain = "the miller of Lorbury weighs nine sacks of barley and sells all but two of them at noon"
    signs = "Show that if a<b and the number of red hens in the yard is odd then c>d holds for all of them"
    items = [(1, plain), (2, signs), (3, "<p>Show <b class=x>how</b> many hens <input disabled> are left</p>")]
    docs = {
        1: f"As i<n here, {plain} -> so it ends", 2: f"if x<y\nthen {plain}\n> a quote", 3: f"<p>{signs}</p>", 4: signs.replace(" red ", " <i>red</i> "), 5: "Show that if a d holds for all of them",
        6: signs.replace("<", "&lt;").replace(">", "&gt;"), 7: f'<a href="x"\n title=\'{plain}\'>none</a>', 8: "Show how many hens are left", 9: "<p>Show how <i>many</i> hens are left</p>", 10: "Show that if a < b and the number of red hens in the yard is even",
    }
    d = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, prompt string")
    assert pairs(d, i) >= {(1, 1), (2, 1), (3, 2), (4, 2), (6, 2), (8, 3), (9, 3), (10, 2)}
    assert not {(5, 2)} & pairs(d, i)


def test_leaks_of_items_that_are_alike(spark):
    items = spark.createDataFrame([(k, f"find the rest of {k} apples") for k in range(7)], "item_id bigint, prompt string")
    docs = spark.createDataFrame([(k, f"say: find the rest of {k} apples!") for k in range(7)], "doc_id bigint, text string")
    assert pairs(docs, items) == {(k, k) for k in range(7)}


def test_long_items_and_documents(spark):
    text = " ".join(f"w{i}" for i in range(3000))
    docs = spark.createDataFrame([(1, "x " * 50000 + text[2000:9000]), (2, "y " * 60000)], "doc_id bigint, text string")
    assert pairs(docs, spark.createDataFrame([(9, text)], "item_id bigint, prompt string")) == {(1, 9)}


def test_each_hyphen_is_read_both_ways(spark):
    prompt = "the well known miller of Lorbury sells a half dozen sacks of very good barley to every neighbour at noon"
    docs = {
        1: "the well-\nknown mil-\nler of Lor-\nbury sells a half-\ndozen sacks of ve-\nry good barley", 2: prompt.replace("well known", "well-\nknown").replace("barley", "bar-\nley"),
        3: "x-\n" + prompt, 4: prompt.replace("very", "v-\ne-\nr-\ny").replace("half dozen", "half-\ndo-\nzen"), 5: "a well-\nknown mil-\nler", 6: "re-\n".join(prompt.split()[:12]),
    }
    d = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    assert pairs(d, spark.createDataFrame([(1, prompt)], "item_id bigint, prompt string")) == {(k, 1) for k in (1, 2, 3, 4)}


def test_unclosed_comments_take_linear_time():
    times = []
    for n in (20_000, 40_000):
        began = time.perf_counter()
        P2.readings("<!-- a <b " * n, lambda w: True)
        times.append(time.perf_counter() - began)
    assert times[1] < 5 * times[0] + 0.5
